"""Packing: pieces against a plain tokenizer run, layouts against their definition."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ohmweave.llm import packing
from ohmweave.llm.common import table


@pytest.fixture(scope="module")
def ids_of():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts, ids_of, capacity=2048):
    """rows: the result; texts: (doc_id, text). Returns the number of sequences."""
    want = Counter()
    for doc, text in texts:
        ids = ids_of(text)
        first = len(ids) % capacity or min(len(ids), capacity)
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_documents(spark, sf_dir, ids_of):
    docs = table(spark, sf_dir, "documents")
    rows = packing.pack(docs.repartition(5)).collect()
    n = check(rows, [(r.doc_id, r.text) for r in docs.collect()], ids_of)
    assert n <= sum(r.length for r in rows) / 2048 * 1.02 + 1


SPECIAL = "<|endoftext|>"


@pytest.mark.parametrize("text", [SPECIAL, f"a{SPECIAL}b", f"{SPECIAL} a", f"a {SPECIAL}", SPECIAL * 3, f"a\n{SPECIAL}\n{SPECIAL}  b", "<|endoftext|", "<|endoftext |>", f"x<|{SPECIAL}|>", " " * 400_000 + "x" + SPECIAL + "\n" * 60_000, "y" * 100_000])
def test_ids_are_those_of_tokenizers(text, ids_of):
    assert [*packing.encoder("byte_bpe_50k")(text), 0] == ids_of(text)


def test_one_very_long_text_beside_many_short_ones(spark, ids_of):
    rows = [(i, f"short text {i}") for i in range(3_000)] + [(9_999, "a long text of many words " * 400_000)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "doc_id long, text string")
    got = packing.pack(df).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got if r[0] in (0, 9_999)} == {i: len(ids_of(t)) for i, t in rows if i in (0, 9_999)}
    assert len(got) == len(rows)


def test_workers_get_batches_of_a_megabyte(spark, monkeypatch, ids_of):
    key, seen, real = "spark.sql.execution.arrow.maxBytesPerBatch", [], packing.stored
    before = spark.conf.get(key)
    monkeypatch.setattr(packing, "stored", lambda df, what: seen.append(spark.conf.get(key)) or real(df, what))
    rows = [(i, "some words " * 300 * (i % 7)) for i in range(400)]
    check(packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows, ids_of)
    assert [int(x.rstrip("b")) <= 1 << 20 for x in seen] == [True]
    assert spark.conf.get(key) == before


def test_edge_rows(spark, ids_of):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (5, "<|endoftext|> é\x00 \n\t  z"), (6, " ".join(f"w{i}" for i in range(9_000)))]
    df = spark.createDataFrame([(i, t, 7, 1) for i, t in rows], "doc_id long, text string, length int, task int")
    check(packing.pack(df).collect(), rows, ids_of)
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 3, 2047, 2048, 2049, 4096, 5000])
def test_cuts(n):
    cut = packing.cuts(n, 2048)
    assert cut[0][0] == 0
    assert sum(x for _, x in cut) == n
    assert all(x == 2048 for _, x in cut[1:])


def test_plan_uses_the_histogram_up():
    rng = random.Random(9)
    for k in range(25):
        capacity = rng.choice([7, 32, 200])
        histogram = {x: rng.randint(1, 30) for x in rng.sample(range(1, capacity + 1), rng.randint(1, min(40, capacity)))}
        steps = packing.plan(histogram, capacity)
        used = Counter()
        for lengths, n in steps:
            assert n > 0
            assert sum(lengths) <= capacity
            for x in lengths:
                used[x] += n
        assert used == histogram
    assert packing.plan({}) == []


def test_exact_combinations_of_one_to_three_complements():
    steps = packing.plan({10: 2, 7: 2, 3: 1, 2: 1, 1: 1, 4: 1, 5: 1}, 10)
    assert Counter(dict(steps))[(10,)] == 2
    assert sum(n for _, n in steps) == -(-sum(k * n for k, n in {10: 2, 7: 2, 3: 1, 2: 1, 1: 1, 4: 1, 5: 1}.items()) // 10)
    assert packing.plan({4: 1, 3: 1, 2: 1, 1: 1}, 10) == [((4, 3, 2, 1), 1)]
