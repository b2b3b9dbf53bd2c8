"""Near copies by exact five-word Jaccard similarity against all pairs compared in plain Python."""

import random

import numpy as np

from ohmweave.llm import jaccard, simhash
from ohmweave.llm.common import smaller_batches, table


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows, t=0.8):
    """The least id of each component of the pairs of similarity t or more. rows: (id, text)."""
    rows = sorted(rows)
    sets = [grams(x) for _, x in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            both = len(a & b)
            if 5 * both >= 4 * (len(a) + len(b) - both) if t == 0.8 else both >= t * (len(a) + len(b) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [rows[i][0] for i in range(len(rows)) if root(i) == i]


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect())


def zipf(rng, n, vocabulary=3000):
    return [f"w{min(vocabulary, int(rng.paretovariate(0.9)))}" for _ in range(n)]


def test_copies_with_an_added_or_cut_block_go(spark):
    rng, rows = random.Random(1), []
    for g in range(40):
        w = zipf(rng, (100, 400, 1500)[g % 3])
        n = len(w)
        at = rng.randrange(n)
        rows.append((10 * g, " ".join(w)))
        rows.append((10 * g + 1, " ".join(w[:at] + zipf(rng, n * 18 // 100) + w[at:])))
        rows.append((10 * g + 2, " ".join(w[n * 15 // 100 :])))
    want = brute_kept(rows)
    assert len(want) < 60
    assert kept(spark, rows) == want


def test_large_groups_of_edited_copies_match_brute_force(spark):
    rng, rows = random.Random(2), []
    for g in range(3):
        w = zipf(rng, 150)
        for k in range(150):
            x = list(w)
            for _ in range(rng.randint(0, 9)):
                x[rng.randrange(150)] = f"e{rng.random()}"
            rows.append((1000 * g + k, " ".join(x)))
    want = brute_kept(rows)
    assert 3 < len(want) < 400
    assert kept(spark, rows) == want


def test_documents_match_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert kept(spark, rows) == brute_kept(rows)


def test_heavily_edited_copies_make_few_pairs(spark):
    """Copies of one text with up to half of its words edited: few of their pairs are similar enough."""
    rng, rows = random.Random(3), []
    w = zipf(rng, 150)
    for k in range(400):
        x = list(w)
        for _ in range(rng.randint(0, 25)):
            x[rng.randrange(150)] = f"e{rng.random()}"
        rows.append((k, " ".join(x)))
    for k in range(60):  # copies of an edited copy
        x = rows[399][1].split()
        x[rng.randrange(150)] = f"e{rng.random()}"
        rows.append((1000 + k, " ".join(x)))
    want = brute_kept(rows)
    assert 50 < len(want) < 400
    assert kept(spark, rows) == want


def test_rows_of_one_id_repeated_rows_nulls_and_names(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, "a b c d e f", "x"), (3, "k l m n o p", "x"), (5, "a b c d e f", "y"), (5, "a text of its own", "y"), (5, "a text of its own", "x"), (6, None, "x"), (7, "", "x"), (None, "a b c d e f", "x"), (None, None, "z"), (8, long, "x"), (9, long + " more", "x"), (9, long, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumnRenamed("node", "a.b").selectExpr("*", "1 fp", "`a.b` key")
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    left = sorted(((r.doc_id is None, r.doc_id), (r.text or "")[:20], r["a.b"]) for r in out.collect())
    none = (True, None)
    assert left == sorted([((False, 1), "a b c d e f", "x"), ((False, 3), "k l m n o p", "x"), ((False, 5), "a text of its own", "x"), ((False, 6), "", "x"), ((False, 8), long[:20], "x"), (none, "a b c d e f", "x"), (none, "", "z")])
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_planted_near_copies_are_caught(spark):
    """Recall by ids over copies with words changed, added and cut at 0.8 or more: all of them go."""
    rng, rows, planted = random.Random(6), [], 0
    for g in range(150):
        w = zipf(rng, rng.choice([30, 120, 500]))
        x = list(w)
        for _ in range(max(1, len(w) // 60)):
            x[rng.randrange(len(x))] = f"e{rng.random()}"
        rows += [(10 * g, " ".join(w)), (10 * g + 1, " ".join(x))]
        a, b = grams(rows[-2][1]), grams(rows[-1][1])
        planted += len(a & b) >= 0.8 * len(a | b)
    left = set(kept(spark, rows))
    assert planted > 100
    assert sum(10 * g + 1 not in left for g in range(150)) == planted


def test_texts_below_the_similarity_stay(spark):
    rng, rows = random.Random(4), []
    vocabulary = [f"v{i}" for i in range(600)]
    for g in range(4):
        w = rng.choices(vocabulary, k=3000)
        x = list(w)
        for at in range(0, 3000, 60):
            x[at] = rng.choice(vocabulary)
        y = list(w)
        for at in range(0, 3000, 24):
            y[at] = rng.choice(vocabulary)
        rows += [(10 * g, " ".join(w)), (10 * g + 1, " ".join(x)), (10 * g + 2, " ".join(y))]
    want = brute_kept(rows)
    assert want == [i for g in range(4) for i in (10 * g, 10 * g + 2)]
    assert kept(spark, rows) == want


def no_differences(monkeypatch):
    def refuse(*_):
        raise AssertionError("members of a large bucket are told apart again")

    monkeypatch.setattr(jaccard, "difference_buckets", refuse)


def test_a_large_bucket_of_one_component_is_done(spark, monkeypatch):
    rng, w = random.Random(11), zipf(random.Random(12), 300)
    rows = []
    for k in range(60):
        x = list(w)
        x[rng.randrange(len(x))] = f"edit{k}"
        rows.append((k, " ".join(x)))
    no_differences(monkeypatch)
    assert kept(spark, rows) == brute_kept(rows) == [0]


def test_a_line_that_the_sample_misses_makes_no_large_bucket(spark):
    rng, line = random.Random(13), " ".join(f"line13x{i}" for i in range(16))
    texts = spark.createDataFrame([(" ".join(f"w{rng.randrange(10**6)}" for _ in range(150)) + " " + line,) for _ in range(60)], "text string")
    order = spark.sparkContext.broadcast(np.empty(0, np.uint64))
    largest = lambda common: jaccard.buckets(texts, 0.8, common).groupBy("key").count().agg({"count": "max"}).first()[0] or 0
    assert largest(order) == 60
    assert largest(spark.sparkContext.broadcast(jaccard.crowded(texts, 0.8, order))) <= jaccard.SMALL


def test_workers_get_batches_of_a_megabyte(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with smaller_batches(spark):
        assert int(spark.conf.get(key).rstrip("b")) <= 1 << 20
    assert spark.conf.get(key) == before


def test_bitmaps_differ_no_more_than_the_sets():
    rng = np.random.default_rng(14)
    for n in (1, 5, 64, 65, 300, 2000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for share in (0.0, 0.1, 0.5, 1.0):
            y = np.unique(np.r_[x[rng.random(len(x)) >= share], rng.integers(0, 1 << 63, int(n * share)).astype(np.uint64)])
            a, b = jaccard.bits_of(x), jaccard.bits_of(y)
            assert np.bitwise_count(jaccard.folded(a, len(b)) ^ jaccard.folded(b, len(a))).sum() <= len(np.setxor1d(x, y))
    assert len(jaccard.bits_of(np.empty(0, np.uint64))) == 4


def test_members_of_a_head_meet_whatever_their_blocks(spark, monkeypatch):
    """All pairs of different components that are similar enough are found in blocks of any size, the nearest of each node among them."""
    rng = np.random.default_rng(15)
    base, sets = rng.integers(0, 1 << 63, 200).astype(np.uint64), {}
    for k in range(60):
        own = rng.integers(0, 1 << 63, rng.integers(0, 30)).astype(np.uint64)
        sets[k] = np.unique(np.r_[base[rng.random(200) >= rng.random() / 6], own])
    root = {k: k % 7 for k in sets}
    similar = {(i, j) for i in sets for j in sets if i < j and root[i] != root[j] and 1.8 * len(np.intersect1d(sets[i], sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j])) - 1e-9}
    assert 100 < len(similar) < 1400
    members = spark.createDataFrame([(1, k) for k in sets], "a long, node long")
    roots = spark.createDataFrame(list(root.items()), "node long, component long")
    bitmaps = spark.createDataFrame([(k, len(x), bytearray(jaccard.bits_of(x).tobytes())) for k, x in sets.items()], "node long, n int, bits binary")
    for block in (1024, 9):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        got = lambda nearest: {tuple(r) for r in jaccard.near_members(members, bitmaps, roots, 0.8, nearest).collect()}  # noqa: E731, B023
        every, few = got(False), got(True)
        assert similar <= every
        assert all(root[a] != root[b] for a, b in every)
        assert few <= every
        assert {x for p in few for x in p} == {x for p in every for x in p}


def test_unlike_copies_of_one_text_are_told_apart_without_pairs(spark, monkeypatch):
    """Pairs that reach the join with the sets grow with the copies, not with their square."""
    rng, rows, seen, real = random.Random(16), [], [], jaccard.plausible
    w = zipf(rng, 300)
    for k in range(500):
        x = list(w)
        for _ in range(rng.randint(0, 12)):
            x[rng.randrange(300)] = f"e{rng.random()}"
        rows.append((k, " ".join(x)))

    def counted(pairs, *more):
        seen.append(pairs.count())
        return real(pairs, *more)

    monkeypatch.setattr(jaccard, "plausible", counted)
    want = brute_kept(rows)
    assert 100 < len(want) < 450
    assert kept(spark, rows) == want
    assert sum(seen) < 20 * len(rows), seen
