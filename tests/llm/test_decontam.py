"""Containment search against sets of shingles compared in plain Python."""

import random
import re

from ohmweave.llm import decontam
from ohmweave.llm.common import table


def grams(text, width):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(docs, items, threshold=0.8):
    out = set()
    for item, text in items:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        mine = grams(text, min(5, len(w))) if w else set()
        for doc, body in docs:
            n = len(mine & grams(body, min(5, len(w)) or 1))
            if mine and n >= threshold * len(mine) - 1e-9:
                out.add((doc, item, len(mine), n))
    return out


def found(df):
    return {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in df.collect()}


def test_matches_brute_force(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    got = found(decontam.contained_items(docs, items))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_threshold_is_exact_around_edits(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 70)))) for i in range(25)]
    docs = []
    for d in range(120):
        w = items[d % 25][1].split()
        for _ in range(d // 25):
            w[rng.randrange(len(w))] = word()
        docs.append((d, " ".join(word() for _ in range(300)) + " " + " ".join(w).upper() + ", " + word()))
    got = found(decontam.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    want = brute(docs, items)
    assert got == want
    assert 25 <= len(want) < 120


def test_edge_rows(spark):
    items = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, "..."), (4, "Short item"), (None, "a b c d e")]
    long = " ".join(f"w{i}" for i in range(30_000)) + " one two three four five six"
    docs = [(1, None), (2, ""), (3, long), (4, "x short-ITEM y"), (5, "a b c d e"), (5, "a b c d e"), (None, "one two three four five six seven")]
    d = spark.createDataFrame([(i, t, 0, "s", 1) for i, t in docs], "doc_id long, text string, hash int, shingle string, item_id int")
    i = spark.createDataFrame([(k, t, "d") for k, t in items], "item_id long, text string, doc_id string")
    assert found(decontam.contained_items(d, i)) == {(3, 1, 2, 2), (None, 1, 2, 2), (4, 4, 1, 1), (5, None, 1, 1)}
    assert decontam.contained_items(d.limit(0), i).count() == 0
    assert decontam.contained_items(d, i.limit(0)).count() == 0
    left = decontam.drop_contaminated(d, i)
    assert left.columns == d.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 2]


def test_a_shared_opening_makes_no_candidates(spark):
    rng = random.Random(8)
    opening = "the question is as follows read the text and choose one answer from the list below"
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(i, opening + " " + " ".join(word() for _ in range(40))) for i in range(60)]
    docs = [(d, opening + " " + " ".join(word() for _ in range(100))) for d in range(90)] + [(100 + k, "x " + items[k][1]) for k in range(9)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(decontam.contained_items(d, i)) == brute(docs, items)
    grams = decontam.item_shingles(i, 5, "item_id", "text")
    assert decontam.candidate_pairs(d, grams, 0.8).count() <= 10 * 9


def test_ties_and_mixed_items(spark):
    items = [(1, "a b c"), (1, "d e f g h i j k l m"), (2, "a b c"), (3, "a b c a b c a b c a b c")]
    docs = [(1, "a b c"), (2, "a b c x d e f g h i j k l m"), (3, "a b c a b c a b c a b c"), (4, "z a b c d e f g h i j k")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = found(decontam.contained_items(d, i))
    assert (2, 1, 7, 7) in got
    assert {(x, 2, 1, 1) for x in (1, 2, 3, 4)} <= got
    assert (3, 3, 3, 3) in got
