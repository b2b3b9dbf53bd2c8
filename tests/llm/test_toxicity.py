"""Toxicity scores on planted words and on held-out labels."""

import random

import numpy as np

from ohmweave.llm import toxicity
from ohmweave.llm.common import table


def planted(n, seed, words=("vrok", "zlim", "quask")):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(n):
        bad = rng.random() < 0.15
        t = rng.choices(common, k=rng.randint(20, 120))
        if bad:
            for _ in range(rng.randint(1, 3)):
                t.insert(rng.randrange(len(t)), rng.choice(words))
        rows.append((" ".join(t), bad))
    return rows


def test_finds_planted_words():
    rows = planted(3000, 1)
    rng = random.Random(2)
    positive = [t for t, bad in rows if bad and rng.random() < 0.4] + [t for t, bad in rows if not bad][:10]  # some labels are wrong
    model = toxicity.fit(positive, [t for t, _ in rows], 0.15)
    assert {"vrok", "zlim", "quask"} <= set(model.weight)
    held = planted(500, 3)
    got = [(model.score(t) >= 0.7, bad) for t, bad in held]
    assert np.mean([g for g, bad in got if bad]) > 0.95
    assert np.mean([g for g, bad in got if not bad]) < 0.05
    assert 0 <= model.score(None) == model.score("") < 0.5


def test_a_repeated_text_makes_no_marks():
    rows = [t for t, _ in planted(1000, 4, words=("w1",))]
    odd = "strange words that only this one text has"
    model = toxicity.fit([f"{odd} {i}" for i in range(60)] + rows[:40], rows, 0.1)
    assert not set(odd.split()) & set(model.weight)


def test_held_out_labels(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels.where("toxic is not null"), "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    s, y = got.score.to_numpy(), got.toxic.to_numpy()
    auc = (s[y == 1][:, None] > s[y == 0]).mean() + (s[y == 1][:, None] == s[y == 0]).mean() / 2
    assert auc > 0.9
    assert got.toxic[got.predicted == 1].mean() > 0.8
    assert ((s >= 0.7) == got.predicted).all()


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1, 5), (2, "", 0.1, 5), (3, "vrok " * 50_000, 0.1, 5), (3, "same", 0.1, 5), (None, "w1", 0.1, 5)], "doc_id long, text string, score double, toxic int")
    labels = spark.createDataFrame([(3, 1, 1), (3, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 5
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert toxicity.toxicity(docs, labels.limit(0)).count() == 5
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_the_query_matches_plain_python(spark, sf_dir):
    import math
    import re
    import zlib

    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    for d in docs.select("doc_id", "text").collect():
        words = {w for w in re.split(r"[\W_]+", (d.text or "").lower()) if w}
        want = 1 / (1 + math.exp(-(model.bias + sum(v for w, v in model.weight.items() if w in words))))
        r = rows[d.doc_id]
        assert abs(r.score - want) < 1e-9
        assert (r.predicted, r.held_out) == (int(want >= 0.7), zlib.crc32(str(d.doc_id).encode()) % 3 == 1)
