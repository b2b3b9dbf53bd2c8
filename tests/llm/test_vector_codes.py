"""Product codes against plain integer k-means, and the transform against its definition."""

import hashlib
import math
import random

import numpy as np

from ohmweave.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    width = -(-size // 4)
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(4)]
    parts = [cut(v) for _, v, _ in kept]
    books = [[list(parts[k][p]) for k in range(min(256, len(parts)))] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((far(x, e), k) for k, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            mine = {}
            for row in parts:
                mine.setdefault(near(row[p], books[p])[1], []).append(row[p])
            for k, got in mine.items():
                books[p][k] = [sum(c) // len(got) for c in zip(*got, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for (i, _, lab), row in zip(kept, parts, strict=True):
        found = [near(row[p], books[p]) for p in range(4)]
        out.append([i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab, sha])
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return sorted((str(i), code, e, total[lab], sha) for i, code, e, lab, sha in out)


def plain(df):
    return sorted((str(r[0]), *tuple(r)[1:]) for r in df.collect())


def made(n, size, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(size)], rng.choice((1, 2, None))) for i in range(n)]


def test_matches_plain_k_means(spark):
    rows = made(400, 12, 1)
    assert plain(vc.compress(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_lengths_that_need_padding(spark):
    for size in (1, 6, 21):
        rows = made(300, size, size)
        assert plain(vc.compress(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(30, 8, 2) + [(3, [0.5] * 8, 1), (3, [0.5] * 8, 1), (None, [0.25] * 8, 2), (40, None, 1), (41, [], 1), (42, [None] * 8, 1), (43, [nan] * 8, 1), (44, [1.0] * 7 + [inf], 1), (45, [1.0] * 7, 1), (46, [-0.0001] * 8, 5)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", code string, error int")
    assert plain(vc.compress(df)) == brute(rows)
    assert vc.compress(df.limit(0)).count() == 0
    assert vc.compress(df.where("vec_id in (40, 41, 42)")).count() == 0
    huge = vc.compress(spark.createDataFrame([(1, [1e300, -1e300, 0.0, 2.0], 1), (2, [1e300, -1e300, 0.0, 2.0], 1)], SCHEMA)).collect()
    assert [(r.code, r.error) for r in huge] == [("00000000", 0)] * 2


def test_transform_and_elimination_are_exact():
    rng = np.random.default_rng(0)
    for width in (1, 3, 8, 16, 30):
        a, b = rng.integers(-5000, 5000, (90, width)), rng.integers(-5000, 5000, (40, width))
        b[7] = b[3]  # a tie goes to the lower index
        d = ((a[:, None] - b[None]) ** 2).sum(axis=2)
        index, distance = vc.nearest(a, b)
        assert (index == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
        t = vc.transformed(a)
        assert (((t[:, None] - t[None]) ** 2).sum(axis=2) == t.shape[1] * ((a[:, None] - a[None]) ** 2).sum(axis=2)).all()
    changes = [(np.diff(row) != 0).sum() for row in vc.transformed(np.eye(16, dtype=np.int64)).T]
    assert changes == list(range(16))
    most = vc.largest(16)
    index, distance = vc.nearest(np.full((1, 16), most), np.array([np.full(16, -most)]))
    assert distance[0] == 16 * (2 * most) ** 2
