"""Near-duplicate vectors against all pairs compared in numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohmweave.llm import vector_dedup as vd

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, least=0.93):
    ok = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: [] for k in range(len(rows))}
    for a in ok:
        for b in ok:
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y):
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[a].append(b)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[s][0] for s in seen if rows[s][0] is not None]
        root = min(ids) if ids else None
        out.append((rows[k][0], len(links[k]), root, root is not None and rows[k][0] == root))
    return sorted(out, key=str)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def groups(n, size, seed):
    """Vectors in chains and groups around the least cosine, and others."""
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        at = rng.standard_normal(size)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), (at * rng.uniform(0.5, 2)).tolist(), int(rng.integers(0, 2))))
            at = at / np.linalg.norm(at) + rng.standard_normal(size) * rng.choice((0.01, 0.3, 0.38, 0.42)) / np.sqrt(size)
    return rows


@pytest.mark.parametrize("block", [8, 2048])
def test_matches_all_pairs(spark, block):
    rows = groups(260, 24, 4)
    rng = np.random.default_rng(1)
    hub = rng.standard_normal(24)
    rows += [(1000 + k, (hub + 0.2 * rng.standard_normal(24)).tolist(), 1) for k in range(60)]  # one large group
    rows += [(2000 + k, hub.tolist(), 1) for k in range(20)]  # copies of one vector in it
    assert plain(vd.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block)) == brute(rows)


def test_edge_rows(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v, 1), (1, v, 1), (2, [2.0, 4.0, 6.0, 8.0], 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0] * 4, 1), (8, [None] + v[1:], 1), (9, [float("nan")] + v[1:], 1), (10, [float("inf")] + v[1:], 1), (11, v[:3], 1)]
    rows += [(None, v, 1), (None, [-x for x in v], 1), (12, [1e300, 2e300, 3e300, 4e300], 1), (13, [1e-310, 2e-310, 3e-310, 4e-310], 1), (None, None, None), (14, [0.0, -0.0, 1.0, 0.0], 3), (15, [0.0, 0.0, 1.0, 0.0], 3)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", node string, component int")
    assert plain(vd.near_duplicates(df)) == brute(rows)
    assert vd.near_duplicates(df.limit(0)).count() == 0


def test_a_large_component_is_not_paired_with_itself(spark):
    rows = [(f"b{k % 2}", k, 0 if k % 10 else k) for k in range(400)]
    df = spark.createDataFrame(rows, "bucket string, node long, root long")
    by = df.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.sum("n").alias("count"), F.max("n").alias("most"), F.max_by("root", "n").alias("main"))
    sizes = by.select("bucket", "count", "main", (F.col("count") - F.col("most")).alias("others"))
    out = vd.in_blocks(df, sizes, "bucket", "node", 16).collect()
    met, cells = set(), {}
    for r in out:
        cells.setdefault((r.bucket, r.i, r.j), []).append(r)
    for (_, i, j), rows_ in cells.items():
        left, right = [r for r in rows_ if r.left], [r for r in rows_ if not r.left or i == j]
        met |= {frozenset((a.node, b.node)) for a in left for b in right if a.node != b.node}
    root = {n: (b, r) for b, n, r in rows}
    want = {frozenset((a, b)) for a in root for b in root if a < b and root[a][0] == root[b][0] and root[a][1] != root[b][1]}
    assert want <= met
    assert max(map(len, cells.values())) <= 3 * 16 * 2
    assert len(out) < 400 * 12


def test_two_close_signs_of_all_tables_miss_rarely():
    rng = random.Random(2)
    x = np.array([[rng.gauss(0, 1) for _ in range(64)] for _ in range(2000)])
    x = vd.unit(x)
    y = np.array([[rng.gauss(0, 1) for _ in range(64)] for _ in range(2000)])
    y = vd.unit(y - (y * x).sum(axis=1, keepdims=True) * x)
    z = 0.93 * x + np.sqrt(1 - 0.93**2) * y  # exactly at the least cosine
    w = vd.planes(64, vd.TABLES * vd.BITS + 128, vd.SEED)
    a, b = x @ w >= 0, z @ w >= 0
    keys = (a == b)[:, : vd.TABLES * vd.BITS].reshape(2000, vd.TABLES, vd.BITS).all(axis=2)
    assert keys.any(axis=1).mean() >= 0.999
    assert ((a != b)[:, vd.TABLES * vd.BITS :].sum(axis=1) <= vd.SKETCH_BITS).all()
