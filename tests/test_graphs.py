"""Components kept up to date, solutions of linear systems, least sums, observed phases and repeats."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohmweave.operators import generate, graph, matrix, netlist
from ohmweave.plans import sweeps
from ohmweave.sources import netlist_text


def components(edges):
    root = {}

    def top(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {v: top(v) for v in list(root)}


def test_components_kept_up_to_date(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    df = lambda e: spark.createDataFrame(e, "a long, b long")
    known = spark.createDataFrame(list(components(edges[:90]).items()), "node long, component long")
    for new in (edges[90:], edges[90:] + [(7, 7), (1000, 1001), (None, 3)], edges[:5], [(1, 1)]):
        got = {r.node: r.component for r in graph.merged_components(known, df(new)).collect()}
        assert got == components(edges[:90] + [e for e in new if None not in e])
    assert {r.node: r.component for r in graph.merged_components(known, df(edges).limit(0)).collect()} == components(edges[:90])
    nothing = known.limit(0)
    assert {r.node: r.component for r in graph.merged_components(nothing, df(edges)).collect()} == components(edges)


def expm(a):
    out, term = np.eye(len(a)), np.eye(len(a))
    small = a / 64
    for k in range(1, 30):
        term = term @ small / k
        out = out + term
    return np.linalg.matrix_power(out, 64)


def test_solutions_of_linear_systems(spark):
    rng = np.random.default_rng(2)
    cells, starts, forces, want = [], [], [], {}
    for name, n in (("a", 3), ("b", 6), ("c", 1)):
        a = rng.standard_normal((n, n)) - 2 * np.eye(n)
        x, b = rng.standard_normal(n), rng.standard_normal(n)
        cells += [(name, i, j, float(a[i, j])) for i in range(n) for j in range(n)]
        starts += [(name, i, float(x[i])) for i in range(n)]
        forces += [(name, i, float(b[i])) for i in range(n)]
        e = expm(a * 0.7)
        want |= {(name, i): v for i, v in enumerate(e @ x + (e - np.eye(n)) @ np.linalg.solve(a, b))}
    m, x, b = (spark.createDataFrame(rows, f"k string, {names}") for rows, names in ((cells, "row long, col long, value double"), (starts, "idx long, value double"), (forces, "idx long, value double")))
    got = {(r.k, r.idx): r.value for r in matrix.ode_solution(m, x, b, 0.7, ["k"]).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-10) for k in want)
    plain = {r.idx: r.value for r in matrix.exponential_action(m.where("k = 'b'"), x.where("k = 'b'")).collect()}
    a = np.array([c[3] for c in cells if c[0] == "b"]).reshape(6, 6)
    assert np.allclose([plain[i] for i in range(6)], expm(a) @ [s[2] for s in starts if s[0] == "b"], atol=1e-10)
    assert matrix.exponential_action(m.limit(0), x, 1.0, ["k"]).count() == x.count()


def test_exponential_of_the_two_state_system(spark):
    a = spark.createDataFrame([(0, 0, -2.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, -1.0)], "row long, col long, value double")
    x, b = (spark.createDataFrame(v, "idx long, value double") for v in ([(0, 1.0), (1, 0.0)], [(0, 2.0), (1, 0.0)]))
    got = {r.idx: round(r.value, 7) for r in matrix.ode_solution(a, x, b).collect()}
    assert got == {0: 1.2133544, 1: 0.6993177}


@pytest.mark.parametrize("small", [False, True])
def test_terms_of_a_series_join_no_keys(spark, monkeypatch, small):
    """Packed products in parts, strips and values of any size; with them no term joins the matrix's keys."""
    if small:
        for name, x in (("PLACE", 3), ("CHUNK", 5), ("STRIP", 20)):
            monkeypatch.setattr(matrix, name, x)
    rng, seen, real = np.random.default_rng(5), [], matrix.times
    a = np.where(rng.random((40, 40)) < 0.15, rng.standard_normal((40, 40)) / 4, 0.0)
    a[:, 7], a[11] = 0.05, 0.02  # a hub's column and row
    start, force = rng.standard_normal(40), rng.standard_normal(40)
    monkeypatch.setattr(matrix, "times", lambda *x: seen.append(1) or real(*x))
    key = lambda i: f"n{i}"
    m = spark.createDataFrame([(key(i), key(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)] + [("n0", "gone", 5.0), ("n1", "n1", None)], "row string, col string, value double")
    x, b = (spark.createDataFrame([(key(i), float(z)) for i, z in enumerate(v) if i % 5 or k], "idx string, value double") for k, v in enumerate((start, force)))
    start[::5] = 0
    got = {r.idx: r.value for r in matrix.ode_solution(m, x, b, 0.5).collect()}
    e = expm(np.block([[a, force[:, None]], [np.zeros((1, 41))]]) * 0.5)
    want = e[:40, :40] @ start + e[:40, 40]
    assert len(got) == 40
    assert np.allclose([got[key(i)] for i in range(40)], want, atol=1e-9)
    assert not seen


@pytest.mark.parametrize("m", [1, 7, 40])
def test_least_sums_without_the_product(spark, m):
    rng = random.Random(m)
    axes = [[(k, rng.randrange(50) / 4) for k in ("x", "y") for _ in range(n)] + [("x", None)] for n in (30, 9, 21)]
    df = [spark.createDataFrame(a, "k string, value double") for a in axes]
    for used in (1, 2, 3):
        got = [(r.k, r.place, r.value) for r in matrix.least_sums(df[:used], ["k"], m).orderBy("k", "place").collect()]
        want = []
        for k in ("x", "y"):
            sums = sorted(sum(c) for c in itertools.product(*([v for key, v in a if key == k and v is not None] for a in axes[:used])))
            want += [(k, i + 1, s) for i, s in enumerate(sums[:m])]
        assert got == want
    assert "CartesianProduct" not in matrix.least_sums(df, ["k"], m)._jdf.queryExecution().toString()


def test_rows_in_blocks(spark):
    rng = random.Random(3)
    cells = {(0 if rng.random() < 0.6 else rng.randrange(20), rng.randrange(90)): float(rng.randrange(1, 9)) for _ in range(400)}
    e = spark.createDataFrame([(i, j, v) for (i, j), v in cells.items()], "row long, col long, value double")
    blocks = matrix.rows_of(e, block=8, most=50).collect()
    for row in {i for i, _ in cells}:
        mine = sorted((b for b in blocks if b.row == row), key=lambda b: b.block)
        assert [b.at for b in mine] == [8 * k for k in range(len(mine))]
        assert all(len(b.entries) == 8 for b in mine[:-1])
        whole = [(c.col, c.value) for b in mine for c in b.entries]
        assert whole == [(row, cells.get((row, row), 0.0))] + sorted((j, v) for (i, j), v in cells.items() if i == row and j != row)
    x = spark.createDataFrame([(j, j / 3) for j in range(90)], "idx long, value double")
    made = matrix.rows_of(e, block=8)
    key = lambda df: {r.idx: round(r.value, 9) for r in df.collect()}
    assert key(matrix.times_blocks(made, x)) == key(matrix.times(e, x))
    offsets = {r.row: (r.at, r.n) for r in matrix.row_offsets(made).collect()}
    at = 0
    for row in sorted(offsets):
        assert offsets[row] == (at, sum(len(b.entries) for b in blocks if b.row == row))
        at += offsets[row][1]


def test_phases_are_observed(spark):
    lines = ["title", "v1 s 0 6", "r1 s a 2", "r2 a s 2", "l1 a b 1", "c1 b 0 1", "r3 b 0 4"]
    parts = netlist_text.components(spark.createDataFrame([("x", i, t) for i, t in enumerate(lines)], "circuit string, line_no int, line string"))
    phases = []
    out = netlist.reduced(parts, phases=phases)
    assert [(p["phase"], p["r"], p["c"], p["i"], p["v"]) for p in phases] == [("merged_parallels", 2, 1, 0, 2), ("collapse_shorts", 2, 1, 0, 1), ("ground_capacitors", 2, 1, 0, 1), ("norton", 2, 1, 1, 0), ("fill_capacitors", 2, 1, 1, 0)]
    assert all(p["seconds"] > 0 for p in phases) and out.count() == 4


def test_runs_are_repeated_under_a_budget(spark):
    got = sweeps.repeated(lambda: spark.range(10).where(F.col("id") > 2), 60.0, 3)
    assert (got["runs"], got["rows"]) == (3, 7) and 0 < got["least"] <= got["mean"]
    assert sweeps.repeated(lambda: spark.range(5), 0.0001)["runs"] == 1


@pytest.mark.parametrize("ends", generate.ENDS)
def test_eigenvectors_of_every_kind_of_ends(spark, ends):
    for size in (1, 2, 5, 6):
        grid = spark.createDataFrame([(0, size, 1, 1)], "id int, nx int, ny int, nz int")
        a = np.zeros((size, size))
        for r in generate.laplacian(grid, ["id"], ends).collect():
            a[r.row, r.col] = r.value
        n, m, x = F.lit(size), F.col("m"), F.col("x")
        p = spark.range(size).select(F.col("id").alias("m")).crossJoin(spark.range(size).select(F.col("id").alias("x")))
        v, w = np.zeros((size, size)), np.zeros(size)
        for r in p.select("m", "x", generate.eigenvector_1d(n, m, x, ends).alias("v"), generate.eigenvalue_1d(n, m, ends).alias("l")).collect():
            v[r.x, r.m], w[r.m] = r.v, r.l
        assert np.allclose(v.T @ v, np.eye(size)) and np.allclose(a @ v, v * w)
