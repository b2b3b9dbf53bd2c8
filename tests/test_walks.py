import numpy as np
import pytest
from pyspark.sql import functions as F

from ohmweave.operators import generate, matrix, stepper, walk
from ohmweave.plans import commands

SIZE = 8


@pytest.fixture(scope="module")
def chain(spark):
    grid = spark.createDataFrame([(SIZE, 1, 1)], "nx int, ny int, nz int")
    return generate.laplacian(grid, []).withColumn("value", -F.col("value"))


def samples(spark, n, start=0, parts=4):
    return spark.range(0, n, 1, parts).select(F.lit(start).cast("long").alias("start"), F.col("id").alias("sample"))


@pytest.mark.parametrize(("shape", "want"), [((8, 1, 1), 0.215269), ((16, 16, 1), 0.0463409), ((8, 8, 8), 0.00997577)])
def test_first_entries_of_exponentials(spark, shape, want):
    grid = spark.createDataFrame([shape], "nx int, ny int, nz int")
    first = F.lit(1.0)
    for n, m in (("nx", "i"), ("ny", "j"), ("nz", "k")):
        first = first * F.when(F.col(n) > 1, F.pow(generate.eigenvector_1d(F.col(n), F.col(m), F.lit(0)), 2)).otherwise(1.0)
    got = generate.eigenvalues(grid.withColumn("id", F.lit(1)), ["id"]).join(grid.withColumn("id", F.lit(1)), "id").agg(F.sum(first * F.exp(-F.col("value")))).first()[0]
    assert abs(got - want) < 1e-5


def test_estimates_do_not_depend_on_partitions(spark, chain):
    a, b = (commands.exp_entry(samples(spark, 4000, parts=p), chain, SIZE, 0, steps=16, seed=3).first() for p in (1, 7))
    assert (a.n, round(a.mean, 12)) == (b.n, round(b.mean, 12))
    assert abs(a.mean - 0.215269) < 5 * a.error + 0.005
    assert commands.exp_entry(samples(spark, 100), chain, SIZE, 0, expected=0.215269).columns[-1] == "error_percent"


def test_new_holding_rates_are_unbiased(spark):
    a = [[-3.0, 2.0, 0.5], [0.2, -1.0, 0.3], [4.0, 1.0, -6.0]]
    x0 = np.array([1.0, 2.0, 0.5])
    w, v = np.linalg.eig(np.array(a))
    exact = (v @ np.diag(np.exp(w)) @ np.linalg.inv(v) @ x0).real[0]
    cells = spark.createDataFrame([(i, j, a[i][j]) for i in range(3) for j in range(3)], "row long, col long, value double")
    c = walk.Chain.of(cells, 3)
    got = {h: walk.point(samples(spark, 40_000), c, x0, None, 1.0, 32, 5, holding=h).first() for h in ("next", "previous")}
    assert abs(got["next"].mean - exact) < 5 * got["next"].error + 0.003
    assert abs(got["previous"].mean - exact) > abs(got["next"].mean - exact)


def test_forcing_and_sequences_agree(spark, chain):
    x0 = np.arange(SIZE) / 4
    end = commands.solve(samples(spark, 20_000), chain, SIZE, 1.0, 32, x0, lambda s, t: 1.0 + 0 * s, seed=9).first()
    states = spark.range(SIZE).select(F.col("id").alias("state"), (F.col("id") / 4).alias("value"))
    forcing = states.select("state", F.lit(1.0).alias("value"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("lag"))
    seq = {r.j: r.value for r in commands.solve_sequence(samples(spark, 20_000), chain, SIZE, states, forcing, 1.0, 32, 8, seed=9).collect()}
    assert seq[0] == 0.0
    assert sorted(seq) == list(range(9))
    assert abs(seq[8] - end.mean) < 0.01


def test_conditions(spark, chain):
    c = walk.Chain.of(chain, SIZE)
    with pytest.raises(ValueError, match="even"):
        walk.point(samples(spark, 10), c, np.ones(SIZE), None, 1.0, 3)
    with pytest.raises(ValueError, match="divide"):
        walk.visits(samples(spark, 10), c, 1.0, 10, 4)
    with pytest.raises(ValueError, match="negative"):
        walk.Chain.of(chain.withColumn("value", -F.col("value")), SIZE)


def test_matrix_lookups_and_bounds(spark, chain):
    assert matrix.entry(chain, 0, 1).first()[0] == 1.0
    with pytest.raises(Exception, match="no entry"):
        matrix.entry(chain, 0, 5).collect()
    with pytest.raises(Exception, match="bounds"):
        matrix.checked(chain, 4, 4).collect()
    rows = {r.row: [(e.col, e.value) for e in r.entries] for r in matrix.rows_of(chain).collect()}
    assert rows[3] == [(3, -2.0), (2, 1.0), (4, 1.0)]


@pytest.mark.parametrize(("ends", "corner", "total"), [("DD", 2.0, 2.0), ("NN", 1.0, 0.0), ("DN", 2.0, 1.0), ("P", 2.0, 0.0)])
def test_boundary_conditions(spark, ends, corner, total):
    m = generate.laplacian(spark.createDataFrame([(5, 1, 1)], "nx int, ny int, nz int"), [], ends)
    assert m.where("row = 0 and col = 0").first().value == corner
    assert m.agg(F.sum("value")).first()[0] == total


def test_conjugate_gradients_solve_as_tables(spark, chain):
    g = chain.withColumn("value", -F.col("value"))
    b = spark.range(SIZE).select(F.col("id").alias("idx"), (F.col("id") + 1.0).alias("value"))
    x = stepper.conjugate_gradients(g, b)
    assert matrix.residual(g, x, b).first().residual < 1e-9
    assert {r.value for r in stepper.conjugate_gradients(g, b.withColumn("value", F.lit(0.0))).collect()} == {0.0}
