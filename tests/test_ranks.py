"""Ranks, neighbours and interpolation of keys that are cut into ranges, against the same in one window."""

import random

import pytest
from pyspark.sql import functions as F

from ohmweave.operators import metrics, ranks


@pytest.fixture(autouse=True)
def small_ranges(spark):
    """Ranges as small as these tables: else Spark joins them into one."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def series(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(("hot", "hot", "hot", "cold", None)), k, float(t), rng.choice((None, rng.random()))) for k, t in enumerate(rng.sample(range(10 * n), n))]
    return spark.createDataFrame(rows, "k string, id long, t double, value double").repartition(5)


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_ranks(spark):
    df = series(spark)
    same(ranks.ranked(df, ["k"], ["t"], most=100), ranks.ranked(df, ["k"], ["t"]))
    assert ranks.crowded(df, ["k"], 100) and not ranks.crowded(df, ["k"])
    assert ranks.in_ranges(df, ["k"], ["t"]).where("k = 'hot'").select("_part").distinct().count() > 1
    assert ranks.ranked(df.limit(0), ["k"], ["t"]).count() == 0


def test_neighbours_cross_borders(spark):
    df = series(spark)
    ask = ({"p": F.col("value"), "q": F.struct("value")}, {"n": F.col("value")})
    same(ranks.carried(df, ["k"], ["t"], *ask, most=100), ranks.carried(df, ["k"], ["t"], *ask))
    rare = df.withColumn("value", F.when(F.col("id") % 700 == 0, F.col("id") * 1.0))  # whole ranges without a value
    same(ranks.carried(rare, ["k"], ["t"], *ask, most=100), ranks.carried(rare, ["k"], ["t"], *ask))


def test_series_of_one_key(spark):
    df = series(spark).where("value is not null").withColumn("k", F.lit("all"))
    grid = spark.range(-5, 3100).select(F.lit("all").alias("k"), (F.col("id") * 10.0).alias("t"))
    digits = lambda x: x.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in x.dtypes))
    same(digits(metrics.interpolated(grid, df, ["k"], most=100)), digits(metrics.interpolated(grid, df, ["k"])))
    same(digits(metrics.time_weights(df, ["k"], most=100)), digits(metrics.time_weights(df, ["k"])))
    same(metrics.with_previous(df, ["k"], "id", most=100), metrics.with_previous(df, ["k"], "id"))
