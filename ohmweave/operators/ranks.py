"""Ranks, neighbours and as-of values along an order, for keys of any size.

A window over a key puts all of its rows into one task. Here that is done only while no key holds many rows. Otherwise the
rows are dealt out by ranges of (key, order), whatever the key; each range is worked on by itself, and what must cross a
border (a count, the last or first value) goes through a table of one row for each key and range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import broadcast_if_small, join_split, stored

#: Rows that a key may hold, and its share of all rows, before it is cut into ranges.
MOST, PARTS = 100_000, 1_000


def crowded(rows: DataFrame, by: Sequence[str], most: int = MOST) -> bool:
    """Whether a key holds so many rows that it has to be cut."""
    sizes = rows.groupBy(*by).count().agg(F.max("count"), F.sum("count")).first()
    return (sizes[0] or 0) > max(most, (sizes[1] or 0) // PARTS)


def in_ranges(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows in ranges of (by, order), with the range's number, _part, and their place, _at."""
    # ids of Spark's running numbers carry the partition in their upper bits; a written table keeps them as they are
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    return stored(dealt.withColumn("_part", F.shiftright("_at", 33).cast("int")), "ranges")


def met_by(rows: DataFrame, told: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """rows joined with the other columns of told on columns of the same names, null equal to null."""
    named = told.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), *(c for c in told.columns if c not in by))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(named, same, how).drop(*(f"_k{i}" for i in range(len(by))))


def on_borders(rows: DataFrame, borders: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with the columns that borders has for their key and range; null keys are keys too."""
    return met_by(rows, broadcast_if_small(borders), [*by, "_part"], "left")


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rank", most: int = MOST) -> DataFrame:
    """rows with their place, from 1, among the rows of their key; order should tell a key's rows apart."""
    if not crowded(rows, by, most):
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    parts = in_ranges(rows, by, order)
    sizes = parts.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = on_borders(parts, sizes.withColumn("_before", before).drop("_n"), by)
    return placed.withColumn(name, F.col("_at") - F.col("_first") + 1 + F.col("_before")).select(*rows.columns, name)


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str, most: int = MOST) -> DataFrame:
    """rows with the sum of `value` over the rows before them in their key; without `by` all rows are one key."""
    frame = lambda *key: Window.partitionBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    keyed = rows if by else rows.withColumn("_all", F.lit(0))
    key = [*by] or ["_all"]
    if not crowded(keyed, key, most):
        return keyed.withColumn(name, F.coalesce(F.sum(value).over(frame(*key).orderBy(*order)), F.lit(0))).select(*rows.columns, name)
    parts = in_ranges(keyed, key, order)
    sums = parts.groupBy(*key, "_part").agg(F.sum(value).alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(frame(*key).orderBy("_part")), F.lit(0))).drop("_n")
    inside = parts.withColumn("_inside", F.coalesce(F.sum(value).over(frame(*key, "_part").orderBy(*order)), F.lit(0)))
    return on_borders(inside, before, key).withColumn(name, F.col("_inside") + F.col("_before")).select(*rows.columns, name)


def carried(rows: DataFrame, by: Sequence[str], order: Sequence[str], before: dict[str, Column], after: dict[str, Column], most: int = MOST, cut: bool | None = None) -> DataFrame:
    """rows with the nearest earlier (before) and later (after) value that isn't null of each column expression, not counting the row itself.

    A value that may itself be null must be wrapped in a struct to be told from no value. cut: what crowded says, if known.
    """
    parts = in_ranges(rows, by, order) if (crowded(rows, by, most) if cut is None else cut) else None
    key = [*by] if parts is None else [*by, "_part"]
    window = lambda down: Window.partitionBy(*key).orderBy(*((F.col(c).desc() if down else F.col(c)) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    asked = [(name, c, False) for name, c in before.items()] + [(name, c, True) for name, c in after.items()]
    # frames only grow, in either direction, so a range is read once for each
    seen = (rows if parts is None else parts).select("*", *(F.last(c, ignorenulls=True).over(window(down)).alias(name) for name, c, down in asked))
    if parts is None:
        return seen
    at = F.struct(*order)
    outer = [(F.min_by if down else F.max_by)(c, F.when(c.isNotNull(), at)).alias(f"_o_{name}") for name, c, down in asked]
    borders = parts.groupBy(*by, "_part").agg(*outer)
    across = lambda down: Window.partitionBy(*by).orderBy(F.col("_part").desc() if down else F.col("_part")).rowsBetween(Window.unboundedPreceding, -1)
    borders = borders.select(*by, "_part", *(F.last(f"_o_{name}", ignorenulls=True).over(across(down)).alias(f"_c_{name}") for name, _, down in asked))
    met = on_borders(seen, borders, by)
    return met.select(*rows.columns, *(F.coalesce(name, f"_c_{name}").alias(name) for name, _, _ in asked))


def with_totals(rows: DataFrame, by: Sequence[str], totals: dict[str, Column], cut: bool) -> DataFrame:
    """rows with aggregates of their whole key, which no task gathers if it is to be cut (see crowded)."""
    if not cut:
        return rows.select("*", *(c.over(Window.partitionBy(*by)).alias(name) for name, c in totals.items()))
    told = rows.groupBy(*by).agg(*(c.alias(name) for name, c in totals.items()))
    return join_split(rows.withColumn("_key", F.struct(*by)), told.select(F.struct(*by).alias("_key"), *totals), "_key", "left").drop("_key")
