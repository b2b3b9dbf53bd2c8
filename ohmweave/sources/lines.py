"""Numbered lines of text files of any size: a file is read by as many tasks as it has splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import stored


def numbered_lines(spark: SparkSession, path: str, separator: str | None = None, keep: Column | None = None) -> DataFrame:
    """(file, line_no, line, lines), numbered from 0 in each file of so many lines; keep says of `value` which are there at all.

    Every line knows its split and its place in it. The number of lines of the splits before it is a sum over one small
    row a split, written once. Lines end at newlines of either kind, or at `separator`.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    raw = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"))
    raw = (raw if keep is None else raw.where(keep)).withColumn("_at", F.monotonically_increasing_id())
    splits = raw.groupBy("file", "_split").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    file = Window.partitionBy("file")
    before = F.coalesce(F.sum("_n").over(file.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(splits.select("file", "_split", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(file).alias("lines")), "splits")
    return raw.join(starts, ["file", "_split"]).select("file", (F.col("_at") + F.col("_shift")).alias("line_no"), F.col("value").alias("line"), "lines")
