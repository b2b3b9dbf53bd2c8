"""Matrix and vector text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import numbered_lines
from .store import broadcast_if_small, stored

BLOCK = 1_000_000


def _number(text: Column, what: str) -> Column:
    got = F.trim(text).try_cast("double")
    return F.when(got.isNull(), F.raise_error(F.concat(F.lit(f"bad {what}: "), F.coalesce(text, F.lit("nothing")))).cast("double")).otherwise(got)


def read_coo(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, cols, row, col, value), from 0: header `rows,cols,nnz`, then `row,col,value` from 1.

    A bad number, an index out of bounds or a count that isn't the header's fails the job.
    """
    part = F.split("line", ",")
    lines = numbered_lines(spark, path, keep=F.col("value") != "")
    told = lines.where("line_no = 0").select("file", (F.col("lines") - 1).alias("found"), *(_number(part[i], "header").cast("long").alias(k) for i, k in enumerate(("rows", "cols", "nnz"))))
    fits = F.when(F.col("found") == F.col("nnz"), F.col("rows")).otherwise(F.raise_error(F.lit("entries do not match the header")).cast("long"))
    heads = stored(told.select("file", fits.alias("rows"), "cols"), "heads")
    body = lines.where("line_no > 0").select("file", *(_number(part[i], "entry").alias(k) for i, k in enumerate(("row", "col", "value"))))
    inside = F.col("row").between(1, F.col("rows")) & F.col("col").between(1, F.col("cols"))
    return body.join(heads, "file").select("file", "rows", "cols", (F.col("row") - 1).cast("long").alias("row"), (F.col("col") - 1).cast("long").alias("col"), F.when(inside, F.col("value")).otherwise(F.raise_error(F.lit("matrix index out of bounds")).cast("double")).alias("value"))


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, col, value): first line n, then n comma rows; zeros are dropped but on the diagonal. A line is one row of work.

    A bad number, a row of more than n values or more than n rows fail the job.
    """
    lines = numbered_lines(spark, path, keep=F.trim("value") != "")
    sizes = stored(lines.where("line_no = 0").select("file", _number(F.col("line"), "size").alias("n")), "sizes")
    rows = lines.where("line_no > 0").join(sizes, "file").select("file", "n", (F.col("line_no") - 1).alias("row"), F.posexplode(F.split("line", ",")).alias("col", "text"))
    inside = (F.col("col") < F.col("n")) & (F.col("row") < F.col("n"))
    value = F.when(inside, _number(F.col("text"), "entry")).otherwise(F.raise_error(F.lit("row too long")).cast("double"))
    return rows.select("file", "row", F.col("col").cast("long").alias("col"), value.alias("value")).where("value <> 0 or row = col")


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, value): first line the length, second the numbers; a length that doesn't match fails the job.

    Numbers are what stands between commas, so that the one long line of a large vector is split among tasks too.
    """
    parts = numbered_lines(spark, path, ",", keep=F.trim(F.regexp_replace("value", r"[\r\n]", "")) != "")
    first = F.col("line_no") == 0
    heads = parts.where(first).select("file", "lines", F.split("line", r"\r?\n").alias("l"))
    heads = heads.select("file", "lines", _number(F.get("l", F.lit(0)), "length").alias("n"), F.trim(F.coalesce(F.get("l", F.lit(1)), F.lit(""))).alias("text"))
    told = heads.select("file", "n", (F.col("lines") - (F.col("text") == "").cast("int")).alias("found"), (F.col("text") == "").alias("empty"))
    same = F.when(F.col("n") == F.col("found"), F.col("n")).otherwise(F.raise_error(F.lit("vector length does not match")).cast("double"))
    told = stored(told.select("file", same.alias("n"), "empty"), "lengths")
    numbers = parts.withColumn("text", F.when(first, F.get(F.split("line", r"\r?\n"), F.lit(1))).otherwise(F.col("line"))).join(told, "file")
    numbers = numbers.where(~first | ~F.col("empty")).where("n >= 0")
    return numbers.select("file", F.col("line_no").alias("idx"), _number(F.regexp_replace("text", r"[\r\n]", ""), "number").alias("value"))


def write_vectors(values: DataFrame, path: str) -> None:
    """values (name, idx, value), idx from 0 without gaps: a file for each name below its folder; its numbers are never one value.

    A name's numbers are one file's, so they pass through one task, in order and as a stream.
    """
    sizes = values.groupBy("name").count()
    value = F.col("value").cast("string")
    text = F.when(F.col("idx") == 0, F.concat(F.col("count").cast("string"), F.lit("\n"), value)).otherwise(value)
    rows = values.join(broadcast_if_small(sizes), "name").select("name", F.col("idx").cast("long").alias("idx"), text.alias("text"))
    rows.repartition("name").sortWithinPartitions("name", "idx").select("name", "text").write.partitionBy("name").option("lineSep", ",").text(path)


def write_dense(entries: DataFrame, n: int, path: str) -> None:
    """entries (name, row, col, value): a file for each name below its folder, n and then n rows of n numbers; what isn't there is 0."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.coalesce(F.element_at("m", c.cast("long")), F.lit(0.0)).cast("string"))
    each = entries.select("name").distinct().select("name", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("row"))
    packed = entries.groupBy("name", "row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("long").alias("c"), "value"))).alias("m"))
    body = each.join(packed, ["name", "row"], "left").select("name", "row", F.array_join(F.when(F.col("m").isNull(), F.array_repeat(F.lit("0.0"), n)).otherwise(cells), ",").alias("text"))
    head = entries.select("name").distinct().select("name", F.lit(-1).alias("row"), F.lit(str(n)).alias("text"))
    rows = head.unionByName(body).repartition("name").sortWithinPartitions("name", "row").select("name", "text")
    rows.write.partitionBy("name").text(path)


def coo_lines(entries: DataFrame, rows: int, cols: int, blocks: int = 1) -> DataFrame:
    """(block, at, at2, line): the lines of `blocks` COO files, each with its own header, which sorts first by `at`."""
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")
    body = entries.select(block, F.col("row").cast("long").alias("at"), F.col("col").cast("long").alias("at2"), F.concat_ws(",", F.col("row") + 1, F.col("col") + 1, F.col("value")).alias("line"))
    whole = body.groupBy("block").agg(F.count(F.lit(1)).alias("n")) if blocks > 1 else body.agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.lit(0).cast("long"))
    head = whole.select("block", F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("at2"), F.format_string(f"{rows},{cols},%d", "n").alias("line"))
    return head.unionByName(body)


def write_coo(entries: DataFrame, rows: int, cols: int, path: str, count: int | None = None) -> None:
    """Write a folder of COO files of about BLOCK entries each; rows of one index share a file, and read_coo reads them all. count: of entries, if known."""
    blocks = max(1, -(-(entries.count() if count is None else count) // BLOCK))
    lines = coo_lines(entries, rows, cols, blocks).repartition("block").sortWithinPartitions("block", "at", "at2")
    lines.select("block", "line").write.partitionBy("block").text(path)
