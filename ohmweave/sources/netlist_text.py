"""Netlist text: lines to components, nodes and settings, and back. Many circuits are parsed at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.waveform import FIELDS, PULSE, pulse_text
from .lines import numbered_lines

COMPONENTS = f"circuit string, line_no long, kind string, name string, node1 string, node2 string, value double, pulse {PULSE}"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(circuit, line_no, line) of netlist files; the circuit is its file. Large files are split among tasks."""
    return numbered_lines(spark, path).select(F.col("file").alias("circuit"), "line_no", "line")


def tokens(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"[\s=,()]+"), lambda x: x != "")


def number(text: Column) -> Column:
    """A plain number; anything else, a unit suffix too, fails the job rather than being misread."""
    got = text.try_cast("double")
    return F.when(got.isNull(), F.raise_error(F.concat(F.lit("not a number: "), F.coalesce(text, F.lit("nothing")))).cast("double")).otherwise(got)


def components(lines: DataFrame) -> DataFrame:
    """COMPONENTS from lines (circuit, line_no, line). Line 0 is the title. An inductor is a source of 0 volts."""
    t = lines.where("line_no > 0").select("circuit", "line_no", tokens(F.col("line")).alias("t")).where(F.size("t") > 0)
    t = t.withColumn("kind", F.substring(F.get("t", F.lit(0)), 1, 1)).where(F.col("kind").isin("v", "i", "r", "c", "l"))
    at = lambda k: F.get("t", F.lit(k))
    pulse = F.struct(*[number(at(5 + k)).alias(f) for k, f in enumerate(FIELDS)])
    short = F.col("kind") == "l"
    return t.select(
        "circuit",
        "line_no",
        F.when(short, "v").otherwise(F.col("kind")).alias("kind"),
        F.when(short, F.concat(F.lit("v_"), at(0))).otherwise(at(0)).alias("name"),
        at(1).alias("node1"),
        at(2).alias("node2"),
        F.when(short, number(at(3)) * 0).otherwise(number(at(3))).alias("value"),
        F.when(F.col("kind").isin("v", "i") & (at(4) == "pulse"), pulse).alias("pulse"),
    )


def settings(lines: DataFrame) -> DataFrame:
    """(circuit, title, tstep, tstop, print) of each circuit; print lists the nodes asked for, in order."""
    low = F.lower(F.trim("line"))
    tran, first = F.when(low.startswith(".tran"), tokens(F.col("line"))), F.col("line_no") == 0
    asked = F.when(low.rlike(r"^\.print\s+tran"), F.regexp_extract_all(low, F.lit(r"v\(\s*([^)\s]+)\s*\)"), F.lit(1)))
    rows = lines.select("circuit", "line_no", F.when(first, F.col("line")).alias("title"), F.when(~first, tran).alias("tran"), F.when(~first, asked).alias("asked"))
    last = F.max_by("tran", F.when(F.col("tran").isNotNull(), F.col("line_no")))
    g = rows.groupBy("circuit").agg(F.max("title").alias("title"), last.alias("tran"), F.array_sort(F.collect_list(F.when(F.col("asked").isNotNull(), F.struct("line_no", "asked")))).alias("p"))
    return g.select("circuit", "title", number(F.get("tran", F.lit(1))).alias("tstep"), number(F.get("tran", F.lit(2))).alias("tstop"), F.flatten(F.transform("p", lambda x: x["asked"])).alias("print"))


def unknown_lines(lines: DataFrame) -> DataFrame:
    """Lines that are neither components, commands nor comments: they are skipped, and this is the warning."""
    first = F.substring(F.lower(F.trim("line")), 1, 1)
    return lines.where((F.col("line_no") > 0) & (F.trim("line") != "") & ~first.isin("v", "i", "r", "c", "l", ".", "*"))


def component_lines(parts: DataFrame) -> DataFrame:
    """(circuit, at, name, line): sources, then resistors, then capacitors, as the parser reads them."""
    order = F.array_position(F.array(*map(F.lit, "virc")), F.col("kind")).cast("int")
    line = F.concat_ws(" ", "name", "node1", "node2", F.col("value").cast("string"), F.when(F.col("pulse").isNotNull(), pulse_text(F.col("pulse"))))
    return parts.select("circuit", order.alias("at"), "name", line.alias("line"))


def netlist_lines(parts: DataFrame, setting: DataFrame) -> DataFrame:
    """(circuit, at, name, line) of whole netlists; sorted by at and name they are files."""
    row = lambda at, line: setting.select("circuit", F.lit(at).alias("at"), F.lit("").alias("name"), line.alias("line"))
    asked = F.concat(F.lit(".print tran"), F.coalesce(F.array_join(F.transform("print", lambda n: F.concat(F.lit(" v("), n, F.lit(")"))), ""), F.lit("")))
    return row(0, F.coalesce("title", F.lit(""))).unionByName(component_lines(parts)).unionByName(row(8, F.concat_ws(" ", F.lit(".tran"), "tstep", "tstop"))).unionByName(row(9, asked)).unionByName(row(10, F.lit(".end")))


def write_netlist(parts: DataFrame, setting: DataFrame, path: str) -> None:
    """One folder for each circuit; a circuit's lines stay together and in order."""
    lines = netlist_lines(parts, setting)
    lines.repartition("circuit").sortWithinPartitions("circuit", "at", "name").select("circuit", "line").write.partitionBy("circuit").text(path)
