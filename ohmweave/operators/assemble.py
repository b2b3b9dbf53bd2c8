"""From reduced netlists to nodal systems C x' = b(t) - G x, and to x' = A x + b."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.waveform import PULSE, fused, scaled
from .netlist import GROUND


def conductances(resistors: DataFrame) -> DataFrame:
    """G as (circuit, row, col, value): a resistor's 1/R on both diagonals, -1/R across; ground has no row."""
    g = 1 / F.col("value")
    cell = lambda r, c, v: F.struct(F.col(r).alias("row"), F.col(c).alias("col"), v.alias("value"))
    stamps = F.array(cell("node1", "node1", g), cell("node2", "node2", g), cell("node1", "node2", -g), cell("node2", "node1", -g))
    flat = resistors.select("circuit", F.inline(stamps)).where((F.col("row") != GROUND) & (F.col("col") != GROUND))
    return flat.groupBy("circuit", "row", "col").agg(F.sum("value").alias("value"))


def injections(sources: DataFrame) -> DataFrame:
    """(circuit, node, dc, pulses): a current leaves node1 and enters node2; beside a pulse the constant is ignored."""
    sign = F.array(F.struct(F.col("node1").alias("node"), F.lit(-1.0).alias("sign")), F.struct(F.col("node2").alias("node"), F.lit(1.0).alias("sign")))
    flat = sources.select("circuit", "value", "pulse", F.explode(sign).alias("s")).where(F.col("s.node") != GROUND)
    flat = flat.select("circuit", "s.node", F.when(F.col("pulse").isNull(), F.col("value") * F.col("s.sign")).otherwise(0.0).alias("dc"), F.when(F.col("pulse").isNotNull(), scaled(F.col("pulse"), F.col("s.sign"))).alias("pulse"))
    dc = flat.groupBy("circuit", "node").agg(F.sum("dc").alias("dc"))
    whole = F.struct("v1", "v2", "td", "tr", "tf", "pw", "per").cast(PULSE)
    pulses = fused(flat, ["circuit", "node"]).groupBy("circuit", "node").agg(F.array_sort(F.collect_list(whole)).alias("pulses"))
    return dc.join(pulses, ["circuit", "node"], "left")


def capacitances(capacitors: DataFrame) -> DataFrame:
    """(circuit, node, value) of capacitors to ground; one that floats fails the job."""
    floats = (F.col("node1") != GROUND) & (F.col("node2") != GROUND)
    node = F.when(F.col("node1") == GROUND, F.col("node2")).otherwise(F.col("node1"))
    node = F.when(floats, F.raise_error(F.concat(F.lit("a floating capacitor: "), F.col("name"))).cast("string")).otherwise(node)
    return capacitors.groupBy("circuit", node.alias("node")).agg(F.sum("value").alias("value"))


def refuse_sources(parts: DataFrame) -> DataFrame:
    """parts; a voltage source that is still there fails the job."""
    return parts.withColumn("kind", F.when(F.col("kind") == "v", F.raise_error(F.concat(F.lit("a voltage source is left: "), F.col("name"))).cast("string")).otherwise(F.col("kind")))


def ode_matrix(g: DataFrame, c: DataFrame) -> DataFrame:
    """A = -G / C, row by row."""
    return g.join(c.select("circuit", F.col("node").alias("row"), F.col("value").alias("c")), ["circuit", "row"]).select("circuit", "row", "col", (-F.col("value") / F.col("c")).alias("value"))


def systems(parts: DataFrame) -> DataFrame:
    """A row for each circuit: nodes and the lists of G, C and b that a solver needs.

    A circuit's lists are gathered in one row: meant for circuits of up to some thousand nodes, any number of them.
    """
    parts = refuse_sources(parts)
    gather = lambda df, name, *cols: df.groupBy("circuit").agg(F.collect_list(F.struct(*cols)).alias(name))
    g = gather(conductances(parts.where("kind = 'r'")), "g", "row", "col", "value")
    c = gather(capacitances(parts.where("kind = 'c'")), "c", "node", "value")
    b = gather(injections(parts.where("kind = 'i'")), "b", "node", "dc", "pulses")
    return g.join(c, "circuit", "left").join(b, "circuit", "left")
