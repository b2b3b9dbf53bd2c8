"""Source waveforms as Column expressions: a base level plus pulses (v1 v2 td tr tf pw per)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("v1", "v2", "td", "tr", "tf", "pw", "per")
PULSE = "struct<" + ",".join(f"{f}:double" for f in FIELDS) + ">"


def pulse(**levels) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(f) for f in FIELDS for v in [levels[f]]])


def pulse_at(p: Column, t: Column) -> Column:
    """v1 before td; then in each period a rise, v2, a fall, v1. A ramp of no length is skipped; no period means v1."""
    c = (t - p["td"]) % p["per"]
    rise = p["v1"] + (p["v2"] - p["v1"]) * c / p["tr"]
    fall = p["v2"] + (p["v1"] - p["v2"]) * (c - p["tr"] - p["pw"]) / p["tf"]
    value = F.when(c < p["tr"], rise).when(c < p["tr"] + p["pw"], p["v2"]).when(c < p["tr"] + p["pw"] + p["tf"], fall).otherwise(p["v1"])
    return F.when((t < p["td"]) | (p["per"] == 0), p["v1"]).otherwise(value)


def wave_at(base: Column, pulses: Column, t: Column) -> Column:
    """A constant and an array of pulses, added up."""
    return F.coalesce(base, F.lit(0.0)) + F.aggregate(F.coalesce(pulses, F.array().cast(f"array<{PULSE}>")), F.lit(0.0), lambda acc, p: acc + pulse_at(p, t))


def shifted(p: Column, by: Column | float) -> Column:
    """A pulse with a number added to both levels."""
    return p.withField("v1", p["v1"] + by).withField("v2", p["v2"] + by)


def scaled(p: Column, by: Column | float) -> Column:
    return p.withField("v1", p["v1"] * by).withField("v2", p["v2"] * by)


def fused(sources: DataFrame, by: list[str], pulse_col: str = "pulse") -> DataFrame:
    """Pulses of one node with equal timing become one: their levels add up."""
    p = sources.where(F.col(pulse_col).isNotNull()).select(*by, f"{pulse_col}.*")
    return p.groupBy(*by, "td", "tr", "tf", "pw", "per").agg(F.sum("v1").alias("v1"), F.sum("v2").alias("v2"))


def pulse_text(p: Column) -> Column:
    return F.concat(F.lit("pulse("), F.concat_ws(", ", *[p[f].cast("string") for f in FIELDS]), F.lit(")"))


def simpson_weight(n: Column, last: Column | int) -> Column:
    """1, 4, 2, ..., 4, 1."""
    return F.when((n == 0) | (n == last), 1.0).when(n % 2 == 1, 4.0).otherwise(2.0)
