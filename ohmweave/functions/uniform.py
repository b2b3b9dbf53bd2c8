"""Random numbers that depend on a key alone, not on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the key's parts, colon-joined."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def exponential(u: Column, rate: Column) -> Column:
    """Waiting time at a rate; no rate never ends."""
    return F.when(rate > 0, -F.ln(1 - u) / rate).otherwise(F.lit(float("inf")))


def scientific(x: Column, digits: int = 1) -> Column:
    """m×10^e as text, 0 as 0."""
    e = F.floor(F.log10(F.abs(x)))
    m = F.round(x / F.pow(F.lit(10.0), e), digits)
    over = F.abs(m) >= 10
    text = F.concat(F.format_number(F.when(over, m / 10).otherwise(m), digits), F.lit("×10^"), F.when(over, e + 1).otherwise(e).cast("string"))
    return F.when(x == 0, F.lit("0")).otherwise(text)
