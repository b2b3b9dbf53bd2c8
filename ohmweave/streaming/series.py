"""Series metrics over streams: event-time windows whose state a watermark bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_metrics(series: DataFrame, by: list[str], ts: str = "ts", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(by, start, n, mean, rms, largest) of tumbling windows; rows later than the watermark are dropped, as streams do.

    The same call serves a batch. Sums are partial before the shuffle on (window, by).
    """
    s = series.withColumn("__ts", F.col(ts).cast("timestamp"))
    s = s.withWatermark("__ts", late) if series.isStreaming else s
    g = s.groupBy(F.window("__ts", width), *by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.max(value).alias("largest"))
    return g.select(*by, F.col("window.start").alias("start"), "n", "mean", "rms", "largest")


def stamped_injections(sources: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, node, dc): currents between node1 and node2 summed by node and window, leaving node1 and entering node2."""
    ends = F.explode(F.array(F.struct(F.col("node1").alias("node"), F.lit(-1.0).alias("sign")), F.struct(F.col("node2").alias("node"), F.lit(1.0).alias("sign"))))
    s = sources.withColumn("__ts", F.col(ts).cast("timestamp"))
    s = s.withWatermark("__ts", late) if sources.isStreaming else s
    flat = s.select("__ts", "value", ends.alias("e")).where("e.node <> '0'")
    return flat.groupBy(F.window("__ts", width), F.col("e.node").alias("node")).agg(F.sum(F.col("value") * F.col("e.sign")).alias("dc")).select(F.col("window.start").alias("start"), "node", "dc")
