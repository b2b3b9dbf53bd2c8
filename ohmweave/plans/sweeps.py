"""Parameter sweeps: every setting of every circuit is a row of one job."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, stepper
from ..sources.store import stored


def step_errors(systems: DataFrame, steps: list[int], reference: int, method: str = "lu") -> DataFrame:
    """(circuit, steps, max_abs, ...): errors of coarser time grids against one of `reference` steps.

    systems: rows of commands.prepared. The reference is interpolated to each grid's times; errors are weighted by time.
    """
    every = systems.drop("steps").withColumn("steps", F.explode(F.array(*[F.lit(n).cast("long") for n in sorted({*steps, reference})])))
    named = every.withColumn("circuit", F.concat_ws("\x01", "circuit", F.col("steps").cast("string")))
    runs = stored(stepper.transients(named, method), "sweep")
    part = F.split("circuit", "\x01")
    runs = runs.select(part[0].alias("circuit"), part[1].cast("long").alias("steps"), F.col("time").alias("t"), "value")
    truth = runs.where(F.col("steps") == reference)
    got = runs.where(F.col("steps").isin(list(steps)))
    grid = got.select("circuit", "t").distinct()
    want = metrics.interpolated(grid, truth, ["circuit"]).withColumnRenamed("value", "want")
    pairs = metrics.time_weights(got, ["circuit", "steps"]).join(want, ["circuit", "t"])
    return metrics.error_metrics(pairs, ["circuit", "steps"], "value", "want", F.col("w"))


def sample_errors(estimates: DataFrame, exact: DataFrame, by: list[str]) -> DataFrame:
    """(by, error_percent) of estimates (mean) against exact values, relative."""
    return estimates.join(exact, by).select(*by, (F.abs(F.col("mean") - F.col("exact")) / F.abs("exact") * 100).alias("error_percent"))


def repeated(run: Callable[[], DataFrame], seconds: float = 30.0, most: int = 5) -> dict:
    """run() again and again, its result read in full each time, until `most` runs or so many seconds: runs, mean, least and rows."""
    took, rows = [], 0
    while len(took) < most and sum(took) < seconds:
        began = time.perf_counter()
        rows = run().count()
        took.append(time.perf_counter() - began)
    return {"runs": len(took), "mean": sum(took) / len(took), "least": min(took), "rows": rows}
