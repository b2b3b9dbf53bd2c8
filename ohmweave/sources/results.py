"""Printed results: waveform lines, timings, tables of another simulator; result caches."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def waveform_rows(lines: DataFrame, by: list[str]) -> DataFrame:
    """(time, value) of lines that are exactly two numbers."""
    m = rf"^\s*({NUMBER})\s+({NUMBER})\s*$"
    return lines.where(F.col("line").rlike(m)).select(*by, *(F.regexp_extract("line", m, i + 1).cast("double").alias(k) for i, k in enumerate(("time", "value"))))


def timing_rows(lines: DataFrame, by: list[str]) -> DataFrame:
    """(phase, seconds) of lines such as `ODE solver time: 0.25 s`."""
    m = rf"^(.*?)\s*time:\s*({NUMBER})"
    return lines.where(F.col("line").rlike(m)).select(*by, F.trim(F.regexp_extract("line", m, 1)).alias("phase"), F.regexp_extract("line", m, 2).cast("double").alias("seconds"))


def indexed_rows(lines: DataFrame, by: list[str]) -> DataFrame:
    """(time, value) of three-number rows, index first, as another simulator prints them."""
    m = rf"^\s*\d+\s+({NUMBER})\s+({NUMBER})\s*$"
    return lines.where(F.col("line").rlike(m)).select(*by, *(F.regexp_extract("line", m, i + 1).cast("double").alias(k) for i, k in enumerate(("time", "value"))))


def write_csv(rows: DataFrame, path: str) -> None:
    """A sweep's results as CSV files with a header each."""
    rows.write.csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results of such files, columns found by their names; a value that isn't of its type fails the job."""
    kinds = [x.split() for x in schema.split(", ")]
    raw = spark.read.csv(path, header=True)
    return raw.select(*(F.col(n).cast(k).alias(n) for n, k in kinds))


def cached(spark: SparkSession, folder: str, key: dict, make: Callable[[], DataFrame], inputs: Sequence[DataFrame] = ()) -> DataFrame:
    """make()'s result under its parameters and the state of its inputs' files, as Parquet; made once.

    A key with seed -1 is never reused: it asks for chance. An input file of another name, size or time makes another result. A result is
    written beside its place and moved there when it is whole, so that of two writers one wins and neither reads half a result.
    """
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
    files = []
    for name in sorted({f for df in inputs for f in df.inputFiles()}):
        at = hadoop.Path(name)
        told = at.getFileSystem(conf).getFileStatus(at)
        files.append([name, told.getLen(), told.getModificationTime()])
    path = f"{folder}/{hashlib.sha256(json.dumps([key, files], sort_keys=True).encode()).hexdigest()}"
    place = hadoop.Path(path)
    fs = place.getFileSystem(conf)
    if key.get("seed") == -1 or not fs.exists(place):
        own = f"{path}-{uuid.uuid4().hex}"
        make().write.parquet(own)
        if key.get("seed") == -1:
            return spark.read.parquet(own)
        if fs.exists(place) or not fs.rename(hadoop.Path(own), place):
            fs.delete(hadoop.Path(own), True)
    return spark.read.parquet(path)
