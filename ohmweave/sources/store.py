"""Tables, the shared folder, what is written there between stages, and joins that neither grow a broadcast nor a task."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether Spark deletes the shuffle files of a query as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master may leave it unset, and gets a temporary folder then; elsewhere that is an error.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at and sc.getCheckpointDir():
        at = os.path.dirname(sc.getCheckpointDir().rstrip("/"))
    if not at:
        if sc.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='ohmweave-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    Spark is told to delete the shuffle files of the write as it ends: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ohmweave-{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def made_of(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, which reads these stored tables: forget deletes them with it."""
    df.stored_at = [p for t in tables for p in ([t.stored_at] if isinstance(t.stored_at, str) else t.stored_at)]
    return df


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was made of them is itself stored."""
    for t in tables:
        for at in [t.stored_at] if isinstance(t.stored_at, str) else t.stored_at:
            path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def broadcast_if_small(df: DataFrame, most_rows: int = 200_000, size: Column | None = None, most_bytes: int = 32 << 20) -> DataFrame:
    """df marked for broadcast if it has few rows by count; otherwise as it is, for a shuffled join.

    size: bytes of a row, for rows that have no bound of their own; they may sum to most_bytes at most.
    """
    n, held = df.select((F.lit(0) if size is None else size).alias("b")).limit(most_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return F.broadcast(df) if n <= most_rows and held <= most_bytes else df


def join_split(left: DataFrame, right: DataFrame, key: str, how: str = "inner", parts: int = 1000, least: int = 100, total: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """left joined on `key` to right, which has one row a key; no task gets all the rows of a frequent key.

    Keys with over a `parts`-th of left's rows (and over `least`) are fewer than `parts`, so right's rows for
    them are broadcast; the other keys shuffle. left is read several times: it should be a stored table.
    counts: (key, count) of left's rows, where that is known.
    """
    counted = left.groupBy(key).count() if counts is None else counts
    bar = max(least, (left.count() if total is None else total) // parts)
    hot = counted.where((F.col("count") > bar) & F.col(key).isNotNull()).select(key).toArrow()  # fewer than `parts`
    if not hot.num_rows:
        return left.join(right, key, how)
    # a table of Arrow stays on the driver; a list would have every executor keep Python workers of another kind for it
    keys = F.broadcast(left.sparkSession.createDataFrame(hot, left.select(key).schema))
    few = F.broadcast(right.join(keys, key, "left_semi"))
    return left.join(keys, key, "left_semi").join(few, key, how).unionByName(left.join(keys, key, "left_anti").join(right, key, how))
