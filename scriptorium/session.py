"""Spark session helpers.

The library never creates a session behind the caller's back inside an
operator; jobs and tests call :func:`get_spark` once.  Settings are the ones a
cluster deployment should keep: AQE on (coalesce + skew join), UTC session
time zone (the oracle engine compares naive timestamps), Arrow for
pandas UDFs, UI off.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(master: str | None = None, app: str = "scriptorium",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    master = master or os.environ.get("SCRIPTORIUM_MASTER", "local[*]")
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.parquet.filterPushdown", "true")
         # reliable checkpoints are removed once their data is no longer referenced
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and versioned tables.

    On a cluster ``spark.checkpoint.dir`` names a shared (DFS / object store)
    folder and is used as is.  Only when it is unset (local tests) do we pick
    a fresh scratch folder and register it.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a shared "
                               "folder (DFS / object store) that every executor can reach")
        d = tempfile.mkdtemp(prefix="scriptorium-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
        spark.sparkContext.setCheckpointDir(d)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df):
    """Reliable checkpoint (written to the shared checkpoint folder).

    Survives executor loss, unlike a local checkpoint.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def dropped_shuffles(spark: SparkSession):
    """Actions inside drop their shuffle files as they end; else these stay until the driver's garbage collector meets
    the plan, and a job of many writes holds the shuffles of all of them."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", by: tuple = ()) -> None:
    """Write a table that this library reads again: packed closely, its shuffle files gone with the write."""
    with dropped_shuffles(df.sparkSession):
        df.write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)


def write_once(df, name: str = "rows"):
    """Write to the shared folder and read back.

    Every later use reads the same rows: values that depend on how the input
    happened to be partitioned are fixed, and a lost executor costs a re-read.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    write_parquet(df, path)
    return spark.read.schema(df.schema).parquet(path)
