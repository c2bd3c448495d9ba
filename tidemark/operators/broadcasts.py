"""Broadcasts of tables whose size is checked, and tables that are computed once."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup table (of short arrays and names) is broadcast.
ROWS = 200_000


def held(df: DataFrame) -> DataFrame:
    """df, kept where it is computed first, in memory or on disk; what is lost with an executor is computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (local runs only)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own[app]


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as Parquet and read again: lists of strings take a small part of what `held` needs for them.

    The shuffles behind it aren't needed any more, and their files go when the driver collects its garbage, which it is asked for.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for _ in range(2):  # what ran is still held for a moment by Spark's listeners
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """A lookup table, computed once: with a broadcast hint if it has at most `rows` rows, else a shuffled join whose skew AQE splits."""
    kept = held(df)
    if kept.limit(rows + 1).count() <= rows:
        return F.broadcast(kept)
    kept.unpersist()
    return df
