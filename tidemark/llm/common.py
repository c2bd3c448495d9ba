"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table may be broadcast when it has at most this many rows (each a few dozen bytes wide).
BROADCAST_ROWS = 100_000
#: A list of row numbers alone may be broadcast up to this length (8 bytes each, some 50 MB with its hash table).
LIST_ROWS = 1_000_000

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


_open: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that `written` has made meanwhile, but for those with keep."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder as Parquet and returns the table read again.

    The files outlive lost executors, and what has been computed once isn't computed again. They stay after the end of a
    `temporary` block only with keep, which hands them to the block around it, if there is one.
    """
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    owners = _open[:-1] if keep else _open
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes(setting: str) -> int:
    """A size as Spark's settings have it, such as 16m or 134217728b."""
    digits = setting.lower().rstrip("bkmgt")
    unit = setting.lower()[len(digits) :].rstrip("b")
    return int(digits) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def bucketed(df: DataFrame, key: str, like: DataFrame) -> DataFrame:
    """df written once to the shared folder as a table bucketed by `key`: groups by that key read it without another shuffle.

    A bucket has about spark.sql.files.maxPartitionBytes by Catalyst's estimate of the size of `like`, which takes no pass
    over the rows; the number of buckets sets no result. The files go at the end of a `temporary` block, as those of `written`.
    """
    spark = df.sparkSession
    size = int(str(like._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    n = 2 * spark.sparkContext.defaultParallelism
    if size < 1 << 60:  # beyond that it isn't known
        n = min(most, max(n, -(-size // _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))))
    name, path = f"tidemark_{uuid.uuid4().hex}", f"{scratch(spark)}/{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018 (resolves it before its name goes)
    spark.sql(f"DROP TABLE {name}")
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else as it is: a shuffled join, whose skew AQE splits."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
