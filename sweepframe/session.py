"""Session helpers: the shared folder, size-checked broadcasts and bounded reads of dimension tables."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a dimension (parameter names, aliases, budgets) may come to the driver or be broadcast.
DIMENSION_ROWS = 10_000


_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_folders: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a new local folder if the master is
    local (tests); on a cluster that raises, as no folder of one machine is shared."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors.

    The folder stays until discard(the returned frame) or release(spark).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _folders.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _written[back] = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete the folder of a materialised frame that no frame reads any more, such as that of a round gone by."""
    if path := _written.pop(df, None):
        _folders[df.sparkSession.sparkContext.applicationId].remove(path)
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> int:
    """Delete every folder that materialise wrote in this application and return their number; call it once the results
    that read them are written."""
    paths = _folders.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def bounded_rows(df: DataFrame, limit: int = DIMENSION_ROWS) -> list | None:
    """All rows of df, or None if there are more than limit: nothing larger ever reaches the driver."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def broadcast_if_small(df: DataFrame, limit: int = DIMENSION_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows; otherwise unchanged, to be joined by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
