"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of narrow tables (ids, addresses) up to which a join may broadcast them.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a local one, for local sessions only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sparkweft-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@lru_cache(maxsize=8)
def _own_folder(spark: SparkSession, base: str, application: str) -> str:
    """The application's folder; removed when the driver's Python ends in the usual way."""
    path = f"{base}/sparkweft/{application}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the JVM is gone: the files stay, as after a crash
            pass

    atexit.register(remove)
    return path


def staging_dir(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables."""
    return f"{_own_folder(spark, shared_dir(spark), spark.sparkContext.applicationId)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as Parquet at ``path``, read again: what comes later survives the loss of executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table with a broadcast hint if it is small; beyond the limit, joins shuffle it."""
    return F.broadcast(df) if df.count() <= rows else df
