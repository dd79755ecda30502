"""Tables that cut lineage: written to the shared folder and read again.

The folder is the one named by ``spark.checkpoint.dir``.  Where that setting is
absent a local folder is made, but only for a session whose master is local;
on a cluster the setting is required, since a folder of one machine would be
lost with it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (an id or a few numbers a row) may be broadcast.
BROADCAST_ROWS = 2_000_000
#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sparkweft-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@lru_cache(maxsize=8)
def _own_folder(spark: SparkSession, base: str, application: str) -> str:
    """The application's folder for intermediate tables; removed when the driver's Python ends in the usual way."""
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


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder, and read from there.

    Later steps read the files, so a lost executor costs no recomputation of
    what came before.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark, shared_dir(spark), spark.sparkContext.applicationId)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is.

    To be called on stored tables, where counting reads file footers only.  Beyond
    the limit the join that uses the result shuffles both sides as usual.
    """
    return F.broadcast(df) if df.count() <= rows else df


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, unless the session sets a bound of its own.

    By rows alone, a batch of ten thousand texts has no limit; executor and worker
    each hold several copies of it.
    """
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
