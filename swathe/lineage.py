"""Cutting lineage with tables in shared storage, and broadcasts behind a check of their size."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
#: bytes as stored; in memory rows take a few times that
MOST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; below a temporary one where that is unset and all tasks run in this process's machine, as in tests.

    It is removed when the driver ends. Without the setting on a cluster it raises: executors do not share local folders.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.mkdtemp(prefix="swathe-"))
        base = f"file://{_OWN_DIR[0]}"
    path = f"{base.rstrip('/')}/swathe-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may have gone before; the folder is only left behind
        pass


def materialize(df: DataFrame, *by: str, **options: int) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts its lineage, survives lost executors. ``by``: columns to partition it by; ``options`` of the writer."""
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.options(**options)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got._written = path
    return got


def discard(*frames: DataFrame) -> None:
    """Removes the files of written tables that nothing will read again, before the driver ends."""
    for df in frames:
        _remove(df.sparkSession, df._written)


def small(df: DataFrame, most_rows: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has ``most_rows`` rows and ``most_bytes`` bytes at most, else as it is (a shuffle join follows).

    ``df`` should be materialized: its rows are counted here, and its bytes are those of its files (estimated by its columns, if it selects some).
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most_bytes and df.limit(most_rows + 1).count() <= most_rows else df
