"""Helpers shared by the text operators: tables, shared storage and checked broadcasts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import discard, materialize, shared_dir, small

__all__ = ["as_text", "discard", "hex16", "materialize", "release", "row_hash", "shared_dir", "small", "small_batches", "table", "typed_id", "union_all"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512, most_bytes: int = 2 << 20) -> None:
    """Lowers the session's Arrow batch sizes, in rows and in bytes, if they are larger: texts can be long, and a batch stands in memory several times.

    They stay lowered, as results are lazy: a plan reads them when it runs. They bound memory only and change no result.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes)):
        now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Gives memory that a worker has freed back to the machine, where the C library can: workers are used again, and keep what their largest task took."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def as_text(c: Column | str) -> Column:
    """An id as text, in which form it goes through pandas: there one null turns a column of longs into doubles."""
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def typed_id(df: DataFrame, like: DataFrame, name: str) -> DataFrame:
    """``df`` with its text column ``id`` in the type of the column ``name`` of ``like``."""
    return df.withColumn("id", F.col("id").cast(like.select(name).schema[0].dataType))


def row_hash(*columns: str) -> Column:
    """A 64-bit key of a row's named columns."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def hex16(c: Column) -> Column:
    """A long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))
