"""Where operators cut lineage, and a few helpers that all of them use.

Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir``: all executors and the
driver see it, so a lost executor costs a re-read and no recomputation.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwright.sources.scratch import scope, scratch_path, shared_dir, table

__all__ = ["BROADCAST_ROWS", "cut", "hinted", "lean", "quoted", "scope", "slim", "small_batches", "table", "whole", "written"]

#: Rows of a narrow table (a few machine words each) up to which it is broadcast; counted before, never assumed.
BROADCAST_ROWS = 200_000
#: Bytes of an Arrow batch: rows of long texts would otherwise make batches of up to 64 MB, several a task, beside the heap.
BATCH_BYTES = 4 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder.  It stays until its scope ends, or without one until the folder is cleaned."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut; Spark deletes the files once nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if its counted rows allow it; else Spark joins by shuffle and splits skewed partitions."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches to BATCH_BYTES for this session, unless it has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def whole(df: DataFrame, *more) -> DataFrame:
    """df's columns as one struct, `row`, beside which more columns may stand whatever df's are named; "row.*" gives them back."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), *more)


def slim() -> None:
    """Gives memory that this Python worker has freed back to the machine: a worker outlives its tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches, with slim() after its last one."""

    def slimmed(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            slim()

    return slimmed
