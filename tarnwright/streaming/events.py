"""Streams over a folder of event files, run to the end of what is there."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnwright.sources.scratch import scratch_path, table
from tarnwright.streaming import activity

#: Keys of a partition of state_on_disk(), and the MB that its state may take of an executor's memory beside the heap, unless the session says.
STATE_KEYS, STATE_MB = 500_000, 1_000


def stream(spark: SparkSession, sf_dir: str, name: str = "events", watermark: str = "1 hour") -> DataFrame:
    """A table as a stream; ts becomes a zoned timestamp, which watermarks need (the session's zone should be UTC)."""
    known = table(spark, sf_dir, name)
    path, reader = f"{sf_dir}/{name}.parquet", spark.readStream.schema(known.schema)
    if all(f.endswith(f"/{name}.parquet") for f in known.inputFiles()):  # one file: a stream reads its folder
        path, reader = sf_dir, reader.option("pathGlobFilter", f"{name}.parquet")
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def folder(spark: SparkSession, path: str, schema: T.StructType, watermark: str = "1 hour", files: int | None = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a micro-batch (None: all there are), the oldest first; ts is made a zoned timestamp."""
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def _drained(df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all available input; the rows of all batches, from the shared folder.

    Each batch has a folder of its own, by its number, which it overwrites: a batch that is run again after a failure
    leaves its rows once.
    """
    spark = df.sparkSession
    path, schema = scratch_path(spark, "stream"), df.schema
    query = df.writeStream.outputMode(mode).option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True)
    query.foreachBatch(lambda batch, number: keep(batch, number, path)).start().awaitTermination()
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)


def in_steps(steps: list[DataFrame], to: Callable[[DataFrame], DataFrame], mode: str, watermark: str = "1 hour", once: bool = False) -> DataFrame:
    """The rows of all batches of a stream whose input comes in steps, each of any number of files.

    A step's files are added to the input folder, and the stream, which `to` makes of it, runs to their end; for the next step
    it starts again from its checkpoint, with its state and watermark.  once: in one batch for each step, as streams that wait
    for the cluster's time must, which would run batches without input for ever.
    """
    spark = steps[0].sparkSession
    into, out, state = (scratch_path(spark, name) for name in ("steps", "stream", "stream-state"))
    schema = None
    for step in steps:
        step.write.mode("append").parquet(into)
        df = to(folder(spark, into, steps[0].schema, watermark, files=None))
        schema = df.schema
        query = df.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(**({"once": True} if once else {"availableNow": True}))
        query.foreachBatch(lambda batch, number: keep(batch, number, out)).start().awaitTermination()
    return spark.read.schema(schema).parquet(out).select(*schema.names)  # without the folders' numbers


@contextlib.contextmanager
def state_on_disk(spark: SparkSession, keys: int) -> Iterator[int]:
    """While it lasts, streams that start keep state of about so many keys in RocksDB, and run no batches without input.

    Executors hold a bounded part of the state in memory, whatever its size, and a stream that starts again copies its files.
    The partitions, whose number it gives, have STATE_KEYS keys each, but are no fewer than what the session runs at once:
    each writes files of its own in every batch, so more would cost time without shortening anything.  For streams that tell
    each row in the batch it comes in, as dropDuplicatesWithinWatermark does: there a batch without input only drops keys
    whose time has passed, which the next batch with input does after its rows.
    """
    parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), -(-keys // STATE_KEYS))
    state = "spark.sql.streaming.stateStore.rocksdb"
    new = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.streaming.noDataMicroBatches.enabled": "false", f"{state}.boundedMemoryUsage": "true", f"{state}.maxMemoryUsageMB": spark.conf.get(f"{state}.maxMemoryUsageMB", str(STATE_MB)), f"{state}.trackTotalNumberOfRows": "false"}
    before = {k: spark.conf.get(k, None) for k in new}
    with activity.rocks(spark):
        for k, v in new.items():
            spark.conf.set(k, v)
        try:
            yield parts
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keep(batch: DataFrame, number: int, path: str) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def to_end(df: DataFrame, mode: str) -> DataFrame:
    """The result of a stream over all available input: in append mode the rows of all batches, in complete mode those of the last."""
    rows = _drained(df, mode)
    if mode == "complete":
        rows = rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def running_totals(events: DataFrame) -> DataFrame:
    """Custom state: each user's events so far and the time of the last, one row for each user and batch that has any."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0)
        for batch in batches:
            n += len(batch)
            last = max(last, int(batch["at"].max()))
        state.update((n, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_at": [last]})

    narrow = events.select("user_id", F.unix_micros("ts").alias("at"))
    return narrow.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, last_at long", "n long, last_at long", "update", GroupStateTimeout.NoTimeout)


def latest(df: DataFrame, to: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a stream in update mode; `to` reduces the rows of all batches to the last state of each key."""
    return to(_drained(df, "update").drop("batch"))
