"""Tables written in buckets of a key, which join and group by that key without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tarnwright.sources.scratch import scratch_path


#: Rows of a bucket, about, which one task sorts and joins.
ROWS = 500_000


def buckets_for(rows: int, least: int = 8) -> int:
    """Buckets for a table of so many rows: a power of two, so that a task's share doesn't grow with the table."""
    return max(least, 1 << max(0, -(-rows // ROWS) - 1).bit_length())


def bucketed(df: DataFrame, keys: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """df, written as a table in so many buckets by the hash of its keys, each one file in order of them.

    Rows are shuffled once, here, so that a bucket is one file; tables of as many buckets by keys of the same types then
    join by these, and group by them, as they stand.  The files go to `path`, or the shared folder.  A key that a third of
    all rows have makes its bucket that large: such a key belongs to joins.heavy_join().
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    out = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    out.option("path", path or scratch_path(spark, "bucketed")).saveAsTable(name)
    return spark.table(name)
