"""Window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwright.operators.joins import named, whole


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with all columns of df, whatever these are named; nulls are a group like any other.

    Spark keeps k rows of a group and task before the shuffle (WindowGroupLimit).
    """
    w = Window.partitionBy(*[named(c) for c in group]).orderBy(*order)
    return df.select(whole(df).alias("row"), F.row_number().over(w).alias("place")).filter(F.col("place") <= k).select("row.*")


def sessions(df: DataFrame, key: str, at: str, gap: str, aggregates: list[Column], start: str = "session_start", end: str = "session_end") -> DataFrame:
    """Sessions of each key that end after a pause of `gap`: key, aggregates, and the first and last event of the session.

    start and end name these two; a name that stands twice in the result is refused.  Rows with a null time are in no
    session; a null key is a key like any other.
    """
    out = df.groupBy(F.struct(named(key)), F.session_window(named(at), gap)).agg(F.max(named(at)), *aggregates)
    names = [key, *out.columns[3:], end, start]
    if len(set(names)) < len(names):
        raise ValueError(f"a session's columns need different names: {names}")
    by_place = out.toDF("key", "window", "last", *[f"a{i}" for i in range(len(names) - 3)])
    return by_place.select(F.col("key").getField(key).alias(key), *[F.col(f"a{i}").alias(n) for i, n in enumerate(names[1:-2])], F.col("last").alias(end), F.col("window.start").alias(start))
