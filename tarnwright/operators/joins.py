"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """A column by its whole name, whatever that holds."""
    return F.col(f"`{column.replace('`', '``')}`")


def whole(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that helper columns can't clash with them."""
    return F.struct(*[named(c) for c in df.columns])


def asof_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, take: list[str], slice_of: Column | None = None) -> DataFrame:
    """left with the columns `take` of right's last row of the same key at or before it (nulls if there is none).

    Ties in right_at are broken by the columns taken, the greatest first.  Rows meet by key and time slice, a day by
    default (slice_of gives another, from the column `at`), so that no key's rows need fit one task; what a slice inherits
    is the last row of the slices before it, carried over one row for each key and slice.  Null keys and times match
    nothing.
    """
    part = slice_of if slice_of is not None else F.floor(F.unix_timestamp(F.col("at").cast("timestamp")) / 86_400)
    newest = F.struct(named(right_at).alias("at"), *[named(c).alias(f"take{i}") for i, c in enumerate(take)])
    r = right.filter(named(key).isNotNull() & named(right_at).isNotNull()).select(named(key).alias("key"), named(right_at).alias("at"), newest.alias("own")).withColumn("slice", part)
    ends = r.groupBy("key", "slice").agg(F.max("own").alias("end"))
    l = left.select(named(key).alias("key"), named(left_at).alias("at"), whole(left).alias("row")).withColumn("slice", part)  # noqa: E741
    slices = l.select("key", "slice").distinct().join(ends, ["key", "slice"], "full")
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    inherited = slices.select("key", "slice", F.last("end", ignorenulls=True).over(before).alias("inherited"))
    both = l.select("key", "slice", "at", F.lit(1).alias("side"), "row", F.lit(None).cast(r.schema["own"].dataType).alias("own"))
    both = both.unionByName(r.select("key", "slice", "at", F.lit(0).alias("side"), F.lit(None).cast(both.schema["row"].dataType).alias("row"), "own"))
    upto = Window.partitionBy("key", "slice").orderBy("at", "side", "own").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("last", F.last("own", ignorenulls=True).over(upto)).filter("side = 1")
    found = found.join(inherited, ["key", "slice"], "left").withColumn("last", F.coalesce("last", "inherited"))
    return found.select("row.*", *[F.col(f"last.take{i}").alias(c) for i, c in enumerate(take)])


def range_join(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Inner join where low <= at <= high, as an equi-join on buckets of the given width: about that of a usual range.

    A range takes the least power of two times the width that holds it, so it touches two buckets of its own level at
    most, however wide it is; a point stands in one bucket of each level that some range has.  So no pair is made twice.
    """
    size = named(high) - named(low)
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size / width, F.lit(1.0)))).cast("int"))
    r = ranges.filter(named(low) <= named(high)).select(whole(ranges).alias("range"), named(low).alias("low"), named(high).alias("high"), level.alias("level"))
    # levels are at most as many as doublings of the width up to the widest range
    levels = r.agg(F.array_sort(F.collect_set("level")).alias("levels"))
    bucket = lambda x: F.floor(x / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("level"))))
    p = points.select(whole(points).alias("point"), named(at).alias("at")).withColumn("level", F.explode(levels.scalar()))
    p = p.withColumn("bucket", bucket(F.col("at")))
    r = r.withColumn("bucket", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))))
    return p.join(r, ["level", "bucket"]).filter(F.col("at").between(F.col("low"), F.col("high"))).select("point.*", "range.*")


def heavy_join(left: DataFrame, right: DataFrame, key: str, share: float = 0.01, parts: int = 64, tracked: int = 10_000) -> DataFrame:
    """Inner join of left and right on a column of both, with the columns of both, left's first; the key stands twice.

    Keys that more than `share` of left's rows have are found by a sketch of `tracked` keys, in one scan: at most 1 / share
    of them.  Their rows of left are dealt to `parts`, and right's rows of these keys stand once in each; all other rows
    meet by their key alone.  Null keys match nothing.
    """
    l = left.filter(named(key).isNotNull()).select(named(key).alias("key"), whole(left).alias("left"))  # noqa: E731, E741
    r = right.filter(named(key).isNotNull()).select(named(key).alias("key"), whole(right).alias("right"))
    most = max(1, int(1 / share))
    found = l.agg(F.expr(f"approx_top_k(key, {most}, {max(tracked, most)})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    heavy = [x["item"] for x in found.top or [] if x["count"] > share * found.n]
    if not heavy:
        return l.join(r, "key").select("left.*", "right.*")
    at = F.broadcast(left.sparkSession.createDataFrame([(k,) for k in heavy], left.select(named(key).alias("key")).schema))  # at most 1 / share rows
    salted = l.join(at.withColumn("heavy", F.lit(True)), "key", "left")
    # a row's part is that of its values, so that a task that runs again deals the same
    salted = salted.withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64(F.to_json("left")), F.lit(parts))).otherwise(0).cast("int"))
    copied = r.join(at.withColumn("heavy", F.lit(True)), "key", "left")
    copied = copied.withColumn("salt", F.explode(F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.drop("heavy").join(copied.drop("heavy"), ["key", "salt"]).select("left.*", "right.*")
