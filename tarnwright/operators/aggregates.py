"""Aggregates that Spark computes with a whole group in one task, spread out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwright.operators.joins import named
from tarnwright.sources.scratch import scratch_path

#: Values of a group in a slice, about.
SLICE = 1_000_000


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def percentile(df: DataFrame, group: list[str], value: str, share: float, slice_rows: int = SLICE) -> DataFrame:
    """group and percentile: the exact percentile of each group, interpolated as quantile_cont does; nulls don't count.

    Values are counted first, in the one scan of df, and kept in the shared folder.  They are dealt to slices of about equal
    size by ranges of group and value, and sums of slices tell which hold one of the two values next to the place: only
    these are looked into.  So a group that is most of the table is never in one task, and no sort is larger than a
    slice.  Nulls are a group like any other; a group whose values are all null has no row.
    """
    rows = df.select(F.struct(*[named(c) for c in group]).alias("key"), named(value).alias("v")).filter("v IS NOT NULL")
    counts = _written(rows.groupBy("key", "v").agg(F.count(F.lit(1)).alias("n")), "counts")
    slices = -(-counts.count() // slice_rows)
    dealt = counts.withColumn("slice", F.lit(0))
    if slices > 1:
        dealt = _written(counts.repartitionByRange(slices, "key", "v").withColumn("slice", F.spark_partition_id()), "slices")
    totals = dealt.groupBy("key", "slice").agg(F.sum("n").alias("n"))
    place = (F.sum("n").over(Window.partitionBy("key")) - 1) * F.lit(float(share))
    totals = totals.withColumn("place", place)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("key", "slice", "place", before.alias("before"), (before + F.col("n")).alias("upto"))
    near = dealt.join(totals, ["key", "slice"]).filter((F.col("before") <= F.ceil("place")) & (F.col("upto") > F.floor("place")))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("key", "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("last", upto - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    at = lambda x: F.max(F.when(x.between(F.col("first"), F.col("last")), F.col("v")))
    found = near.groupBy("key").agg(at(F.floor("place")).alias("low"), at(F.ceil("place")).alias("high"), F.first("place").alias("place"))
    return found.select("key.*", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))).alias("percentile"))


def range_counts(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, name: str = "n", slice_rows: int = SLICE) -> DataFrame:
    """ranges with the number of points where low <= at <= high, as a column `name`; ranges with a null bound, or low > high, are left out.

    No pair of a point and a range is made: a range has the points up to its high less those below its low.  Values of points and
    bounds are sorted once, in slices of about equal size by ranges of them, and running counts within slices go on from the
    sums of the slices before.  Equal values are counted first, so that none is a slice too large.
    """
    r = ranges.filter(named(low) <= named(high)).select(F.struct(*[named(c) for c in ranges.columns]).alias("range"), named(low).alias("low"), named(high).alias("high"))
    counted = points.select(named(at).alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    # of equal values a low comes before the points, a high after them
    marks = counted.select("v", F.lit(1).alias("side"), "n")
    for side, bound in ((0, "low"), (2, "high")):
        marks = marks.unionByName(r.select(F.col(bound).alias("v"), F.lit(side).alias("side"), F.lit(0).cast("long").alias("n")).distinct())
    marks = _written(marks, "marks")
    slices = max(1, -(-marks.count() // slice_rows))
    dealt = _written(marks.repartitionByRange(slices, "v", "side").withColumn("slice", F.spark_partition_id()), "slices")
    totals = dealt.groupBy("slice").agg(F.sum("n").alias("total"))  # one row a slice
    before = F.sum("total").over(Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")
    within = F.sum("n").over(Window.partitionBy("slice").orderBy("v", "side").rowsBetween(Window.unboundedPreceding, 0))
    upto = dealt.withColumn("within", within).filter("side <> 1").join(totals.select("slice", before.alias("before")), "slice").select("v", "side", (F.col("before") + F.col("within")).alias("upto"))
    below, reached = upto.filter("side = 0").select(F.col("v").alias("low"), F.col("upto").alias("below")), upto.filter("side = 2").select(F.col("v").alias("high"), F.col("upto").alias("reached"))
    return r.join(below, "low").join(reached, "high").select("range.*", (F.col("reached") - F.col("below")).alias(name))


#: Keys of one bitmap of Spark's bitmap functions.
BITMAP = 32_768


def distinct_by_sets(df: DataFrame, group: list[str], value: str, sets: list[list[str]]) -> DataFrame:
    """The group's columns, grouping (a bit for each column that a set leaves out, the last lowest) and distinct: the exact number
    of values of a column of whole numbers in each grouping set; nulls don't count, but a set's row stays without values.

    Spark's own count(DISTINCT) repeats every row for every set.  Here each value is a bit: rows are shuffled once, as
    bitmaps of the finest groups, and coarser sets are unions of these bitmaps, a row for 32,768 neighbouring values.
    Values that are spread thinly over a wide range fill few bits of each bitmap, and should be numbered first.
    """
    v = named(value).cast("long")
    # values from 0 are bits 0 to 32767 of bucket 0, and so on; those below 0 go to buckets below 0
    rows = df.select(*[named(c).alias(f"g{i}") for i, c in enumerate(group)], F.floor(v / BITMAP).alias("bucket"), F.pmod(v, F.lit(BITMAP)).alias("bit"))
    keys = [f"g{i}" for i in range(len(group))]
    finest = rows.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = None
    for chosen in sets:
        kept = [k for k, c in zip(keys, group, strict=True) if c in chosen]
        merged = finest.groupBy(*kept, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        counts = merged.groupBy(*kept).agg(F.coalesce(F.sum(F.when(F.col("bucket").isNotNull(), F.bitmap_count("bits"))), F.lit(0)).alias("distinct"))
        left_out = sum(1 << (len(group) - 1 - i) for i, k in enumerate(keys) if k not in kept)
        columns = [(F.col(k) if k in kept else F.lit(None).cast(df.schema[c].dataType)).alias(c) for k, c in zip(keys, group, strict=True)]
        rows_ = counts.select(*columns, F.lit(left_out).cast("long").alias("grouping"), "distinct")
        out = rows_ if out is None else out.unionByName(rows_)
    return out


def cube_sets(group: list[str]) -> list[list[str]]:
    return [[c for i, c in enumerate(group) if not mask >> i & 1] for mask in range(1 << len(group))]
