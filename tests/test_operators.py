"""Operators on small tables with nulls, ties, repeats and skew."""

import datetime

import pytest
from pyspark.sql import functions as F

from tarnwright.operators import joins, windows
from tarnwright.sources import formats

T0 = datetime.datetime(2024, 1, 1)


def at(hours):
    return T0 + datetime.timedelta(hours=hours)


def test_asof_join_against_a_loop(spark):
    left = [(i, i % 4 if i % 11 else None, at(i * 5 % 97)) for i in range(120)] + [(500, 9, at(3)), (501, 0, None)]
    right = [(i % 4 if i % 7 else None, at(i * 7 % 101), i) for i in range(90)] + [(9, at(4), 1), (0, None, 5)]
    l, r = spark.createDataFrame(left, "id int, k int, t timestamp_ntz"), spark.createDataFrame(right, "k int, t timestamp_ntz, v int")  # noqa: E741
    out = {(x.id): x.v for x in joins.asof_join(l, r, "k", "t", "t", ["v"]).collect()}
    assert len(out) == len(left)
    for i, k, t in left:
        fit = [(u, v) for key, u, v in right if k is not None and t is not None and key == k and u is not None and u <= t]
        assert out[i] == (max(fit)[1] if fit else None)


def test_range_join_against_a_loop(spark):
    points = [(i, i * 3.7 % 100 - 20) for i in range(80)] + [(900, None)]
    ranges = [(i, i * 11.0 % 90 - 20, i * 11.0 % 90 - 20 + i % 13) for i in range(40)] + [(99, 5.0, 1.0), (98, None, 2.0)]
    p, r = spark.createDataFrame(points, "id int, x double"), spark.createDataFrame(ranges, "rid int, a double, b double")
    out = sorted((x.id, x.rid) for x in joins.range_join(p, "x", r, "a", "b", 5.0).collect())
    assert out == sorted((i, j) for i, x in points for j, a, b in ranges if None not in (x, a, b) and a <= x <= b)


def test_range_join_of_very_wide_ranges_and_clashing_names(spark):
    """A range a million times as wide as usual stands in two buckets, not in a million."""
    points = [(i, float(i * 37 % 5_000)) for i in range(300)]
    ranges = [(0, -1e6, 1e6), (1, 100.0, 100.0), (2, 99.5, 130.0), (3, 0.0, 5_000.0)] + [(10 + i, i * 17.0, i * 17.0 + 1) for i in range(100)]
    p = spark.createDataFrame([(*x, 7, 8) for x in points], "id int, at double, level int, `a``b` int")
    r = spark.createDataFrame([(*x, 9) for x in ranges], "rid int, low double, high double, bucket int")
    out = joins.range_join(p, "at", r, "low", "high", 1.0)
    assert out.columns == ["id", "at", "level", "a`b", "rid", "low", "high", "bucket"]
    assert sorted((x.id, x.rid) for x in out.collect()) == sorted((i, j) for i, x in points for j, a, b in ranges if a <= x <= b)
    assert joins.range_join(p, "at", r.filter("false"), "low", "high", 1.0).count() == 0


def test_asof_join_keeps_columns_of_any_name(spark):
    l = spark.createDataFrame([(1, at(3), "a", "b", "c", 5)], "k int, t timestamp_ntz, at string, `key` string, `slice` string, `x``y` int")  # noqa: E741
    r = spark.createDataFrame([(1, at(1), 10, 11), (1, at(2), 20, 21), (1, at(4), 30, 31)], "k int, t timestamp_ntz, `v``w` int, own int")
    (row,) = joins.asof_join(l, r, "k", "t", "t", ["v`w", "own"]).collect()
    assert tuple(row) == (1, at(3), "a", "b", "c", 5, 20, 21)


def test_heavy_join_against_a_plain_one_and_its_tasks(spark):
    rows = [(0 if i % 3 == 0 else i % 701, i, "x") for i in range(30_000)] + [(None, -1, "x")]
    l = spark.createDataFrame(rows, "k int, key int, left string")  # noqa: E741
    r = spark.createDataFrame([(i % 800, i, 1) for i in range(1_600)] + [(None, 9, 9)], "k int, salt int, heavy int")
    out = joins.heavy_join(l, r, "k", parts=16)
    assert out.columns == ["k", "key", "left", "k", "salt", "heavy"]
    got = out.toDF("k", "key", "left", "k2", "salt", "heavy")
    want = l.join(r.withColumnRenamed("k", "k2"), F.col("k") == F.col("k2")).select("k", "key", "left", "k2", "salt", "heavy")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    # dealt to tasks by the join's own hash, the heavy key's rows are spread
    l2 = l.filter("k IS NOT NULL").withColumn("part", F.pmod(F.hash("k", F.when(F.col("k") == 0, F.pmod(F.xxhash64(F.to_json(joins.whole(l))), F.lit(16))).otherwise(0).cast("int")), F.lit(8)))
    sizes = sorted(x["count"] for x in l2.groupBy("part").count().collect())
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]
    assert joins.heavy_join(l.filter("k > 0"), r, "k").count() == l.filter("k > 0").count() * 2
    assert joins.heavy_join(l.filter("false"), r, "k").count() == 0 and joins.heavy_join(l, r.filter("false"), "k").count() == 0


def test_percentile_in_slices_against_numpy(spark):
    import numpy as np

    from tarnwright.operators.aggregates import percentile

    rng = np.random.default_rng(3)
    rows = [("big", float(x)) for x in rng.normal(size=3_000)] + [("ties", float(x % 3)) for x in range(100)] + [("one", 5.0), ("none", None), (None, 1.0), (None, 2.0), ("big", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for share in (0.0, 0.25, 0.5, 0.999, 1.0):
        for slice_rows in (50, 1_000_000):
            out = {r.g: r.percentile for r in percentile(df, ["g"], "v", share, slice_rows).collect()}
            want = {g: float(np.quantile([v for h, v in rows if h == g and v is not None], share)) for g in ("big", "ties", "one", None)}
            assert out.keys() == want.keys() and all(abs(out[g] - want[g]) < 1e-12 for g in want), (share, slice_rows)


def test_distinct_by_sets_against_sets(spark):
    from tarnwright.operators.aggregates import cube_sets, distinct_by_sets

    rows = [(i % 3 if i % 5 else None, "xy"[i % 2], v) for i, v in enumerate([0, 1, 32_767, 32_768, -1, -32_768, -32_769, 1 << 40, -(1 << 40), None] * 9)] + [(7, "z", None)]
    df = spark.createDataFrame(rows, "bucket int, bits string, v long").repartition(3)
    out = {(r.bucket, r.bits, r.grouping): r.distinct for r in distinct_by_sets(df, ["bucket", "bits"], "v", cube_sets(["bucket", "bits"])).collect()}
    want = {}
    for a, b, v in rows:
        for left_out in range(4):
            want.setdefault((a if not left_out & 2 else None, b if not left_out & 1 else None, left_out), set()).update([] if v is None else [v])
    assert out == {k: len(v) for k, v in want.items()}


def test_sketches_keep_their_bounds(spark):
    """Sketches of parts, merged, against exact values: counts within 1 %, quantiles within 1 % of ranks, heavy hitters found."""
    df = spark.range(200_000).selectExpr("id % 50 AS part", "id * 7919 % 1000003 AS v", "CASE WHEN id % 3 = 0 THEN 5 ELSE id % 5000 END AS h")
    parts = df.groupBy("part").agg(F.hll_sketch_agg("v", F.lit(16)).alias("d"), F.kll_sketch_agg_bigint("v").alias("q"), F.expr("approx_top_k_accumulate(h, 10000)").alias("t"))
    out = parts.agg(F.hll_sketch_estimate(F.hll_union_agg("d")).alias("d"), F.kll_sketch_get_quantile_bigint(F.kll_merge_agg_bigint("q"), F.lit(0.9)).alias("q"), F.expr("approx_top_k_estimate(approx_top_k_combine(t, 10000), 1)").alias("t")).first()
    values = sorted(r.v for r in df.select("v").collect())
    assert abs(out.d - 200_000) < 2_000 and abs(sum(v <= out.q for v in values) / len(values) - 0.9) < 0.02
    assert out.t[0]["item"] == 5


def test_a_batch_that_runs_again_leaves_its_rows_once(spark, tmp_path):
    from tarnwright.streaming import events as streams

    for _ in range(2):
        streams.keep(spark.range(5), 0, str(tmp_path / "s"))
    streams.keep(spark.range(3), 1, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 8


def test_several_batches_and_repeated_events(spark, tmp_path):
    from tarnwright.streaming import events as streams

    for n, ids in enumerate([[1, 2, 2], [2, 3], [1, 4, 4]]):
        rows = spark.createDataFrame([(i, at(i), 1) for i in ids], "event_id long, ts timestamp_ntz, user_id long")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = streams.folder(spark, str(tmp_path / "in"), rows.schema, watermark="10 days")
    kept = streams.to_end(events.dropDuplicatesWithinWatermark(["event_id"]).select("event_id"), "append")
    assert sorted(r.event_id for r in kept.collect()) == [1, 2, 3, 4]
    counts = streams.to_end(streams.tumbling(events), "complete")
    assert {r.start: r.n for r in counts.collect()} and counts.agg(F.sum("n")).first()[0] == 8
    state = streams.latest(streams.running_totals(events), lambda r: r.groupBy("user_id").agg(F.max("n").alias("n")))
    assert [tuple(r) for r in state.collect()] == [(1, 8)]


def test_top_per_group_and_sessions(spark):
    df = spark.createDataFrame([(1, 5), (1, 7), (1, 6), (2, 1), (None, 3)], "g int, v int")
    assert sorted((str(r.g), r.v) for r in windows.top_per_group(df, ["g"], [F.desc("v")], 2).collect()) == [("1", 6), ("1", 7), ("2", 1), ("None", 3)]
    ev = spark.createDataFrame([(1, at(0)), (1, at(1)), (1, at(9))], "u int, t timestamp_ntz")
    out = windows.sessions(ev, "u", "t", "2 hours", [F.count(F.lit(1)).alias("n")]).collect()
    assert sorted((r.session_start, r.session_end, r.n) for r in out) == [(at(0), at(1), 2), (at(9), at(9), 1)]


def test_top_per_group_and_sessions_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, 5, "a", "b", 0), (1, 7, "c", "d", 1), (2, 1, "e", "f", 2)], "`g``h` int, __n int, row string, place string, n int")
    out = windows.top_per_group(df, ["g`h"], [F.desc("__n")], 1)
    assert out.columns == df.columns and sorted(tuple(r) for r in out.collect()) == [(1, 7, "c", "d", 1), (2, 1, "e", "f", 2)]
    ev = spark.createDataFrame([(1, at(0), 3), (1, at(1), 4), (1, at(9), 5)], "s int, `window` timestamp_ntz, key int")
    out = windows.sessions(ev, "s", "window", "2 hours", [F.sum("key").alias("total"), F.count(F.lit(1)).alias("last")])
    assert out.columns == ["s", "total", "last", "session_end", "session_start"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, 5, 1, at(9), at(9)), (1, 7, 2, at(1), at(0))]
    clash = ev.withColumnRenamed("s", "session_start")
    with pytest.raises(ValueError):
        windows.sessions(clash, "session_start", "window", "2 hours", [])
    assert sorted(tuple(r) for r in windows.sessions(clash, "session_start", "window", "2 hours", [], start="begin").collect()) == [(1, at(1), at(0)), (1, at(9), at(9))]


def test_formats_refuse_inference(spark, tmp_path):
    with pytest.raises(ValueError):
        formats.read(spark, str(tmp_path), "csv")
    with pytest.raises(ValueError):
        formats.read(spark, str(tmp_path), "xlsx")
    df = spark.createDataFrame([(1, "a,\"b\"\n"), (2, None)], "k int, s string")
    formats.write(df, str(tmp_path / "c"), "csv", multiLine="true")
    back = formats.read(spark, str(tmp_path / "c"), "csv", "k int, s string", multiLine="true")
    assert sorted((r.k, str(r.s)) for r in back.collect()) == [(1, 'a,"b"\n'), (2, "None")]


def test_plans(spark):
    from tarnwright.plans import relational

    def plan(name):
        df = relational.QUERIES[name](spark, "/root/testdata/sf0.001")
        return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    assert "GreaterThan(o_totalprice,400000.0)" in plan("filter_compound") and "o_orderdate" not in plan("filter_compound")
    assert "WindowGroupLimit" in plan("topk_per_group") and "TakeOrderedAndProject" in plan("topk_global")
    for name in ("join_range", "join_asof", "join_four_way_revenue", "subquery_scalar"):
        assert "NestedLoop" not in plan(name) and "Cartesian" not in plan(name)


def test_buckets_join_and_group_without_an_exchange(spark):
    from tarnwright.plans import catalog

    df = catalog.QUERIES["join_bucketed"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_distinct_parts_are_exact_beside_their_sketch(spark, tmp_path):
    """200,000 parts, which a sketch alone counts a few too many or too few; a null flag and null parts too."""
    from tarnwright.plans import catalog

    parts = spark.range(400_000).selectExpr("CASE WHEN id % 4 > 1 THEN 'A' WHEN id % 4 = 1 THEN 'N' END AS l_returnflag", "CASE WHEN id > 9 THEN id div 2 END AS l_partkey", "date_add(DATE'1995-01-01', CAST(id % 3 AS INT)) AS l_shipdate")
    parts.write.parquet(str(tmp_path / "lineitem.parquet"))
    out = {r.l_returnflag: tuple(r)[1:] for r in catalog.QUERIES["agg_approx_distinct"](spark, str(tmp_path)).collect()}
    assert out == {"A": (99_998, True), "N": (99_997, True), None: (99_997, True)}
    out = {r.l_returnflag: r.n for r in catalog.QUERIES["agg_sketch_merge"](spark, str(tmp_path)).collect()}
    assert out == {"A": 99_998, "N": 99_997, None: 99_997}


@pytest.mark.parametrize("slice_rows", [7, 1_000_000])
def test_range_counts_against_a_loop(spark, slice_rows):
    from tarnwright.operators.aggregates import range_counts

    points = [(i, i * 3.7 % 100 - 20) for i in range(80)] + [(i, 5.0) for i in range(50)] + [(900, None), (901, -0.0), (902, 0.0), (903, float("nan"))]
    ranges = [(i, i * 11.0 % 90 - 20, i * 11.0 % 90 - 20 + i % 13) for i in range(40)] + [(99, 5.0, 1.0), (98, None, 2.0), (97, 5.0, 5.0), (97, 5.0, 5.0), (96, 0.0, -0.0), (95, -1e6, 1e6), (94, 500.0, 600.0)]
    p, r = spark.createDataFrame(points, "id int, x double"), spark.createDataFrame(ranges, "v int, low double, `b``c` double")
    out = range_counts(p, "x", r, "low", "b`c", "side", slice_rows)
    assert out.columns == ["v", "low", "b`c", "side"]
    want = [(j, a, b, sum(1 for _, x in points if x is not None and a <= x <= b)) for j, a, b in ranges if None not in (a, b) and a <= b]
    assert sorted(tuple(x) for x in out.collect()) == sorted(want)
    assert range_counts(p.filter("false"), "x", r.filter("v = 95"), "low", "b`c").first().n == 0 and range_counts(p, "x", r.filter("false"), "low", "b`c").count() == 0


def test_counts_by_range_make_no_pairs(spark):
    from tarnwright.plans import catalog

    df = catalog.QUERIES["join_range"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "bucket" not in plan and "Generate" not in plan


def test_buckets_grow_in_number_and_not_in_rows(spark, monkeypatch):
    from tarnwright.plans import catalog
    from tarnwright.sources import bucketed

    assert [bucketed.buckets_for(n) for n in (0, 1, 4_000_000, 4_000_001, 8_000_001, 216_000_000)] == [8, 8, 8, 16, 32, 512]
    monkeypatch.setattr(bucketed, "ROWS", 300)
    df = catalog.QUERIES["join_bucketed"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "32 out of 32" in plan and "Exchange" not in plan
