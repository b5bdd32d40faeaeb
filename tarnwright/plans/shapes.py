"""Queries on semi-structured values and on files as they come; each beside the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwright.functions.types import big, dbl, money
from tarnwright.operators import variants
from tarnwright.plans.relational import query
from tarnwright.sources import arrow_log, bucketed, formats
from tarnwright.sources.scratch import scratch_path

# --- JSON of several shapes: props as it is, wrapped, in a list, with more members, and cut off

SHAPES = """SELECT event_id, CASE CAST(event_id % 6 AS INTEGER) WHEN 1 THEN '{"k":' || event_id || ',"at":{"type":"' || event_type || '","value":' || CAST(round(value, 1) AS VARCHAR) || '}}'
WHEN 2 THEN '[' || props || ']' WHEN 3 THEN '{"k":"' || event_type || '","new":true}' WHEN 4 THEN substr(props, 1, length(props) - 1) WHEN 5 THEN NULL ELSE props END AS j FROM events"""


def _shapes(events: DataFrame) -> DataFrame:
    return events.selectExpr(*_columns())


def _columns() -> list[str]:
    case = SHAPES.removeprefix("SELECT event_id, ").removesuffix(" FROM events").replace("AS VARCHAR", "AS STRING")
    return ["event_id", case]


VARIANT_TYPED = f"""SELECT event_id, coalesce(json_valid(j), false) AS sound, CASE WHEN json_valid(j) THEN CASE WHEN json_type(j) = 'OBJECT' THEN json_extract_string(j, '$.k') END END AS k,
CASE WHEN json_valid(j) THEN json_extract_string(j, '$.at.type') END AS at_type, CASE WHEN json_valid(j) THEN CAST(json_extract_string(j, '$.at.value') AS DOUBLE) END AS at_value,
CASE WHEN json_valid(j) THEN CAST(json_extract_string(j, '$.new') AS BOOLEAN) END AS fresh FROM ({SHAPES})"""


@query(VARIANT_TYPED)
def variant_typed(events):
    shapes = _shapes(events)
    # k holds numbers and strings, so its column stays a variant
    types = variants.columns(variants.schema(shapes, "j"))
    out = variants.typed(shapes, "j", types)
    return out.select("row.event_id", "sound", F.col("typed.k").cast("string").alias("k"), F.col("typed")["at.type"].alias("at_type"), F.col("typed")["at.value"].alias("at_value"), F.col("typed.new").alias("fresh"))


VARIANT_SCHEMA = f"""WITH j AS (SELECT CASE WHEN json_valid(j) THEN CAST(j AS JSON) END AS j FROM ({SHAPES})),
m AS (SELECT '$' AS path, j AS v FROM j UNION ALL SELECT '$.' || k, json_extract(j, '$.' || k) FROM j, (VALUES ('k'), ('at'), ('new'), ('at.type'), ('at.value')) AS t(k) WHERE json_extract(j, '$.' || k) IS NOT NULL)
SELECT path, CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'whole' WHEN 'BIGINT' THEN 'whole' WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' END AS kind,
CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1, 2"""


@query(VARIANT_SCHEMA)
def variant_schema(events):
    # the schemas of two halves, merged
    shapes = _shapes(events)
    halves = [variants.schema(shapes.filter(F.col("event_id") % 2 == i), "j") for i in range(2)]
    return variants.merged(*halves).select("path", F.when(F.col("kind") == "whole", "whole").otherwise(F.col("kind")).alias("kind"), big("n").alias("n"))


# --- a source and sink of this library's own

ORDERS = "SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderdate FROM orders"


def _orders(spark, orders: DataFrame) -> tuple[str, DataFrame]:
    """Orders written in two commits."""
    arrow_log.register(spark)
    path, rows = scratch_path(spark, "arrow-log"), orders.select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    for i in range(2):
        rows.filter(F.col("o_orderkey") % 2 == i).write.format("arrow_log").mode("append").save(path)
    return path, rows


@query(ORDERS + " WHERE o_orderkey BETWEEN 100 AND 900")
def source_arrow_log(spark, orders):
    path, rows = _orders(spark, orders)
    return spark.read.format("arrow_log").schema(rows.schema).load(path).filter("o_orderkey BETWEEN 100 AND 900")


@query(ORDERS)
def stream_arrow_log(spark, orders):
    # read as a stream, written as a stream, read again
    path, rows = _orders(spark, orders)
    out = scratch_path(spark, "arrow-log")
    read = spark.readStream.format("arrow_log").schema(rows.schema).load(path)
    read.writeStream.format("arrow_log").option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.format("arrow_log").schema(rows.schema).load(out)


# --- files with lines that don't fit

BROKEN = """SELECT c_custkey, CASE CAST(c_custkey % 10 AS INTEGER) WHEN 3 THEN concat_ws(',', c_custkey, c_name, 'many') WHEN 5 THEN concat_ws(',', c_custkey, c_name) WHEN 7 THEN concat_ws(',', c_custkey, c_name, c_nationkey, 'more')
WHEN 9 THEN concat_ws(',', c_custkey, c_name, 99999999999) ELSE concat_ws(',', c_custkey, c_name, c_nationkey) END AS line FROM customer"""
QUARANTINE = f"""SELECT CASE WHEN c_custkey % 10 IN (3, 5, 7, 9) THEN NULL ELSE c_custkey END AS c_custkey, CASE WHEN c_custkey % 10 IN (3, 5, 7, 9) THEN line END AS line,
CASE CAST(c_custkey % 10 AS INTEGER) WHEN 3 THEN 'type' WHEN 9 THEN 'type' WHEN 5 THEN 'columns' WHEN 7 THEN 'columns' END AS reason FROM ({BROKEN})"""


@query(QUARANTINE)
def source_csv_quarantine(spark, customer):
    path = scratch_path(spark, "broken")
    case = BROKEN.removeprefix("SELECT c_custkey, ").removesuffix(" FROM customer").removesuffix(" AS line")
    customer.selectExpr(f"{case} AS value").write.text(path)
    found = formats.quarantine(spark, path, "csv", T.StructType().add("c_custkey", T.LongType()).add("c_name", T.StringType()).add("c_nationkey", T.IntegerType()))
    good = found.rows.select("c_custkey", F.lit(None).cast("string").alias("line"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(found.refused.select(F.lit(None).cast("bigint").alias("c_custkey"), "line", "reason"))


# --- buckets


@query("""SELECT o_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS price, CAST(count(*) AS BIGINT) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def join_bucketed(orders, lineitem):
    n = bucketed.buckets_for(max(orders.count(), lineitem.count()))
    o = bucketed.bucketed(orders.select("o_orderkey"), ["o_orderkey"], n)
    l = bucketed.bucketed(lineitem.select("l_orderkey", "l_extendedprice"), ["l_orderkey"], n)  # noqa: E741
    # both sides meet, and are added up, in their buckets
    met = o.hint("merge").join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    return met.groupBy("o_orderkey").agg(dbl(F.sum(money("l_extendedprice"))).alias("price"), F.count(F.lit(1)).alias("n"))
