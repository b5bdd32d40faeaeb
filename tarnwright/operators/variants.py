"""JSON of any shape as VARIANT: which paths a column has and of what types, and typed columns from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwright.operators.joins import named, whole

#: Paths that a schema has at most by default; rows beyond it are an error, not dropped.
PATHS = 1_000


def parsed(text: Column) -> Column:
    """A text as VARIANT; null where it is null or no JSON."""
    return F.try_parse_json(text)


def kind(v: Column) -> Column:
    """The JSON type of a variant: object, array, string, number, whole, boolean or null; null of no variant."""
    name = F.schema_of_variant(v)
    whole_, real = name.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), name.startswith("DECIMAL") | name.isin("DOUBLE", "FLOAT")
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(whole_, "whole")
        .when(real, "number").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").when(name.isNotNull(), "other")
    )


def _members(rows: DataFrame) -> DataFrame:
    """path, v of every member of the objects in rows (path, v), one level down.  Names with other characters than letters, digits and _ are quoted."""
    objects = rows.filter(F.schema_of_variant("v").startswith("OBJECT"))
    entries = objects.select("path", F.explode(F.map_entries(F.variant_get("v", "$", "map<string, variant>"))).alias("e"))
    plain = F.col("e.key").rlike("^[A-Za-z_][0-9A-Za-z_]*$")
    step = F.when(plain, F.concat(F.lit("."), F.col("e.key"))).otherwise(F.concat(F.lit("['"), F.col("e.key"), F.lit("']")))
    return entries.select(F.concat("path", step).alias("path"), F.col("e.value").alias("v"))


def schema(rows: DataFrame, column: str, depth: int = 3) -> DataFrame:
    """path, kind, n: how many rows have a value of each kind at each path of their objects, down to `depth` members; $ is the
    whole value.  Rows whose text is null or no JSON count at $ with the kind null.

    Counts are sums of tasks' counts, so schemas of parts merge: merged().
    """
    level = rows.select(F.lit("$").alias("path"), parsed(named(column)).alias("v"))
    every = level.select("path", kind(F.col("v")).alias("kind"))
    for _ in range(depth):
        level = _members(level)
        every = every.unionByName(level.select("path", kind(F.col("v")).alias("kind")))
    return every.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


def merged(*schemas: DataFrame) -> DataFrame:
    """The schema of all rows from those of parts of them."""
    every = schemas[0]
    for s in schemas[1:]:
        every = every.unionByName(s)
    return every.groupBy("path", "kind").agg(F.sum("n").alias("n"))


#: The type of a column whose values are of one kind, or of kinds that this type holds without loss.
_TYPES = [("bigint", {"whole"}), ("double", {"whole", "number"}), ("boolean", {"boolean"}), ("string", {"string"})]


def columns(schema_: DataFrame, most: int = PATHS) -> dict[str, str]:
    """The type of each path that some row has a plain value at: bigint, double, boolean or string; of values of several kinds,
    variant.  More paths than `most` are an error: what has names without end is no schema, but data."""
    rows = schema_.filter("path <> '$' AND kind NOT IN ('object', 'null')").groupBy("path").agg(F.collect_set("kind").alias("kinds")).orderBy("path").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} paths")
    return {r.path: next((t for t, kinds in _TYPES if set(r.kinds) <= kinds), "variant") for r in rows}


def typed(rows: DataFrame, column: str, types: dict[str, str]) -> DataFrame:
    """rows and a struct `typed` with a field for each path, without its $ and dot: its value, or null where the path is missing,
    holds another type, or the row no JSON; and `sound`, whether it holds any.  Columns of rows keep their names, whatever
    these are, in the struct `row`."""
    v = F.col("v")
    fields = [F.try_variant_get(v, path, kind_).alias(path[1:].lstrip(".")) for path, kind_ in types.items()]
    out = rows.select(whole(rows).alias("row"), parsed(named(column)).alias("v"))
    return out.select("row", (F.struct(*fields) if fields else F.lit(None)).alias("typed"), v.isNotNull().alias("sound"))
