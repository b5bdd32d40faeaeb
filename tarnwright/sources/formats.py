"""Reading and writing files by format; a schema is given, or inferred where that is asked for."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwright.sources.scratch import scratch_path

FORMATS = ("parquet", "orc", "json", "csv", "text")
#: A header, quotes doubled as in RFC 4180, and spaces kept.
CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read(spark: SparkSession, path: str, fmt: str, schema: T.StructType | str | None = None, infer: float | None = None, **options: str) -> DataFrame:
    """A file or folder as a DataFrame.

    csv and json need a schema, so that no pass over the data is spent on one, or `infer`: the share of rows that the
    schema is inferred from.  A value of another type than inferred is null, or for csv fails the query (ANSI).
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    if fmt in ("csv", "json") and schema is None:
        if infer is None:
            raise ValueError(f"{fmt} needs a schema, or a share of rows to infer it from")
        options = {"inferSchema": "true", "samplingRatio": str(infer)} | options
    reader = spark.read.format(fmt).options(**(CSV if fmt == "csv" else {}) | options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, fmt: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists", **options: str) -> None:
    """Writes df; with partition columns, rows meet by them first so that each folder gets few files, in parts that Spark may split."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    out = df.hint("rebalance", *partition_by) if partition_by else df
    out.write.format(fmt).options(**(CSV if fmt == "csv" else {}) | options).partitionBy(*partition_by).mode(mode).save(path)


class Sorted(NamedTuple):
    rows: DataFrame  # the schema's columns
    refused: DataFrame  # file, line, reason


def quarantine(spark: SparkSession, path: str, fmt: str, schema: T.StructType, header: bool = False) -> Sorted:
    """The lines of csv or json files as typed rows, and those that don't fit apart, with the file they stand in and why:
    "columns" (csv: more or fewer than the schema), "json" (no JSON object), or "type" (a value of another type, or too wide).

    The files are read once and the lines kept, typed, in the shared folder; each line is in one of the two, empty ones and, with
    header, lines that equal the schema's names are in neither.  A JSON object may lack columns, which are null, and have more,
    which are left out.  A value doesn't run over lines.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"no lines to sort in {fmt!r}")
    whole = "_line" + "_" * sum(n.startswith("_line") for n in schema.names)
    wide = T.StructType([*schema.fields, T.StructField(whole, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": whole}
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).filter("trim(line) <> ''")
    if fmt == "csv":
        if header:
            lines = lines.filter(F.col("line") != ",".join(schema.names))
        options |= {k: v for k, v in CSV.items() if k != "header"}
        strings = T.StructType([*(T.StructField(n, T.StringType()) for n in schema.names), wide[-1]])
        typed = F.from_csv("line", _ddl(wide), options)
        reason = F.when(F.from_csv("line", _ddl(strings), options)[whole].isNotNull(), "columns").otherwise("type")
    else:
        typed = F.from_json("line", wide, options)
        reason = F.when(F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False)), "type").otherwise("json")
    read = lines.select("file", "line", typed.alias("row")).withColumn("reason", F.when(F.col("row").isNull() | F.col("row")[whole].isNotNull(), reason))
    kept = scratch_path(spark, "lines")
    read.select("file", F.when(F.col("reason").isNotNull(), F.col("line")).alias("line"), F.when(F.col("reason").isNull(), F.col("row")).alias("row"), "reason").write.parquet(kept)
    every = spark.read.parquet(kept)
    names = [F.col("row").getField(n).alias(n) for n in schema.names]
    return Sorted(every.filter("reason IS NULL").select(*names), every.filter("reason IS NOT NULL").select("file", "line", "reason"))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
