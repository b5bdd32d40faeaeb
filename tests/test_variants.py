"""Schemas and typed columns of JSON of any shape."""

import pytest
from pyspark.sql import functions as F

from tarnwright.operators import variants as va

ROWS = ['{"a":1,"b":{"c":"x","d":[1,2]}}', '{"a":2.5,"b":{"c":"y","e":{"f":{"g":1}}}}', '{"a":true,"sp ace":1}', '{"a":null,"h":7}', "[1]", '"text"', "3", "null", None, "", "{", '{"b":5}', '{"n":9007199254740993}']


def test_schema_types_and_columns(spark):
    df = spark.createDataFrame([(i, j, "r") for i, j in enumerate(ROWS)], "id int, v string, row string").repartition(3)
    schema = va.schema(df, "v", depth=3)
    found = {(r.path, r.kind): r.n for r in schema.collect()}
    assert found[("$", "object")] == 6 and found[("$", None)] == 3 and found[("$", "null")] == 1 and found[("$", "array")] == found[("$", "string")] == found[("$", "whole")] == 1
    assert found[("$.a", "whole")] == found[("$.a", "number")] == found[("$.a", "boolean")] == found[("$.a", "null")] == 1
    assert found[("$.b", "object")] == 2 and found[("$.b.d", "array")] == 1 and found[("$['sp ace']", "whole")] == 1 and found[("$.b.e.f", "object")] == 1
    assert not any(p == "$.b.e.f.g" for p, _ in found)  # four members down
    halves = [va.schema(df.filter(F.col("id") % 2 == i), "v") for i in range(2)]
    assert {(r.path, r.kind): r.n for r in va.merged(*halves).collect()} == found
    types = va.columns(schema)
    assert types == {"$.a": "variant", "$.b": "bigint", "$.b.c": "string", "$.b.d": "variant", "$['sp ace']": "bigint", "$.h": "bigint", "$.n": "bigint"}
    out = {r.row.id: r for r in va.typed(df, "v", types).select("row", "sound", F.col("typed")["b.c"].alias("c"), F.col("typed")["b"].alias("b"), F.col("typed")["n"].alias("n"), F.col("typed")["['sp ace']"].alias("s")).collect()}
    assert [out[i].sound for i in range(len(ROWS))] == [True] * 8 + [False] * 3 + [True] * 2
    assert (out[0].c, out[0].b, out[11].b, out[12].n, out[2].s, out[4].c) == ("x", None, 5, 9007199254740993, 1, None) and out[3].row.row == "r"
    with pytest.raises(ValueError):
        va.columns(schema, most=3)
    assert va.columns(va.schema(df.filter("false"), "v")) == {} and va.typed(df, "v", {}).count() == len(ROWS)
