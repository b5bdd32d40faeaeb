"""Lines that fit a schema, and those that don't."""

import pytest
from pyspark.sql import types as T

from tarnwright.sources import formats

SCHEMA = T.StructType().add("k", T.IntegerType()).add("_line", T.StringType()).add("x", T.DoubleType()).add("t", T.TimestampNTZType())


def test_csv_lines(spark, tmp_path):
    lines = ['1,"a,""b""",2.5,2024-01-02 03:04:05', "2,b,,", "3,c,1", "4,d,1,2024-01-02,5", "five,e,1,", "99999999999,f,1,", "7,g,1,never", "", "  ", "k,_line,x,t"]
    (tmp_path / "a.csv").write_text("\n".join(["k,_line,x,t", *lines]))
    (tmp_path / "b.csv").write_text("8,h,1e3,")
    out = formats.quarantine(spark, str(tmp_path), "csv", SCHEMA, header=True)
    assert out.rows.columns == SCHEMA.names and sorted((r[0], r[1], r[2]) for r in out.rows.collect()) == [(1, 'a,"b"', 2.5), (2, "b", None), (8, "h", 1000.0)]
    refused = {r.line: (r.reason, r.file.rsplit("/", 1)[1]) for r in out.refused.collect()}
    assert refused == {lines[2]: ("columns", "a.csv"), lines[3]: ("columns", "a.csv"), lines[4]: ("type", "a.csv"), lines[5]: ("type", "a.csv"), lines[6]: ("type", "a.csv")}


def test_json_lines(spark, tmp_path):
    lines = ['{"k":1,"_line":"a","x":2}', '{"k":2}', '{"k":3,"new":[1]}', '{"k":"four"}', '{"k":5', "[6]", "7", '{"k":99999999999}', '{"k":null,"x":null}']
    (tmp_path / "a.json").write_text("\n".join(lines))
    out = formats.quarantine(spark, str(tmp_path), "json", SCHEMA)
    assert sorted((str(r[0]), r[1], r[2]) for r in out.rows.collect()) == [("1", "a", 2.0), ("2", None, None), ("3", None, None), ("None", None, None)]
    assert {r.line: r.reason for r in out.refused.collect()} == {lines[3]: "type", lines[4]: "json", lines[5]: "json", lines[6]: "json", lines[7]: "type"}
    with pytest.raises(ValueError):
        formats.quarantine(spark, str(tmp_path), "orc", SCHEMA)
