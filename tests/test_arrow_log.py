"""The source and sink of this library's own."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tarnwright.sources import arrow_log as al

SCHEMA = "k long, s string, x double, t timestamp_ntz, `a b` array<int>, d decimal(12,2)"


@pytest.fixture
def log(spark, tmp_path):
    al.register(spark)
    return str(tmp_path / "log")


def rows(spark, lo, hi):
    base = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, f"s{i:04}" if i % 7 else None, i / 3, base + datetime.timedelta(seconds=i), [i, None], None) for i in range(lo, hi)], SCHEMA).coalesce(4)


def read(spark, log):
    return spark.read.format("arrow_log").schema(SCHEMA).load(log)


def files(log):
    return sorted(f for f in os.listdir(log) if f.endswith(".arrow"))


def test_round_trip_append_overwrite_and_columns(spark, log):
    assert read(spark, log).count() == 0
    rows(spark, 0, 100).write.format("arrow_log").mode("append").save(log)
    rows(spark, 100, 150).write.format("arrow_log").mode("append").save(log)
    assert sorted(map(tuple, read(spark, log).collect()), key=str) == sorted(map(tuple, rows(spark, 0, 150).collect()), key=str)
    assert read(spark, log).select("s", "a b").filter("k = 5").first()[0] == "s0005"
    rows(spark, 0, 0).write.format("arrow_log").mode("append").save(log)
    rows(spark, 7, 9).write.format("arrow_log").mode("overwrite").save(log)
    assert sorted(r.k for r in read(spark, log).collect()) == [7, 8] and len(al.Log(log).numbers()) == 4


def test_a_failed_write_leaves_nothing(spark, log):
    rows(spark, 0, 20).write.format("arrow_log").mode("append").save(log)
    before = files(log)
    bad = rows(spark, 20, 60).withColumn("k", F.when(F.col("k") == 59, F.raise_error(F.lit("no"))).otherwise(F.col("k")).cast("long"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("arrow_log").mode("append").save(log)
    assert read(spark, log).count() == 20
    al.Log(log).vacuum(0)  # of a task that ended after the write was given up
    assert files(log) == before
    # a file that no record names, as a lost task leaves one, isn't read
    with open(f"{log}/stray.arrow", "wb") as f, open(f"{log}/{before[0]}", "rb") as g:
        f.write(g.read())
    assert read(spark, log).count() == 20


def test_filters_choose_files(spark, log):
    rows(spark, 0, 400).write.format("arrow_log").mode("append").save(log)
    reader = al.Reader(log, read(spark, log).schema)
    assert len(reader.partitions()) == 4
    for test, n in ((al.ds.EqualTo(("k",), 150), 1), (al.ds.GreaterThanOrEqual(("k",), 300), 1), (al.ds.LessThan(("k",), 0), 0), (al.ds.In(("s",), ("s0001", "s0398")), 2), (al.ds.EqualTo(("x",), 1.0), 4)):
        assert [*reader.pushFilters([test])] == [test] and len(reader.partitions()) == n, test
    assert read(spark, log).filter("k > 298 AND k < 302").count() == 3 and read(spark, log).filter("s = 's0001'").count() == 1
    assert read(spark, log).filter("s IS NULL").count() == 58
    assert read(spark, log).rdd.getNumPartitions() == 4


def test_stream_of_records_with_a_restart_and_a_repeated_batch(spark, log, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = spark.readStream.format("arrow_log").schema(SCHEMA).load(log).writeStream.format("arrow_log")
        stream.option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()

    rows(spark, 0, 30).write.format("arrow_log").mode("append").save(log)
    run()
    rows(spark, 30, 50).write.format("arrow_log").mode("append").save(log)
    run()
    run()
    assert sorted(r.k for r in read(spark, out).collect()) == list(range(50))
    kept = al.Log(out)
    last = kept.record(kept.numbers()[-1])
    kept.add(last["files"], False, last["batch"])  # the batch's commit comes again
    assert read(spark, out).count() == 50
    with pytest.raises(Exception, match="needs a schema"):
        spark.read.format("arrow_log").load(log)
