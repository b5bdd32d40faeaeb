"""State of many keys: where it is kept, in how many partitions, and in how many batches."""

import datetime

import pytest

from tarnwright.plans.relational import QUERIES
from tarnwright.streaming import events as streams

SETTINGS = ["spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"]


def test_dedup_keeps_its_keys_on_disk_and_runs_a_batch_a_step(spark, tmp_path, monkeypatch):
    T0 = datetime.datetime(2024, 1, 1)
    rows = [(i, T0 + datetime.timedelta(hours=i), 1, "ab"[i % 2]) for i in range(700)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    batches, keep = [], streams.keep

    def seen(batch, number, path):
        batches.append((batch.columns, [batch.sparkSession.conf.get(k) for k in SETTINGS[:2]]))
        keep(batch, number, path)

    monkeypatch.setattr(streams, "keep", seen)
    monkeypatch.setattr(streams, "STATE_KEYS", 100, raising=False)
    before = [spark.conf.get(k) for k in SETTINGS]
    out = QUERIES["stream_dedup"](spark, str(tmp_path))
    assert sorted((r.event_id, r.event_type) for r in out.collect()) == [(i, k) for i, _, _, k in rows]
    assert len(batches) == 5  # one for each step
    assert all(parts == "7" and "RocksDB" in provider for _, (parts, provider) in batches)
    assert [spark.conf.get(k) for k in SETTINGS] == before


@pytest.mark.parametrize(("keys", "parts"), [(0, 4), (500_000, 4), (2_000_001, 5), (36_000_000, 72)])
def test_partitions_of_state_follow_the_number_of_keys(spark, keys, parts):
    with streams.state_on_disk(spark, keys) as found:
        assert found == parts
