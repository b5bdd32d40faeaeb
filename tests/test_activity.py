"""Stateful processors over several batches and restarts."""

import datetime

from tarnwright.streaming import activity
from tarnwright.streaming import events as streams

HOUR = 3_600_000_000
T0 = datetime.datetime(2024, 1, 1)


def step(spark, *rows):
    """Rows (event_id, user, hour, kind)."""
    return spark.createDataFrame([(i, u, T0 + datetime.timedelta(hours=h), k) for i, u, h, k in rows], "event_id long, user_id long, ts timestamp_ntz, event_type string").repartition(2)


def told(df):
    base = int(T0.timestamp() * 1e6)
    return sorted((r.user_id, r.what, (r["at"] - base) / HOUR if r.what == "pause" else r["at"], r.n, r.kinds) for r in df.collect())


def test_pauses_timers_and_late_rows(spark):
    steps = [
        step(spark, (1, 1, 0, "a"), (2, 1, 2, "b"), (3, 1, 10, "a"), (4, 2, 1, "a"), (5, 2, 3, "a")),  # a pause of user 1 within a batch
        step(spark, (6, 3, 20, "c")),  # the watermark passes the pauses of users 1 and 2
        step(spark, (7, 1, 5, "z"), (8, 2, 30, "b"), (9, 1, 21, "a")),  # event 7 is late; user 1 paused after hour 10
        step(spark, (10, 4, 100, "a")),
        step(spark, (11, 4, 101, "a"), (12, 2, 31, "a")),  # event 12 is late
    ]
    with activity.rocks(spark):
        out = streams.in_steps(steps, lambda rows: activity.pauses(rows, 4 * HOUR), "append", "1 hour")
    assert told(out) == [
        (1, "late", 7, None, None), (1, "pause", 2.0, 2, 2), (1, "pause", 10.0, 1, 1), (1, "pause", 21.0, 1, 1),
        (2, "late", 12, None, None), (2, "pause", 3.0, 2, 1), (2, "pause", 30.0, 1, 1), (3, "pause", 20.0, 1, 1),
    ]


def test_first_seen_and_expiry(spark):
    steps = [step(spark, (1, 1, 0, "a"), (1, 1, 0, "a"), (2, 1, 2, "b")), step(spark, (2, 1, 2, "b"), (3, 1, 3, "b"))]
    with activity.rocks(spark):
        kept = streams.in_steps(steps, lambda rows: activity.first_seen(rows, 3_600_000), "append", once=True)
        assert sorted(r.event_id for r in kept.collect()) == [1, 2, 3]
        short = streams.in_steps([*steps, steps[0]], lambda rows: activity.first_seen(rows, 1), "append", once=True)  # gone by the next step
        assert sorted(r.event_id for r in short.collect()) == [1, 1, 2, 2, 2, 3]


def test_keys_of_a_bucket_expire_one_by_one():
    """A call takes a whole bucket; a key goes by the time that it was seen last itself."""
    import types

    import pandas as pd

    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, x):
            self.held = x

    first, value = activity._First(100), Value()
    first.init(types.SimpleNamespace(getValueState=lambda *_: value))

    def fresh(now, *batches):
        at = types.SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now)
        return [i for out in first.handleInputRows((0,), iter([pd.DataFrame({"event_id": b}) for b in batches]), at) for i in out["event_id"]]

    assert fresh(0, [3, 1, 3], [1, 2]) == [1, 2, 3]
    assert fresh(60, [2, 4]) == [4]
    assert fresh(99, [1]) == []
    assert fresh(110, [1, 2, 3, 4]) == [3]  # 3 was last seen at 0, the others at 99, 60 and 60
    assert fresh(300, [4]) == [4] and len(value.held[0]) == 8  # what has expired takes no room


def test_users_of_a_bucket_share_a_timer():
    """One timer for all users of a bucket, always at the first end; whom it doesn't end stays."""
    import types

    import pandas as pd

    timers, held = set(), []

    def put(rows):
        held[:] = rows

    since = types.SimpleNamespace(get=lambda: iter(held), put=put, clear=held.clear)
    handle = types.SimpleNamespace(getListState=lambda *_: since, registerTimer=timers.add, deleteTimer=timers.remove)
    pauses = activity._Pauses(10_000)
    pauses.init(handle)
    at = lambda ms: types.SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    batch = lambda *rows: iter([pd.DataFrame(rows, columns=["user_id", "event_id", "event_type", "at"])])
    told = lambda frames: [tuple(None if pd.isna(x) else x for x in r) for f in frames for r in f.itertuples(index=False)]

    assert told(pauses.handleInputRows((0,), batch((1, 1, "a", 0), (2, 2, "a", 5_000), (2, 3, "b", 15_000), (3, 4, "a", 90_000)), at(0))) == [] and timers == {11}
    timers.clear()  # Spark takes a timer away once it was told
    assert told(pauses.handleExpiredTimer((0,), at(20), None)) == [(1, "pause", 0, 1, 1)] and timers == {26}
    # the watermark is past user 2, who isn't in the batch; event 5 is late
    assert told(pauses.handleInputRows((0,), batch((3, 5, "a", 29_000), (3, 6, "c", 95_000)), at(30))) == [(3, "late", 5, None, None), (2, "pause", 15_000, 2, 2)]
    assert timers == {106} and held == [(3, 95_000, 2, ["a", "c"])]
    timers.clear()
    assert told(pauses.handleExpiredTimer((0,), at(106), None)) == [(3, "pause", 95_000, 2, 2)] and not timers and not held
