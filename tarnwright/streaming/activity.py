"""Stateful processors with several state variables, timers, expiry and a side output."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Buckets that keys are dealt to by their hash; those of a bucket share a state, and a call of the processor in each batch.
BUCKETS = 4_096

PAUSES = "user_id long, what string, at long, n long, kinds long"


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """While it lasts, streams that start keep state in RocksDB, which these processors need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _Pauses(StatefulProcessor):
    """State of a bucket of users: of each with events since the last pause, the time of the last, their number and kinds; a timer at the
    first end of a pause."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getListState("since", "user_id long, last long, n long, kinds array<string>")

    def _load(self) -> dict:
        return {user: (last, n, set(kinds)) for user, last, n, kinds in self.since.get()}

    def _keep(self, users: dict) -> None:
        if users:
            self.since.put([(user, last, n, sorted(kinds)) for user, (last, n, kinds) in users.items()])
        else:
            self.since.clear()

    def _end(self, last: int) -> int:
        return -(-(last + self.gap + 1) // 1000)

    def _timer(self, users: dict) -> int | None:
        return min((self._end(last) for last, _, _ in users.values()), default=None)

    def _ended(self, users: dict, watermark: int) -> list[tuple]:
        """The pauses whose end the watermark has passed; their users go."""
        gone = [user for user, (last, _, _) in users.items() if self._end(last) <= watermark]
        return [_paused(user, *users.pop(user)) for user in gone]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        batch = pd.concat(rows).sort_values(["at", "event_id"], kind="stable")
        late = batch["at"].to_numpy() < watermark * 1000
        told, events = batch[late], batch[~late]
        out = [(user, "late", i, None, None) for user, i in zip(told["user_id"].tolist(), told["event_id"].tolist(), strict=True)]
        users = self._load()
        before = self._timer(users)
        out += self._ended(users, watermark)  # so that no timer is set at a time that has passed
        for user, at, kind in zip(events["user_id"].tolist(), events["at"].tolist(), events["event_type"], strict=True):
            last, n, kinds = users.get(user, (at, 0, set()))
            if at - last > self.gap:
                out.append(_paused(user, last, n, kinds))
                n, kinds = 0, set()
            if kind is not None:
                kinds.add(kind)
            users[user] = (at, n + 1, kinds)
        self._keep(users)
        after = self._timer(users)
        if after != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        users = self._load()
        out = self._ended(users, timerValues.getCurrentWatermarkInMs())
        self._keep(users)
        after = self._timer(users)
        if after is not None:
            self.handle.registerTimer(after)
        yield _frame(out)

    def close(self) -> None:
        pass


def _paused(user: int, last: int, n: int, kinds: set[str]) -> tuple:
    return (user, "pause", last, n, len(kinds))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["user_id", "what", "at", "n", "kinds"])
    return out.astype({"user_id": "int64", "what": "object", "at": "int64", "n": "Int64", "kinds": "Int64"})


def pauses(events: DataFrame, gap_us: int, buckets: int = BUCKETS) -> DataFrame:
    """What happens to each user, as rows (user_id, what, at, n, kinds).

    "pause": a user had no event for longer than gap_us after the one at `at` (microseconds), the last of n since the pause
    before, of so many kinds.  It is told once the watermark has passed, or the next event comes.  "late": an event, by its
    event_id in `at`, that came after the watermark had passed its time: it is told instead of dropped, and counts
    nowhere.  events: a stream with a watermark on ts, event_id, user_id and event_type.

    Users share a state by their hash, as in first_seen().
    """
    # a plain number has no watermark, so that Spark drops no late rows before the processor sees them
    narrow = events.select("user_id", "event_id", "event_type", F.unix_micros("ts").alias("at"), F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket"))
    return narrow.groupBy("bucket").transformWithStateInPandas(_Pauses(gap_us), PAUSES, "append", "eventTime")


class _First(StatefulProcessor):
    """State of a bucket of keys: the keys seen, and when, for as long as one of them lives."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "ids binary, at binary", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        ids = np.unique(np.concatenate([np.unique(b["event_id"].to_numpy().astype(np.int64)) for b in rows]))
        held, at = (np.frombuffer(x, np.int64) for x in (self.seen.get() if self.seen.exists() else (b"", b"")))
        lives = at + self.ttl_ms > now
        fresh = ~np.isin(ids, held[lives])
        # what isn't in this batch keeps its time
        stays = lives & ~np.isin(held, ids)
        kept, times = np.concatenate([held[stays], ids]), np.concatenate([at[stays], np.full(len(ids), now, np.int64)])
        self.seen.update((kept.tobytes(), times.tobytes()))
        yield pd.DataFrame({"event_id": ids[fresh]})

    def close(self) -> None:
        pass


def first_seen(events: DataFrame, ttl_ms: int, buckets: int = BUCKETS) -> DataFrame:
    """The event_id of each event that wasn't seen within the last ttl_ms of the cluster's time; a key that isn't seen again goes.

    Keys share a state by their hash, as calls of the processor, and not rows, are what costs time: a batch reads and writes
    the buckets, of 16 bytes a key, that it has keys of.  `buckets` can't change once the stream has begun.
    """
    keys = events.select("event_id", F.pmod(F.xxhash64("event_id"), F.lit(buckets)).alias("bucket"))
    return keys.groupBy("bucket").transformWithStateInPandas(_First(ttl_ms), "event_id long", "append", "processingTime")
