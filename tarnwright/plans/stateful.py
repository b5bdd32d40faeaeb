"""Queries on streams with stateful processors; each beside the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwright.functions.types import ntz
from tarnwright.plans.relational import late_steps, query
from tarnwright.sources.scratch import table
from tarnwright.streaming import activity
from tarnwright.streaming import events as streams

LATE = "(event_id % 10 = 0 AND ts < (SELECT min(ts) + INTERVAL 7 DAY FROM events))"


@query(f"""SELECT user_id, 'pause' AS what, max(ts) AS at, CAST(NULL AS BIGINT) AS event_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT event_type) AS BIGINT) AS kinds
FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE NOT {LATE})) GROUP BY user_id, s
UNION ALL SELECT user_id, 'late', NULL, event_id, NULL, NULL FROM events WHERE {LATE}""")
def stream_pauses(spark, sf_dir):
    # the event that ends the stream begins a time of its own, of which no pause is told
    steps = late_steps(table(spark, sf_dir, "events"))
    with activity.rocks(spark):
        told = streams.in_steps(steps, lambda rows: activity.pauses(rows, 12 * 3_600_000_000), "append", "1 hour")
    late = F.col("what") == "late"
    return told.select("user_id", "what", F.when(~late, ntz(F.timestamp_micros("at"))).alias("at"), F.when(late, F.col("at")).alias("event_id"), "n", "kinds")


@query("SELECT event_id FROM events UNION SELECT -1")
def stream_first_seen(spark, sf_dir):
    # every event comes again in the step after its own
    steps = late_steps(table(spark, sf_dir, "events"))
    twice = [a if b is None else a.unionByName(b) for a, b in zip(steps, [None, *steps], strict=False)]
    with activity.rocks(spark):
        return streams.in_steps(twice, lambda rows: activity.first_seen(rows, 86_400_000), "append", once=True)
