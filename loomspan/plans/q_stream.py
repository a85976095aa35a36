"""Windows and sessions over events, with their SQL twins."""

from __future__ import annotations

from loomspan.plans.base import load, query
from loomspan.streaming import streams as S


@query("events_windowed", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS \"start\", time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_windowed(spark, d):
    """Counts and sums of each hour and kind of event."""
    from pyspark.sql import functions as F

    return S.windowed(load(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("events_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark, d):
    """A user's events less than half an hour apart are one session, which ends half an hour behind its last one."""
    return S.sessions(load(spark, d, "events"))
