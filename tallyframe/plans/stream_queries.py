"""Streams run over what there is; the results equal the batch results on the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import health
from tallyframe.plans.catalog import register
from tallyframe.plans.events import BREAKER, DEBOUNCE
from tallyframe.session import read_table, scratch_path
from tallyframe.streaming import stateful, streams


def r_stream_dedup(spark, d):
    return streams.run_available(streams.first_of_key(streams.read_events(spark, d), ["user_id", "event_type"], late="365 days").select("user_id", "event_type"))


def r_stream_windows(spark, d):
    return streams.run_available(streams.windowed_counts(streams.read_events(spark, d), F.col("event_type") == "error", ["event_type"], "1 day", late="1 hour"))


def r_stream_sliding(spark, d):
    return streams.run_available(streams.windowed_counts(streams.read_events(spark, d), F.col("event_type") == "error", ["user_id"], "2 days", "1 day", late="1 hour"))


def r_stream_sessions(spark, d):
    return streams.run_available(streams.sessions(streams.read_events(spark, d), ["user_id"], "6 hours", late="1 hour"))


def r_stream_debounce(spark, d):
    alerts = streams.read_events(spark, d).filter("event_type = 'error'").select("user_id", "ts")
    return streams.run_available(streams.debounced(alerts, "user_id", seconds=6 * 3600.0))


def r_stream_sync(spark, d):
    """Event values as prices per user and type, against those of the first day."""
    known = read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).filter("ts < '2024-01-02'")
    known = known.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    out = scratch_path(spark, "stream-sync")
    streams.run_available(streams.read_events(spark, d).filter("ts >= '2024-01-02'"), each=streams.sync_batches(known, out, ["user_id", "event_type"], "value", ["ts", "event_id"], 0.01))
    return spark.read.parquet(out)


def r_stream_breaker(spark, d):
    events = streams.read_events(spark, d).withColumn("failed", F.col("event_type").isin("error", "view"))
    return streams.run_available(streams.breaker_states(events, "user_id", "failed", health.BreakerRules(3, 6 * 3600.0, 2)))


def r_stream_health(spark, d):
    return streams.run_available(streams.stream_health(streams.read_events(spark, d), F.col("event_type") == "error", ["event_type"], late="1 hour"))


def r_stream_delistings(spark, d):
    """Users not seen for a day. A stream that only runs over what there is ends with its last batch, so that those
    whose day is over before the last event less the watermark's delay are told."""
    return streams.run_available(streams.delistings(streams.read_events(spark, d), "user_id", 1, late="1 hour"))


def r_stream_monitor(spark, d):
    """Health of each user after each event, and the silences of more than twelve hours."""
    with stateful.rocksdb_state(spark):
        return streams.run_available(stateful.monitored(streams.read_events(spark, d), "user_id", F.col("event_type") == "error", 12 * 3600.0, late="1 hour"))


#: What the watermark has passed when the stream ends.
_DONE = "(SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL 1 HOUR FROM events)"
_COUNTS = "count(*) AS n_rows, count(CASE WHEN event_type = 'error' THEN 1 END) AS n_failed, CAST(count(CASE WHEN event_type = 'error' THEN 1 END) AS DOUBLE) / count(*) AS error_rate"
_DAILY = f"SELECT date_trunc('day', CAST(ts AS TIMESTAMP)) AS window_start, event_type, {_COUNTS} FROM events GROUP BY 1, 2 HAVING date_trunc('day', CAST(ts AS TIMESTAMP)) + INTERVAL 1 DAY <= {_DONE}"
_NEWEST = "arg_max(value, {'a': ts, 'b': event_id}) AS value FROM events WHERE"

register("r_stream_dedup", r_stream_dedup, "SELECT DISTINCT user_id, event_type FROM events")
register("r_stream_windows", r_stream_windows, _DAILY)
register("r_stream_health", r_stream_health, f"SELECT *, CASE WHEN n_rows < 5 THEN 'unknown' WHEN error_rate > 0.5 THEN 'critical' WHEN error_rate > 0.25 THEN 'unhealthy' WHEN error_rate > 0.1 THEN 'degraded' ELSE 'healthy' END AS level FROM ({_DAILY})")
register(
    "r_stream_sliding",
    r_stream_sliding,
    f"SELECT date_trunc('day', CAST(ts AS TIMESTAMP)) - to_days(back) AS window_start, user_id, {_COUNTS} FROM events, (VALUES (0), (1)) AS v(back) GROUP BY 1, 2 HAVING date_trunc('day', CAST(ts AS TIMESTAMP)) - to_days(back) + INTERVAL 2 DAY <= {_DONE}".replace("GROUP BY 1, 2 HAVING date_trunc('day', CAST(ts AS TIMESTAMP)) - to_days(back)", "GROUP BY 1, 2 HAVING window_start"),
)
register(
    "r_stream_sessions",
    r_stream_sessions,
    f"""WITH o AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS t, lag(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), g AS (SELECT user_id, t, sum(CASE WHEN before IS NULL OR t > before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS s FROM o)
 SELECT user_id, min(t) AS started, max(t) + INTERVAL 6 HOUR AS ended, count(*) AS n_rows FROM g GROUP BY user_id, s HAVING max(t) + INTERVAL 6 HOUR <= {_DONE}""",
)
register("r_stream_debounce", r_stream_debounce, DEBOUNCE + " SELECT user_id, ts AS sent_at FROM r WHERE n > 0 AND sent")
register("r_stream_breaker", r_stream_breaker, BREAKER)
register("r_stream_delistings", r_stream_delistings, f"SELECT user_id, max(CAST(ts AS TIMESTAMP)) AS last_seen FROM events GROUP BY 1 HAVING max(CAST(ts AS TIMESTAMP)) + INTERVAL 1 DAY < {_DONE}")
register(
    "r_stream_sync",
    r_stream_sync,
    f"""WITH k AS (SELECT user_id, event_type, {_NEWEST} ts < TIMESTAMP '2024-01-02' GROUP BY ALL), i AS (SELECT user_id, event_type, {_NEWEST} ts >= TIMESTAMP '2024-01-02' GROUP BY ALL)
 SELECT i.user_id, i.event_type, i.value, k.value AS known_price, CASE WHEN k.value IS NULL THEN 'new' WHEN abs(i.value - k.value) <= 0.01::DOUBLE THEN 'unchanged' WHEN i.value > k.value THEN 'increase' ELSE 'decrease' END AS outcome, coalesce(abs(i.value - k.value) > k.value, FALSE) AS spike, 0 AS batch FROM i LEFT JOIN k USING (user_id, event_type)""",
)
register(
    "r_stream_monitor",
    r_stream_monitor,
    f"""WITH e AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bad FROM events),
 o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e),
 g AS (SELECT *, sum(CASE WHEN ts > before + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS life FROM o),
 i AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id, life ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g),
 m AS (SELECT user_id, ts, event_id, life, count(*) OVER l AS n_rows, avg(bad) OVER (PARTITION BY user_id, life ORDER BY ts, event_id ROWS 19 PRECEDING) AS error_rate,
   CAST(sum(bad) OVER (PARTITION BY user_id, life, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after
   FROM i WINDOW l AS (PARTITION BY user_id, life ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
 SELECT user_id, ts, event_id, n_rows, error_rate, streak, CASE WHEN n_rows < 5 THEN 'unknown' WHEN error_rate > 0.5 OR streak >= 10 THEN 'critical' WHEN error_rate > 0.25 OR streak >= 5 THEN 'unhealthy' WHEN error_rate > 0.1 OR streak >= 3 THEN 'degraded' ELSE 'healthy' END AS level FROM m
 UNION ALL SELECT user_id, ts, NULL, n_rows, error_rate, streak, 'silent' FROM m WHERE ts + INTERVAL 12 HOUR < coalesce(after, {_DONE})""",
)
