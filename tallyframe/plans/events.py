"""Queries on the event stream as scraper runs: ranks, rates, streaks, monitors, retention, merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.operators import health, history, relational
from tallyframe.plans.catalog import register
from tallyframe.session import read_table


def _events(spark, d):
    return read_table(spark, d, "events")


def failed():
    return F.col("event_type") == "error"


def q_latest_run(spark, d):
    done = _events(spark, d).filter("event_type = 'purchase'")
    return relational.keep_first(done, ["user_id"], [F.col("ts").desc(), "event_id"]).select("user_id", "event_id", "ts")


register("q_latest_run", q_latest_run, "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events WHERE event_type = 'purchase') WHERE n = 1")


def q_dedup_keep_first(spark, d):
    return relational.keep_first(_events(spark, d), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


register("q_dedup_keep_first", q_dedup_keep_first, "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")


def q_last_write_wins(spark, d):
    return relational.last_values(_events(spark, d), ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "value"])


register("q_last_write_wins", q_last_write_wins, "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")


def q_cap_per_key(spark, d):
    return relational.cap_per_key(_events(spark, d), ["event_type"], ["ts", "event_id"], 20).select("event_type", "event_id")


register("q_cap_per_key", q_cap_per_key, "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) WHERE n <= 20")


def q_best_per_pair(spark, d):
    e = _events(spark, d).select(F.col("user_id").alias("a"), ((F.col("event_id") * 7) % 150).alias("b"), "event_id", "value").filter("a <> b")
    return relational.best_per_pair(e, "a", "b", "value", ["event_id"]).select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), "event_id", "value")


register("q_best_per_pair", q_best_per_pair, "SELECT low, high, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY low, high ORDER BY value DESC, event_id) AS n FROM (SELECT least(user_id, (event_id * 7) % 150) AS low, greatest(user_id, (event_id * 7) % 150) AS high, event_id, value FROM events WHERE user_id <> (event_id * 7) % 150)) WHERE n = 1")


def q_error_rate_20(spark, d):
    rated = relational.moving(_events(spark, d), ["user_id"], ["ts", "event_id"], failed().cast("int"), 20, "error_rate")
    return rated.select("event_id", "user_id", "error_rate")


register("q_error_rate_20", q_error_rate_20, "SELECT event_id, user_id, avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING) AS error_rate FROM events")


def q_failure_streak(spark, d):
    return relational.failure_streaks(_events(spark, d), ["user_id"], ["ts", "event_id"], failed()).select("event_id", "user_id", "streak")


STREAK = """WITH i AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
 s AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i)"""
register("q_failure_streak", q_failure_streak, STREAK + " SELECT event_id, user_id, streak FROM s")


def q_health_status(spark, d):
    order = ["ts", "event_id"]
    rated = relational.moving(_events(spark, d), ["user_id"], order, failed().cast("int"), 20, "error_rate")
    rated = relational.failure_streaks(rated, ["user_id"], order, failed())
    rated = rated.withColumn("n_rows", F.count("*").over(Window.partitionBy("user_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    last = relational.last_values(rated, ["user_id"], order, ["error_rate", "streak", "n_rows"])
    return last.withColumn("level", health.health_level(F.col("error_rate"), F.col("streak"), F.col("n_rows")))


register(
    "q_health_status",
    q_health_status,
    STREAK
    + """, r AS (SELECT *, avg(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING) AS error_rate, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n_rows,
 row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM s)
 SELECT user_id, error_rate, streak, n_rows, CASE WHEN n_rows < 5 THEN 'unknown' WHEN error_rate > 0.5 OR streak >= 10 THEN 'critical' WHEN error_rate > 0.25 OR streak >= 5 THEN 'unhealthy' WHEN error_rate > 0.1 OR streak >= 3 THEN 'degraded' ELSE 'healthy' END AS level FROM r WHERE n = 1""",
)


def q_nearest_before(spark, d):
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return relational.nearest_before(_events(spark, d), ["user_id"], ["ts", "event_id"], bought, 30, "purchase_before").select("event_id", "purchase_before")


register("q_nearest_before", q_nearest_before, "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS purchase_before FROM events")


def r_alert_debounce(spark, d):
    return health.debounce_alerts(_events(spark, d).filter(failed()), "user_id", "ts", "event_id", 6 * 3600.0)


def r_circuit_breaker(spark, d):
    return health.circuit_breaker(_events(spark, d).withColumn("failed", F.col("event_type").isin("error", "view")), "user_id", "ts", "event_id", "failed", health.BreakerRules(3, 6 * 3600.0, 2))


def r_rate_limiter(spark, d):
    return health.adaptive_delay(_events(spark, d).withColumn("failed", failed()), "user_id", "ts", "event_id", "failed")


def _walk(chosen: str, start: str, names: str, step: str) -> str:
    """SQL that goes through each user's events in order: r holds the state after event n, e is the next one."""
    return f"""WITH RECURSIVE e AS (SELECT *, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, event_id, {chosen})),
 r(user_id, n, ts, event_id, {names}) AS (SELECT user_id, 0::BIGINT, NULL::TIMESTAMP, NULL::BIGINT, {start} FROM (SELECT DISTINCT user_id FROM e) UNION ALL SELECT e.user_id, e.n, e.ts, e.event_id, {step})"""


DEBOUNCE = _walk("TRUE AS bad FROM events WHERE event_type = 'error'", "NULL::DOUBLE, FALSE", "last, sent", "CASE WHEN last IS NULL OR s - last >= 21600 THEN s ELSE last END, last IS NULL OR s - last >= 21600 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1")
register("r_alert_debounce", r_alert_debounce, DEBOUNCE + " SELECT user_id, ts, event_id, sent FROM r WHERE n > 0")

BREAKER = _walk(
    "event_type IN ('error', 'view') AS bad FROM events",
    "'closed', 0::BIGINT, 0.0::DOUBLE, TRUE",
    "state, held, since, allowed",
    """CASE WHEN blocked THEN 'open' WHEN now = 'closed' THEN CASE WHEN bad AND c + 1 >= 3 THEN 'open' ELSE 'closed' END WHEN bad THEN 'open' WHEN c + 1 >= 2 THEN 'closed' ELSE 'half_open' END,
 CASE WHEN blocked THEN held WHEN now = 'closed' THEN CASE WHEN bad THEN c + 1 ELSE 0 END WHEN bad OR c + 1 >= 2 THEN 0 ELSE c + 1 END,
 CASE WHEN NOT blocked AND bad AND (now = 'half_open' OR c + 1 >= 3) THEN s ELSE since END, NOT blocked
 FROM (SELECT e.user_id, e.n, e.ts, e.event_id, e.bad, e.s, r.held, r.since, r.state = 'open' AND e.s - r.since < 21600 AS blocked, CASE WHEN r.state = 'open' THEN 'half_open' ELSE r.state END AS now, CASE WHEN r.state = 'open' THEN 0 ELSE r.held END AS c FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) e""",
) + " SELECT user_id, ts, event_id, state, allowed FROM r WHERE n > 0"
register("r_circuit_breaker", r_circuit_breaker, BREAKER)

register(
    "r_rate_limiter",
    r_rate_limiter,
    _walk("event_type = 'error' AS bad FROM events", "1.0::DOUBLE, 0::BIGINT", "delay, good", "CASE WHEN bad THEN least(delay * 2, 30) WHEN good + 1 >= 5 THEN greatest(delay * 0.9::DOUBLE, 0.5) ELSE delay END, CASE WHEN bad OR good + 1 >= 5 THEN 0 ELSE good + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1")
    + " SELECT user_id, ts, event_id, delay FROM r WHERE n > 0",
)


def q_upsert_merge(spark, d):
    e = _events(spark, d)
    target = relational.last_values(e.filter("event_type = 'view'"), ["user_id"], ["ts", "event_id"], ["event_id", "value"])
    source = relational.last_values(e.filter("event_type = 'click'"), ["user_id"], ["ts", "event_id"], ["event_id", "value"])
    return history.upsert(target, source, ["user_id"], ["event_id", "value"])


_LAST = "SELECT user_id, arg_max(event_id, {'a': ts, 'b': event_id}) AS event_id, arg_max(value, {'a': ts, 'b': event_id}) AS value FROM events WHERE "
register(
    "q_upsert_merge",
    q_upsert_merge,
    f"WITH t AS ({_LAST} event_type = 'view' GROUP BY 1), s AS ({_LAST} event_type = 'click' GROUP BY 1) "
    "SELECT coalesce(t.user_id, s.user_id) AS user_id, coalesce(s.event_id, t.event_id) AS event_id, coalesce(s.value, t.value) AS value, CASE WHEN t.user_id IS NULL THEN 'inserted' WHEN s.user_id IS NULL THEN 'kept' ELSE 'updated' END AS action FROM t FULL JOIN s ON t.user_id = s.user_id",
)


def q_insert_ignore(spark, d):
    e = _events(spark, d)
    first = lambda kind: e.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return history.insert_ignore(first("signup"), first("click"), ["user_id"])


register(
    "q_insert_ignore",
    q_insert_ignore,
    "WITH t AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT * FROM t UNION ALL SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM t) GROUP BY 1",
)


def q_fill_missing(spark, d):
    parts = read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.lit("")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).alias("brand"))
    other = read_table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.lower("p_brand").alias("brand"))
    return history.fill_missing(parts, other, ["id"], ["brand"])


register(
    "q_fill_missing",
    q_fill_missing,
    "WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN p_brand END AS brand FROM part) SELECT t.id, coalesce(nullif(t.brand, ''), lower(p.p_brand), t.brand) AS brand FROM t LEFT JOIN part p ON p.p_partkey = t.id AND p.p_partkey % 2 = 0",
)


def q_retention_split(spark, d):
    kept, archived = history.split_retention(_events(spark, d), "ts", F.lit("2024-01-15").cast("timestamp"))
    return kept.select("event_id", F.lit("kept").alias("fate")).unionAll(archived.select("event_id", F.lit("archived").alias("fate")))


register("q_retention_split", q_retention_split, "SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN 'kept' ELSE 'archived' END AS fate FROM events")


def q_conf_buckets(spark, d):
    return relational.bucketed_counts(_events(spark, d), F.col("value"), [("high", 50.0), ("medium", 10.0)], "low")


register("q_conf_buckets", q_conf_buckets, "SELECT CASE WHEN value >= 50 THEN 'high' WHEN value >= 10 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n_rows FROM events GROUP BY 1")


def q_reason_hist(spark, d):
    return _events(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("int")).groupBy("event_type", (F.col("k") % 5).alias("reason")).agg(F.count("*").alias("n_rows"))


register("q_reason_hist", q_reason_hist, "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS reason, count(*) AS n_rows FROM events GROUP BY ALL")


def q_run_lifecycle(spark, d):
    runs = _events(spark, d).groupBy("user_id", F.to_date("ts").alias("day"))
    return runs.agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("n_rows"))


register("q_run_lifecycle", q_run_lifecycle, "SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS started, max(ts) AS ended, arg_max(event_type, {'a': ts, 'b': event_id}) AS status, count(*) AS n_rows FROM events GROUP BY ALL")


def q_union_feeds(spark, d):
    feeds = [read_table(spark, d, t).select(F.lit(t).alias("feed"), F.col(k).cast("long").alias("id")) for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))]
    return relational.first_source(feeds, ["id"])


register("q_union_feeds", q_union_feeds, "SELECT feed, id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r) AS n FROM (SELECT 'customer' AS feed, c_custkey AS id, 0 AS r FROM customer UNION ALL SELECT 'supplier', s_suppkey, 1 FROM supplier UNION ALL SELECT 'part', p_partkey, 2 FROM part)) WHERE n = 1")


def q_set_ops(spark, d):
    sold = read_table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    cheap = read_table(spark, d, "part").filter("p_size < 10").select(F.col("p_partkey").alias("id"))
    return sold.intersect(cheap).select("id", F.lit("both").alias("side")).union(cheap.subtract(sold).select("id", F.lit("cheap").alias("side")))


register("q_set_ops", q_set_ops, "WITH s AS (SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 45), c AS (SELECT p_partkey AS id FROM part WHERE p_size < 10) SELECT id, 'both' AS side FROM (SELECT id FROM s INTERSECT SELECT id FROM c) UNION ALL SELECT id, 'cheap' FROM (SELECT id FROM c EXCEPT SELECT id FROM s)")
