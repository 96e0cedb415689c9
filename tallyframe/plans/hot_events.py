"""All events as one sequence: windows over a single key that holds every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import ranges
from tallyframe.plans.catalog import register
from tallyframe.plans.events import failed
from tallyframe.session import read_table

ORDER = ["ts", "event_id"]


def q_sequence_rates(spark, d):
    """Error rate of the last 20 events, highest value of the last 50, and the type of the event before and after."""
    events = read_table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    columns = {
        "error_rate": lambda w: F.avg(failed().cast("int")).over(w.rowsBetween(-19, 0)),
        "peak": lambda w: F.max("value").over(w.rowsBetween(-49, 0)),
        "type_before": lambda w: F.lag("event_type").over(w),
        "type_after": lambda w: F.lead("event_type").over(w),
    }
    return ranges.framed(events, [], ORDER, columns, reach=49, ahead=1).select("event_id", *columns)


register(
    "q_sequence_rates",
    q_sequence_rates,
    """SELECT event_id, avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS 19 PRECEDING) AS error_rate, max(value) OVER (ORDER BY ts, event_id ROWS 49 PRECEDING) AS peak,
 lag(event_type) OVER (ORDER BY ts, event_id) AS type_before, lead(event_type) OVER (ORDER BY ts, event_id) AS type_after FROM events""",
)


def q_sequence_streaks(spark, d):
    """How many events without a purchase end at each event, and its place, over all users."""
    events = ranges.placed(read_table(spark, d, "events").select("event_id", "ts", "event_type"), [], ORDER)
    return ranges.streaks(events, [], ORDER, F.col("event_type") != "purchase").select("event_id", "place", "streak")


register(
    "q_sequence_streaks",
    q_sequence_streaks,
    """WITH i AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS place, sum(CASE WHEN event_type <> 'purchase' THEN 0 ELSE 1 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)
 SELECT event_id, place, CAST(sum(CASE WHEN event_type <> 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i""",
)


def q_sequence_preceding(spark, d):
    """Nearest event of high value among the 99 before each, and the first among the 30 before it, within two groups of types."""
    events = read_table(spark, d, "events").select("event_id", "ts", "event_type", F.col("event_type").isin("error", "view").alias("watched"), F.when(F.col("value") > 90, F.col("event_id")).alias("high"))
    found = ranges.framed(events, ["watched"], ORDER, {"nearest": lambda w: F.last("high", ignorenulls=True).over(w.rowsBetween(-99, -1)), "first_high": lambda w: F.first("high", ignorenulls=True).over(w.rowsBetween(-30, -1))}, reach=99)
    return found.select("event_id", "watched", "nearest", "first_high")


register(
    "q_sequence_preceding",
    q_sequence_preceding,
    """WITH e AS (SELECT event_id, ts, event_type IN ('error', 'view') AS watched, CASE WHEN value > 90 THEN event_id END AS high FROM events)
 SELECT event_id, watched, last_value(high IGNORE NULLS) OVER (PARTITION BY watched ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND 1 PRECEDING) AS nearest,
 first_value(high IGNORE NULLS) OVER (PARTITION BY watched ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS first_high FROM e""",
)
