"""Prices kept as versions by merges of batches; the result is that of one pass over all observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators.versions import VersionTable
from tallyframe.plans.catalog import register
from tallyframe.session import read_table, scratch_path

#: The batches begin at these days.
CUTS = ("0001-01-01", "2024-01-11", "2024-01-21", "9999-12-31")


def _merged(spark, d) -> VersionTable:
    """Event values as prices per user and type, merged in three batches, of which the second comes twice."""
    table = VersionTable(scratch_path(spark, "versions"), ("user_id", "event_type"), "value", "ts", "event_id", least=5.0, buckets=16)
    events = read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for number in (0, 1, 1, 2):
        table.merge(events.filter((F.col("ts") >= CUTS[number]) & (F.col("ts") < CUTS[number + 1])), number)
    return table


_OBSERVED = """WITH o AS (SELECT user_id, event_type, CAST(ts AS TIMESTAMP) AS ts, event_id, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS known FROM events WHERE value IS NOT NULL AND ts IS NOT NULL)"""


def q_version_table(spark, d):
    return _merged(spark, d).versions(spark)


register(
    "q_version_table",
    q_version_table,
    _OBSERVED + " SELECT user_id, event_type, value, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_to FROM o WHERE known IS NULL OR abs(value - known) >= 5",
)


def q_version_outcomes(spark, d):
    return _merged(spark, d).outcomes(spark)


register(
    "q_version_outcomes",
    q_version_outcomes,
    _OBSERVED
    + """ SELECT user_id, event_type, ts, event_id, value, known, CASE WHEN known IS NULL THEN 'new' WHEN abs(value - known) < 5 THEN 'unchanged' WHEN value > known THEN 'increase' ELSE 'decrease' END AS outcome,
 coalesce(abs(value - known) > known, FALSE) AS spike, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS version FROM o""",
)
