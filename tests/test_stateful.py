"""The stream monitor: the same rows whatever the batches, state that ends with silence and survives a restart."""

from pyspark.sql import functions as F

from tallyframe.session import scratch_path
from tallyframe.streaming import stateful, streams

HOUR = 3600
DDL = "who string, ts timestamp, event_id long, bad boolean"


def put(spark, folder, rows):
    spark.createDataFrame(rows, "who string, t long, event_id long, bad boolean").select("who", F.timestamp_seconds("t").alias("ts"), "event_id", "bad").coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, state=None):
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(folder)
    out = scratch_path(spark, "told")
    with stateful.rocksdb_state(spark):
        watched = stateful.monitored(stream, "who", F.col("bad"), 10 * HOUR, recent=3, late="1 hour")
        streams.run_available(watched, each=lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), checkpoint=state)
    return spark.read.parquet(out)


def told(df):
    return sorted(((r.who or "", r.ts.timestamp() / HOUR, r.event_id or 0, r.n_rows, round(r.error_rate, 3), r.streak, r.level) for r in df.collect()), key=str)


ROWS = [("a", h * HOUR, h, h in (2, 3, 4, 40)) for h in (1, 2, 3, 4, 5, 6, 40, 41)] + [(None, HOUR, 70, True), ("b", 41 * HOUR, 71, None)]
WANT = [
    ("", 1.0, 0, 1, 1.0, 1, "silent"), ("", 1.0, 70, 1, 1.0, 1, "unknown"),
    ("a", 1.0, 1, 1, 0.0, 0, "unknown"), ("a", 2.0, 2, 2, 0.5, 1, "unknown"), ("a", 3.0, 3, 3, 0.667, 2, "unknown"), ("a", 4.0, 4, 4, 1.0, 3, "unknown"),
    ("a", 5.0, 5, 5, 0.667, 0, "critical"), ("a", 6.0, 0, 6, 0.333, 0, "silent"), ("a", 6.0, 6, 6, 0.333, 0, "unhealthy"),
    ("a", 40.0, 40, 1, 1.0, 1, "unknown"), ("a", 41.0, 41, 2, 0.5, 0, "unknown"), ("b", 41.0, 71, 1, 0.0, 0, "unknown"),
]


def test_one_batch_and_many_tell_the_same(spark):
    whole, parts = scratch_path(spark, "whole"), scratch_path(spark, "parts")
    put(spark, whole, ROWS)
    assert told(run(spark, whole)) == sorted(WANT, key=str)
    for some in (ROWS[:2], ROWS[2:5] + ROWS[8:9], ROWS[5:6], ROWS[6:8] + ROWS[9:]):
        put(spark, parts, some)
    assert told(run(spark, parts)) == sorted(WANT, key=str)


def test_restart_goes_on_and_silence_ends_state(spark):
    folder, state = scratch_path(spark, "events"), scratch_path(spark, "state")
    put(spark, folder, ROWS[:4])
    first = told(run(spark, folder, state))
    put(spark, folder, ROWS[4:6])
    put(spark, folder, [("c", 100 * HOUR, 90, False)])
    second = told(run(spark, folder, state))
    put(spark, folder, [("a", 101 * HOUR, 91, True), ("c", 101 * HOUR, 92, True)])
    third = told(run(spark, folder, state))
    assert first == [w for w in WANT if w[0] == "a" and w[1] <= 4]
    assert second == sorted([w for w in WANT if w[0] == "a" and 5 <= w[1] <= 6] + [("c", 100.0, 90, 1, 0.0, 0, "unknown")], key=str)
    assert third == [("a", 101.0, 91, 1, 1.0, 1, "unknown"), ("c", 101.0, 92, 2, 0.5, 1, "unknown")]
