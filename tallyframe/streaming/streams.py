"""Structured Streaming: ingest with change detection, dedup, windows, delisting, alert debounce."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyframe.operators import history, relational
from tallyframe.operators.health import CLOSED, BreakerRules, breaker_step, health_level
from tallyframe.session import scratch_path

LATE = "2 days"


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_trigger: int = 100) -> DataFrame:
    """The files of a table as a stream, event time as a timestamp."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], Any] | None = None, checkpoint: str | None = None) -> DataFrame | None:
    """Runs a stream over what there is, to a Parquet sink (or `each`), and returns what was written."""
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, "stream-out"), checkpoint or scratch_path(spark, "stream-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.foreachBatch(each) if each else writer.format("parquet").option("path", out)).start()
    query.awaitTermination()
    return None if each else spark.read.schema(stream.schema).parquet(out)


def first_of_key(events: DataFrame, keys: list[str], at: str = "ts", late: str = LATE) -> DataFrame:
    """The first row of each key within the watermark; state is dropped behind it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, failed: Column, keys: list[str], size: str = "1 day", slide: str | None = None, at: str = "ts", late: str = LATE) -> DataFrame:
    """Events, failures and error rate per key and window; closed windows only, in append mode."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    counted = events.withWatermark(at, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n_rows"), F.count_if(failed).alias("n_failed"))
    return counted.select(F.col("w.start").alias("window_start"), *keys, "n_rows", "n_failed", (F.col("n_failed") / F.col("n_rows")).alias("error_rate"))


def sync_batches(current: DataFrame, path: str, keys: list[str], price: str, order: list[str], tolerance) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step: classifies each batch's last prices against the prices known before it. Outcomes go to
    path/batch=N; beside them path-known/N holds the prices known after batch N, so that a batch reads one table and not all
    earlier ones. Both are overwritten if a batch is run again; tables of known prices older than the last but one are removed."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = (current if number == 0 else spark.read.parquet(f"{path}-known/{number - 1}")).select(*keys, price)
        newest = relational.last_values(batch, keys, order, [price])
        history.classify_sync(known, newest, keys, price, tolerance).write.mode("overwrite").parquet(f"{path}/batch={number}")
        history.insert_replace(known, newest.select(*keys, price), keys).write.mode("overwrite").parquet(f"{path}-known/{number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}-known/{number - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return step


def debounced(alerts: DataFrame, key: str, at: str = "ts", seconds: float = 300.0, late: str = LATE) -> DataFrame:
    """Alerts that are sent: none within so many seconds of the key's last one sent. Within a batch rows are taken in time
    order; one that comes late, before the last sent, is not sent again. The state is the time of the last alert sent, and
    ends when the watermark is past the time in which it matters."""
    kind = alerts.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("sent_at", T.TimestampType())])
    state_schema = T.StructType([T.StructField("last", T.DoubleType())])

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = pd.concat([b[at] for b in batches]).sort_values() if not state.hasTimedOut else pd.Series([], dtype="datetime64[ns]")
        last = state.get[0] if state.exists else float("-inf")
        sent = []
        for t in times:
            if t.timestamp() - last >= seconds:
                last = t.timestamp()
                sent.append(t)
        if state.hasTimedOut:
            state.remove()
        elif last > float("-inf"):
            state.update((last,))
            state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        if sent:
            yield pd.DataFrame({key: [group[0]] * len(sent), "sent_at": sent})

    return alerts.withWatermark(at, late).groupBy(key).applyInPandasWithState(step, out, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def breaker_states(events: DataFrame, key: str, failed: str, rules: BreakerRules | None = None, at: str = "ts", tie: str = "event_id", late: str = LATE) -> DataFrame:
    """The circuit breaker of each key as a stream: its state after each event and whether the call was let through. Within a
    batch rows are taken in time order; the state is that of the breaker."""
    rules = rules or BreakerRules()
    kind = events.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField(at, T.TimestampType()), T.StructField(tie, events.schema[tie].dataType), T.StructField("state", T.StringType()), T.StructField("allowed", T.BooleanType())])
    held = T.StructType([T.StructField("name", T.StringType()), T.StructField("count", T.LongType()), T.StructField("since", T.DoubleType())])

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, now = pd.concat(list(batches)).sort_values([at, tie]), state.get if state.exists else CLOSED
        found = []
        for t, n, bad in zip(rows[at], rows[tie], rows[failed], strict=True):
            now, said = breaker_step(now, t.timestamp(), bool(bad), rules)
            found.append((group[0], t, n, *said))
        state.update(now)
        yield pd.DataFrame(found, columns=out.names)

    return events.withWatermark(at, late).groupBy(key).applyInPandasWithState(step, out, held, "append", GroupStateTimeout.NoTimeout)


def stream_health(events: DataFrame, failed: Column, keys: list[str], size: str = "1 day", at: str = "ts", late: str = LATE) -> DataFrame:
    """Windowed counts with a health level by error rate; the level by streaks needs the batch operator's order."""
    counted = windowed_counts(events, failed, keys, size, None, at, late)
    return counted.withColumn("level", health_level(F.col("error_rate"), F.lit(0), F.col("n_rows")))


def delistings(events: DataFrame, key: str, days: int, at: str = "ts", late: str = LATE) -> DataFrame:
    """Keys that were not seen for so many days, once the watermark has passed that time; their state ends with it, and a key
    that comes back starts anew."""
    kind = events.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("last_seen", T.TimestampType())])
    held = T.StructType([T.StructField("last", T.LongType())])  # microseconds

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield pd.DataFrame({key: [group[0]], "last_seen": [pd.Timestamp(state.get[0] * 1000)]})
            state.remove()
            return
        last = max(b[at].max().value // 1000 for b in batches)
        last = max(last, state.get[0]) if state.exists else last
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + days * 86_400_000, state.getCurrentWatermarkMs() + 1))

    return events.select(key, at).withWatermark(at, late).groupBy(key).applyInPandasWithState(step, out, held, "append", GroupStateTimeout.EventTimeTimeout)


def last_seen(events: DataFrame, keys: list[str], at: str = "ts") -> DataFrame:
    """Latest time per key, for delisting (update or complete mode)."""
    return events.groupBy(*keys).agg(F.max(at).alias("last_seen"), F.count("*").alias("n_rows"))


def sessions(events: DataFrame, keys: list[str], gap: str, at: str = "ts", late: str = LATE) -> DataFrame:
    """Sessions that end after a gap without events."""
    grouped = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n_rows"))
    return grouped.select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_rows")


def quarantine(events: DataFrame, at: str, floor: Column) -> tuple[DataFrame, DataFrame]:
    """(in time, late) rows around a floor, for what a watermark would drop."""
    return events.filter(F.col(at) >= floor), events.filter(F.col(at) < floor)
