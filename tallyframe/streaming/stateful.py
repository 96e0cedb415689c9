"""Typed state with timers: monitors of event streams whose state ends with the silence of its key."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tallyframe.operators.health import health_level
from tallyframe.streaming.streams import LATE

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, on disk beyond memory, which typed state needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def monitored(events: DataFrame, key: str, failed: Column, idle: float, at: str = "ts", tie: str = "event_id", recent: int = 20, late: str = LATE) -> DataFrame:
    """The health of each key after each of its events: how many there were, the error rate of the last `recent`, the failures in a row that
    end there, and the level they make. A key without events for more than `idle` seconds is told once more, as `silent`, with
    the time of its last event and no `tie`; its state ends, and a later event starts anew. It is told when its next event comes or
    when the watermark passes that time, whichever is first, so that the result does not depend on the batches in which events
    that are in order come. Events that come after later ones of their key, in another batch, count as of the last time known.

    The state of a key is one row: time of the last event, events, streak, and the last `recent` outcomes as text. Events of a key are
    sorted within a batch, so that a batch must leave them room (files per trigger). A null outcome is no failure; null times are
    dropped, a null key is a key. Start it inside rocksdb_state()."""
    kind, number = events.schema[key].dataType, events.schema[tie].dataType
    names = ["key", "at_us", "tie", "n_rows", "error_rate", "streak", "silent"]
    out = T.StructType([T.StructField("key", kind), T.StructField("at_us", T.LongType()), T.StructField("tie", number), T.StructField("n_rows", T.LongType()), T.StructField("error_rate", T.DoubleType()), T.StructField("streak", T.LongType()), T.StructField("silent", T.BooleanType())])
    gap = int(idle * 1_000_000)

    class Monitor(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.held = handle.getValueState("monitor", "last long, n long, streak long, recent string")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            rows = pd.concat(list(rows)).sort_values(["at_us", "tie"], kind="stable")
            times, ties, bad = rows["at_us"].to_numpy(), rows["tie"].to_numpy(), rows["bad"].to_numpy().astype(np.int64)
            last, n, streak, past = self.held.get() if self.held.exists() else (None, 0, 0, "")
            if last is not None:
                self.handle.deleteTimer((last + gap) // 1000 + 1)
                times = np.maximum(times, last)
            starts = [i for i in np.flatnonzero(np.diff(times) > gap) + 1]
            # one frame for all that is told of a key in a batch: frames cost more than their rows
            told = []
            if last is not None and times[0] - last > gap:
                told.append(self.silence(last, n, streak, past))
                n, streak, past = 0, 0, ""
            bounds = [0, *starts, len(times)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if a:
                    told.append(self.silence(last, n, streak, past))
                    n, streak, past = 0, 0, ""
                f, place = bad[a:b], np.arange(b - a)
                good = np.maximum.accumulate(np.where(f == 0, place, -1))
                streaks = np.where(good < 0, place + 1 + streak, place - good)
                before = np.frombuffer(past.encode(), dtype=np.uint8).astype(np.int64) - 48
                all_ = np.concatenate([before, f])
                sums = np.concatenate([[0], np.cumsum(all_)])
                ends = np.arange(len(before) + 1, len(all_) + 1)
                begins = np.maximum(ends - recent, 0)
                told.append((times[a:b], ties[a:b].astype(object), n + 1 + place, (sums[ends] - sums[begins]) / (ends - begins), streaks, np.zeros(b - a, dtype=bool)))
                last, n, streak, past = int(times[b - 1]), n + b - a, int(streaks[-1]), "".join(map(str, all_[-recent:]))
            self.held.update((last, n, streak, past))
            self.handle.registerTimer((last + gap) // 1000 + 1)
            yield self.frame(key, told)

        def silence(self, last, n, streak, past) -> tuple:
            return [last], np.array([None], dtype=object), [n], [past.count("1") / len(past)], [streak], [True]

        def frame(self, key, told) -> pd.DataFrame:
            columns = [np.concatenate(parts) for parts in zip(*told, strict=True)]
            return pd.DataFrame(dict(zip(names, [[key[0]] * len(columns[0]), *columns], strict=True)))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if self.held.exists():
                last, n, streak, past = self.held.get()
                if expiredTimerInfo.getExpiryTimeInMs() == (last + gap) // 1000 + 1:
                    self.held.clear()
                    yield self.frame(key, [self.silence(last, n, streak, past)])

        def close(self) -> None:
            pass

    rows = events.select(F.col(key).alias("key"), at, F.unix_micros(at).alias("at_us"), F.col(tie).alias("tie"), F.coalesce(failed, F.lit(False)).alias("bad")).filter(F.col(at).isNotNull())
    told = rows.withWatermark(at, late).groupBy("key").transformWithStateInPandas(Monitor(), out, "append", "EventTime")
    level = F.when(F.col("silent"), "silent").otherwise(health_level(F.col("error_rate"), F.col("streak"), F.col("n_rows")))
    return told.select(F.col("key").alias(key), F.timestamp_micros("at_us").alias(at), F.col("tie").alias(tie), "n_rows", "error_rate", "streak", level.alias("level"))
