"""Order-dependent monitors: alert debounce, circuit breaker, adaptive delay. One pass per key in event order."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fold(df: DataFrame, key: str, order: list[str], start, step, names: list[str], ddl: str) -> DataFrame:
    """Folds step over each key's rows in order, one output row per input row. Rows arrive
    sorted and in batches, so a key of any length takes constant memory."""
    columns = [key, *order, *names]

    def run(batches):
        state, last = None, object()
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                if row[0] != last:
                    last, state = row[0], start()
                state, out = step(state, row)
                rows.append((*row[: 1 + len(order)], *out))
            yield pd.DataFrame(rows, columns=[key, *order, *[d.split()[0] for d in ddl.split(", ")]])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [key, *order])
    sorted_ = df.select(*columns).repartition(key).sortWithinPartitions(key, *order)
    return sorted_.mapInPandas(run, f"{kinds}, {ddl}")


def debounce_alerts(alerts: DataFrame, key: str, at: str, tie: str, seconds: float = 300.0) -> DataFrame:
    """`sent` is true unless the same key's last alert that was sent is less than so many seconds old."""
    timed = alerts.withColumn("_s", F.unix_micros(F.col(at).cast("timestamp")) / 1e6)

    def step(last, row):
        send = last is None or row[3] - last >= seconds
        return (row[3] if send else last), (send,)

    return _fold(timed, key, [at, tie], lambda: None, step, ["_s"], "sent boolean")


@dataclass(frozen=True)
class BreakerRules:
    failures: int = 5
    timeout: float = 60.0
    successes: int = 2


#: Name, count (failures while closed, successes while half open), time it opened.
CLOSED = ("closed", 0, 0.0)


def breaker_step(state: tuple, now: float, bad: bool, rules: BreakerRules) -> tuple[tuple, tuple[str, bool]]:
    """The breaker after one event, its name and whether the call was let through."""
    name, count, since = state
    if name == "open":
        if now - since < rules.timeout:
            return state, (name, False)
        name, count = "half_open", 0
    if name == "closed":
        count = count + 1 if bad else 0
        name, since = ("open", now) if count >= rules.failures else (name, since)
    elif bad:
        name, count, since = "open", 0, now
    else:
        count += 1
        name, count = ("closed", 0) if count >= rules.successes else (name, count)
    return (name, count, since), (name, True)


def circuit_breaker(events: DataFrame, key: str, at: str, tie: str, failed: str, rules: BreakerRules | None = None) -> DataFrame:
    """State of each key's breaker after each event (closed, open, half_open) and whether the call was let through."""
    rules = rules or BreakerRules()
    timed = events.withColumn("_s", F.unix_micros(F.col(at).cast("timestamp")) / 1e6)

    return _fold(timed, key, [at, tie], lambda: CLOSED, lambda state, row: breaker_step(state, row[3], bool(row[4]), rules), ["_s", failed], "state string, allowed boolean")


@dataclass(frozen=True)
class DelayRules:
    start: float = 1.0
    least: float = 0.5
    most: float = 30.0
    backoff: float = 2.0
    recovery: float = 0.9
    calm: int = 5


def adaptive_delay(events: DataFrame, key: str, at: str, tie: str, failed: str, rules: DelayRules | None = None) -> DataFrame:
    """Delay after each event: grows with failures, shrinks after `calm` successes in a row."""
    rules = rules or DelayRules()

    def step(state, row):
        delay, good = state
        if row[3]:
            delay, good = min(delay * rules.backoff, rules.most), 0
        else:
            good += 1
            if good >= rules.calm:
                delay, good = max(delay * rules.recovery, rules.least), 0
        return (delay, good), (delay,)

    return _fold(events, key, [at, tie], lambda: (rules.start, 0), step, [failed], "delay double")


def health_level(error_rate, streak, rows) -> F.Column:
    """healthy, degraded, unhealthy or critical; unknown without enough events."""
    return F.when(rows < 5, "unknown").when((error_rate > 0.5) | (streak >= 10), "critical").when((error_rate > 0.25) | (streak >= 5), "unhealthy").when((error_rate > 0.1) | (streak >= 3), "degraded").otherwise("healthy")
