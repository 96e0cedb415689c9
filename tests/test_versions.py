"""The versioned table: equal to one pass whatever the batches, repeats, failures between, buckets left alone."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.history import validity_intervals
from tallyframe.operators.versions import VersionTable
from tallyframe.session import scratch_path
from tallyframe.streaming import streams

DDL = "sku string, price double, at timestamp, n long, extra string"


def table(spark, **more):
    return VersionTable(scratch_path(spark, "test-versions"), ("sku",), "price", "at", "n", **{"buckets": 8, **more})


def observations(spark, rows):
    return spark.createDataFrame([(k, p, t, n, "x") for k, p, t, n in rows], "sku string, price double, t long, n long, extra string").select("sku", "price", F.timestamp_seconds("t").alias("at"), "n", "extra")


def told(df):
    return sorted(((r.sku or "", r.price, r.valid_from.timestamp(), r.valid_to.timestamp() if r.valid_to else None) for r in df.collect()), key=str)


def test_batches_equal_one_pass(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", "d", None]), rng.choice([1.0, 1.005, 2.0, 5.0]), i * 10 // 2, i) for i in range(400)]
    t = table(spark)
    for number, start in enumerate(range(0, 400, 150)):
        assert t.merge(observations(spark, rows[start : start + 150]), number) == number
    want = validity_intervals(observations(spark, rows), ["sku"], ["at", "n"], "price", "at", 0.01)
    assert told(t.versions(spark)) == told(want)
    known = {r.sku: (r.last_seen.n, r.last_value) for r in t.current(spark).collect()}
    assert known == {k: max((n, p) for s, p, _, n in rows if s == k) for k in {r[0] for r in rows}}


def test_repeats_late_rows_and_nulls(spark):
    t = table(spark)
    t.merge(observations(spark, [("a", 1.0, 100, 1), ("b", 1.0, 100, 2), ("b", None, 150, 3)]), 0)
    day = observations(spark, [("a", 3.0, 200, 4), ("a", 2.0, 50, 5), ("a", 9.0, 100, 1), ("c", 1.0, 10, 6)])
    assert [t.merge(day, 1), t.merge(day, 1), t.merge(day, 0)] == [1, 1, 1]
    assert told(t.versions(spark)) == [("a", 1.0, 100.0, 200.0), ("a", 3.0, 200.0, None), ("b", 1.0, 100.0, None), ("c", 1.0, 10.0, None)]
    found = {(r.sku, r.n): (r.outcome, r.spike) for r in t.outcomes(spark).filter("version = 1").collect()}
    assert found == {("a", 4): ("increase", True), ("a", 5): ("late", False), ("a", 1): ("late", False), ("c", 6): ("new", False)}
    assert told(t.versions(spark, 0)) == [("a", 1.0, 100.0, None), ("b", 1.0, 100.0, None)]


def test_only_touched_buckets_are_read_and_written(spark):
    t = table(spark, buckets=64)
    t.merge(observations(spark, [(f"k{i}", 1.0, i, i) for i in range(500)]), 0)
    before, _ = t._heads(spark, 0)
    t.merge(observations(spark, [("k7", 2.0, 900, 900), ("k8", 2.0, 900, 901)]), 1)
    after, _ = t._heads(spark, 1)
    assert len(before) > 60 and sum(v == 1 for v in after.values()) <= 2
    written = spark.read.parquet(f"{t.path}/current/version=1")
    assert written.select("bucket").distinct().count() <= 2 and written.count() < 40
    assert t.current(spark).count() == 500 and t.versions(spark).count() == 502
    assert t.vacuum(spark, keep=1) == sum(v == 1 for v in after.values())
    assert t.current(spark).count() == 500 and t.versions(spark).count() == 502


def test_failed_merge_leaves_nothing(spark, monkeypatch):
    t = table(spark)
    t.merge(observations(spark, [("a", 1.0, 100, 1)]), 0)
    broken = observations(spark, [("a", 2.0, 200, 2)])
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):  # all parts are written, the commit is not
        t.merge(broken, 1)
    monkeypatch.undo()
    assert t.version(spark) == 0
    assert told(t.versions(spark)) == [("a", 1.0, 100.0, None)]
    assert t.merge(broken, 1) == 1
    assert told(t.versions(spark)) == [("a", 1.0, 100.0, 200.0), ("a", 2.0, 200.0, None)]


def test_empty_batches_and_clashes(spark):
    t = table(spark)
    with pytest.raises(ValueError):
        t.versions(spark)
    t.merge(observations(spark, []), 0)
    assert t.versions(spark).count() == 0
    t.merge(observations(spark, [("a", 1.0, 1, 1)]), 1)
    t.merge(observations(spark, []), 2)
    assert told(t.versions(spark)) == [("a", 1.0, 1.0, None)]
    with pytest.raises(ValueError):
        VersionTable("x", ("bucket",), "price", "at", "n")


def test_stream_that_stops_and_goes_on(spark):
    t, folder, state = table(spark), scratch_path(spark, "obs"), scratch_path(spark, "state")
    read = lambda: spark.readStream.schema(DDL).parquet(folder)
    observations(spark, [("a", 1.0, 1, 1), ("b", 1.0, 1, 2)]).write.mode("append").parquet(folder)
    streams.run_available(read(), each=t.step("feed"), checkpoint=state)
    observations(spark, [("a", 4.0, 5, 3)]).write.mode("append").parquet(folder)
    streams.run_available(read(), each=t.step("feed"), checkpoint=state)
    streams.run_available(read(), each=t.step("again"))  # a new checkpoint and writer: all rows are late or known
    assert told(t.versions(spark)) == [("a", 1.0, 1.0, 5.0), ("a", 4.0, 5.0, None), ("b", 1.0, 1.0, None)]
