import json
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import grouping, health, history, matching, relational
from tallyframe.sources import files, web
from tallyframe.streaming import streams


@pytest.mark.parametrize("seed", range(3))
def test_greedy_groups_equal_the_sequence(spark, seed):
    draw = random.Random(seed)
    edges = [(i, draw.sample(range(25), draw.choice([2, 2, 3])), draw.choice([0.5, 0.7, 0.9])) for i in range(40)]
    taken, want = set(), {}
    for i, members, _ in sorted(edges, key=lambda e: (-e[2], e[0])):
        free = sorted(set(members) - taken)
        if len(free) >= 2:
            want[i] = free
            taken |= set(free)
    got = grouping.greedy_groups(spark.createDataFrame(edges, "id long, members array<long>, score double")).collect()
    assert {r.id: sorted(r.members) for r in got} == want


@pytest.mark.parametrize("seed", range(3))
def test_serial_choice_equals_the_sequence(spark, seed):
    draw = random.Random(seed)
    rows = {(draw.randrange(12), draw.randrange(10)): draw.choice([0.1, 0.5, 0.9]) for _ in range(60)}
    used, want = set(), set()
    for left in sorted({a for a, _ in rows}):
        free = [(-s, b) for (a, b), s in rows.items() if a == left and b not in used]
        if free:
            used.add(min(free)[1])
            want.add((left, min(free)[1]))
    got = grouping.serial_choice(spark.createDataFrame([(a, b, s) for (a, b), s in rows.items()], "left long, right long, score double")).collect()
    assert {(r.left, r.right) for r in got} == want


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (8, 9)], "a long, b long")
    assert {r.node: r.label for r in grouping.link_components(edges).collect()} == {5: 2, 4: 2, 3: 2, 2: 2, 9: 8, 8: 8}


def test_breaker_opens_and_recovers(spark):
    bad = [True, True, True, False, False, False, False]
    events = spark.createDataFrame([("s", i, f) for i, f in enumerate(bad)], "k string, i long, f boolean").withColumn("ts", F.timestamp_seconds(F.col("i") * 40))
    got = health.circuit_breaker(events, "k", "ts", "i", "f", health.BreakerRules(3, 60.0, 2)).orderBy("i").collect()
    assert [(r.state, r.allowed) for r in got] == [("closed", True), ("closed", True), ("open", True), ("open", False), ("half_open", True), ("closed", True), ("closed", True)]


def test_debounce_counts_from_the_last_sent(spark):
    alerts = spark.createDataFrame([("a", i, t) for i, t in enumerate([0, 200, 350, 500, 700])], "k string, i long, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert [r.sent for r in health.debounce_alerts(alerts, "k", "ts", "i").orderBy("i").collect()] == [True, False, True, False, True]


def test_delay_grows_and_shrinks(spark):
    events = spark.createDataFrame([("a", i, i < 2) for i in range(8)], "k string, i long, f boolean").withColumn("ts", F.timestamp_seconds("i"))
    got = [r.delay for r in health.adaptive_delay(events, "k", "ts", "i", "f").orderBy("i").collect()]
    assert got[:2] == [2.0, 4.0] and got[6] == pytest.approx(3.6)


def test_validity_intervals(spark):
    prices = spark.createDataFrame([(1, t, p) for t, p in enumerate([100, 100, 250, 250, 100])], "id long, t long, p long")
    got = history.validity_intervals(prices, ["id"], ["t"], "p", "t", 100).orderBy("valid_from").collect()
    assert [(r.p, r.valid_from, r.valid_to) for r in got] == [(100, 0, 2), (250, 2, 4), (100, 4, None)]


def test_jaccard_is_symmetric(spark):
    from tallyframe.functions.similarity import jaccard

    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["x"]), (["x"], ["x"])], "a array<string>, b array<string>")
    assert all(r.x == r.y for r in df.select(jaccard(F.col("a"), F.col("b")).alias("x"), jaccard(F.col("b"), F.col("a")).alias("y")).collect())


def test_first_source_wins(spark):
    a, b = spark.createDataFrame([(1, "a")], "id long, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "id long, v string")
    assert {(r.id, r.v) for r in relational.first_source([a, b], ["id"]).collect()} == {(1, "a"), (2, "b")}


def test_json_ld_products(spark):
    graph = json.dumps({"@graph": [{"@type": "Product", "name": "Milk", "offers": {"price": "1.5"}}, {"@type": "Thing", "name": "x"}]})
    html = f'<script type="application/ld+json">{graph}</script><script type="application/ld+json">{json.dumps({"@type": "Product", "name": "Bread", "brand": {"name": "B"}})}</script>'
    got = web.json_ld_products(spark.createDataFrame([(1, html), (2, None)], "id long, html string"), "id").collect()
    assert {(r.id, r.name, r.price, r.brand) for r in got} == {(1, "Milk", 1.5, None), (1, "Bread", None, "B")}


def test_embedded_offers(spark):
    html = 'x {"offers":[{"klNr":"1","title":"a ] b"},{"klNr":"1","title":"c"},{"klNr":"2","title":"d"}] } y'
    got = web.embedded_offers(spark.createDataFrame([(1, html)], "id long, html string"), "struct<klNr:string,title:string>", "id", "klNr").collect()
    assert {(r.klNr, r.title) for r in got} == {("1", "a ] b"), ("2", "d")}


def test_after_marker(spark):
    html = 'a "klNr":"1","title":"x" "klNr":"2","title":"y"'
    got = web.after_marker(spark.createDataFrame([(1, html)], "id long, html string"), "id", '"klNr":', {"nr": '^"(\\d+)"', "title": '"title":"([^"]*)"'}).collect()
    assert {(r.nr, r.title) for r in got} == {("1", "x"), ("2", "y")}


def test_feeds(spark, tmp_path):
    for name, rows in (("acme_20240101.json", [{"name": "old", "price_bgn": 1.95583}]), ("acme_20240202.json", [{"title": "new", "price": 2.0, "sku": "7"}, {"title": "free", "price": 0.0}])):
        (tmp_path / name).write_text(json.dumps(rows))
    raw = files.read_listings(spark, str(tmp_path))
    rows = files.accepted(files.unify_listings(raw)).collect()
    assert {(r.name, r.price) for r in rows} == {("old", 1.0), ("new", 2.0)}
    assert {r.name for r in files.newest_only(files.unify_listings(raw)).collect()} == {"new", "free"}
    assert files.first_existing(spark, [str(tmp_path / "none"), str(tmp_path)]) == str(tmp_path)


def test_sitemap(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc>http://x/p/1</loc></url><url><loc>http://x/c/2</loc></url></urlset>")
    assert [r.loc for r in files.read_sitemap(spark, str(tmp_path / "s.xml")).collect()] == ["http://x/p/1"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    files.write_csv(df, str(tmp_path / "c"), ["v"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    files.archive_json_lines(df, str(tmp_path / "a"))
    files.archive_json_lines(df, str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 4


def test_override_and_fill(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    better = spark.createDataFrame([(1, ""), (2, "z")], "id long, v string")
    assert {(r.id, r.v) for r in files.override(rows, better, "id", ["v"]).collect()} == {(1, "x"), (2, "z")}


def test_stream_equals_batch(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = streams.run_available(streams.first_of_key(streams.read_events(spark, sf), ["user_id", "event_type"], late="365 days").select("user_id", "event_type"))
    assert got.count() == e.select("user_id", "event_type").distinct().count()
    alerts = e.filter("event_type = 'error'")
    sent = streams.run_available(streams.debounced(streams.read_events(spark, sf).filter("event_type = 'error'").select("user_id", "ts"), "user_id", seconds=86400.0))
    want = health.debounce_alerts(alerts, "user_id", "ts", "event_id", 86400.0).filter("sent").select("user_id", F.col("ts").alias("sent_at"))
    assert sorted(map(tuple, sent.select("user_id", "sent_at").collect())) == sorted(map(tuple, want.collect()))


def test_stream_resumes(spark, sf, tmp_path):
    seen = []
    step = lambda batch, n: seen.append(batch.count())
    for _ in range(2):
        streams.run_available(streams.read_events(spark, sf), each=step, checkpoint=str(tmp_path / "state"))
    assert sum(seen) == spark.read.parquet(f"{sf}/events.parquet").count()


def test_fast_match_takes_barcodes_first(spark):
    p = spark.createDataFrame([(1, "red ring", "c1", 5.0), (2, "blue bolt big", None, 5.0)], "id long, name string, barcode string, size double")
    c = spark.createDataFrame([(10, "x", "c1", 1.0), (11, "blue bolt", None, 5.0)], "off_id long, off_name string, off_barcode string, off_size double")
    assert {(r.id, r.off_id, r.method) for r in matching.fast_match(p, c).collect()} == {(1, 10, "barcode"), (2, 11, "token")}
