"""Matchers against plain Python on small tables, sources and sinks on small files, streams against batches."""

import difflib
import json
import sys
import types

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import quantity
from tallyframe.operators import health, history, matching, relational
from tallyframe.sources import files
from tallyframe.streaming import streams

PRODUCTS = [
    (1, "n", "dairy", "fresh milk red", "acme", 1.0, "l", 2.0),
    (2, "s", "dairy", "fresh milk reds", "acme", 1000.0, "ml", 2.5),
    (3, "s", "dairy", "fresh milk red", "other", 3.0, "l", 2.0),
    (4, "n", "dairy", "fresh milk blue xl", "acme inc", None, None, 9.0),
    (5, "s", "other", "fresh milk red", None, None, None, 2.0),
    (6, "n", "other", "fresh milk red", None, 1.0, "kg", 2.2),
    (7, "n", "other", "apples per kg", None, 2.0, "kg", 2.2),
    (8, "s", "other", "apples per 1 kg", None, 7.0, "kg", 2.0),
    (9, "n", "dairy", "xy", None, None, None, 1.0),
    (10, "s", "dairy", "fresh milk red", "acme", 1.0, "l", 99.0),
    (11, "n", "dairy", "totally different thing", "Acme", 1.0, "l", 2.0),
]
DDL = "id long, store string, category string, name string, brand string, quantity double, unit string, price double"
BASE = {"l": (1000, "ml"), "ml": (1, "ml"), "kg": (1000, "g")}


def ratio(a, b):
    return difflib.SequenceMatcher(None, a or "", b or "").ratio()


def agree(p, q):
    """True, False, or None if exactly one quantity is missing."""
    if not p[5] and not q[5]:
        return True
    if not p[5] or not q[5]:
        return None
    (f, u), (g, v) = BASE[p[6]], BASE[q[6]]
    return u == v and 0.8 <= p[5] * f / (q[5] * g) <= 1.2


def pairs(most):
    for p in PRODUCTS:
        for q in PRODUCTS:
            if p[0] < q[0] and p[1] != q[1] and p[2] == q[2] and abs(p[7] - q[7]) / min(p[7], q[7]) * 100 <= most:
                yield p, q


def test_ratio_match_equals_plain_python(spark):
    want = {(p[0], q[0]): ratio(p[3], q[3]) for p, q in pairs(200) if p[2] != "other" and ratio(p[3], q[3]) >= 0.7 and agree(p, q) is not False}
    got = {(r.a, r.b): r.score for r in matching.ratio_match(spark.createDataFrame(PRODUCTS, DDL)).collect()}
    assert got == pytest.approx(want) and want


def test_sign_match_equals_plain_python(spark):
    want = {}
    for p, q in pairs(150):
        signs = [sorted(s for s in ("xl", "red") if s in x[3]) for x in (p, q)]
        kilo = all("per kg" in x[3] or "per 1 kg" in x[3] for x in (p, q))
        fits = kilo or agree(p, q) or (agree(p, q) is None and p[2] != "other")
        if min(len(p[3]), len(q[3])) < 3 or signs[0] != signs[1] or not fits:
            continue
        n = ratio(p[3], q[3])
        m = ratio(p[4].lower(), q[4].lower()) if p[4] and q[4] else 0
        if m >= 0.85 and n >= 0.55:
            want[p[0], q[0]] = (0.3 * m + 0.7 * n, "brand+name")
        elif n >= 0.65:
            want[p[0], q[0]] = (n, "name_only")
    got = {(r.a, r.b): (r.score, r.method) for r in matching.sign_match(spark.createDataFrame(PRODUCTS, DDL), ["xl", "red"]).collect()}
    assert set(got) == set(want) and all(got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1] for k in want) and len({m for _, m in want.values()}) == 2


CATALOGUE = [(10, "fresh milk", "acme"), (11, "fresh red milk", "acme foods"), (12, "apples", "akme"), (13, "milk", "coca cola"), (14, "fresh milk red", None)]


def test_offline_match_equals_plain_python(spark):
    products = [(1, "fresh milk red", "acme"), (2, "milk", "coca-cola"), (3, "apples", "akmee"), (4, "bread", None), (5, "milk", "zz")]
    want = {}
    for pid, name, brand in products:
        found = [c for c in CATALOGUE if brand and c[2] and {w for w in brand.split() if len(w) > 2} & set(c[2].split())] or CATALOGUE
        best = None
        for off_id, off_name, off_brand in found:
            score = 0.0
            if brand and off_brand:
                a, b = brand.replace("-", " "), off_brand.replace("-", " ")
                score = 0.5 if a in b or b in a else 0.4 if ratio(a, b) > 0.8 else 0.0
            x, y = set(name.split()), set(off_name.split())
            score += 0.3 * len(x & y) / max(len(x), len(y)) + 0.2 * ratio(name, off_name)
            if best is None or score > best[1]:
                best = (off_id, score)
        if best[1] >= 0.6:
            want[pid] = best
    got = {r.id: (r.off_id, r.confidence) for r in matching.offline_match(spark.createDataFrame(products, "id long, name string, brand string"), spark.createDataFrame(CATALOGUE, "off_id long, off_name string, off_brand string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(got[k][1] == pytest.approx(want[k][1]) for k in want) and len(want) >= 3


def test_multi_pass_scores(spark):
    p = spark.createDataFrame([(1, "red ring", "acme", 10.0), (2, "blue bolt", "acme", 10.0), (3, "small green gear", "nord", 5.0)], "id long, name string, brand string, size double")
    c = spark.createDataFrame([(10, "red ring", "acme", 10.0), (11, "blue bolt", "acme", 9.5), (12, "small green gear", "nordic", 5.0)], "off_id long, off_name string, off_brand string, off_size double")
    got = {r.id: (r.off_id, r["pass"], round(r.confidence, 9)) for r in matching.multi_pass_match(p, c, brand_cap=None, token_cap=None).collect()}
    assert got == {1: (10, 1, 0.95), 2: (11, 2, round(0.40 + 0.35 + 0.25 * 0.9, 9)), 3: (12, 3, round(0.4 * 0.8 + 0.35 + 0.25, 9))}


def test_containing_and_alike_pairs(spark):
    a = ["a", "ab", "cola", "coca cola", "x", "", "nordwind"]
    b = ["b", "coca cola light", "cola", "xy", "nordwinds", None]
    left, right = spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string")
    want = {(x, y) for x in a for y in b if x and y and (x in y or y in x)}
    assert {(r.a, r.b) for r in matching.containing_pairs(left, right, "a", "b").collect()} == want
    near = {(x, y) for x in a for y in b if x and y and ratio(x, y) > 0.7}
    assert {(r.a, r.b) for r in matching.alike_pairs(left, right, "a", "b", 0.7).collect()} == near


def test_close_brand_pairs(spark):
    from tallyframe.operators import phases

    a, b = ["acme", "nordwind", "zz"], ["acme foods", "nordwynd", "xy", "zz"]
    got = phases.close_brand_pairs(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string"), "a", "b")
    assert {(r.a, r.b) for r in got.collect()} == {(x, y) for x in a for y in b if x in y or y in x or ratio(x, y) > 0.7} and got.count() == 3


def parts(sf):
    import duckdb

    return duckdb.sql(f"SELECT p_partkey, p_name, lower(p_brand), p_type, p_size FROM '{sf}/part.parquet'").fetchall()


def test_blends_equal_plain_python(spark, sf):
    import __spark_entry__ as entry

    rows = {p[0]: p for p in parts(sf)}
    got = entry.queries()["r_blends"](spark, sf).collect()
    assert len(got) == sum(p[2:4] == q[2:4] for p in rows.values() for q in rows.values() if p[0] < q[0])
    for r in got:
        x, y, seq = set(rows[r.a][1].split()), set(rows[r.b][1].split()), ratio(rows[r.a][1], rows[r.b][1])
        j, o = len(x & y) / len(x | y), len(x & y) / max(len(x), len(y))
        assert (r.strict, r.passes, r.translit) == pytest.approx((0.6 * j + 0.4 * seq, 0.6 * o + 0.4 * seq, 0.6 * seq + 0.4 * j))


def test_api_hits_equal_plain_python(spark, sf):
    import __spark_entry__ as entry

    rows, want = parts(sf), {}
    words = lambda n: {w for w in n.split() if len(w) > 2}
    for p in rows:
        if p[0] % 2:
            continue
        scores = []
        for q in rows:
            if q[0] % 2 and p[2] == q[2]:
                apart = max(p[4], q[4]) / min(p[4], q[4])
                scores.append((-(0.4 + min(0.1 * len(words(p[1]) & words(q[1])), 0.4) + (0.2 if apart <= 1.1 else 0.1 if apart <= 1.5 else 0) + 0.2 * ratio(p[1], q[1])), q[0]))
        if scores and -min(scores)[0] >= 0.55:
            want[p[0]] = min(scores)
    got = {r.id: (-r.score, r.off_id) for r in entry.queries()["r_api_hits"](spark, sf).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want) and want


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_similar_pairs_miss_nothing(spark, least):
    import random

    draw = random.Random(int(least * 10))
    rows = [(i, draw.choice("xy"), [draw.choice("abcdefgh") for _ in range(draw.randint(0, 7))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, block string, words array<string>")
    want = {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and p[1] == q[1] and p[2] and q[2] and len(set(p[2]) & set(q[2])) >= least * len(set(p[2]) | set(q[2]))}
    got = {(r.l.id, r.r.id) for r in matching.similar_pairs(df, "id", ["block"], F.col("words"), least).collect()}
    assert want <= got and len(got) < 60 * 59 / 2


def test_best_candidate_without_scores(spark):
    df = spark.createDataFrame([(1, 5, None), (1, 4, 0.5), (1, 3, 0.5), (2, 7, None), (2, 6, None)], "p long, c long, s double")
    assert {(r.p, r.c, r.s) for r in matching.best_candidate(df, "p", "c", "s").collect()} == {(1, 3, 0.5), (2, 6, None)}


def test_numbers_are_consecutive_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"), "id").repartition(7)
    rows = relational.numbered(df, [F.col("v").desc()]).collect()
    assert [r.n for r in sorted(rows, key=lambda r: -r.v)] == list(range(1, 1001))


def test_accepted_source_falls_back(spark):
    few, none = spark.range(3), spark.range(0)
    for sources, want in ((([("a", few), ("b", none)]), "a"), ([("a", none), ("b", few)], "b"), ([("a", none), ("b", few), ("c", few)], "b")):
        assert {r.source_name for r in relational.accepted_source(sources, 4).collect()} == {want}


def test_document_index_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, token string")
    files.write_document(df, df.limit(1), str(tmp_path / "d"), {"source": "t"})
    assert json.loads(spark.read.text(str(tmp_path / "d/meta")).first().value) == {"source": "t"}
    assert (spark.read.json(str(tmp_path / "d/products")).count(), spark.read.json(str(tmp_path / "d/groups")).count()) == (2, 1)
    files.write_index(df, str(tmp_path / "i"))
    files.replace_table(df, str(tmp_path / "t"))
    files.replace_table(df.limit(1), str(tmp_path / "t"))
    files.append_rows(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3 and spark.read.parquet(str(tmp_path / "i")).count() == 2
    (tmp_path / "c.json").write_text('{"a": [1, 2]}')
    assert files.load_config(spark, str(tmp_path / "c.json")) == {"a": [1, 2]}


def test_listings_keep_the_order_of_their_files(spark, tmp_path):
    (tmp_path / "a_1.json").write_text(json.dumps([{"sku": "1", "name": "z first", "price": 1.0}, {"sku": "1", "name": "a second", "price": 2.0}]))
    (tmp_path / "b_1.json").write_text(json.dumps([{"sku": "1", "name": "b", "price": 3.0}, {"sku": "2", "name": "c", "price": 4.0}]))
    rows = files.unify_listings(files.read_listings(spark, str(tmp_path)))
    assert {(r.sku, r.name) for r in files.first_by_file(rows, "sku").collect()} == {("1", "z first"), ("2", "c")}


def test_scans_with_results(spark, tmp_path):
    for name in ("a.png", "b.png"):
        (tmp_path / name).write_bytes(b"123")
    results = spark.createDataFrame([("a.png", "ACME")], "file_name string, brand string")
    assert {(r.file_name, r.brand, r.length) for r in files.read_with_results(spark, str(tmp_path), results, "*.png").collect()} == {("a.png", "ACME", 3), ("b.png", None, 3)}


def test_paged_source_by_offset(spark):
    module = types.ModuleType("paged_fake")
    exec("def fetch(offset, size):\n    return [(str(i % 5), str(i)) for i in range(offset, offset + size)]", module.__dict__)  # noqa: S102
    sys.modules["paged_fake"] = module
    files.register_paged(spark)
    source = files._PagedReader({"fetch": "paged_fake:fetch", "total": "12", "fetchsize": "5"})
    rows = [r for part in source.partitions() for r in source.read(part)]
    assert [b for _, b in rows] == [str(i) for i in range(12)] and len(source.partitions()) == 3
    last = files.latest_pages(spark.createDataFrame([(a, int(b)) for a, b in rows], "id string, body long"), "id", ["body"])
    assert {(r.id, r.body) for r in last.collect()} == {("0", 10), ("1", 11), ("2", 7), ("3", 8), ("4", 9)}


def test_breaker_stream_equals_batch(spark, sf):
    failed = F.col("event_type").isin("error", "view")
    rules = health.BreakerRules(3, 6 * 3600.0, 2)
    got = streams.run_available(streams.breaker_states(streams.read_events(spark, sf).withColumn("failed", failed), "user_id", "failed", rules))
    want = health.circuit_breaker(spark.read.parquet(f"{sf}/events.parquet").withColumn("failed", failed), "user_id", "ts", "event_id", "failed", rules)
    pick = lambda df: sorted((r.event_id, r.state, r.allowed) for r in df.collect())
    assert pick(got) == pick(want)


def test_sync_over_several_batches_equals_one_pass(spark, tmp_path):
    """Three files in three batches: each is classified against the prices known before it, from one table."""
    from tallyframe.session import scratch_path

    rows = [[(1, 10.0, 1), (2, 5.0, 1)], [(1, 12.0, 2), (3, 1.0, 2)], [(1, 12.0, 3), (2, 4.0, 3), (3, 9.0, 3)]]
    schema = "id long, price double, at long"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    out = scratch_path(spark, "sync-test")
    step = streams.sync_batches(spark.createDataFrame([(1, 10.0)], "id long, price double"), out, ["id"], "price", ["at"], 0.01)
    for i in range(3):
        step(spark.read.parquet(str(tmp_path / f"in/{i}")), i)
    got = {(r.batch, r.id, r.outcome) for r in spark.read.parquet(out).collect()}
    assert got == {(0, 1, "unchanged"), (0, 2, "new"), (1, 1, "increase"), (1, 3, "new"), (2, 1, "unchanged"), (2, 2, "decrease"), (2, 3, "increase")}


def test_size_units_come_from_one_table(spark):
    texts = {"2 x 500 грама": (1000.0, "g"), "1 литър": (1000.0, "ml"), "3 pieces": (3.0, "pcs"), "0,5 л": (500.0, "ml"), "1 кг": (1000.0, "g")}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", quantity.parse_quantity(F.col("t")).alias("q"))
    assert {r.t: (r.q.value, r.q.unit) for r in df.collect()} == texts


def test_touch_and_current_versions(spark):
    target, seen = spark.createDataFrame([(1, 5, 6)], "id long, first_seen long, last_seen long"), spark.createDataFrame([(1, 3, 9), (2, 7, 7)], "id long, first_seen long, last_seen long")
    assert {tuple(r) for r in history.touch(target, seen, ["id"]).collect()} == {(1, 3, 9), (2, 7, 7)}
