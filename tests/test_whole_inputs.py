"""Queries over all rows of their tables: results equal SQL without cuts, or brute force, on inputs where a cut would show."""

import collections
import difflib
import os
import re

import duckdb

import __spark_entry__ as entry
from tallyframe.operators import matching, phases
from tallyframe.plans.offers import OFFERS

SF = "/root/testdata/sf0.001"


def tables(sf=SF):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def same_as_sql(spark, name, sql, sf=SF):
    con = tables(sf)
    got, want = entry.queries()[name](spark, sf), con.sql(sql)
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    at = [want.columns.index(c) for c in order]
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    found = sorted((tuple(r[c] for c in order) for r in got.collect()), key=key)
    assert found == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
    return found


def test_shared_identifier_reads_all_orders(spark):
    same_as_sql(spark, "q_shared_identifier", OFFERS + " SELECT product_id, count(DISTINCT store) AS n_stores, string_agg(DISTINCT store, ',' ORDER BY store) AS stores FROM offers GROUP BY product_id HAVING count(DISTINCT store) >= 2")


def test_inverted_index_keeps_all_postings(spark):
    found = same_as_sql(spark, "q_inverted_index", "SELECT token, count(*) AS n, min(p_partkey) AS low, max(p_partkey) AS high FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part) GROUP BY 1", "/root/testdata/sf0.01")
    assert min(n for _, _, n, _ in found) > 100


def test_qty_compat_classes_pairs_all_parts(spark):
    sql = """SELECT a.p_partkey, b.p_partkey AS other, CASE WHEN r <= 1.3 THEN 'same_size' WHEN r <= 5 THEN 'different_size' ELSE 'incompatible' END AS class4, r <= 1.25 AS agree25, x / y BETWEEN 0.75 AND 1.25 AS between75, abs(x - y) <= 0.15 * greatest(x, y) AS share15
 FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey, LATERAL (SELECT CAST(a.p_size AS DOUBLE) AS x, CAST(b.p_size AS DOUBLE) AS y), LATERAL (SELECT greatest(x, y) / least(x, y) AS r)"""
    found = same_as_sql(spark, "q_qty_compat_classes", sql, "/root/testdata/sf0.01")
    assert any(400 <= v for r in found for v in r if type(v) is int)


def test_tier_waterfall_takes_the_second_source_at_any_size(spark):
    same_as_sql(spark, "q_tier_waterfall", entry.oracle_sql()["q_tier_waterfall"], "/root/testdata/sf0.1")


def test_parse_quantity_reads_packs(spark):
    """A pack without a known unit after it takes the first unit's letters anywhere in the label, as the reference does."""
    base = {"g": (1.0, "g"), "kg": (1000.0, "g"), "ml": (1.0, "ml"), "l": (1000.0, "ml")}
    want = {}
    for key, name, size in duckdb.sql(f"SELECT p_partkey, p_name, p_size FROM '{SF}/part.parquet'").fetchall():
        packs, unit = (2 if key % 7 == 0 else 1), [" g", " kg", "ml", " l", " pcs", ""][key % 6]
        label = f"{name} {'2 x ' if packs == 2 else ''}{size}{unit}"
        written = unit.strip()
        if packs == 2 and written not in base:
            written = (re.search("ml|l|g|kg", label) or [""])[0]
        scale, kind = base.get(written, (1.0, written or None))
        want[key] = (label, None if packs == 1 and not unit else packs * size * scale, kind)
    got = {r.p_partkey: (r.label, r.value, r.unit) for r in entry.queries()["q_parse_quantity"](spark, SF).collect()}
    assert got == want and sum(" 2 x " in v[0] for v in got.values()) == 29


def parts(sf=SF):
    return duckdb.sql(f"SELECT p_partkey, p_name, lower(p_brand), p_type, p_size FROM '{sf}/part.parquet'").fetchall()


def ratio(a, b):
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


def test_importer_matches_all_parts(spark):
    left, right = [p for p in parts() if p[0] % 2 == 0], [p for p in parts() if p[0] % 2 == 1]
    want = collections.Counter()
    for a in left:
        for b in right:
            if a[0] % 10 == 0 and b[0] == a[0] + 1:
                want[a[0], b[0], 1.0, "barcode"] += 1
            if (a[2] in b[2] or b[2] in a[2]) and ratio(a[1], b[1]) >= 0.6:
                want[a[0], b[0], round(ratio(a[1], b[1]), 9), "brand"] += 1
            if a[1][:20] == b[1][:20] and ratio(a[1], b[1]) >= 0.7:
                want[a[0], b[0], round(ratio(a[1], b[1]) * 0.8, 9), "prefix"] += 1
    got = collections.Counter((r.id, r.off_id, round(r.confidence, 9), r.method) for r in entry.queries()["r_importer_matches"](spark, SF).collect())
    assert got == want


def test_jaccard_matcher_pairs_all_sizes(spark):
    stores = dict(tables().sql(OFFERS + " SELECT product_id, arg_min(store, {'a': price4, 'b': store}) FROM offers GROUP BY 1").fetchall())
    rows = [p for p in parts() if p[0] in stores]
    words = lambda p: {w for w in p[1].split() if len(w) > 1}
    score = lambda a, b: len(words(a) & words(b)) / len(words(a) | words(b))
    want = {(a[0], b[0], round(score(a, b), 9)) for a in rows for b in rows if a[3] == b[3] and stores[a[0]] < stores[b[0]] and score(a, b) >= 0.3}
    assert {(r.a, r.b, round(r.score, 9)) for r in entry.queries()["r_jaccard_matcher"](spark, SF).collect()} == want


def test_matchers_get_whole_sides(spark, monkeypatch):
    seen = {}
    for name in ("hybrid_match", "transliterated_match"):
        real = getattr(phases, name)
        monkeypatch.setattr(phases, name, lambda *a, name=name, real=real: seen.update({name: a}) or real(*a))
    ids = {p[0] for p in parts() if p[0] % 2 == 0}
    assert {r.id for r in entry.queries()["r_hybrid_match"](spark, SF).collect()} == ids
    assert {r.id for r in entry.queries()["r_transliterated_match"](spark, SF).collect()} == ids
    assert all((a[0].count(), a[1].count()) == (100, 100) for a in seen.values()) and seen["hybrid_match"][2] == 100


LAST = "SELECT user_id, arg_max(event_id, {'a': ts, 'b': event_id}) AS event_id, arg_max(value, {'a': ts, 'b': event_id}) AS value FROM events WHERE "


def test_upsert_merge_reads_all_users(spark):
    same_as_sql(
        spark,
        "q_upsert_merge",
        f"WITH t AS ({LAST} event_type = 'view' GROUP BY 1), s AS ({LAST} event_type = 'click' GROUP BY 1) "
        "SELECT coalesce(t.user_id, s.user_id) AS user_id, coalesce(s.event_id, t.event_id) AS event_id, coalesce(s.value, t.value) AS value, CASE WHEN t.user_id IS NULL THEN 'inserted' WHEN s.user_id IS NULL THEN 'kept' ELSE 'updated' END AS action FROM t FULL JOIN s ON t.user_id = s.user_id",
        "/root/testdata/sf0.01",
    )


def test_insert_ignore_reads_all_users(spark):
    same_as_sql(spark, "q_insert_ignore", "WITH t AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT * FROM t UNION ALL SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM t) GROUP BY 1")


def test_fallback_lookup_reads_all_parts(spark):
    sql = """WITH a AS (SELECT p_name AS name, min(p_partkey) AS hit FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), b AS (SELECT string_split(p_name, ' ')[-1] AS w, min(p_partkey) AS hit FROM part GROUP BY 1)
 SELECT p_partkey AS row_id, coalesce(a.hit, b.hit) AS hit FROM part LEFT JOIN a ON a.name = p_name LEFT JOIN b ON b.w = string_split(p_name, ' ')[-1]"""
    same_as_sql(spark, "q_fallback_lookup", sql)


def test_nulls_last_sorts_all_orders(spark, tmp_path):
    """Order keys from 2000 on come first by line, so the page depends on orders beyond the first 300."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT range AS o_orderkey FROM range(3000)) TO '{tmp_path}/orders.parquet'")
    con.sql(f"COPY (SELECT range AS l_orderkey, CASE WHEN range < 2000 THEN 2 ELSE 1 END AS l_linenumber FROM range(2950)) TO '{tmp_path}/lineitem.parquet'")
    got = entry.queries()["q_nulls_last"](spark, str(tmp_path)).collect()
    assert [(r.ord, r.line) for r in got] == [(k, 1) for k in range(2000, 2200)]


def test_shared_tokens_count_short_words(spark):
    token = "SELECT DISTINCT {0}, token FROM (SELECT {0}, unnest(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) AS token FROM {1}) WHERE length(token) > 2"
    same_as_sql(spark, "q_shared_tokens_ge2", f"SELECT doc_id, item_id, count(*) AS shared FROM ({token.format('doc_id', 'documents')}) JOIN ({token.format('item_id', 'benchmark')}) USING (token) GROUP BY ALL HAVING count(*) >= 2")


def test_fast_match_by_brand_and_by_spelling(spark):
    p = spark.createDataFrame([(1, "red ring", None, "acme", None), (2, "yoghurt creamy natural organic plain", None, None, None), (3, "zzz", None, None, None)], "id long, name string, barcode string, brand string, size double")
    c = spark.createDataFrame([(10, "widget", None, "acme foods", None), (11, "plain yoghurts creamyy naturale organics", None, None, None)], "off_id long, off_name string, off_barcode string, off_brand string, off_size double")
    got = {r.id: (r.off_id, r.method, round(r.confidence, 9)) for r in matching.fast_match(p, c).collect()}
    assert got[1] == (10, "token", 0.5)
    assert 3 not in got
    p = spark.createDataFrame([(2, "abcdefgh jklmnop qrstuvw zyxwvut milk one two", None, None)], "id long, name string, barcode string, size double")
    c = spark.createDataFrame([(11, "milk abcdefgk jklmnoq", None, None), (12, "abcdefgh jklmnox qrstuvx zyxwvux milks ones twos", None, None)], "off_id long, off_name string, off_barcode string, off_size double")
    best = ratio("abcdefgh jklmnop qrstuvw zyxwvut milk one two", "abcdefgh jklmnox qrstuvx zyxwvux milks ones twos") * 0.8
    got = [(r.id, r.off_id, r.method, round(r.confidence, 9)) for r in matching.fast_match(p, c).collect()]
    assert got == [(2, 12, "fuzzy", round(best, 9))]


def test_hybrid_match_ends_with_spelling(spark):
    p = spark.createDataFrame([(1, "chocolate", "none", 1.0, None), (2, "qq", "none", 1.0, None)], "id long, name string, brand string, size double, barcode string")
    c = spark.createDataFrame([(10, "chocolates", "x", 1.0, None), (11, "bread", "x", 1.0, None)], "off_id long, off_name string, off_brand string, off_size double, off_barcode string")
    got = [(r.id, r.off_id, r.method, round(r.confidence, 9)) for r in phases.hybrid_match(p, c, 2).collect()]
    assert got == [(1, 10, "fuzzy", round(0.5 * ratio("chocolate", "chocolates"), 9))]
