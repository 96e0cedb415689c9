"""Queries on feeds, pages, lookups, groups and checks, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import candidates, grouping, history, matching, phases, relational, standardise
from tallyframe.plans.links import _parts, _vector_sides, _VEC
from tallyframe.plans.listings import _part, _q, text_of
from tallyframe.plans.offers import OFFERS, group_members, offers
from tallyframe.session import read_table, spread
from tallyframe.sources import files, web

# pages made of table rows --------------------------------------------------------------------------


def _json(spark, d):
    item = F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("sku"), F.struct(F.col("p_brand").alias("name")).alias("brand"), F.struct(F.col("p_size").cast("string").alias("price"), F.lit("EUR").alias("priceCurrency")).alias("offers"))
    return _part(spark, d).withColumn("item", F.to_json(item))


@_q("q_jsonld_extract", "SELECT p_partkey, p_name AS name, CAST(p_partkey AS VARCHAR) AS sku, p_brand AS brand, CAST(p_size AS DOUBLE) AS price, 'EUR' AS currency FROM part")
def q_jsonld_extract(spark, d):
    """A product alone, in a graph, in an array, and in a list of items."""
    forms = F.array(text_of("item"), text_of('={"@graph":[{"@type":"WebPage"},', "item", "=]}"), text_of("=[", "item", "=]"), text_of('={"itemListElement":[{"item":', "item", "=}]}"))
    json = F.element_at(forms, (F.col("p_partkey") % 4 + 1).cast("int"))
    pages = _json(spark, d).withColumn("html", text_of('=<html><script type="application/ld+json">', json, "=</script><p>x</p></html>"))
    return web.json_ld_products(pages, "p_partkey")


@_q("q_embedded_offers", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) || x AS klNr, p_name || ' [' || x || ']' AS title FROM part, (VALUES ('a'), ('b')) AS v(x)")
def q_embedded_offers(spark, d):
    """Two offers and a repeated one in an array behind its marker; titles hold brackets."""
    offer = lambda x: text_of('={"klNr":"', "p_partkey", f'={x}","title":"', "p_name", f'= [{x}]"}}')
    pages = _part(spark, d).withColumn("html", text_of('=<script>var s={"n":1,"offers":[', offer("a"), "=,", offer("b"), "=,", offer("a"), '=],"m":[2]}</script>'))
    return web.embedded_offers(pages, "struct<klNr:string,title:string>", "p_partkey", "klNr")


@_q("q_offer_json", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS sku, p_name || ' fresh' AS name, CAST(p_size + 0.38 AS DOUBLE) AS price, CAST(CASE WHEN p_size % 2 = 0 THEN p_size + 1.5 END AS DOUBLE) AS old_price FROM part")
def q_offer_json(spark, d):
    old = F.when(F.col("p_size") % 2 == 0, text_of('=,"old":"', F.col("p_size") + 1, '=,5 лв"')).otherwise("")
    json = text_of('={"klNr":"', "p_partkey", '=","title":"', "p_name", '=","subtitle":"fresh","prices":{"alternative":{"formatted":{"standard":"', "p_size", '=,38 ЛВ."', old, "=}}}}")
    return web.offer_products(_part(spark, d).withColumn("json", json), "json").select("p_partkey", "sku", "name", "price", "old_price")


@_q(
    "q_grid_items",
    "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS product_id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand, CAST(p_size AS DOUBLE) AS price_eur, CASE WHEN p_size % 3 > 0 THEN p_size + 1.0::DOUBLE END AS old_price_eur, CASE WHEN p_partkey % 3 = 0 THEN p_size * 2.0::DOUBLE ELSE round(p_size * 1.95583::DOUBLE, 2) END AS price_bgn FROM part",
)
def q_grid_items(spark, d):
    old = F.when(F.col("p_size") % 3 > 0, F.col("p_size") + 1).otherwise(0)
    leva = F.when(F.col("p_partkey") % 3 == 0, text_of('=,"priceSecond":{"price":', F.col("p_size") * 2, "=}")).otherwise("")
    json = text_of('={"gridbox":{"data":{"productId":"', "p_partkey", '=","fullTitle":"', "p_name", '=","showBrand":', F.when(F.col("p_partkey") % 2 == 0, "true").otherwise("false"), '=,"brand":{"name":"', "p_brand", '="},"price":{"price":', "p_size", '=,"oldPrice":', old, "=}", leva, "=}}}")
    return web.grid_products(_part(spark, d).withColumn("json", json), "json").select("p_partkey", "product_id", "name", "brand", "price_eur", "old_price_eur", "price_bgn")


@_q("q_priced_pages", "SELECT p_partkey, p_name AS title, p_size + 0.5 AS price, CASE WHEN p_partkey % 3 = 0 THEN p_size + 2.0::DOUBLE END AS old_price, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS category, p_size || ' kg' AS size FROM part")
def q_priced_pages(spark, d):
    data = text_of('=<script>{"price": "', "p_size", '=.5", "brand": {"@type": "Brand", "name": "', "p_brand", '="}, "category": "', "p_type", '="}</script>')
    inline = text_of('=<span class="big price">', "p_size", "=,5</span>")
    html = text_of("=<h1>", "p_name", "=</h1>", F.when(F.col("p_partkey") % 2 == 0, data).otherwise(inline), F.when(F.col("p_partkey") % 3 == 0, text_of("=<del> ", F.col("p_size") + 2, "=</del>")).otherwise(""), "=<p>in ", "p_size", "= kg bags</p>")
    return web.priced_page(_part(spark, d).withColumn("html", html)).select("p_partkey", "title", "price", "old_price", "brand", "category", "size")


@_q("q_label_prices", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 7.0 ELSE p_size + 0.5 END::DOUBLE AS price, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_size + 2.0 END::DOUBLE AS old_price FROM part")
def q_label_prices(spark, d):
    """Prices behind labels, two prices without labels, and one price."""
    new, old = text_of("p_size", "=.5 €"), text_of(F.col("p_size") + 2, "= €")
    labelled = text_of('=<div class="l">New price</div> <div class="v">', new, "=</div><div>other 99 €</div><div>Old price</div><div>", old, "=</div>")
    bare, one = text_of("=<b>", old, "=</b><i>", new, "=</i>"), F.lit("<b>7 EUR</b>")
    html = F.element_at(F.array(labelled, bare, one), (F.col("p_partkey") % 3 + 1).cast("int"))
    return web.label_prices(_part(spark, d).withColumn("html", html)).select("p_partkey", "price", "old_price")


@_q("q_marker_chunks", "SELECT p_partkey, x AS pos, CAST(p_partkey AS VARCHAR) || '-' || x AS id, CASE x WHEN 1 THEN p_size + 0.5 ELSE p_size + 1.0 END::DOUBLE AS price FROM part, (VALUES (1), (2)) AS v(x)")
def q_marker_chunks(spark, d):
    """A chunk with a nested and a flat price, and one with a flat price only."""
    html = text_of('={"a":1,"canonicalUrl":"/p/', "p_partkey", '=-1","prices":{"now":{"amount":', "p_size", '=.5}},"price":99,"canonicalUrl":"/p/', "p_partkey", '=-2","price":', F.col("p_size") + 1, "=}")
    fields = {"id": '^:"/p/([0-9-]+)', "price": [r'"amount":([0-9.]+)', r'"price":([0-9.]+)']}
    return web.after_marker(_part(spark, d).withColumn("html", html), "p_partkey", '"canonicalUrl"', fields).withColumn("price", F.col("price").try_cast("double"))


#: A page: a whole entry; one without a title, which finds the next one's; the first one again; a price that is no number; an entry
#: whose title is too far away; one that ends the page. Column names stand for their values.
LOOK_AHEAD_PAGE = [
    '<html>{"klNr":"1', "p_partkey", '","title":"', "p_name", '","subtitle":"', "p_type", '","price":', "p_size", '.5},\n{"klNr":"2', "p_partkey", '","price":', "p_size", '},{"klNr":"1', "p_partkey", '","title":"again","price":7},',
    '{"klNr":"","title":"none"},{"klNr":"3', "p_partkey", '","title":"', "p_brand", '","subtitle":"","price":1.2.3},' + "x" * 2500, '{"klNr":"4', "p_partkey", '","note":"' + "y" * 1990, '","title":"too far"},{"klNr":"5', "p_partkey", '","title":"last"',
]
_PAGE = " || ".join(x if x.startswith("p_") else "'" + x.replace("\n", "' || chr(10) || '") + "'" for x in LOOK_AHEAD_PAGE)


@_q(
    "q_look_ahead",
    f"""WITH h AS (SELECT p_partkey, {_PAGE} AS html FROM part), i AS (SELECT p_partkey, html, unnest(range(1, length(html) + 1)) AS p FROM h), m AS (SELECT p_partkey, p, substring(html, p, 2000) AS c FROM i WHERE substring(html, p, 8) = '"klNr":"'),
 f AS (SELECT *, regexp_extract(c, '^"klNr":"([0-9]+)"', 1) AS kl FROM m), o AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, kl ORDER BY p) AS n FROM f WHERE kl <> '')
 SELECT p_partkey, kl AS id, nullif(regexp_extract(c, '"title":"([^"]+)"', 1), '') AS title, nullif(regexp_extract(c, '"subtitle":"([^"]*)"', 1), '') AS subtitle, TRY_CAST(nullif(regexp_extract(c, '"price":([0-9.]+)', 1), '') AS DOUBLE) AS price FROM o WHERE n = 1 AND regexp_extract(c, '"title":"([^"]+)"', 1) <> ''""",
)
def q_look_ahead(spark, d):
    """Entries with a title within 2,000 characters of their number."""
    pages = spread(_part(spark, d)).withColumn("html", F.concat(*[F.col(x).cast("string") if x.startswith("p_") else F.lit(x) for x in LOOK_AHEAD_PAGE]))
    fields = {"title": '"title":"([^"]+)"', "subtitle": '"subtitle":"([^"]*)"', "price": r'"price":([\d.]+)'}
    return web.look_ahead(pages, "p_partkey", '"klNr":"([0-9]+)"', fields, 2000).filter("title IS NOT NULL").withColumn("price", F.col("price").try_cast("double"))


@_q("q_flat_array", "SELECT p_partkey, 'id-' || p_partkey || x AS id, p_name AS name, CASE WHEN x = 'a' THEN p_size || '.5' END AS price FROM part, (VALUES ('a'), ('b')) AS v(x)")
def q_flat_array(spark, d):
    """Two products in a flat array: id, name, price; the second has no price, and what stands before any id counts for nothing."""
    json = text_of('=["head","n:x","id-', "p_partkey", '=a","z","n:', "p_name", '=","', "p_size", '=.5","id-', "p_partkey", '=b","n:', "p_name", '="]')
    values = web.flat_array_values(_part(spark, d).withColumn("json", json), "p_partkey", F.col("json"), 30).drop("window")
    value = F.col("value")
    found = web.decoded_products(values, "p_partkey", value.startswith("id-"), {"name": (value.startswith("n:"), 30), "price": (value.rlike(r"^\d+\.\d+$"), 30)})
    return found.withColumn("name", F.substring("name", 3, 1000))


@_q("q_positions_before", "SELECT p_partkey, p AS pos, CASE WHEN p IN (3, 4) THEN 'id-' || p_partkey WHEN p = 5 AND p_partkey % 2 = 0 THEN 'id-' || p_partkey END AS id FROM part, (VALUES (0), (1), (2), (3), (4), (5)) AS v(p)")
def q_positions_before(spark, d):
    """The id at 2 reaches two places in odd arrays, and three in even ones; position 0 is never looked at."""
    json = text_of('=["id-x","a","id-', "p_partkey", '=","b","c","d"]')
    values = web.flat_array_values(_part(spark, d).withColumn("json", json), "p_partkey", F.col("json"), 30)
    near = lambda back: files.positions_before(values, "p_partkey", F.col("value").startswith("id-"), back)
    return near(2).filter("p_partkey % 2 = 1").union(near(3).filter("p_partkey % 2 = 0")).select("p_partkey", "pos", "id")


@_q("q_repaired_names", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' fresh' WHEN p_partkey % 3 = 1 THEN p_name END AS name, p_size || '%' AS fat, 'origin: here' AS origin, 2 AS n_facts FROM part")
def q_repaired_names(spark, d):
    p = _part(spark, d).withColumn("name", F.when(F.col("p_partkey") % 3 == 1, F.col("p_name")))
    patch = _part(spark, d).filter("p_partkey % 3 = 0").select("p_partkey", F.col("p_name").alias("title"), F.lit("fresh").alias("subtitle"))
    facts = web.key_facts(text_of("=<ul><li>", "p_size", "=%</li><li> origin: here </li></ul>"))
    return web.repaired_names(p, patch, "p_partkey").select("p_partkey", "name", facts["fat"].alias("fat"), facts["origin"].alias("origin"), F.size(facts["features"]).alias("n_facts"))


# feeds -----------------------------------------------------------------------------------------------


def _feed(spark, d):
    """Listings of two stores in dated files: stores by parity, dates by thirds."""
    k = F.col("p_partkey")
    file = F.concat(F.when(k % 2 == 0, "north").otherwise("south"), F.lit("_2024010"), (k % 3 + 1).cast("string"), F.lit(".json"))
    return _part(spark, d).select(F.col("p_name").alias("sku"), F.col("p_name").alias("name"), k.alias("source_row"), F.col("p_size").cast("double").alias("price"), F.col("p_brand").alias("brand"), F.when(k % 2 == 0, "north").otherwise("south").alias("store"), file.alias("source_file"))


@_q("q_newest_feed", "SELECT p_partkey AS source_row FROM part WHERE p_partkey % 3 = 2")
def q_newest_feed(spark, d):
    return files.newest_only(_feed(spark, d)).select("source_row")


@_q("q_first_by_file", "SELECT sku, source_row FROM (SELECT p_name AS sku, p_partkey AS source_row, row_number() OVER (PARTITION BY p_name ORDER BY CASE WHEN p_partkey % 2 = 0 THEN 'north' ELSE 'south' END || (p_partkey % 3), p_partkey) AS n FROM part) WHERE n = 1")
def q_first_by_file(spark, d):
    return files.first_by_file(_feed(spark, d), "sku").select("sku", "source_row")


@_q("q_accepted_rows", "SELECT p_partkey AS source_row, CASE WHEN p_size > 8 THEN 'hit' ELSE 'late' END AS late FROM part WHERE p_size BETWEEN 3 AND 40")
def q_accepted_rows(spark, d):
    return files.accepted(_feed(spark, d), 40.0, 3.0).select("source_row", F.when(F.col("price") > 8, "hit").otherwise("late").alias("late"))


@_q("q_admission", "SELECT store, count(*) AS n_rows, CAST(count(CASE WHEN price > 0 THEN 1 END) AS DOUBLE) / count(*) AS priced, count(*) >= CASE store WHEN 'north' THEN 50 ELSE 1000000 END AS admitted, CAST(count(CASE WHEN price > 0 THEN 1 END) AS DOUBLE) / count(*) < 0.5 AS warned FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'north' ELSE 'south' END AS store, CASE WHEN p_partkey % 4 <> 1 THEN p_size END AS price FROM part) GROUP BY store")
def q_admission(spark, d):
    priced = _feed(spark, d).withColumn("price", F.when(F.col("source_row") % 4 != 1, F.col("price")))
    return files.admitted(priced, {"north": 50, "south": 1000000})


@_q("q_unified_listings", "SELECT p_partkey AS source_row, CAST(p_partkey AS VARCHAR) AS sku, p_name AS name, CASE WHEN p_partkey > 0 THEN p_brand END AS brand, CASE p_partkey % 3 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size::DOUBLE ELSE round(p_size / 1.95583::DOUBLE, 2) END AS price, p_size || ' kg' AS quantity, '/' || p_partkey AS url FROM part")
def q_unified_listings(spark, d):
    k = F.col("p_partkey")
    named = {"name": (k % 3 == 0, "p_name"), "fullTitle": (k % 3 == 1, "p_name"), "title": (k % 3 == 2, "p_name"), "product_id": (k % 2 == 0, "p_partkey"), "internal_code": (k % 2 == 1, "p_partkey"), "brand": (k > 0, "p_brand")}
    prices = {"price_eur": (k % 3 == 0, "p_size"), "price": (k % 3 == 1, "p_size"), "priceSecond": (k % 3 == 2, "p_size")}
    raw = _part(spark, d)
    for field in files.LISTING.fields:
        condition, column = {**named, **prices}.get(field.name, (F.lit(False), "p_name"))
        value = {"quantity": text_of("p_size", "= kg"), "product_url": text_of("=/", "p_partkey")}.get(field.name)
        raw = raw.withColumn(field.name, (value if value is not None else F.when(condition, F.col(column))).cast(field.dataType) if field.name != "store" else F.lit("s"))
    return files.unify_listings(raw.withColumn("source_row", k)).select("source_row", "sku", "name", "brand", "price", "quantity", "url")


@_q("q_override", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) ELSE p_brand END AS p_brand, CASE p_partkey % 4 WHEN 0 THEN 'hit' WHEN 1 THEN 'failed' ELSE 'miss' END AS state FROM part")
def q_override(spark, d):
    """Better brands for a third of the keys, empty ones for another; a cache with hits, recent failures and old ones."""
    p = _part(spark, d).select("p_partkey", "p_brand")
    better = p.filter("p_partkey % 3 < 2").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.lower("p_brand")).otherwise("").alias("p_brand"))
    as_of, k = F.lit("2024-01-02 00:00:00").cast("timestamp"), F.col("p_partkey")
    cache = _part(spark, d).filter("p_partkey % 4 < 3").select("p_partkey", (k % 4 == 0).alias("ok"), (as_of - F.when(k % 4 == 2, F.expr("INTERVAL 2 HOURS")).otherwise(F.expr("INTERVAL 10 MINUTES"))).alias("fetched_at"), F.lit("x").alias("payload"))
    return files.enrich_from_cache(files.override(p, better, "p_partkey", ["p_brand"]), cache, "p_partkey", as_of).select("p_partkey", "p_brand", "state")


@_q("q_tier_waterfall", "SELECT p_partkey AS id, 'second' AS source_name FROM part WHERE p_partkey % 2 = 0")
def q_tier_waterfall(spark, d):
    """The first source has under half of the rows it should, the second enough; the third is the cache."""
    p = _part(spark, d).select(F.col("p_partkey").alias("id"))
    return relational.accepted_source([("first", p.filter("id % 50 = 0")), ("second", p.filter("id % 2 = 0")), ("cache", p)], p.count() // 2)


@_q("q_priority_first", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'a' WHEN p_partkey % 2 = 0 THEN 'b' ELSE 'c' END AS feed FROM part")
def q_priority_first(spark, d):
    p = lambda name, where: _part(spark, d).filter(where).select(F.col("p_partkey").alias("id"), F.lit(name).alias("feed"))
    return phases.priority_first([p("a", "p_partkey % 3 = 0"), p("b", "p_partkey % 2 = 0"), p("c", "true")], ["id"], ["feed"])


# history ---------------------------------------------------------------------------------------------


@_q(
    "q_current_prices",
    OFFERS + ", c AS (SELECT product_id, store, ts, ord, line, price4, lag(price4) OVER (PARTITION BY product_id, store ORDER BY ts, ord, line) AS before FROM offers), v AS (SELECT product_id, store, price4, ts AS valid_from, row_number() OVER (PARTITION BY product_id, store ORDER BY ts DESC, ord DESC, line DESC) AS n FROM c WHERE before IS NULL OR abs(price4 - before) >= 100) SELECT DISTINCT o.product_id, o.store, v.price4, v.valid_from FROM offers o JOIN v ON v.product_id = o.product_id AND v.store = o.store AND v.n = 1",
)
def q_current_prices(spark, d):
    view = offers(spark, d)
    versions = history.validity_intervals(view, ["product_id", "store"], ["ts", "ord", "line"], "price4", "ts", 100).select("product_id", "store", "price4", "valid_from", "valid_to")
    return history.current_versions(view.select("product_id", "store").distinct(), versions, ["product_id", "store"])


@_q("q_first_last_seen", "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def q_first_last_seen(spark, d):
    e = read_table(spark, d, "events")
    seen = lambda kind: e.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return history.touch(seen("view"), seen("click"), ["user_id"])


@_q("q_insert_replace", "WITH s AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'error' AND value > 10 GROUP BY 1) SELECT * FROM s UNION ALL SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM s) GROUP BY 1")
def q_insert_replace(spark, d):
    e = read_table(spark, d, "events")
    target = e.filter("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return history.insert_replace(target, e.filter("event_type = 'error' and value > 10").groupBy("user_id").agg(F.max("event_id").alias("event_id")), ["user_id"])


@_q(
    "q_price_statistics",
    OFFERS + """ SELECT product_id, CAST(floor(avg(CASE WHEN ts > TIMESTAMP '2001-01-01' - INTERVAL 30 DAY THEN price4 END) + 0.5) AS BIGINT) AS avg_30d, CAST(floor(avg(CASE WHEN ts > TIMESTAMP '2001-01-01' - INTERVAL 90 DAY THEN price4 END) + 0.5) AS BIGINT) AS avg_90d, min(price4) AS min_ever, max(price4) AS max_ever,
 CAST(floor(stddev_samp(price4) / 100 + 0.5) AS BIGINT) AS volatility, CAST(floor(regr_slope(price4, datediff('day', DATE '1970-01-01', CAST(ts AS DATE))) / 100 + 0.5) AS BIGINT) AS trend, CAST(floor((min(price4) + (avg(price4) - min(price4)) * 0.25) / 100 + 0.5) AS BIGINT) AS deal_threshold
 FROM offers WHERE ts <= TIMESTAMP '2001-01-01' GROUP BY product_id""",
)
def q_price_statistics(spark, d):
    whole = lambda c, n=1: F.floor(F.col(c) / n + 0.5).alias(c)
    stats = history.price_statistics(offers(spark, d), ["product_id"], "ts", "price4", F.lit("2001-01-01").cast("timestamp"))
    return stats.select("product_id", whole("avg_30d"), whole("avg_90d"), "min_ever", "max_ever", whole("volatility", 100), whole("trend", 100), whole("deal_threshold", 100))


@_q("q_storage_report", "SELECT CAST(floor(max(event_id) * 1000.0 / 1048576 * 1000 + 0.5) AS BIGINT) AS size_kb, CASE WHEN max(event_id) * 1000.0 / 1048576 > 1 THEN 'critical' ELSE 'ok' END AS level FROM events WHERE ts = (SELECT max(ts) FROM events)")
def q_storage_report(spark, d):
    metrics = read_table(spark, d, "events").select(F.col("ts").alias("recorded_at"), (F.col("event_id") * 1000).alias("size_bytes"))
    report = standardise.storage_report(metrics, 1.0, 1.0, 1e9)
    return report.select(F.floor(F.col("size_mb") * 1000 + 0.5).alias("size_kb"), "level")


# checks and groups -------------------------------------------------------------------------------------

_GROUPS = OFFERS + ", m AS (SELECT category || ':' || name AS group_id, product_id, store, min(price4) AS price4 FROM offers GROUP BY ALL)"


@_q("q_orphan_groups", _GROUPS + ", g AS (SELECT DISTINCT group_id, 5 AS claimed FROM m UNION ALL SELECT 'none:' || p_brand, 2 FROM part GROUP BY p_brand), a AS (SELECT group_id, count(DISTINCT store) AS n FROM m GROUP BY 1) SELECT g.group_id, claimed, coalesce(n, 0) AS actual, CASE WHEN n IS NULL THEN 'orphan' ELSE 'stores' END AS problem FROM g LEFT JOIN a USING (group_id) WHERE n IS NULL OR n <> claimed")
def q_orphan_groups(spark, d):
    members = group_members(offers(spark, d))
    claimed = members.select("group_id").distinct().withColumn("n_stores", F.lit(5)).union(_part(spark, d).select(text_of("=none:", "p_brand")).distinct().withColumn("n_stores", F.lit(2)))
    return grouping.orphan_groups(claimed, members)


@_q(
    "q_constraints",
    "SELECT 'unique:l_orderkey,l_linenumber' AS rule, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_violations FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) UNION ALL SELECT 'unique:l_partkey', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey) UNION ALL SELECT 'check:discount', count(*) FROM lineitem WHERE NOT l_discount <= 0.07 UNION ALL SELECT 'reference:part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)",
)
def q_constraints(spark, d):
    return grouping.constraint_violations(read_table(spark, d, "lineitem"), [["l_orderkey", "l_linenumber"], ["l_partkey"]], {"discount": F.col("l_discount") <= 0.07}, {"part": ("l_partkey", _part(spark, d).filter("p_size > 5"), "p_partkey")})


@_q("q_feed_coverage", OFFERS + " SELECT store, count(*) AS n_rows, CAST(count(CASE WHEN size > 25 THEN 1 END) AS DOUBLE) / count(*) AS quantity, CAST(count(CASE WHEN contains(name, 'red') THEN 1 END) AS DOUBLE) / count(*) AS described, CAST(count(CASE WHEN old4 > price4 THEN 1 END) AS DOUBLE) / count(*) AS was FROM offers GROUP BY store")
def q_feed_coverage(spark, d):
    return relational.coverage(offers(spark, d), ["store"], {"quantity": F.col("size") > 25, "described": F.contains("name", F.lit("red")), "was": F.col("old4") > F.col("price4")})


_PAIRED = "FROM m a JOIN m b ON a.group_id = b.group_id AND a.product_id < b.product_id"


@_q(
    "q_repaired_groups",
    "WITH m AS (SELECT p_type AS group_id, p_partkey AS product_id, CASE WHEN p_partkey % 2 = 0 THEN 'n' ELSE 's' END AS store, p_retailprice AS price, p_name FROM part), p AS (SELECT a.group_id, a.product_id AS a, b.product_id AS b, len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) > 0 AS ok " + _PAIRED + "), s AS (SELECT group_id, a AS product_id, ok FROM p UNION ALL SELECT group_id, b, ok FROM p), k AS (SELECT group_id, product_id FROM s GROUP BY ALL HAVING 2 * count(CASE WHEN ok THEN 1 END) >= count(*)), l AS (SELECT m.* EXCLUDE (p_name) FROM m JOIN k USING (group_id, product_id)) SELECT * FROM l WHERE group_id IN (SELECT group_id FROM l GROUP BY 1 HAVING count(DISTINCT store) >= 2 AND max(price) <= 100 * min(price))",
)
def q_repaired_groups(spark, d):
    """Groups of a type; names match if they share a word."""
    p = _part(spark, d).select(F.col("p_type").alias("group_id"), F.col("p_partkey").alias("product_id"), F.when(F.col("p_partkey") % 2 == 0, "n").otherwise("s").alias("store"), F.col("p_retailprice").alias("price"), F.split("p_name", " ").alias("w"))
    return grouping.repaired_by_class(p, "w", F.arrays_overlap, 100.0)


@_q("q_denied_groups", _GROUPS + " SELECT group_id, count(*) AS n FROM m WHERE group_id NOT IN (SELECT p_type || ':' || p_name FROM part WHERE p_size < 10) GROUP BY 1")
def q_denied_groups(spark, d):
    groups = group_members(offers(spark, d)).groupBy("group_id").agg(F.count("*").alias("n"))
    return phases.denied(groups, _part(spark, d).filter("p_size < 10").select(F.concat_ws(":", "p_type", "p_name").alias("group_id")).distinct(), "group_id")


@_q("q_samples", "SELECT p_type, array_to_string(list_sort(list(p_name)), ',') AS names FROM (SELECT p_type, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part) WHERE n <= 3 GROUP BY 1")
def q_samples(spark, d):
    found = standardise.samples(_part(spark, d), "p_type", "p_name", ["p_partkey"])
    return found.select("p_type", F.array_join("samples", ",").alias("names"))


# lookups and matches -----------------------------------------------------------------------------------


@_q("q_key_groups", "WITH k AS (SELECT lower(p_brand) || ':' || p_type || ':' || p_size // 10 || ':' || CASE WHEN contains(p_name, 'red') THEN 'red' ELSE '' END AS key, p_partkey % 3 AS store, p_partkey AS id FROM part) SELECT key, count(DISTINCT store) AS n_stores, array_to_string(list_sort(list_distinct(list(id))), ',') AS members FROM k GROUP BY key HAVING count(DISTINCT store) >= 2")
def q_key_groups(spark, d):
    variants = F.filter(F.array(F.when(F.contains("p_name", F.lit("red")), "red")), lambda v: v.isNotNull())
    keyed = _part(spark, d).select(matching.match_key(F.col("p_brand"), F.col("p_type"), F.floor(F.col("p_size") / 10), variants).alias("key"), (F.col("p_partkey") % 3).alias("store"), F.col("p_partkey").alias("id"))
    return phases.shared_identifier_groups(keyed, "key", "store", "id").select("key", "n_stores", F.array_join("members", ",").alias("members"))


@_q("q_containing_brands", "SELECT DISTINCT a.b AS a, b.b AS b FROM (SELECT DISTINCT substring(lower(p_brand), 1, 1 + CAST(p_partkey % 8 AS INTEGER)) AS b FROM part) a JOIN (SELECT DISTINCT lower(p_brand) AS b FROM part) b ON a.b = b.b OR length(a.b) >= 4 AND contains(b.b, a.b) OR length(b.b) >= 4 AND contains(a.b, b.b)")
def q_containing_brands(spark, d):
    """Beginnings of brands against whole brands."""
    p = _part(spark, d)
    starts = p.select(F.substr(F.lower("p_brand"), F.lit(1), (1 + F.col("p_partkey") % 8).cast("int")).alias("a"))
    return phases.containing_brand_pairs(starts, p.select(F.lower("p_brand").alias("b")), "a", "b")


@_q(
    "q_name_lookup",
    "WITH t AS (SELECT p_partkey AS hit, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE string_split(p_name, ' ')[-1] || ' x' END AS known FROM part WHERE p_size > 25), r AS (SELECT p_partkey AS row_id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'new ' || p_name ELSE string_split(p_name, ' ')[-1] END AS name FROM part), e AS (SELECT known, min(hit) AS hit FROM t GROUP BY 1) SELECT row_id, coalesce(a.hit, b.hit, (SELECT min(hit) FROM t WHERE contains(known, r.name) OR contains(r.name, known))) AS hit FROM r LEFT JOIN e a ON a.known = r.name LEFT JOIN e b ON b.known = nullif(regexp_replace(r.name, '^[^ ]+ ?', ''), '')",
)
def q_name_lookup(spark, d):
    last, k = F.element_at(F.split("p_name", " "), -1), F.col("p_partkey")
    table = _part(spark, d).filter("p_size > 25").select(k.alias("hit"), F.when(k % 2 == 0, F.col("p_name")).otherwise(F.concat(last, F.lit(" x"))).alias("known"))
    rows = _part(spark, d).select(k.alias("row_id"), F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.concat(F.lit("new "), "p_name")).otherwise(last).alias("name"))
    return phases.name_lookup(rows, table.withColumn("ord", F.col("hit")), "name", "known", "hit", "ord").select("row_id", "hit")


@_q("q_prefix_lookup", "SELECT p_partkey AS row_id, hit FROM part LEFT JOIN (SELECT substring(lower(p_name), 1, 6) AS p, max(p_partkey) AS hit FROM part WHERE p_size > 25 GROUP BY 1) ON p = substring(lower(p_name), 1, 6)")
def q_prefix_lookup(spark, d):
    table = _part(spark, d).filter("p_size > 25").select(F.col("p_partkey").alias("hit"), F.col("p_name").alias("known"))
    return phases.prefix_lookup(_part(spark, d).select(F.col("p_partkey").alias("row_id"), "p_name"), table.withColumn("ord", F.col("hit")), "p_name", "known", "hit", "ord", 6).select("row_id", "hit")


@_q("q_nn_tiers", f"WITH {_VEC} SELECT a, b, score, CASE WHEN score >= 300000 THEN 'confident' WHEN score >= 200000 THEN 'likely' ELSE 'low' END AS tier FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS x FROM p) WHERE x = 1 AND score >= 100000")
def q_nn_tiers(spark, d):
    nearest = candidates.nearest(*_vector_sides(spark, d), ["label"], "vec_id", "embedding", 0.1).filter("side = 'a'")
    return matching.with_tiers(nearest.select(F.col("own").alias("a"), F.col("other").alias("b"), "score"), "score", [(300000, "confident"), (200000, "likely"), (100000, "low")])


@_q("q_quantity_join", "SELECT a.p_partkey AS a, min(b.p_partkey) AS b, count(*) AS n FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey AND a.p_size >= 0.8 * b.p_size AND a.p_size <= 1.2 * b.p_size GROUP BY 1")
def q_quantity_join(spark, d):
    fits = lambda x, y: (x >= 0.8 * y) & (x <= 1.2 * y)
    return matching.first_and_count(_parts(spark, d), ["brand", "type"], "id", "size", fits)
