"""The price view over the star schema, and queries on it with their SQL twins.

A store is a supplier's region; an offer is a line item. price4 and old4 are
whole ten-thousandths, so that sums and comparisons are exact everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators import history, relational
from tallyframe.plans.catalog import register
from tallyframe.session import read_table

OFFERS = """
WITH offers AS (
  SELECT l_orderkey AS ord, l_linenumber AS line, p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS category,
         p_size AS size, r_name AS store, CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS price4,
         CAST(round(l_extendedprice * 100) AS BIGINT) * 100 AS old4, CAST(round(l_discount * 100) AS BIGINT) AS off, l_shipdate AS ts
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def offers(spark, sf_dir) -> DataFrame:
    """One row per line item with its product and store. Dimensions are joined by key; Spark broadcasts those below its size limit."""
    t = lambda name: read_table(spark, sf_dir, name)
    stores = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("store"))
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    return (
        t("lineitem")
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(stores, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
            F.col("p_type").alias("category"), F.col("p_size").alias("size"), "store", (cents("l_extendedprice") * (100 - cents("l_discount"))).alias("price4"),
            (cents("l_extendedprice") * 100).alias("old4"), cents("l_discount").alias("off"), F.col("l_shipdate").alias("ts"),
        )
    )


def money(column) -> F.Column:
    return (column if isinstance(column, F.Column) else F.col(column)).cast("double") / 10000


def _q(name: str, sql: str, prefix: str = OFFERS):
    def wrap(f):
        register(name, f, prefix + sql)
        return f

    return wrap


TIE = ["price4", "product_id", "ord", "line"]


def best_price_by_brand(view: DataFrame, least_stores: int = 2, least_savings: int = 0) -> DataFrame:
    """Brands sold in several stores: the cheapest offer of each store, extremes and savings."""
    per_store = view.groupBy("brand", "store").agg(F.min(F.struct(*TIE, "name")).alias("b"))
    brands = per_store.groupBy("brand").agg(F.count("*").alias("n_stores"), F.min("b.price4").alias("low"), F.max("b.price4").alias("high"), F.min_by("store", F.struct("b.price4", "store")).alias("cheapest_store"), F.min_by("b.name", F.struct(F.length("b.name"), "b.name")).alias("shortest_name"))
    return brands.filter((F.col("n_stores") >= least_stores) & (F.col("high") - F.col("low") >= least_savings)).select(
        "brand", "n_stores", "cheapest_store", "shortest_name", money("low").alias("min_price"), money("high").alias("max_price"), money(F.col("high") - F.col("low")).alias("savings"),
        ((F.col("high") - F.col("low")) * 1000 / F.col("high")).cast("long").alias("savings_permille"),
    )


@_q(
    "q_best_price_by_brand",
    """, b AS (SELECT brand, store, name, price4, row_number() OVER (PARTITION BY brand, store ORDER BY price4, product_id, ord, line) AS n FROM offers),
 g AS (SELECT brand, count(*) AS n_stores, min(price4) AS low, max(price4) AS high, arg_min(store, {'a': price4, 'b': store}) AS cheapest_store,
       arg_min(name, {'a': length(name), 'b': name}) AS shortest_name FROM b WHERE n = 1 GROUP BY brand)
 SELECT brand, n_stores, cheapest_store, shortest_name, CAST(low AS DOUBLE) / 10000 AS min_price, CAST(high AS DOUBLE) / 10000 AS max_price,
        CAST(high - low AS DOUBLE) / 10000 AS savings, CAST(floor((high - low) * 1000 / high) AS BIGINT) AS savings_permille FROM g WHERE n_stores >= 2""",
)
def q_best_price_by_brand(spark, d):
    return best_price_by_brand(offers(spark, d))


@_q("q_brand_price_list", " SELECT store, product_id, name, min(price4) AS low4, count(*) AS n_offers FROM offers WHERE lower(brand) = 'brand#12' GROUP BY store, product_id, name")
def q_brand_price_list(spark, d):
    return offers(spark, d).filter(F.lower("brand") == "brand#12").groupBy("store", "product_id", "name").agg(F.min("price4").alias("low4"), F.count("*").alias("n_offers"))


@_q("q_products_filtered", " SELECT product_id, name, brand, store, ord, line, price4 FROM offers WHERE store = 'ASIA' AND contains(lower(name), 'red') AND coalesce(off, 0) >= 5 AND price4 > 0 AND price4 <= 500000000")
def q_products_filtered(spark, d):
    keep = relational.all_of([F.col("store") == "ASIA", relational.contains_text(F.col("name"), "RED"), F.coalesce("off", F.lit(0)) >= 5, F.col("price4") > 0, F.col("price4") <= 500000000])
    return offers(spark, d).filter(keep).select("product_id", "name", "brand", "store", "ord", "line", "price4")


@_q(
    "q_search_relevance",
    " SELECT p_partkey AS product_id, p_name AS name, CASE WHEN lower(p_name) = 'red bolt' THEN 0 WHEN starts_with(lower(p_name), 'red') THEN 1 ELSE 2 END AS relevance FROM part WHERE contains(lower(p_name), 'red') ORDER BY relevance, p_partkey LIMIT 50",
    "",
)
def q_search_relevance(spark, d):
    name = F.lower("p_name")
    rank = F.when(name == "red bolt", 0).when(F.startswith(name, F.lit("red")), 1).otherwise(2)
    found = read_table(spark, d, "part").filter(relational.contains_text(F.col("p_name"), "red")).select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), rank.alias("relevance"))
    return relational.page(found, ["relevance", "product_id"], 50)


@_q("q_page_offset", " SELECT p_partkey AS product_id, p_name AS name, p_size AS size FROM part ORDER BY p_size DESC, p_partkey LIMIT 25 OFFSET 50", "")
def q_page_offset(spark, d):
    return relational.page(read_table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_size").alias("size")), [F.col("size").desc(), "product_id"], 25, 50)


@_q("q_brand_counts", " SELECT lower(p_brand) AS brand, count(*) AS n_products, count(DISTINCT p_type) AS n_types FROM part GROUP BY 1", "")
def q_brand_counts(spark, d):
    return read_table(spark, d, "part").groupBy(F.lower("p_brand").alias("brand")).agg(F.count("*").alias("n_products"), F.count_distinct("p_type").alias("n_types"))


@_q("q_multi_store_brands", " SELECT brand, count(DISTINCT store) AS n_stores, string_agg(DISTINCT store, ',' ORDER BY store) AS stores FROM offers GROUP BY brand HAVING count(DISTINCT store) >= 2")
def q_multi_store_brands(spark, d):
    return offers(spark, d).groupBy("brand").agg(F.count_distinct("store").alias("n_stores"), F.array_join(F.array_sort(F.collect_set("store")), ",").alias("stores")).filter("n_stores >= 2")


@_q("q_store_stats", " SELECT store, count(*) AS n_offers, count(DISTINCT product_id) AS n_products, CAST(sum(CASE WHEN off > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_promotions, CAST(sum(price4) AS DOUBLE) / count(*) / 10000 AS avg_price FROM offers GROUP BY store")
def q_store_stats(spark, d):
    return offers(spark, d).groupBy("store").agg(F.count("*").alias("n_offers"), F.count_distinct("product_id").alias("n_products"), F.count_if(F.col("off") > 0).alias("n_promotions"), (F.sum("price4").cast("double") / F.count("*") / 10000).alias("avg_price"))


@_q("q_brand_coverage", " SELECT store, count(*) AS n_rows, CAST(sum(CASE WHEN brand IS NOT NULL THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS with_brand, CAST(sum(CASE WHEN off > 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS discounted FROM offers GROUP BY store")
def q_brand_coverage(spark, d):
    return relational.coverage(offers(spark, d), ["store"], {"with_brand": F.col("brand").isNotNull(), "discounted": F.col("off") > 0})


@_q("q_top_deals", " SELECT product_id, store, ord, line, off, price4 FROM offers WHERE off >= 5 ORDER BY off DESC, price4, product_id, ord, line LIMIT 100")
def q_top_deals(spark, d):
    return relational.page(offers(spark, d).filter("off >= 5").select("product_id", "store", "ord", "line", "off", "price4"), [F.col("off").desc(), *TIE], 100)


@_q("q_cheapest", " SELECT product_id, store, price4, ord, line FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price4, store, ord, line) AS n FROM offers) WHERE n = 1")
def q_cheapest(spark, d):
    return offers(spark, d).groupBy("product_id").agg(F.min(F.struct("price4", "store", "ord", "line")).alias("b")).select("product_id", "b.store", "b.price4", "b.ord", "b.line")


@_q("q_grouped_first", " SELECT category, store, product_id, name FROM (SELECT *, row_number() OVER (PARTITION BY category, store ORDER BY ts, ord, line) AS n FROM offers) WHERE n <= 3")
def q_grouped_first(spark, d):
    return relational.cap_per_key(offers(spark, d), ["category", "store"], ["ts", "ord", "line"], 3).select("category", "store", "product_id", "name")


@_q("q_nulls_last", " SELECT o.o_orderkey AS ord, l.line FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS line FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey ORDER BY l.line ASC NULLS LAST, ord LIMIT 200", "")
def q_nulls_last(spark, d):
    head = read_table(spark, d, "orders").select("o_orderkey")
    lines = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("line"))
    joined = head.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("ord"), "line")
    return relational.page(joined, [F.col("line").asc_nulls_last(), "ord"], 200)


@_q("q_left_join_prices", " SELECT p_partkey AS product_id, count(l_orderkey) AS n_offers, min(l_extendedprice) AS low FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_discount >= 0.09 GROUP BY p_partkey", "")
def q_left_join_prices(spark, d):
    lines = read_table(spark, d, "lineitem").filter("l_discount >= 0.09").select("l_partkey", "l_orderkey", "l_extendedprice")
    return read_table(spark, d, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy(F.col("p_partkey").alias("product_id")).agg(F.count("l_orderkey").alias("n_offers"), F.min("l_extendedprice").alias("low"))


@_q("q_anti_not_matched", " SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", "")
def q_anti_not_matched(spark, d):
    return read_table(spark, d, "customer").join(read_table(spark, d, "orders").filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@_q("q_semi_exists", " SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", "")
def q_semi_exists(spark, d):
    return read_table(spark, d, "customer").join(read_table(spark, d, "orders").filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@_q("q_top1_lateral", " SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_totalprice >= 1000) ON c_custkey = o_custkey AND n = 1", "")
def q_top1_lateral(spark, d):
    best = read_table(spark, d, "orders").filter("o_totalprice >= 1000").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey"))).alias("b"))
    return read_table(spark, d, "customer").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "b.o_orderkey", "b.o_totalprice")


@_q("q_price_changes", ", c AS (SELECT product_id, store, ord, line, price4, price4 - lag(price4) OVER (PARTITION BY product_id, store ORDER BY ts, ord, line) AS change FROM offers) SELECT product_id, store, ord, line, change FROM c WHERE abs(change) > 100")
def q_price_changes(spark, d):
    return history.price_changes(offers(spark, d), ["product_id", "store"], ["ts", "ord", "line"], "price4", 100).filter("changed").select("product_id", "store", "ord", "line", "change")


@_q(
    "q_scd2_prices",
    """, c AS (SELECT *, lag(price4) OVER (PARTITION BY product_id, store ORDER BY ts, ord, line) AS before FROM offers)
 SELECT product_id, store, price4, ts AS valid_from, lead(ts) OVER (PARTITION BY product_id, store ORDER BY ts, ord, line) AS valid_to FROM c WHERE before IS NULL OR abs(price4 - before) >= 100""",
)
def q_scd2_prices(spark, d):
    return history.validity_intervals(offers(spark, d), ["product_id", "store"], ["ts", "ord", "line"], "price4", "ts", 100).select("product_id", "store", "price4", "valid_from", "valid_to")


@_q(
    "q_daily_sync",
    """, k AS (SELECT product_id, store, price4 FROM (SELECT *, row_number() OVER (PARTITION BY product_id, store ORDER BY ts DESC, ord DESC, line DESC) AS n FROM offers WHERE ts < TIMESTAMP '2000-01-01') WHERE n = 1),
 i AS (SELECT product_id, store, price4 FROM (SELECT *, row_number() OVER (PARTITION BY product_id, store ORDER BY ts DESC, ord DESC, line DESC) AS n FROM offers WHERE ts >= TIMESTAMP '2000-01-01') WHERE n = 1)
 SELECT i.product_id, i.store, i.price4, k.price4 AS known_price, CASE WHEN k.price4 IS NULL THEN 'new' WHEN abs(i.price4 - k.price4) <= 100 THEN 'unchanged' WHEN i.price4 > k.price4 THEN 'increase' ELSE 'decrease' END AS outcome,
        coalesce(abs(i.price4 - k.price4) > k.price4, FALSE) AS spike FROM i LEFT JOIN k USING (product_id, store)""",
)
def q_daily_sync(spark, d):
    view, cut = offers(spark, d), F.lit("2000-01-01").cast("timestamp")
    latest = lambda df: relational.last_values(df, ["product_id", "store"], ["ts", "ord", "line"], ["price4"])
    return history.classify_sync(latest(view.filter(F.col("ts") < cut)), latest(view.filter(F.col("ts") >= cut)), ["product_id", "store"], "price4", 100)


@_q("q_delisted", ", s AS (SELECT product_id, store, max(ts) AS last_seen FROM offers GROUP BY ALL), g AS (SELECT store, max(ts) AS latest FROM offers GROUP BY store) SELECT store, product_id, last_seen, latest FROM s JOIN g USING (store) WHERE last_seen < latest - INTERVAL 365 DAY")
def q_delisted(spark, d):
    return history.delisted(offers(spark, d), ["product_id", "store"], ["store"], "ts", 365).select("store", "product_id", "last_seen", "latest")


@_q("q_lookback", " SELECT product_id, store, ord, line, ts FROM offers WHERE ts >= (SELECT max(ts) FROM offers) - INTERVAL 30 DAY")
def q_lookback(spark, d):
    view = offers(spark, d)
    latest = read_table(spark, d, "lineitem").agg(F.max("l_shipdate").alias("latest")).first()[0]
    return view.filter(F.col("ts") >= F.lit(latest) - F.expr("INTERVAL 30 DAYS")).select("product_id", "store", "ord", "line", "ts")


@_q(
    "q_price_stats_30_90",
    """ SELECT product_id, store, CAST(sum(CASE WHEN ts > TIMESTAMP '2001-01-01' - INTERVAL 30 DAY THEN price4 END) AS BIGINT) AS sum_30, count(CASE WHEN ts > TIMESTAMP '2001-01-01' - INTERVAL 30 DAY THEN 1 END) AS n_30,
 CAST(sum(CASE WHEN ts > TIMESTAMP '2001-01-01' - INTERVAL 90 DAY THEN price4 END) AS BIGINT) AS sum_90, count(CASE WHEN ts > TIMESTAMP '2001-01-01' - INTERVAL 90 DAY THEN 1 END) AS n_90, min(price4) AS low4, max(price4) AS high4,
 count(*) AS n FROM offers WHERE ts <= TIMESTAMP '2001-01-01' GROUP BY product_id, store""",
)
def q_price_stats_30_90(spark, d):
    as_of = F.lit("2001-01-01").cast("timestamp")
    view = offers(spark, d).filter(F.col("ts") <= as_of)
    since = lambda days: F.when(F.col("ts") > as_of - F.expr(f"INTERVAL {days} DAYS"), F.col("price4"))
    return view.groupBy("product_id", "store").agg(F.sum(since(30)).alias("sum_30"), F.count(since(30)).alias("n_30"), F.sum(since(90)).alias("sum_90"), F.count(since(90)).alias("n_90"), F.min("price4").alias("low4"), F.max("price4").alias("high4"), F.count("*").alias("n"))


@_q("q_growth_rate", " SELECT o_orderstatus AS status, arg_min(o_totalprice, {'a': o_orderdate, 'b': o_orderkey}) AS first_value, arg_max(o_totalprice, {'a': o_orderdate, 'b': o_orderkey}) AS last_value, count(*) AS n FROM orders GROUP BY 1", "")
def q_growth_rate(spark, d):
    at = F.struct("o_orderdate", "o_orderkey")
    return read_table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.min_by("o_totalprice", at).alias("first_value"), F.max_by("o_totalprice", at).alias("last_value"), F.count("*").alias("n"))


@_q("q_store_wins", ", m AS (SELECT product_id, arg_min(store, {'a': price4, 'b': store}) AS store FROM offers GROUP BY product_id) SELECT store, count(*) AS wins, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM m GROUP BY store")
def q_store_wins(spark, d):
    best = offers(spark, d).groupBy("product_id").agg(F.min_by("store", F.struct("price4", "store")).alias("store"))
    return best.groupBy("store").agg(F.count("*").alias("wins")).withColumn("share", F.col("wins") / F.sum("wins").over(Window.partitionBy()))


@_q("q_status_report", " SELECT store, count(DISTINCT product_id) AS n_products, count(DISTINCT CASE WHEN ts >= TIMESTAMP '2001-01-01' THEN product_id END) AS n_active, count(CASE WHEN off > 5 THEN 1 END) AS n_deals FROM offers GROUP BY store")
def q_status_report(spark, d):
    return offers(spark, d).groupBy("store").agg(F.count_distinct("product_id").alias("n_products"), F.count_distinct(F.when(F.col("ts") >= F.lit("2001-01-01").cast("timestamp"), F.col("product_id"))).alias("n_active"), F.count_if(F.col("off") > 5).alias("n_deals"))


@_q("q_group_members", " SELECT category || ':' || name AS group_id, product_id, store, min(price4) AS price4 FROM offers GROUP BY ALL")
def q_group_members(spark, d):
    return group_members(offers(spark, d))


def group_members(view: DataFrame) -> DataFrame:
    return view.groupBy(F.concat_ws(":", "category", "name").alias("group_id"), "product_id", "store").agg(F.min("price4").alias("price4"))


@_q(
    "q_rollup_prices",
    " SELECT store, category, count(*) AS n_offers, CAST(sum(price4) AS BIGINT) AS total4, grouping(store) + grouping(category) AS level FROM offers GROUP BY ROLLUP (store, category)",
)
def q_rollup_prices(spark, d):
    return offers(spark, d).rollup("store", "category").agg(F.count("*").alias("n_offers"), F.sum("price4").alias("total4"), (F.grouping("store").cast("long") + F.grouping("category").cast("long")).alias("level"))


@_q("q_fresh_cheapest_pivot", " SELECT category, min(CASE WHEN store = 'ASIA' THEN price4 END) AS ASIA, min(CASE WHEN store = 'EUROPE' THEN price4 END) AS EUROPE FROM offers GROUP BY category")
def q_fresh_cheapest_pivot(spark, d):
    return offers(spark, d).groupBy("category").pivot("store", ["ASIA", "EUROPE"]).agg(F.min("price4"))
