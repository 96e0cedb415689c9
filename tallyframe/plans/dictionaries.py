"""Queries that look names up in rule tables of any size: order lines as names, customers as brands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import dictionary
from tallyframe.plans.catalog import register
from tallyframe.session import read_table

#: A keyword table beside the large ones: term, value, ord.
KEYWORDS = [("urgent", "fast", 1), ("high", "fast", 2), ("machin", "tools", 3), ("build", "houses", 4), ("ture", "never: too short for inside words", 5), ("not specified", "slow", 6)]

_NAMES = "n AS (SELECT o_orderkey, o_orderstatus AS store, c_mktsegment || ': ' || c_name || CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END || ', ' || o_orderpriority AS name FROM orders JOIN customer ON o_custkey = c_custkey)"
_PLAIN = "' ' || trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
_BETWEEN = f"contains({_PLAIN.format('name')}, {_PLAIN.format('term')})"
_INSIDE = "contains(lower(name), lower(term))"
_LETTERS = f"length({_PLAIN.format('term')}) - 2"
_WORDS = ", ".join(f"('{t}', '{v}', CAST({o} AS BIGINT))" for t, v, o in KEYWORDS)


def _names(spark, d) -> DataFrame:
    customers = read_table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    joined = read_table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    name = F.concat("c_mktsegment", F.lit(": "), "c_name", F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(""), F.lit(", "), "o_orderpriority")
    return joined.select("o_orderkey", F.col("o_orderstatus").alias("store"), name.alias("name"))


def _customers(spark, d, when: str) -> DataFrame:
    return read_table(spark, d, "customer").filter(when).select(F.col("c_name").alias("term"), F.col("c_name").alias("value"), F.col("c_custkey").alias("ord"))


def _segments(spark, d, when: str = "true") -> DataFrame:
    return read_table(spark, d, "customer").filter(when).select("c_mktsegment").distinct().select(F.col("c_mktsegment").alias("term"), F.lower("c_mktsegment").alias("value"), F.lit(0).cast("long").alias("ord"))


def _keywords(spark) -> DataFrame:
    return spark.createDataFrame(KEYWORDS, "term string, value string, ord long")


_CUSTOMERS = "SELECT c_name AS term, c_name AS value, c_custkey AS ord FROM customer WHERE {0}"
_SEGMENTS = "SELECT DISTINCT c_mktsegment AS term, lower(c_mktsegment) AS value, CAST(0 AS BIGINT) AS ord FROM customer WHERE {0}"


def q_dictionary_brand(spark, d):
    brands = _customers(spark, d, "c_custkey % 2 = 1").unionByName(_segments(spark, d))
    return dictionary.with_best_term(_names(spark, d), "name", brands, "brand").select("o_orderkey", "brand")


register(
    "q_dictionary_brand",
    q_dictionary_brand,
    f"WITH {_NAMES}, t AS ({_CUSTOMERS.format('c_custkey % 2 = 1')} UNION ALL {_SEGMENTS.format('true')}) SELECT o_orderkey, arg_min(value, {{'a': -({_LETTERS}), 'b': ord}}) AS brand FROM n LEFT JOIN t ON {_BETWEEN} GROUP BY o_orderkey",
)


def q_dictionary_house_brand(spark, d):
    """Stores F and O have brands of their own; other names fall back to all brands, between word limits or anywhere."""
    store = lambda df, s: df.withColumn("store", F.lit(s).cast("string"))
    brands = store(_segments(spark, d, "c_mktsegment < 'G'"), "F").unionByName(store(_customers(spark, d, "c_custkey % 3 = 0"), "O")).unionByName(store(_customers(spark, d, "c_custkey % 2 = 0"), None))
    return dictionary.with_house_brand(_names(spark, d), "name", "store", brands, "brand").select("o_orderkey", "brand")


register(
    "q_dictionary_house_brand",
    q_dictionary_house_brand,
    f"WITH {_NAMES}, t AS (SELECT *, 'F' AS of FROM ({_SEGMENTS.format(chr(39).join(['c_mktsegment < ', 'G', '']))}) UNION ALL SELECT *, 'O' FROM ({_CUSTOMERS.format('c_custkey % 3 = 0')}) UNION ALL SELECT *, NULL FROM ({_CUSTOMERS.format('c_custkey % 2 = 0')})), "
    f"a AS (SELECT o_orderkey, arg_min(value, {{'a': t.of IS NULL, 'b': -({_LETTERS}), 'c': ord}}) AS brand FROM n JOIN t ON (t.of IS NULL OR t.of = store) AND {_BETWEEN} GROUP BY 1), "
    f"b AS (SELECT o_orderkey, arg_min(value, {{'b': -length(term), 'c': ord}}) AS brand FROM n JOIN t ON t.of IS NULL AND {_INSIDE} GROUP BY 1) SELECT o_orderkey, coalesce(a.brand, b.brand) AS brand FROM n LEFT JOIN a USING (o_orderkey) LEFT JOIN b USING (o_orderkey)",
)


def q_dictionary_resolved_brand(spark, d):
    aliases, house = _segments(spark, d, "c_mktsegment < 'G'"), _customers(spark, d, "c_custkey % 5 = 0")
    found = dictionary.with_resolved_brand(_names(spark, d), "name", aliases, house, {"urgent": "express"}, "found")
    return found.select("o_orderkey", "found.*")


register(
    "q_dictionary_resolved_brand",
    q_dictionary_resolved_brand,
    f"WITH {_NAMES}, a AS (SELECT o_orderkey, min(value) AS brand FROM n JOIN ({_SEGMENTS.format(chr(39).join(['c_mktsegment < ', 'G', '']))}) ON {_BETWEEN} GROUP BY 1), h AS (SELECT o_orderkey, arg_min(value, {{'a': -({_LETTERS}), 'b': ord}}) AS brand FROM n JOIN ({_CUSTOMERS.format('c_custkey % 5 = 0')}) ON {_BETWEEN} GROUP BY 1), "
    "p AS (SELECT o_orderkey, nullif(trim(regexp_extract(name, '^((?:[A-Z][A-Za-z&''.-]+\\s*){1,3})', 1)), '') AS brand, regexp_matches(name, '(?i)urgent') AS urgent FROM n) "
    "SELECT o_orderkey, CASE WHEN a.brand IS NOT NULL THEN a.brand WHEN urgent THEN 'express' WHEN h.brand IS NOT NULL THEN h.brand ELSE p.brand END AS brand, CASE WHEN a.brand IS NOT NULL THEN 'alias' WHEN urgent THEN 'regex' WHEN h.brand IS NOT NULL THEN 'house' WHEN p.brand IS NOT NULL THEN 'prefix' END AS method, "
    "CAST(CASE WHEN a.brand IS NOT NULL THEN 0.95 WHEN urgent THEN 0.9 WHEN h.brand IS NOT NULL THEN 0.85 WHEN p.brand IS NOT NULL THEN 0.8 END AS DOUBLE) AS confidence FROM p LEFT JOIN a USING (o_orderkey) LEFT JOIN h USING (o_orderkey)",
)


def _categories(spark, d) -> DataFrame:
    known = read_table(spark, d, "customer").filter("c_custkey % 7 = 0").select(F.col("c_name").alias("term"), F.concat(F.lit("known-"), (F.col("c_custkey") % 10).cast("string")).alias("value"), (F.col("c_custkey") + 1000).alias("ord"))
    return _keywords(spark).unionByName(known)


_CATEGORIES = f"t AS (SELECT * FROM (VALUES {_WORDS}) AS k(term, value, ord) UNION ALL SELECT c_name, 'known-' || CAST(c_custkey % 10 AS VARCHAR), c_custkey + 1000 FROM customer WHERE c_custkey % 7 = 0)"


def q_dictionary_category(spark, d):
    return dictionary.with_category(_names(spark, d), "name", _categories(spark, d), "category").select("o_orderkey", "category")


register(
    "q_dictionary_category",
    q_dictionary_category,
    f"WITH {_NAMES}, {_CATEGORIES}, a AS (SELECT o_orderkey, arg_min(value, ord) AS v FROM n JOIN t ON {_BETWEEN} GROUP BY 1), b AS (SELECT o_orderkey, arg_min(value, ord) AS v FROM n JOIN t ON length(term) >= 5 AND {_INSIDE} GROUP BY 1) "
    "SELECT o_orderkey, coalesce(a.v, b.v) AS category FROM n LEFT JOIN a USING (o_orderkey) LEFT JOIN b USING (o_orderkey)",
)


def q_dictionary_scored(spark, d):
    found = dictionary.with_scored_term(_names(spark, d), "name", _categories(spark, d), "best")
    return found.select("o_orderkey", F.col("best.value").alias("category"), F.col("best.score").alias("score"))


register(
    "q_dictionary_scored",
    q_dictionary_scored,
    f"WITH {_NAMES}, {_CATEGORIES}, s AS (SELECT o_orderkey, value, CAST(sum(length(term)) AS BIGINT) AS score, min(ord) AS ord FROM n JOIN t ON {_INSIDE} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, ord) AS k FROM s) "
    "SELECT o_orderkey, value AS category, score FROM n LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (o_orderkey)",
)


def q_dictionary_types(spark, d):
    found = dictionary.with_terms(_names(spark, d), "name", _categories(spark, d), "types")
    return found.select("o_orderkey", F.array_join("types", ",").alias("types"))


register(
    "q_dictionary_types",
    q_dictionary_types,
    f"WITH {_NAMES}, {_CATEGORIES}, s AS (SELECT o_orderkey, value, min(ord) AS ord FROM n JOIN t ON {_BETWEEN} GROUP BY 1, 2) SELECT n.o_orderkey, coalesce(string_agg(value, ',' ORDER BY ord), '') AS types FROM n LEFT JOIN s ON n.o_orderkey = s.o_orderkey GROUP BY 1",
)


def q_dictionary_normal_brand(spark, d):
    rows = read_table(spark, d, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")), F.when(F.col("c_custkey") % 3 == 0, "®, Ltd.").otherwise(" gmbh")).alias("brand"))
    usual = read_table(spark, d, "customer").filter("c_custkey % 5 < 3").select(F.lower("c_name").alias("term"), F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("value"))
    return dictionary.with_normal_brand(rows, "brand", usual, "normal").select("c_custkey", "normal")


register("q_dictionary_normal_brand", q_dictionary_normal_brand, "SELECT c_custkey, CASE WHEN c_custkey % 5 < 3 THEN 'c-' || CAST(c_custkey AS VARCHAR) ELSE lower(c_name) END AS normal FROM customer")
