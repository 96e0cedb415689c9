"""Queries on texts, names and pages: normal forms, tokens, quantities, rules, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import quantity, rules, text
from tallyframe.operators import matching, relational
from tallyframe.plans.catalog import register
from tallyframe.session import read_table
from tallyframe.sources import web

#: Rules over the table's invented names, in order; the first that fits wins.
CATEGORIES = [("fasteners", ["bolt", "screw", "nail"]), ("parts", ["ring", "gear", "widget"]), ("colours", ["red", "blue", "green"])]
STOP = ["the", "and", "of"]


def _docs(spark, d):
    return read_table(spark, d, "documents")


NORMAL = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def q_normalise_name(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(text.normal_name(F.col("text"))).alias("normal_md5"))


register("q_normalise_name", q_normalise_name, f"SELECT doc_id, md5({NORMAL.format('text')}) AS normal_md5 FROM documents")


def q_tokenise(spark, d):
    tokens = text.words(text.normal_name(F.col("text")), 2)
    return _docs(spark, d).select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct"))


_TOKENS = f"list_filter(string_split({NORMAL.format('text')}, ' '), lambda w: length(w) > 2)"
register("q_tokenise", q_tokenise, f"SELECT doc_id, len({_TOKENS}) AS n_tokens, len(list_distinct({_TOKENS})) AS n_distinct FROM documents")


def q_stopword_tokens(spark, d):
    tokens = text.words(text.normal_name(F.col("text")), 1, STOP)
    return _docs(spark, d).select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter("n >= 20")


register("q_stopword_tokens", q_stopword_tokens, f"SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(string_split({NORMAL.format('text')}, ' '), lambda w: length(w) > 1 AND w NOT IN ('the', 'and', 'of'))) AS token FROM documents) GROUP BY 1 HAVING count(*) >= 20")


def q_ngrams(spark, d):
    return read_table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(text.ngrams(F.col("p_name"))), ",").alias("grams"))


register("q_ngrams", q_ngrams, "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substring(p_name, i, 3)))), ',') AS grams FROM part")


def q_top_terms_by_group(spark, d):
    counted = _docs(spark, d).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n")).filter("n >= 2")
    return relational.cap_per_key(counted, ["lang"], [F.col("n").desc(), "term"], 30)


register("q_top_terms_by_group", q_top_terms_by_group, "SELECT lang, term, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS r FROM (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents) GROUP BY ALL HAVING count(*) >= 2)) WHERE r <= 30")


def _sized(spark, d):
    unit = F.element_at(F.array(*[F.lit(u) for u in (" g", " kg", "ml", " l", " pcs", "")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    pack = F.when(F.col("p_partkey") % 7 == 0, "2 x ").otherwise("")
    return read_table(spark, d, "part").withColumn("label", F.concat("p_name", F.lit(" "), pack, F.col("p_size").cast("string"), unit))


_SIZED = "WITH s AS (SELECT *, p_name || ' ' || CASE WHEN p_partkey % 7 = 0 THEN '2 x ' ELSE '' END || CAST(p_size AS VARCHAR) || [' g', ' kg', 'ml', ' l', ' pcs', ''][CAST(p_partkey % 6 + 1 AS INTEGER)] AS label FROM part)"


def q_parse_quantity(spark, d):
    sized = _sized(spark, d).withColumn("q", quantity.parse_quantity(F.col("label")))
    return sized.select("p_partkey", "label", F.col("q.value").alias("value"), F.col("q.unit").alias("unit"))


register(
    "q_parse_quantity",
    q_parse_quantity,
    # a pack without a known unit after it takes the first unit's letters of the label
    _SIZED
    + """, w AS (SELECT *, p_partkey % 7 = 0 AS pack, CASE WHEN p_partkey % 7 = 0 AND p_partkey % 6 >= 4 THEN regexp_extract(label, 'ml|l|g|kg') ELSE ['g', 'kg', 'ml', 'l', 'pcs', ''][CAST(p_partkey % 6 + 1 AS INTEGER)] END AS written FROM s)
 SELECT p_partkey, label, CASE WHEN pack OR written <> '' THEN CAST(p_size AS DOUBLE) * CASE WHEN pack THEN 2 ELSE 1 END * CASE WHEN written IN ('kg', 'l') THEN 1000 ELSE 1 END END AS value,
        CASE WHEN written IN ('g', 'kg') THEN 'g' WHEN written IN ('ml', 'l') THEN 'ml' WHEN written <> '' THEN written END AS unit FROM w""",
)


def q_unit_price(spark, d):
    q = quantity.unit_price_quantity(F.col("label"))
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    return _sized(spark, d).withColumn("q", q).filter("q is not null").select("p_partkey", F.floor(cents * 1000 / F.col("q.value")).alias("cents_per_kilo"))


register(
    "q_unit_price",
    q_unit_price,
    _SIZED + " SELECT p_partkey, CAST(floor(CAST(round(p_retailprice * 100) AS BIGINT) * 1000 / (CASE WHEN p_partkey % 7 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE * p_size * CASE WHEN p_partkey % 6 IN (1, 3) THEN 1000 ELSE 1 END)) AS BIGINT) AS cents_per_kilo FROM s WHERE p_partkey % 6 < 4",
)


def q_discount_pct(spark, d):
    line = read_table(spark, d, "lineitem")
    old, new = F.round(F.col("l_extendedprice") * 100).cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long") - F.round(F.col("l_extendedprice") * F.col("l_discount")).cast("long") * 100
    return line.select("l_orderkey", "l_linenumber", quantity.discount_percent(old.cast("double"), new.cast("double"), "trunc").alias("off"))


register("q_discount_pct", q_discount_pct, "SELECT l_orderkey, l_linenumber, CASE WHEN o > n AND n > 0 THEN floor((o - n) / o * 100) END AS off FROM (SELECT *, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DOUBLE) AS o, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) - CAST(round(l_extendedprice * l_discount) AS BIGINT) * 100 AS DOUBLE) AS n FROM lineitem)")


def q_price_flag(spark, d):
    line = read_table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))
    return line.select("l_partkey", quantity.price_ratio_flag(F.col("low"), F.col("high")).alias("suspicious"))


register("q_price_flag", q_price_flag, "SELECT l_partkey, max(l_extendedprice) / min(l_extendedprice) > 3 AS suspicious FROM lineitem GROUP BY 1")


def q_validate_price_codes(spark, d):
    codes = rules.error_codes([("price:low", F.col("l_extendedprice") < 2000), ("price:high", F.col("l_extendedprice") > 90000), ("discount:deep", F.col("l_discount") > 0.08), ("quantity:one", F.col("l_quantity") <= 1)])
    line = read_table(spark, d, "lineitem").select("l_orderkey", F.explode(codes).alias("code"))
    return line.groupBy(F.substring_index("code", ":", 1).alias("family"), "code").agg(F.count("*").alias("n_rows"))


register(
    "q_validate_price_codes",
    q_validate_price_codes,
    "SELECT string_split(code, ':')[1] AS family, code, count(*) AS n_rows FROM (SELECT unnest(list_filter([CASE WHEN l_extendedprice < 2000 THEN 'price:low' END, CASE WHEN l_extendedprice > 90000 THEN 'price:high' END, CASE WHEN l_discount > 0.08 THEN 'discount:deep' END, CASE WHEN l_quantity <= 1 THEN 'quantity:one' END], lambda x: x IS NOT NULL)) AS code FROM lineitem) GROUP BY ALL",
)


def q_qty_compat_classes(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("size"))
    g, size, size2 = F.lit("g"), F.col("l.size"), F.col("r.size")
    classes = lambda pairs: pairs.select(
        "*", quantity.quantity_class(size, g, size2, g).alias("class4"), quantity.quantities_agree(size, g, size2, g).alias("agree25"),
        quantity.ratio_between(size, size2, 0.75, 1.25, None).alias("between75"), quantity.within_share(size, size2).alias("share15"),
    )
    return matching.pairs_by_class(p, p, ["p_brand"], "p_partkey", classes).withColumnsRenamed({"a": "p_partkey", "b": "other"})


register(
    "q_qty_compat_classes",
    q_qty_compat_classes,
    """SELECT a.p_partkey, b.p_partkey AS other, CASE WHEN r <= 1.3 THEN 'same_size' WHEN r <= 5 THEN 'different_size' ELSE 'incompatible' END AS class4, r <= 1.25 AS agree25, x / y BETWEEN 0.75 AND 1.25 AS between75, abs(x - y) <= 0.15 * greatest(x, y) AS share15
 FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey, LATERAL (SELECT CAST(a.p_size AS DOUBLE) AS x, CAST(b.p_size AS DOUBLE) AS y), LATERAL (SELECT greatest(x, y) / least(x, y) AS r)""",
)


def q_brand_extract(spark, d):
    listed = ["red", "red widget", "blue bolt", "ring"]
    return read_table(spark, d, "part").select("p_partkey", rules.longest_brand(F.col("p_name"), listed).alias("brand"))


register("q_brand_extract", q_brand_extract, "SELECT p_partkey, CASE WHEN contains(n, ' red widget ') THEN 'red widget' WHEN contains(n, ' blue bolt ') THEN 'blue bolt' WHEN contains(n, ' ring ') THEN 'ring' WHEN contains(n, ' red ') THEN 'red' END AS brand FROM (SELECT p_partkey, ' ' || lower(p_name) || ' ' AS n FROM part)")


def q_category_rules(spark, d):
    return read_table(spark, d, "part").select("p_partkey", rules.first_category(F.col("p_name"), CATEGORIES).alias("category"))


register("q_category_rules", q_category_rules, "SELECT p_partkey, CASE WHEN regexp_matches(n, ' (bolt|screw|nail) ') THEN 'fasteners' WHEN regexp_matches(n, ' (ring|gear|widget) ') THEN 'parts' WHEN regexp_matches(n, ' (red|blue|green) ') THEN 'colours' WHEN regexp_matches(n, 'screw') THEN 'fasteners' WHEN regexp_matches(n, 'widget') THEN 'parts' WHEN regexp_matches(n, 'green') THEN 'colours' END AS category FROM (SELECT p_partkey, ' ' || lower(p_name) || ' ' AS n FROM part)")


def q_category_score(spark, d):
    best = rules.scored_category(F.col("text"), [("article", ["the ", " a "]), ("preposition", [" of ", " in ", " with "]), ("german", [" und ", " der "])])
    return _docs(spark, d).select("doc_id", best["category"].alias("category"), best["score"].cast("int").alias("score"))


register(
    "q_category_score",
    q_category_score,
    """SELECT doc_id, CASE WHEN greatest(a, p, g) = 0 THEN NULL WHEN a >= p AND a >= g THEN 'article' WHEN p >= g THEN 'preposition' ELSE 'german' END AS category, nullif(greatest(a, p, g), 0) AS score FROM (SELECT doc_id,
 CASE WHEN contains(t, 'the ') THEN 4 ELSE 0 END + CASE WHEN contains(t, ' a ') THEN 3 ELSE 0 END AS a, CASE WHEN contains(t, ' of ') THEN 4 ELSE 0 END + CASE WHEN contains(t, ' in ') THEN 4 ELSE 0 END + CASE WHEN contains(t, ' with ') THEN 6 ELSE 0 END AS p,
 CASE WHEN contains(t, ' und ') THEN 5 ELSE 0 END + CASE WHEN contains(t, ' der ') THEN 5 ELSE 0 END AS g FROM (SELECT doc_id, lower(text) AS t FROM documents))""",
)


def q_array_sets(spark, d):
    words = lambda c: text.token_set(F.split(F.col(c), " "))
    p = read_table(spark, d, "part").select("p_partkey", words("p_name").alias("a"), F.array(F.lit("red"), F.lit("bolt")).alias("b"))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return p.select("p_partkey", joined(F.array_intersect("a", "b")).alias("both"), joined(F.array_union("a", "b")).alias("either"), joined(F.array_except("a", "b")).alias("only"))


register("q_array_sets", q_array_sets, "SELECT p_partkey, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only FROM (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, ['red', 'bolt'] AS b FROM part)")


def q_strip_html(spark, d):
    return read_table(spark, d, "pages").select("page_id", F.md5(text.strip_markup(F.col("html"))).alias("plain_md5"))


register("q_strip_html", q_strip_html, "SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&[a-zA-Z]+;', ' ', 'g'), '\\s+', ' ', 'g'))) AS plain_md5 FROM pages")


def q_url_parts(spark, d):
    return web.url_parts(read_table(spark, d, "pages")).select("page_id", "host", "lang", "item")


register("q_url_parts", q_url_parts, "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1), '') AS lang, TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)/?(?:[?#].*)?$', 1), '') AS BIGINT) AS item FROM pages")


def q_page_cards(spark, d):
    return web.page_fields(read_table(spark, d, "pages")).select("page_id", "title", "lang", "n_links")


register("q_page_cards", q_page_cards, "SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1), '') AS lang, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS n_links FROM pages")


def q_inverted_index(spark, d):
    p = read_table(spark, d, "part")
    return matching.postings(p, "p_partkey", F.split(F.col("p_name"), " ")).groupBy("token").agg(F.count("*").alias("n"), F.min("p_partkey").alias("low"), F.max("p_partkey").alias("high"))


register("q_inverted_index", q_inverted_index, "SELECT token, count(*) AS n, min(p_partkey) AS low, max(p_partkey) AS high FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part) GROUP BY 1")


def r_translit(spark, d):
    rows = spark.createDataFrame([("Мляко прясно",), ("щастие и юнак",), ("Кафе 200 гр",), ("tsh shtastie yug",)], "name string")
    return rows.select("name", text.to_latin(F.col("name")).alias("latin"), text.to_cyrillic(F.col("name")).alias("cyrillic"))


def r_size_normalise(spark, d):
    rows = spark.createDataFrame([("Мляко 1,5 Л",), ("Кафе 200 гр",), ("Олио 1л",), ("Сирене 2 КГ",), ("Вода 500 мл",)], "name string")
    return rows.select("name", text.normalise_size(F.col("name")).alias("size"))


register("r_size_normalise", r_size_normalise, "SELECT * FROM (VALUES ('Мляко 1,5 Л', 'Мляко 1.5l'), ('Кафе 200 гр', 'Кафе 200g'), ('Олио 1л', 'Олио 1l'), ('Сирене 2 КГ', 'Сирене 2kg'), ('Вода 500 мл', 'Вода 500ml')) AS v(name, size)")
register(
    "r_translit",
    r_translit,
    "SELECT * FROM (VALUES ('Мляко прясно', 'mlyako pryasno', 'мляко прясно'), ('щастие и юнак', 'shtastie i yunak', 'щастие и юнак'), ('Кафе 200 гр', 'kafe 200 gr', 'кафе 200 гр'), ('tsh shtastie yug', 'tsh shtastie yug', 'цх щастие юг')) AS v(name, latin, cyrillic)",
)
