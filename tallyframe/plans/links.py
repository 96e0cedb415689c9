"""Queries on similarity, candidates, matchers and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import quantity, rules, similarity, text
from tallyframe.operators import candidates, grouping, matching, phases, standardise
from tallyframe.plans.catalog import register
from tallyframe.plans.offers import OFFERS, group_members, offers
from tallyframe.session import materialize, read_table, spread


def _parts(spark, d) -> DataFrame:
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lower("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))


_PAIRS = "FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey"
_WORDS = "list_sort(list_distinct(string_split({0}.p_name, ' ')))"
_A, _B = _WORDS.format("a"), _WORDS.format("b")
_MEET = f"len(list_intersect({_A}, {_B}))"
_EITHER = f"len(list_distinct(list_concat({_A}, {_B})))"


def _block_pairs(spark, d) -> DataFrame:
    p = _parts(spark, d)
    return matching.blocked_pairs(p, p, ["type", "brand"], "id")


def _tokens(side: str):
    return text.token_set(F.split(F.col(f"{side}.name"), " "))


def _scored(spark, d, *scores) -> DataFrame:
    """(a, b, scores) of the pairs of a block by their names, each two names of it compared once."""
    p = _parts(spark, d).select("id", "type", "brand", "name")
    return matching.pairs_by_class(p, p, ["type", "brand"], "id", lambda pairs: pairs.select("*", *scores))


def _similar_parts(spark, d, tokens, least: float) -> DataFrame:
    """(a, b, score): parts of a block by the Jaccard similarity of tokens of their names, from `least` on."""
    p = _parts(spark, d).select("id", "type", "brand", "name")
    classes, members = matching.similar_classes(p, "id", ["type", "brand"], tokens, similarity.jaccard, least)
    return matching.expanded(classes, members, "a", "b")


_name_words = lambda: text.token_set(F.split("name", " "))


def q_jaccard_pairs(spark, d):
    return _similar_parts(spark, d, _name_words(), 0.3)


register("q_jaccard_pairs", q_jaccard_pairs, f"SELECT a.p_partkey AS a, b.p_partkey AS b, CAST({_MEET} AS DOUBLE) / {_EITHER} AS score {_PAIRS} WHERE CAST({_MEET} AS DOUBLE) / {_EITHER} >= 0.3")


def q_overlap_coeff(spark, d):
    return _scored(spark, d, similarity.overlap(_tokens("l"), _tokens("r")).alias("overlap"), similarity.recall(_tokens("l"), _tokens("r")).alias("recall"))


register("q_overlap_coeff", q_overlap_coeff, f"SELECT a.p_partkey AS a, b.p_partkey AS b, CAST({_MEET} AS DOUBLE) / greatest(len({_A}), len({_B})) AS overlap, CAST({_MEET} AS DOUBLE) / len({_A}) AS recall {_PAIRS}")

_GRAMS = "list_distinct(list_transform(range(1, length({0}.p_name) - 1), lambda i: substring({0}.p_name, i, 3)))"
_G = f"CAST(len(list_intersect({_GRAMS.format('a')}, {_GRAMS.format('b')})) AS DOUBLE) / len(list_distinct(list_concat({_GRAMS.format('a')}, {_GRAMS.format('b')})))"


def q_trigram_pairs(spark, d):
    return _similar_parts(spark, d, text.ngrams(F.col("name")), 0.4)


register("q_trigram_pairs", q_trigram_pairs, f"SELECT a.p_partkey AS a, b.p_partkey AS b, {_G} AS score {_PAIRS} WHERE {_G} >= 0.4")


def q_trigram_blend(spark, d):
    blend = 0.6 * similarity.jaccard(_tokens("l"), _tokens("r")) + 0.4 * similarity.jaccard(text.ngrams(F.col("l.name")), text.ngrams(F.col("r.name")))
    return _scored(spark, d, F.floor(blend * 1000 + 0.5).alias("permille"))


register("q_trigram_blend", q_trigram_blend, f"SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(floor((CAST(0.6 AS DOUBLE) * (CAST({_MEET} AS DOUBLE) / {_EITHER}) + CAST(0.4 AS DOUBLE) * ({_G})) * 1000 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS permille {_PAIRS}")


def q_exact_branded(spark, d):
    view = offers(spark, d).select("product_id", "name", "brand", "size", "store").distinct()
    return matching.exact_groups(view, [F.lower("brand"), F.substring("name", 1, 50), F.col("size")], "store", "product_id").withColumnsRenamed({"k0": "brand", "k1": "name", "k2": "size"})


register(
    "q_exact_branded",
    q_exact_branded,
    OFFERS + ", f AS (SELECT lower(brand) AS brand, substring(name, 1, 50) AS name, size, store, min(product_id) AS first FROM offers GROUP BY ALL) SELECT brand, name, size, string_agg(store, ',' ORDER BY store) AS stores, string_agg(CAST(first AS VARCHAR), ',' ORDER BY store) AS products FROM f GROUP BY brand, name, size HAVING count(*) >= 2",
)


def q_exact_generic(spark, d):
    view = offers(spark, d)
    branded = view.filter("lower(brand) = 'brand#12'").select("product_id").distinct()
    rest = view.join(branded, "product_id", "left_anti").filter(F.length("name") >= 3)
    return matching.exact_groups(rest, [F.lower(F.substring("name", 1, 60)), F.col("size")], "store", "product_id").withColumnsRenamed({"k0": "name", "k1": "size"})


register(
    "q_exact_generic",
    q_exact_generic,
    OFFERS + ", f AS (SELECT lower(substring(name, 1, 60)) AS name, size, store, min(product_id) AS first FROM offers WHERE length(name) >= 3 AND lower(brand) <> 'brand#12' GROUP BY ALL) SELECT name, size, string_agg(store, ',' ORDER BY store) AS stores, string_agg(CAST(first AS VARCHAR), ',' ORDER BY store) AS products FROM f GROUP BY name, size HAVING count(*) >= 2",
)


def q_attr_tiers(spark, d):
    return matching.tier_counts(_parts(spark, d))


register(
    "q_attr_tiers",
    q_attr_tiers,
    "SELECT CAST(CASE WHEN a.p_brand = b.p_brand AND abs(a.p_size - b.p_size) <= 0.15 * greatest(a.p_size, b.p_size) THEN 0.95 WHEN a.p_brand = b.p_brand THEN 0.80 WHEN abs(a.p_size - b.p_size) <= 0.15 * greatest(a.p_size, b.p_size) THEN 0.65 ELSE 0.50 END AS DOUBLE) AS tier, count(*) AS n_pairs FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_name = b.p_name AND a.p_partkey < b.p_partkey GROUP BY 1",
)


#: Types of the table's invented names.
TYPES = {"holding": ["bolt", "screw", "nail"], "turning": ["ring", "gear"]}
_TYPES_SQL = "list_filter([CASE WHEN regexp_matches(' ' || {0}.p_name || ' ', ' (bolt|screw|nail) ') THEN 'holding' END, CASE WHEN regexp_matches(' ' || {0}.p_name || ' ', ' (ring|gear) ') THEN 'turning' END], lambda t: t IS NOT NULL)"


def q_match_v3_scored(spark, d):
    """Scored matcher within type and size blocks; half the parts have no brand, names tell shapes or colours as types."""
    types = rules.product_types(F.col("name"), TYPES)
    reps, members = matching.represented(_parts(spark, d).select("id", "name", F.when(F.col("id") % 2 == 0, F.col("brand")).alias("brand"), "type", "size"), "id")
    p = reps.select(
        "id", "name", F.split("name", " ").alias("tokens"), text.ngrams(F.col("name")).alias("grams"), "brand", F.col("type").alias("category"),
        F.col("size").alias("quantity"), quantity.amount(F.col("size"), F.lit("g")).alias("amount"), types.alias("types"),
    )
    pairs = candidates.blended_pairs(p, ["category", "quantity"], "id", matching.MatchRules().least_base, own=True)
    scored = matching.matcher_score(pairs).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), "brand_class", "quantity_class", F.floor(F.col("score") * 1000 + 0.5).alias("permille"))
    return matching.expanded(scored, members, "a", "b")


register(
    "q_match_v3_scored",
    q_match_v3_scored,
    f"""WITH p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, CASE WHEN a.p_partkey % 2 = 0 THEN lower(a.p_brand) END AS ba, CASE WHEN b.p_partkey % 2 = 0 THEN lower(b.p_brand) END AS bb,
   {_TYPES_SQL.format('a')} AS ta, {_TYPES_SQL.format('b')} AS tb, CAST({_MEET} AS DOUBLE) / {_EITHER} AS j, {_G} AS g FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey),
 c AS (SELECT *, CAST(0.6 AS DOUBLE) * j + CAST(0.4 AS DOUBLE) * g AS base, CASE WHEN ba IS NULL AND bb IS NULL THEN 'both_unknown' WHEN ba IS NULL OR bb IS NULL THEN 'one_unknown' WHEN ba = bb OR contains(ba, bb) OR contains(bb, ba) THEN 'match' ELSE 'reject' END AS brand_class FROM p),
 k AS (SELECT * FROM c WHERE brand_class <> 'reject' AND base >= CASE WHEN brand_class = 'match' THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.35 AS DOUBLE) END AND NOT (brand_class = 'match' AND len(ta) > 0 AND len(tb) > 0 AND len(list_intersect(ta, tb)) = 0) AND NOT (brand_class = 'match' AND j = 0 AND base < 0.35)),
 s AS (SELECT *, CASE WHEN brand_class = 'match' THEN least(1.0::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, base + CAST(0.15 AS DOUBLE)) + CAST(0.05 AS DOUBLE)) + CAST(0.12 AS DOUBLE)) WHEN brand_class = 'one_unknown' THEN least(1.0::DOUBLE, base * CAST(0.85 AS DOUBLE) + CAST(0.05 AS DOUBLE)) ELSE least(1.0::DOUBLE, base + CAST(0.05 AS DOUBLE)) END AS s1 FROM k),
 r AS (SELECT *, CASE WHEN g >= 0.65 AND base >= 0.3 AND s1 < 0.5 THEN CAST(0.51 AS DOUBLE) ELSE s1 END AS score FROM s)
 SELECT a, b, brand_class, 'same_size' AS quantity_class, CAST(floor(score * 1000 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS permille FROM r WHERE score >= 0.5""",
)


def _index(spark, d):
    tokens = lambda: text.words(text.normal_name(F.col("text")), 2)
    docs = read_table(spark, d, "documents").select(F.col("doc_id"), "text")
    items = read_table(spark, d, "benchmark").select("item_id", "text")
    return docs, items, tokens()


def q_shared_tokens_ge2(spark, d):
    docs, items, tokens = _index(spark, d)
    return matching.shared_token_pairs(matching.postings(docs, "doc_id", tokens), matching.postings(items, "item_id", tokens), "doc_id", "item_id", 2)


_WORD_SET = "SELECT DISTINCT {0}, token FROM (SELECT {0}, unnest(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) AS token FROM {1}) WHERE length(token) > 2"
register("q_shared_tokens_ge2", q_shared_tokens_ge2, f"SELECT doc_id, item_id, count(*) AS shared FROM ({_WORD_SET.format('doc_id', 'documents')}) JOIN ({_WORD_SET.format('item_id', 'benchmark')}) USING (token) GROUP BY ALL HAVING count(*) >= 2")


def q_tfidf_cosine_top1(spark, d):
    """For every benchmark item the document with the largest TF-IDF cosine. Texts are tokenised and counted once; norms are taken of all tokens, weights
    only of those that an item has."""
    docs, items, _ = _index(spark, d)
    tokens = lambda df: F.filter(text.plain_tokens(df["text"]), lambda t: F.length(t) > 2)
    counts = matching.counted_tokens(docs, "doc_id", tokens)
    idf = materialize(matching.inverse_frequencies(counts, "doc_id", docs.count()), "tfidf-idf")
    asked = materialize(matching.token_counts(items, "item_id", tokens(items)), "tfidf-asked")
    norms = matching.token_norms(counts, "doc_id", idf)
    known = materialize(idf.join(asked.select("token").distinct(), "token", "left_semi").select("token", "idf"), "tfidf-known")
    raw = counts.join(known, "token").select("doc_id", "token", ((1 + F.log("n")) * F.col("idf")).alias("raw"))
    # norms and classes by documents first, so that weights are joined with them and written once
    placed = norms.join(raw.groupBy("doc_id").agg(F.max("raw").alias("top")), "doc_id")
    placed = materialize(placed.select("doc_id", "norm", F.floor(-F.log2(F.col("top") / F.col("norm"))).alias("class")), "tfidf-documents")
    weights = raw.join(placed, "doc_id").select("doc_id", "token", (F.col("raw") / F.col("norm")).alias("weight"), "class")
    return candidates.best_by_cosine(matching.weighted(asked, "item_id", known), weights, "item_id", "doc_id")


_TOK = "SELECT {0}, token, count(*) AS n FROM (SELECT {0}, unnest(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) AS token FROM {1}) WHERE length(token) > 2 GROUP BY ALL"
register(
    "q_tfidf_cosine_top1",
    q_tfidf_cosine_top1,
    f"""WITH d AS ({_TOK.format('doc_id', 'documents')}), b AS ({_TOK.format('item_id', 'benchmark')}), f AS (SELECT token, ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (count(*) + 1)) + 1 AS idf FROM d GROUP BY token),
 dw AS (SELECT doc_id, token, (1 + ln(n)) * idf AS w FROM d JOIN f USING (token)), bw AS (SELECT item_id, token, (1 + ln(n)) * idf AS w FROM b JOIN f USING (token)),
 dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY 1), bn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM bw GROUP BY 1),
 c AS (SELECT item_id, doc_id, CAST(floor(sum(bw.w / bn.norm * (dw.w / dn.norm)) * 10000 + 0.5) AS BIGINT) AS cosine FROM bw JOIN dw USING (token) JOIN bn USING (item_id) JOIN dn USING (doc_id) GROUP BY item_id, doc_id)
 SELECT item_id, doc_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, doc_id) AS r FROM c) WHERE r = 1""",
)

_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def _vector_sides(spark, d):
    e = read_table(spark, d, "embeddings")
    return e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1")


def q_mutual_nn(spark, d):
    return candidates.mutual_nearest(*_vector_sides(spark, d), ["label"], "vec_id", "embedding", 0.1)


_VEC = f"p AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(floor({_COS} * 1000000 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)"
register("q_mutual_nn", q_mutual_nn, f"WITH {_VEC}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS x, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS y FROM p) SELECT a, b, score FROM r WHERE x = 1 AND y = 1 AND score >= 100000")


def q_nn_threshold(spark, d):
    found = candidates.nearest(*_vector_sides(spark, d), ["label"], "vec_id", "embedding", 0.2)
    return found.filter("side = 'a'").select(F.col("own").alias("a"), F.col("other").alias("b"), "score")


register("q_nn_threshold", q_nn_threshold, f"WITH {_VEC} SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS x FROM p) WHERE x = 1 AND score >= 200000")


def q_truth_agreement(spark, d):
    labels = read_table(spark, d, "labels")
    docs = read_table(spark, d, "documents").select("doc_id", "lang", (F.size(F.split("text", " ")) >= 50).cast("int").alias("guess"))
    return docs.join(labels, "doc_id").groupBy("lang").agg(F.count("*").alias("n_rows"), F.count_if(F.col("guess") == F.col("quality")).alias("n_agree"))


register("q_truth_agreement", q_truth_agreement, "SELECT lang, count(*) AS n_rows, count(CASE WHEN (CASE WHEN len(string_split(text, ' ')) >= 50 THEN 1 ELSE 0 END) = quality THEN 1 END) AS n_agree FROM documents JOIN labels USING (doc_id) GROUP BY lang")


def q_group_finalise(spark, d):
    members = group_members(offers(spark, d)).withColumnRenamed("price4", "price")
    return grouping.finalise_groups(members)


_MEMBERS = OFFERS + ", m AS (SELECT category || ':' || name AS group_id, product_id, store, min(price4) AS price FROM offers GROUP BY ALL)"
register("q_group_finalise", q_group_finalise, _MEMBERS + " SELECT group_id, count(*) AS n_members, string_agg(DISTINCT store, ',' ORDER BY store) AS stores, count(DISTINCT store) AS n_stores, min(price) AS min_price, max(price) AS max_price, max(price) - min(price) AS savings, max(price) > 3 * min(price) AS suspicious FROM m GROUP BY group_id HAVING count(*) >= 2 AND count(DISTINCT store) >= 2")


def q_integrity(spark, d):
    return grouping.integrity_violations(group_members(offers(spark, d)))


register(
    "q_integrity",
    q_integrity,
    _MEMBERS + ", g AS (SELECT group_id, count(DISTINCT product_id) AS p, count(DISTINCT store) AS s FROM m GROUP BY 1) SELECT 'product_in_groups' AS rule, count(*) AS n_violations FROM (SELECT product_id FROM m GROUP BY 1 HAVING count(DISTINCT group_id) > 1) UNION ALL SELECT 'single_product', count(CASE WHEN p < 2 THEN 1 END) FROM g UNION ALL SELECT 'single_store', count(CASE WHEN s < 2 THEN 1 END) FROM g",
)


def q_group_validate(spark, d):
    """Groups of (brand, type) of which every pair of names shares a word and prices are within the ratio."""
    p = _parts(spark, d).select(F.concat_ws(":", "brand", "type").alias("group_id"), text.token_set(F.split("name", " ")).alias("words"), "price")
    return grouping.valid_groups(p, "group_id", "words", lambda x, y: similarity.jaccard(x, y) >= 0.3, "price")


register("q_group_validate", q_group_validate, f"SELECT lower(a.p_brand) || ':' || a.p_type AS group_id, bool_and(CAST({_MEET} AS DOUBLE) / {_EITHER} >= 0.3 AND greatest(a.p_retailprice, b.p_retailprice) / least(a.p_retailprice, b.p_retailprice) <= 2.5) AS valid, count(*) AS n_pairs {_PAIRS} GROUP BY 1")


def r_seq_ratio(spark, d):
    return _scored(spark, d, similarity.sequence_ratio(F.col("l.name"), F.col("r.name")).alias("ratio"))


def _catalogue(spark, d):
    p = _parts(spark, d)
    return p.filter("id % 2 = 0").withColumn("barcode", F.when(F.col("id") % 10 == 0, F.concat(F.lit("b"), F.col("id").cast("string")))), p.filter("id % 2 = 1").select(
        F.col("id").alias("off_id"), F.col("name").alias("off_name"), F.col("brand").alias("off_brand"), F.col("size").alias("off_size"), F.when(F.col("id") % 10 == 1, F.concat(F.lit("b"), (F.col("id") - 1).cast("string"))).alias("off_barcode")
    )


def r_fast_matcher(spark, d):
    return matching.fast_match(*_catalogue(spark, d))


def r_multi_pass(spark, d):
    return matching.multi_pass_match(*_catalogue(spark, d))


def r_strict_greedy(spark, d):
    p = _parts(spark, d).select("id", "name", "type", F.array("type").alias("types"), F.col("size").alias("quantity"), "price")
    p = matching.like_prices(p, ["type", "name"], "price", 2.5)
    (even, lefts), (odd, rights) = (matching.represented(p.filter(F.col("id") % 2 == side), "id") for side in (0, 1))
    pairs = matching.blocked_pairs(even, odd, ["type", "name"], "id", F.lit(True))
    return grouping.serial_choice_by_class(matching.strict_match(pairs), lefts, rights)


def r_greedy_groups(spark, d):
    """Pairs of parts of a block with a word Jaccard over .3, taken from the best on, each part once; equals by the smaller keys."""
    return grouping.greedy_similar(_parts(spark, d).select("id", "type", "brand", _name_words().alias("words")), "id", ["type", "brand"], "words", 0.3)


def r_components(spark, d):
    p = _parts(spark, d).select("id", "type", "brand", _name_words().alias("words"))
    return grouping.similar_components(p, "id", ["type", "brand"], "words", 0.9)


for _f in (r_seq_ratio, r_fast_matcher, r_multi_pass, r_strict_greedy, r_greedy_groups):
    register(_f.__name__, _f)

register(
    "r_components",
    r_components,
    f"""WITH RECURSIVE p AS (SELECT a.p_partkey AS a, b.p_partkey AS b {_PAIRS} WHERE CAST({_MEET} AS DOUBLE) / {_EITHER} > 0.9), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
 r(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS node, min(b) AS label FROM r GROUP BY a""",
)


def q_fallback_lookup(spark, d):
    """Part names looked up among all part names: exact among every second part, then by the last word."""
    p = _parts(spark, d)
    table = p.select("id", F.col("name").alias("known"))
    rows = p.select(F.col("id").alias("row_id"), "name", "size")
    last = lambda c: F.element_at(F.split(F.col(c), " "), -1)
    keys = [(F.concat_ws("|", "name", F.lit("x")), F.concat_ws("|", "known", F.when(F.col("id") % 2 == 0, F.lit("x")).otherwise(F.lit("y")))), (last("name"), last("known"))]
    return phases.fallback_lookup(rows, table.withColumn("hit", F.col("id")), keys, "hit", "id").select("row_id", "hit")


register(
    "q_fallback_lookup",
    q_fallback_lookup,
    "WITH k AS (SELECT p_partkey AS id, p_name AS name FROM part), a AS (SELECT name, min(id) AS hit FROM k WHERE id % 2 = 0 GROUP BY 1), b AS (SELECT string_split(name, ' ')[-1] AS w, min(id) AS hit FROM k GROUP BY 1) "
    "SELECT p_partkey AS row_id, coalesce(a.hit, b.hit) AS hit FROM part LEFT JOIN a ON a.name = p_name LEFT JOIN b ON b.w = string_split(p_name, ' ')[-1]",
)


def q_first_fit(spark, d):
    p = _parts(spark, d)
    catalogue = p.filter("id % 2 = 1").select(F.col("id").alias("off_id"), F.col("brand").alias("off_brand"), F.col("size").alias("off_size"), F.col("id").alias("ord"))
    return phases.first_fit(p.filter("id % 2 = 0"), catalogue)


register(
    "q_first_fit",
    q_first_fit,
    "SELECT id, off_id, fits FROM (SELECT a.p_partkey AS id, b.p_partkey AS off_id, abs(a.p_size - b.p_size) <= 0.15 * greatest(a.p_size, b.p_size) AS fits, row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(a.p_size - b.p_size) <= 0.15 * greatest(a.p_size, b.p_size) DESC, b.p_partkey) AS n FROM part a JOIN part b ON lower(a.p_brand) = lower(b.p_brand) WHERE a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1) WHERE n = 1",
)


def q_shared_identifier(spark, d):
    return phases.shared_identifier_groups(offers(spark, d).select("product_id", "store"), "product_id", "store", "store").select("product_id", "n_stores", F.array_join("members", ",").alias("stores"))


register("q_shared_identifier", q_shared_identifier, OFFERS + " SELECT product_id, count(DISTINCT store) AS n_stores, string_agg(DISTINCT store, ',' ORDER BY store) AS stores FROM offers GROUP BY product_id HAVING count(DISTINCT store) >= 2")


def q_rule_mining(spark, d):
    return standardise.mined_words(read_table(spark, d, "part"), "p_type", "p_name", 5)


register("q_rule_mining", q_rule_mining, "SELECT p_type, word, n FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, word) AS r FROM (SELECT p_type, word, count(*) AS n FROM (SELECT p_type, unnest(regexp_extract_all(lower(p_name), '[a-z]{3,}')) AS word FROM part) GROUP BY ALL HAVING count(*) >= 2)) WHERE r <= 5")


def q_table_counts(spark, d):
    return standardise.table_counts(spark, {**{n: read_table(spark, d, n) for n in ("part", "orders", "events")}, "missing": None})


register("q_table_counts", q_table_counts, "SELECT 'part' AS table_name, count(*) AS n_rows FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'missing', 0")


def _stocked(spark, d) -> DataFrame:
    # a store's cheapest offer first, by a hash aggregate; an unknown price comes before others
    cheapest = offers(spark, d).groupBy("product_id", "store").agg(F.when(F.count("price4") == F.count("*"), F.min("price4")).alias("price4"))
    stores = cheapest.groupBy("product_id").agg(F.min_by("store", F.struct("price4", "store")).alias("store"))
    return _parts(spark, d).join(stores, F.col("id") == F.col("product_id")).select("id", "store", "name", "brand", F.col("type").alias("category"), "size", F.lit(None).cast("string").alias("barcode"))


def r_jaccard_matcher(spark, d):
    return phases.jaccard_matcher(_stocked(spark, d), 0.3, 1)


def r_phase_matcher(spark, d):
    vectors = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = phases.phase_matcher(_stocked(spark, d), vectors, 0.2, 0.3)
    return found.select("a", "b", F.floor(F.col("confidence") * 1000000 + 0.5).alias("micro"), "phase")


def _phase_sql() -> str:
    """Each phase: pairs of the rest, those that are each other's best, and the rest without them."""
    parts, rest = [], "s0"
    cosine = "list_cosine_similarity(CAST(u.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"
    vectors = "JOIN embeddings u ON u.vec_id = x.id JOIN embeddings v ON v.vec_id = y.id"
    for n, (keys, score, joins, least) in enumerate([(("brand", "name", "size"), "1.0::DOUBLE", "", 0), (("name", "size"), "0.98::DOUBLE", "", 0), (("brand",), cosine, vectors, 0.2), (("category",), cosine, vectors, 0.3)], 1):
        on = " AND ".join(f"x.{k} = y.{k}" for k in keys)
        parts.append(f"p{n} AS (SELECT x.id AS a, y.id AS b, {score} AS c FROM {rest} x JOIN {rest} y ON {on} AND x.store < y.store {joins})")
        parts.append(f"m{n} AS (SELECT a, b, c FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS i, row_number() OVER (PARTITION BY b ORDER BY c DESC, a) AS j FROM p{n}) WHERE i = 1 AND j = 1 AND c >= {least}::DOUBLE)")
        parts.append(f"s{n} AS (SELECT * FROM {rest} WHERE id NOT IN (SELECT a FROM m{n} UNION ALL SELECT b FROM m{n}))")
        rest = f"s{n}"
    union = " UNION ALL ".join(f"SELECT a, b, CAST(floor(c * 1000000 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS micro, {n} AS phase FROM m{n}" for n in range(1, 5))
    return ", " + ", ".join(parts) + " " + union


def r_hybrid_match(spark, d):
    products, catalogue = _catalogue(spark, d)
    return phases.hybrid_match(products, catalogue, catalogue.count())


def r_transliterated_match(spark, d):
    products, catalogue = _catalogue(spark, d)
    return phases.transliterated_match(products, catalogue)


def r_importer_matches(spark, d):
    products, catalogue = _catalogue(spark, d)
    return phases.importer_matches(products, catalogue)


def r_standard_products(spark, d):
    raw = offers(spark, d).select(F.col("product_id").alias("sku"), "store", F.concat("name", F.lit(" "), F.col("size").cast("string"), F.lit(" g")).alias("name"), (F.col("price4") / 10000).alias("price"), (F.col("old4") / 10000).alias("old_price"))
    found = standardise.standard_products(raw, ["red ring", "blue bolt"], [("fasteners", ["bolt"]), ("parts", ["ring", "gear"])], {"ASIA": ["promo"]})
    return found.withColumn("errors", F.array_join("errors", ","))


_DECIMAL = "CAST(round(CAST(CAST({0} AS VARCHAR) AS DECIMAL(38, 12)), {1}) AS DOUBLE)"
_STANDARD = (
    OFFERS
    + """, r AS (SELECT product_id AS sku, store, name || ' ' || size || ' g' AS raw_name, name, CAST(size AS DOUBLE) AS quantity, price4 / 10000.0::DOUBLE AS price, old4 / 10000.0::DOUBLE AS old FROM offers),
 d AS (SELECT *, CASE WHEN old > price AND price > 0 THEN """
    + _DECIMAL.format("(old - price) / old * 100", 1)
    + """ END AS discount FROM r)
 SELECT sku, store, raw_name, raw_name AS clean_name, CASE WHEN name = 'blue bolt' THEN 'blue bolt' WHEN name = 'red ring' THEN 'red ring' END AS brand,
   CASE WHEN contains(name, 'bolt') THEN 'fasteners' WHEN contains(name, 'ring') OR contains(name, 'gear') THEN 'parts' ELSE 'other' END AS category, price,
   CASE WHEN old > price AND old < 3 * price THEN old END AS old_price, quantity, 'g' AS unit, CASE WHEN quantity > 0 THEN """
    + _DECIMAL.format("price / quantity * 1000", 2)
    + """ END AS unit_price, discount,
   concat_ws(',', CASE WHEN price <= 0 OR price > 10000 THEN 'price:range' END, CASE WHEN discount > 90 THEN 'discount:deep' END) AS errors FROM d"""
)


register(
    "r_jaccard_matcher",
    r_jaccard_matcher,
    OFFERS
    + """, s AS (SELECT product_id, arg_min(store, {'a': price4, 'b': store}) AS store FROM offers GROUP BY 1), w AS (SELECT p_partkey AS id, p_type, store, list_distinct(list_filter(string_split(p_name, ' '), lambda x: length(x) > 1)) AS t FROM part JOIN s ON product_id = p_partkey)
 SELECT a, b, score FROM (SELECT a.id AS a, b.id AS b, CAST(len(list_intersect(a.t, b.t)) AS DOUBLE) / len(list_distinct(list_concat(a.t, b.t))) AS score FROM w a JOIN w b ON a.p_type = b.p_type AND a.store < b.store) WHERE score >= 0.3""",
)


def _stored_parts(spark, d) -> DataFrame:
    """Parts of three stores, with types as categories; a seventh has no size and a ninth no brand."""
    k = F.col("id")
    return _parts(spark, d).select(
        "id", (k % 3).alias("store"), F.col("type").alias("category"), "name", F.when(k % 9 > 0, F.col("brand")).alias("brand"), F.when(k % 7 > 0, F.col("size")).alias("quantity"), F.when(k % 2 == 0, "kg").otherwise("кг").alias("unit"), "price"
    )


def r_ratio_match(spark, d):
    return matching.ratio_match(_stored_parts(spark, d), 0.8, 200.0, "ECONOMY")


def r_sign_match(spark, d):
    return matching.sign_match(_stored_parts(spark, d), ["red", "blue", "xl"], 0.75, 150.0, "ECONOMY")


def r_offline_match(spark, d):
    products, catalogue = _catalogue(spark, d)
    return matching.offline_match(products, catalogue)


def r_blends(spark, d):
    """The three blends with the sequence ratio, for pairs of a block."""
    def blends(pairs: DataFrame) -> DataFrame:
        pairs = pairs.withColumn("seq", similarity.sequence_ratio(F.col("l.name"), F.col("r.name"))).withColumn("j", similarity.jaccard(_tokens("l"), _tokens("r"))).withColumn("o", similarity.overlap(_tokens("l"), _tokens("r")))
        named = {"strict": similarity.blend(F.col("j"), F.col("seq")), "passes": similarity.blend(F.col("o"), F.col("seq")), "translit": similarity.blend(F.col("seq"), F.col("j"))}
        return pairs.withColumns(named).drop("seq", "j", "o")

    p = _parts(spark, d).select("id", "type", "brand", "name")
    return matching.pairs_by_class(p, p, ["type", "brand"], "id", blends)


def r_api_hits(spark, d):
    """Catalogue rows of a product's brand as hits of a search, by score; from .55 on, the best one."""
    return phases.api_best(*_catalogue(spark, d))


for _f in (r_ratio_match, r_sign_match, r_offline_match, r_blends, r_api_hits):
    register(_f.__name__, _f)

for _f in (r_hybrid_match, r_transliterated_match, r_importer_matches):
    register(_f.__name__, _f)

_PHASES = OFFERS + ", t AS (SELECT product_id, arg_min(store, {'a': price4, 'b': store}) AS store FROM offers GROUP BY 1), s0 AS (SELECT p_partkey AS id, store, p_name AS name, lower(p_brand) AS brand, p_type AS category, p_size AS size FROM part JOIN t ON product_id = p_partkey)"
register("r_phase_matcher", r_phase_matcher, _PHASES + _phase_sql())
register("r_standard_products", r_standard_products, _STANDARD)
