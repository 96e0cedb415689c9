"""Matchers in several passes, and lookups that fall back from one key to the next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import quantity, similarity, text
from tallyframe.operators import candidates, matching, spelling
from tallyframe.operators.relational import keep_first
from tallyframe.session import materialize


def _tokens(name: str, longer: int = 1) -> Column:
    return F.array_distinct(text.words(text.normal_name(F.col(name)), longer))


def jaccard_matcher(products: DataFrame, least: float = 0.5, common: int = 2) -> DataFrame:
    """Pairs of products (id, store, category, name) of different stores in one category by word Jaccard."""
    p = products.select("id", "store", "category", _tokens("name").alias("t"))

    def scored(pairs: DataFrame) -> DataFrame:
        pairs = pairs.filter(F.col("l.store") < F.col("r.store")).withColumn("score", similarity.jaccard(F.col("l.t"), F.col("r.t"), common))
        return pairs.filter(F.col("score") >= least)

    return matching.pairs_by_class(p, p, ["category"], "id", scored, ordered=False)


def phase_matcher(products: DataFrame, vectors: DataFrame, brand_least: float = 0.80, category_least: float = 0.92) -> DataFrame:
    """products (id, store, name, brand, category, size); vectors (id, embedding). Four phases, each
    on what the earlier ones left: same brand, name and size; same name and size; mutual nearest
    neighbours within a brand; within a category. Gives a, b, confidence, phase."""

    def pairs_on(rest: DataFrame, keys: list[str]) -> DataFrame:
        return matching.blocked_pairs(rest, rest, keys, "id", F.col("l.store") < F.col("r.store"))

    def exact(rest: DataFrame, keys: list[str], confidence: float, phase: int) -> DataFrame:
        # of products alike in keys and store only the first can be another's best, so only firsts can be each other's
        firsts = rest.groupBy(*keys, "store").agg(F.min("id").alias("id"))
        found = pairs_on(firsts.dropna(subset=keys), keys).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.lit(confidence).alias("confidence"))
        return matching.mutual_best(found, "a", "b", "confidence", 0.0).withColumn("phase", F.lit(phase))

    def nearest(rest: DataFrame, keys: list[str], least: float, phase: int) -> DataFrame:
        found = materialize(rest.join(vectors, "id").dropna(subset=[*keys, "store"]).select("id", "store", *keys, "embedding"), "phase-vectors")
        best = candidates.mutual_nearest(found, found, keys, "id", "embedding", least, scale=None, order="store")
        return best.select("a", "b", F.col("score").alias("confidence"), F.lit(phase).alias("phase"))

    named = products.withColumn("name", text.normal_name(F.col("name")))
    steps = [
        lambda rest: exact(rest, ["brand", "name", "size"], 1.0, 1),
        lambda rest: exact(rest, ["name", "size"], 0.98, 2),
        lambda rest: nearest(rest, ["brand"], brand_least, 3),
        lambda rest: nearest(rest, ["category"], category_least, 4),
    ]
    rest, found = materialize(named, "phase-rest"), []
    for step in steps:
        if found:
            rest = materialize(rest.join(found[-1].select(F.explode(F.array("a", "b")).alias("id")), "id", "left_anti"), "phase-rest")
        found.append(materialize(step(rest), "phase-found"))
    return reduce(DataFrame.unionByName, found)


def first_fit(products: DataFrame, catalogue: DataFrame) -> DataFrame:
    """products (id, brand, size), catalogue (off_id, off_brand, off_size, ord): the first catalogue row of
    the brand within 15 % of the size, else the first of the brand."""
    wanted = products.select("brand", "size").distinct()
    # of catalogue rows alike in brand and size, only the first can be chosen
    offered = catalogue.groupBy("off_brand", "off_size").agg(F.min(F.struct("ord", "off_id")).alias("first"))
    late = ~quantity.within_share(F.col("size"), F.col("off_size"))
    best = wanted.join(offered, F.col("brand") == F.col("off_brand")).groupBy("brand", "size").agg(F.min(F.struct(late.alias("late"), "first")).alias("m"))
    best = best.select(F.col("brand").alias("_b"), F.col("size").alias("_s"), F.col("m.first.off_id").alias("off_id"), (~F.col("m.late")).alias("fits"))
    return products.join(best, (F.col("brand") == F.col("_b")) & F.col("size").eqNullSafe(F.col("_s"))).select("id", "off_id", "fits")


def hybrid_match(products: DataFrame, catalogue: DataFrame, n_docs: int | None = None, least: float = 0.45) -> DataFrame:
    """products (id, name, brand, size, barcode), catalogue (off_*): barcode; then .85 of .4 brand + .3 size +
    .3 name against TF-IDF cosine. The brand result wins from .75 on, or from nine tenths of the cosine.
    Where neither reaches `least`, .5 times sequence ratio with all catalogue names, if that does."""
    by_code = products.join(catalogue.filter("off_barcode is not null").groupBy(F.col("off_barcode").alias("barcode")).agg(F.min("off_id").alias("off_id")), "barcode").select("id", "off_id", F.lit(1.0).alias("confidence"), F.lit("barcode").alias("method"))
    rest = products.join(by_code, "id", "left_anti")
    idf = matching.inverse_frequencies(matching.postings(catalogue, "off_id", _tokens("off_name")), "off_id", catalogue.count() if n_docs is None else n_docs).select("token", "idf")
    firsts = matching.first_of_class(catalogue, "off_id", ["off_name", "off_brand", "off_size"])
    return by_code.unionByName(matching.for_each_class(rest, "id", ["name", "brand", "size"], lambda p: _hybrid_rest(p, firsts, materialize(idf, "hybrid-idf"), least)))


def _hybrid_rest(rest: DataFrame, catalogue: DataFrame, idf: DataFrame, least: float) -> DataFrame:
    """hybrid_match of distinct products without a barcode that is known; idf is that of the whole catalogue."""
    p, o = rest.withColumn("t", _tokens("name")), catalogue.withColumn("o", _tokens("off_name"))
    same = p.join(o, F.col("brand") == F.col("off_brand")).select("id", "off_id", "size", "off_size", "t", "o")
    close = F.when(quantity.within_share(F.col("size"), F.col("off_size")), 1.0).otherwise(0.0)
    brand = matching.best_candidate(same.select("id", "off_id", (0.85 * (0.4 + 0.3 * close + 0.3 * similarity.jaccard(F.col("t"), F.col("o")))).alias("score")), "id", "off_id", "score").select("id", F.col("off_id").alias("brand_off"), F.col("score").alias("brand_score")).filter(F.col("brand_score") >= least)
    # a cosine depends on the two names alone
    names = matching.first_of_class(o, "off_id", ["o"])
    named = lambda rows: matching.tfidf_weights(rows, "id", F.col("t"), idf)
    weights = matching.tfidf_weights(names, "off_id", F.col("o"), idf)
    cosine = matching.for_each_class(p, "id", ["t"], lambda q: matching.best_candidate(matching.cosine_pairs(named(q), weights, "id", "off_id"), "id", "off_id", "cosine"))
    cosine = cosine.select("id", F.col("off_id").alias("cos_off"), "cosine").filter(F.col("cosine") >= least)
    both = brand.join(cosine, "id", "full")
    wins = (F.col("brand_score") >= 0.75) | (F.col("brand_score") >= 0.9 * F.col("cosine")) | F.col("cosine").isNull()
    chosen = both.select("id", F.when(wins, F.col("brand_off")).otherwise(F.col("cos_off")).alias("off_id"), F.when(wins, F.col("brand_score")).otherwise(F.col("cosine")).alias("confidence"), F.when(wins, "brand").otherwise("cosine").alias("method"))
    left = rest.join(chosen, "id", "left_anti").select("id", text.normal_name(F.col("name")).alias("n"))
    return chosen.unionByName(left.join(_nearest_names(left, catalogue, 2 * least), "n").select("id", "off_id", (0.5 * F.col("ratio")).alias("confidence"), F.lit("fuzzy").alias("method")))


def _nearest_names(products: DataFrame, catalogue: DataFrame, least: float) -> DataFrame:
    """(n, off_id, ratio): the catalogue row nearest in spelling to each distinct name n, from `least` on."""
    known = catalogue.select("off_id", text.normal_name(F.col("off_name")).alias("o")).filter(F.length("o") > 0).groupBy("o").agg(F.min("off_id").alias("off_id"))
    scored = spelling.spelt_pairs(products, known, "n", "o", least).join(known, "o").select("n", "off_id", "ratio")
    return matching.best_candidate(scored, "n", "off_id", "ratio")


#: Fixed value: how many rows of a word the short form of transliterated_match takes.
TRANSLITERATED_CAP = 50


def transliterated_match(products: DataFrame, catalogue: DataFrame, cap: int | None = None, least: float = 0.45) -> DataFrame:
    """Names against catalogue names as written and transliterated either way; shared words propose (of a word all rows, or the
    first `cap`; TRANSLITERATED_CAP is that of the short form), .6 sequence ratio + .4 Jaccard decides. Tiers from .85 and .75."""
    if cap is None:
        catalogue = matching.first_of_class(catalogue, "off_id", ["off_name"])
    return matching.for_each_class(products, "id", ["name"], lambda p: _transliterated(p, catalogue, cap, least))


def _transliterated(products: DataFrame, catalogue: DataFrame, cap: int | None, least: float) -> DataFrame:
    """transliterated_match of distinct products."""
    variants = lambda c: F.array_distinct(F.array(F.lower(F.col(c)), text.to_latin(F.col(c)), text.to_cyrillic(F.col(c))))
    p = products.select("id", F.explode(variants("name")).alias("v")).withColumn("t", _tokens("v", 2))
    o = catalogue.select("off_id", F.explode(variants("off_name")).alias("w")).withColumn("o", _tokens("w", 2))
    near = matching.shared_token_pairs(matching.postings(p, "id", F.col("t")), matching.postings(o, "off_id", F.col("o"), cap), "id", "off_id")
    scored = near.join(p, "id").join(o, "off_id").withColumn("score", 0.6 * similarity.sequence_ratio(F.col("v"), F.col("w")) + 0.4 * similarity.jaccard(F.col("t"), F.col("o")))
    best = matching.best_candidate(scored.groupBy("id", "off_id").agg(F.max("score").alias("score")), "id", "off_id", "score").filter(F.col("score") >= least)
    return best.withColumn("tier", F.when(F.col("score") >= 0.85, "confident").when(F.col("score") >= 0.75, "likely").otherwise("low"))


def importer_matches(products: DataFrame, catalogue: DataFrame, brand_least: float = 0.6, prefix_least: float = 0.7) -> DataFrame:
    """All matches: barcode 1.0; brand inside brand and sequence ratio; the first 20 letters of the name and ratio times .8."""
    by_code = products.join(catalogue, F.col("barcode") == F.col("off_barcode")).select("id", "off_id", F.lit(1.0).alias("confidence"), F.lit("barcode").alias("method"))
    ratio = similarity.sequence_ratio(F.lower("name"), F.lower("off_name"))
    (p, own), (o, offered) = matching.represented(products.select("id", "name", "brand"), "id"), matching.represented(catalogue.select("off_id", "off_name", "off_brand"), "off_id")
    brands = matching.containing_pairs(p, o, "brand", "off_brand")
    by_brand = p.join(brands, "brand").join(o, "off_brand").withColumn("confidence", ratio).filter(F.col("confidence") >= brand_least).select("id", "off_id", "confidence", F.lit("brand").alias("method"))
    key = lambda c: F.substring(text.normal_name(F.col(c)), 1, 20)
    by_prefix = p.withColumn("k", key("name")).join(o.withColumn("k", key("off_name")), "k").withColumn("confidence", ratio).filter(F.col("confidence") >= prefix_least)
    found = by_brand.unionByName(by_prefix.select("id", "off_id", (F.col("confidence") * 0.8).alias("confidence"), F.lit("prefix").alias("method")))
    return by_code.unionByName(matching.expanded(found, own, "id", "off_id", offered))


def api_best(products: DataFrame, catalogue: DataFrame, least: float = 0.55) -> DataFrame:
    """products (id, name, brand, size), catalogue (off_id, off_name, off_brand, off_size): of the catalogue rows of a product's brand, as hits of a
    search, the best by score, from `least` on: brand .4, .1 per shared term up to .4, size .2 (within half: .1), .2 times sequence
    ratio. Names are compared once; of the rows of a name only the one of the best size, the first of these, meets a product."""
    catalogue = matching.first_of_class(catalogue, "off_id", ["off_name", "off_brand", "off_size"])
    size = F.when(quantity.ratio(F.col("size"), F.col("off_size")) <= 1.1, 0.2).when(quantity.ratio(F.col("size"), F.col("off_size")) <= 1.5, 0.1).otherwise(0.0)

    def best(p: DataFrame) -> DataFrame:
        p = p.filter("brand IS NOT NULL").select("id", "name", "brand", F.struct("size").alias("_at"))
        of_brand = catalogue.withColumnRenamed("off_brand", "brand")
        met = p.select("brand", "_at", "_at.size").distinct().join(of_brand, "brand").groupBy("brand", "_at", "off_name")
        first = met.agg(F.min(F.struct((-size).alias("low"), "off_id")).alias("first")).select("brand", "_at", "off_name", (-F.col("first.low")).alias("_size"), "first.off_id")
        pairs = p.select("name", "brand").distinct().join(of_brand.select("brand", "off_name").distinct(), "brand").select("name", "off_name").distinct()
        terms = F.least(F.size(F.array_intersect(_tokens("name", 2), _tokens("off_name", 2))) * 0.1, F.lit(0.4))
        named = pairs.select(F.struct("name").alias("_named"), F.struct("off_name").alias("_offered"), terms.alias("_terms"), similarity.sequence_ratio(F.lower("name"), F.lower("off_name")).alias("_ratio"))
        hits = p.withColumn("_named", F.struct("name")).join(first, ["brand", "_at"]).withColumn("_offered", F.struct("off_name")).join(materialize(named, "api-names"), ["_named", "_offered"])
        scored = hits.select("id", "off_id", (F.lit(0.4) + F.col("_terms") + F.col("_size") + 0.2 * F.col("_ratio")).alias("score"))
        return matching.best_candidate(scored, "id", "off_id", "score").filter(F.col("score") >= least)

    return matching.for_each_class(products, "id", ["name", "brand", "size"], best)


def fallback_lookup(rows: DataFrame, table: DataFrame, keys: list[tuple[Column, Column]], value: str, order: str) -> DataFrame:
    """rows with `value` of the first table row (by `order`) that matches the first key pair that matches any.
    Each pair is (key of rows, key of table); a table key that repeats gives its first row."""
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    found = numbered
    for i, (left, right) in enumerate(keys):
        side = table.select(right.alias(f"_k{i}"), F.col(value).alias(f"_v{i}"), F.col(order).alias("_ord")).filter(F.col(f"_k{i}").isNotNull())
        side = side.groupBy(f"_k{i}").agg(F.min_by(f"_v{i}", "_ord").alias(f"_v{i}"))
        found = found.withColumn("_l", left).join(side, F.col("_l") == F.col(f"_k{i}"), "left").drop("_l", f"_k{i}")
    return found.withColumn(value, F.coalesce(*[F.col(f"_v{i}") for i in range(len(keys))])).drop("_row", *[f"_v{i}" for i in range(len(keys))])


def shared_identifier_groups(rows: DataFrame, identifier: str, store: str, member: str) -> DataFrame:
    """Identifiers that several stores carry, with their members in order."""
    grouped = rows.dropna(subset=[identifier]).groupBy(identifier).agg(F.count_distinct(store).alias("n_stores"), F.array_sort(F.collect_set(member)).alias("members"))
    return grouped.filter("n_stores >= 2")


def containing_brand_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: int = 4) -> DataFrame:
    """Distinct brand pairs that are equal or of which one of `least` letters stands in the other."""
    inside = ((F.length(a) >= least) & F.contains(b, a)) | ((F.length(b) >= least) & F.contains(a, b)) | (F.col(a) == F.col(b))
    return matching.containing_pairs(left, right, a, b).filter(inside)


def close_brand_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: float = 0.7) -> DataFrame:
    """Distinct brand pairs of which one holds the other, or whose sequence ratio is over `least`."""
    return matching.containing_pairs(left, right, a, b).union(matching.alike_pairs(left, right, a, b, least)).distinct()


def name_lookup(rows: DataFrame, table: DataFrame, name: str, known: str, value: str, order: str) -> DataFrame:
    """rows with `value` of the table row of the same name; else of the one named like the row without its first word; else of
    the first (by `order`) whose name holds the row's or stands in it. Names are compared in normal form."""
    key, other = text.normal_name(F.col(name)), text.normal_name(F.col(known))
    rest = F.nullif(F.regexp_replace(key, "^[^ ]+ ?", ""), F.lit(""))
    exact = fallback_lookup(rows, table, [(key, other), (rest, other)], value, order)
    left = exact.filter(F.col(value).isNull()).select(key.alias("_a")).distinct()
    named = table.select(other.alias("_b"), F.col(value).alias("_found"), F.col(order).alias("_ord"))
    first = matching.containing_pairs(left, named, "_a", "_b").join(named, "_b").groupBy("_a").agg(F.min_by("_found", "_ord").alias("_found"))
    return exact.withColumn("_key", key).join(first, F.col("_key") == F.col("_a"), "left").withColumn(value, F.coalesce(value, "_found")).drop("_key", "_a", "_found")


def prefix_lookup(rows: DataFrame, table: DataFrame, name: str, known: str, value: str, order: str, letters: int = 30) -> DataFrame:
    """rows with `value` of the last table row (by `order`) whose name begins with the same letters."""
    start = lambda c: F.substring(F.lower(F.trim(F.col(c))), 1, letters)
    last = table.select(start(known).alias("_p"), value, order).filter("_p <> ''").groupBy("_p").agg(F.max_by(value, order).alias(value))
    return rows.withColumn("_q", start(name)).join(last, F.col("_q") == F.col("_p"), "left").drop("_p", "_q")


def denied(groups: DataFrame, deny: DataFrame, key: str) -> DataFrame:
    """Groups not on a deny list."""
    return groups.join(deny.select(key), key, "left_anti")


def priority_first(parts: list[DataFrame], keys: list[str], order: list) -> DataFrame:
    """Union in order of priority; of each key the first by priority, then order."""
    ranked = reduce(DataFrame.unionByName, [p.withColumn("_p", F.lit(i)) for i, p in enumerate(parts)])
    return keep_first(ranked, keys, ["_p", *order]).drop("_p")
