"""Product matching: candidates by blocks and tokens, scores, nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import quantity, rules, similarity, text
from tallyframe.operators import spelling
from tallyframe.session import materialize


def blocked_pairs(left: DataFrame, right: DataFrame, block: list[str], key: str, condition: Column | None = None) -> DataFrame:
    """Pairs that share a block, as structs l and r; condition over l.* and r.* (default: smaller key first)."""
    a = left.select(*[F.col(b).alias(f"_{b}") for b in block], F.struct("*").alias("l"))
    b = right.select(*[F.col(c).alias(f"_{c}") for c in block], F.struct("*").alias("r"))
    pairs = a.join(b, [f"_{c}" for c in block])
    return pairs.filter(condition if condition is not None else F.col(f"l.{key}") < F.col(f"r.{key}")).select("l", "r")


#: Keys of one class that meet as one row, and pairs that one task makes, about.
CLASS_KEYS, TASK_PAIRS = 1000, 20_000_000


def members(rows: DataFrame, key: str) -> DataFrame:
    """(class, keys): the rows that are alike in all columns but the key, as structs of these with the keys in order. Larger
    classes are cut by hash into rows of about CLASS_KEYS keys."""
    rows = rows.select(F.struct(*[c for c in rows.columns if c != key]).alias("class"), F.col(key).alias("_key"))
    large = rows.groupBy("class").agg(F.count("*").alias("_n")).filter(F.col("_n") > CLASS_KEYS).select(F.col("class").alias("_large"), "_n")
    cut = rows.join(large, F.col("class").eqNullSafe(F.col("_large")), "left").withColumn("_cut", F.when(F.col("_n") > 0, F.pmod(F.xxhash64("_key"), F.ceil(F.col("_n") / CLASS_KEYS))).otherwise(0))
    return cut.groupBy("class", "_cut").agg(F.array_sort(F.collect_list("_key")).alias("keys")).select("class", "keys")


#: Tasks that make pairs, at most.
MOST_TASKS = 10_000


def pairs_by_class(left: DataFrame, right: DataFrame, block: list[str], key: str, score: Callable[[DataFrame], DataFrame], ordered: bool = True) -> DataFrame:
    """What score gives for pairs of rows that share a block, as a and b (the keys, the smaller first if `ordered`) and its further columns.
    score takes structs l and r, the rows without their keys, and may drop pairs: it sees two classes of equal rows once,
    however many rows they have. Blocks are dealt to as many tasks as their pairs ask for, and pairs are not shuffled."""
    a = materialize(members(left, key), "classes")
    b = a if right is left else materialize(members(right, key), "classes")
    met = classes_met(a, b, block)
    if ordered:
        met = met.filter(F.element_at("_a", 1) < F.element_at("_b", -1))
    pairs = each_two(score(met).drop("l", "r"))
    return pairs.filter("a < b") if ordered else pairs


def classes_met(a: DataFrame, b: DataFrame, block: list[str], links: DataFrame | None = None) -> DataFrame:
    """(l, r, _a, _b): two classes and their keys, of members a and b, that share a block; or whose blocks are linked by a row of `links` (_l_ and
    _r_ before each column of the block, and further columns, which are given too)."""
    sides = {s: [f"_{s}_{c}" for c in block] for s in "lr"}
    placed = lambda df, s: df.select(*[F.col(f"class.{c}").alias(f"_{s}_{c}") for c in block], "class", "keys")
    sized = lambda df, s: placed(df, s).groupBy(*sides[s]).agg(F.sum(F.size("keys")).alias(f"_n_{s}"))
    further = [] if links is None else [c for c in links.columns if c not in (*sides["l"], *sides["r"])]
    if links is None:
        blocks = sized(a, "l").join(sized(b, "r"), [F.col(x) == F.col(y) for x, y in zip(sides["l"], sides["r"], strict=True)])
    else:
        blocks = links.join(sized(a, "l"), sides["l"]).join(sized(b, "r"), sides["r"])
    # two blocks that meet are a square of so many rows and columns of tasks
    blocks = blocks.withColumn("_pairs", F.col("_n_l").cast("double") * F.col("_n_r")).withColumn("_side", F.ceil(F.sqrt(F.col("_pairs") / TASK_PAIRS)).cast("int"))
    blocks = materialize(blocks.withColumn("_cell", F.monotonically_increasing_id()), "class-blocks")
    total = blocks.agg(F.sum("_pairs")).first()[0] or 0
    tasks = min(max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(3 * total / TASK_PAIRS)), MOST_TASKS)
    own, all_of = F.pmod(F.xxhash64("keys"), F.col("_side")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_side") - 1))
    at = ["_cell", "_row", "_column"]
    dealt = lambda df, s, *columns: placed(df, s).join(blocks.select(*sides[s], "_cell", "_side", *columns), sides[s])
    l = dealt(a, "l", *further).withColumn("_row", own).withColumn("_column", all_of).select(*at, F.col("class").alias("l"), F.col("keys").alias("_a"), *further)
    r = dealt(b, "r").withColumn("_column", own).withColumn("_row", all_of).select(*at, F.col("class").alias("r"), F.col("keys").alias("_b"))
    return l.repartition(tasks, *at).join(r.repartition(tasks, *at).hint("shuffle_hash"), at).select("l", "r", "_a", "_b", *further)


def each_two(met: DataFrame) -> DataFrame:
    """Rows with the keys _a and _b as a row (a, b, and the other columns) for each two of them. A compiled stage holds all rows that it makes of
    one: the coalesce, which joins no partitions, ends the first one, so that a task holds the pairs of one key at a time and not those of two classes."""
    further = [c for c in met.columns if c not in ("_a", "_b")]
    one = met.select(F.explode("_a").alias("a"), "_b", *further).coalesce(MOST_TASKS)
    return one.select("a", F.explode("_b").alias("b"), *further)


def represented(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Of classes of rows alike in all columns but the key: one row of each, with its smallest key, and the members (rep, cuts,
    keys), in rows of about CLASS_KEYS keys of which a class has `cuts`. Both are written."""
    chunks = materialize(members(rows, key), "members")
    reps = materialize(chunks.groupBy("class").agg(F.min(F.element_at("keys", 1)).alias(key), F.count("*").alias("cuts"), F.sum(F.size("keys")).alias("n")), "classes")
    of = reps.select(F.col("class").alias("_class"), F.col(key).alias("rep"), "cuts", "n")
    return reps.select(key, "class.*"), materialize(chunks.join(of, F.col("class").eqNullSafe(F.col("_class"))).select("rep", "cuts", "n", "keys"), "class-members")


def expanded(pairs: DataFrame, chunks: DataFrame, l: str, r: str, other: DataFrame | None = None, both: bool = False) -> DataFrame:
    """Pairs of classes (l, r: their smallest keys; with itself, a class once) as pairs of their members: the same columns, for each two keys the
    smaller as l. With `both`, pairs come in both orders, each for the keys that stand so; with `other`, r is of other members, and
    all pairs count. A large class is dealt to several tasks, and pairs of keys are made last, after all shuffles."""
    further = [c for c in pairs.columns if c not in (l, r)]
    theirs = chunks if other is None else other
    side = lambda df, c: df.select("rep", "cuts", "n").distinct().select(F.col("rep").alias(c), F.col("cuts").alias(f"_cuts_{c}"), F.col("n").alias(f"_n_{c}"))
    sized = materialize(pairs.join(side(chunks, l), l).join(side(theirs, r), r), "class-pairs")
    total = sized.agg(F.sum(F.col(f"_n_{l}").cast("double") * F.col(f"_n_{r}"))).first()[0] or 0
    tasks = min(max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(3 * total / TASK_PAIRS)), MOST_TASKS)
    mine = sized.join(chunks.select(F.col("rep").alias(l), F.col("keys").alias("_a")), l).withColumn("_deal", F.pmod(F.xxhash64("_a"), F.col(f"_cuts_{r}")))
    theirs = theirs.select(F.col("rep").alias(r), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("_deal"), F.col("keys").alias("_b"))
    met = mine.repartition(tasks, r, "_deal").join(theirs.repartition(tasks, r, "_deal").hint("shuffle_hash"), [r, "_deal"])
    two = each_two(met.select((F.col(l) == F.col(r)).alias("_same"), "_a", "_b", *further)).withColumnsRenamed({"a": "_x", "b": "_y"})
    if both or other is not None:
        return (two.filter("_x < _y") if other is None else two).select(F.col("_x").alias(l), F.col("_y").alias(r), *further)
    two = two.filter(~F.col("_same") | (F.col("_x") < F.col("_y")))
    return two.select(F.least("_x", "_y").alias(l), F.greatest("_x", "_y").alias(r), *further)


def for_each_class(rows: DataFrame, key: str, columns: list[str], match: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What match gives for one row of each class of rows alike in these columns, for all rows of the class."""
    reps, chunks = represented(rows.select(key, *columns), key)
    found = match(reps)
    return found.join(chunks.select(F.col("rep").alias(key), "keys"), key).select(*[F.explode("keys").alias(c) if c == key else c for c in found.columns])


def first_of_class(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The row of the smallest key of those alike in these columns: the only one that the best of candidates can be."""
    return materialize(rows.groupBy(*columns).agg(F.min(key).alias(key)), "class-firsts")


def similar_classes(rows: DataFrame, key: str, block: list[str], tokens: Column, score: Callable[[Column, Column], Column], least: float) -> tuple[DataFrame, DataFrame]:
    """(a, b, score) of classes of rows alike in all columns but the key, a class with itself included, and their members as of
    `represented`: classes of a block whose token sets have a Jaccard similarity of `least` or more, which `score` takes of two `tokens`."""
    reps, chunks = represented(rows, key)
    sets = reps.withColumn("_tokens", tokens)
    two = similar_pairs(sets, key, block, F.col("_tokens"), least).union(sets.filter(" AND ".join(["_tokens IS NOT NULL", *[f"{c} IS NOT NULL" for c in block]])).select(F.struct("*").alias("l"), F.struct("*").alias("r")))
    scored = two.select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"), score(F.col("l._tokens"), F.col("r._tokens")).alias("score"))
    return scored.filter(F.col("score") >= least), chunks


def similar_pairs(rows: DataFrame, key: str, block: list[str], tokens: Column, least: float) -> DataFrame:
    """Candidate pairs (structs l and r, smaller key first) of a block for a Jaccard similarity of at least `least` of token
    sets: sets that similar share one of their rarest n - ceil(least * n) + 1 tokens, so only those meet, and sets whose
    sizes rule it out do not. No pair that reaches the threshold is missed."""
    sets = rows.withColumn("_set", F.array_distinct(tokens)).filter(F.size("_set") > 0)
    each = sets.select(key, *block, F.size("_set").alias("_n"), F.explode("_set").alias("_token"))
    frequent = each.groupBy("_token").agg(F.count("*").alias("_df"))
    rare = each.join(frequent, "_token").groupBy(key, *block, "_n").agg(F.sort_array(F.collect_list(F.struct("_df", "_token"))).alias("_sorted"))
    prefix = (F.col("_n") - F.ceil(F.col("_n") * least - 1e-9) + 1).cast("int")
    heads = rare.select(key, *block, "_n", F.explode(F.slice("_sorted", 1, prefix)["_token"]).alias("_token"))
    other = heads.withColumnsRenamed({key: "_other", "_n": "_m"})
    fits = (F.col(key) < F.col("_other")) & (F.least("_n", "_m") >= F.greatest("_n", "_m") * least - 1e-9)
    pairs = heads.join(other, [*block, "_token"]).filter(fits).select(key, "_other").distinct()
    side = lambda name, by: rows.select(F.col(key).alias(by), F.struct("*").alias(name))
    return pairs.join(side("l", key), key).join(side("r", "_other"), "_other").select("l", "r")


def postings(df: DataFrame, key: str, tokens: Column, cap: int | None = None) -> DataFrame:
    """The inverted index (token, key), up to `cap` keys per token in key order where one is given."""
    rows = df.select(F.explode(F.array_distinct(tokens)).alias("token"), F.col(key))
    if cap is None:
        return rows
    w = Window.partitionBy("token").orderBy(key)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")


def shared_token_pairs(left: DataFrame, right: DataFrame, l_key: str, r_key: str, least: int = 1) -> DataFrame:
    """(l_key, r_key, shared) from two posting tables with at least so many tokens in common."""
    return left.join(right, "token").groupBy(l_key, r_key).agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def inverse_frequencies(index: DataFrame, key: str, n_docs: Column | int) -> DataFrame:
    """(token, df, idf) with idf = ln((N+1)/(df+1)) + 1; index has one row per token and key."""
    return index.groupBy("token").agg(F.count(key).alias("df")).withColumn("idf", F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1)


def token_counts(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, token, n): how often each row holds each token."""
    return df.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def tfidf_weights(df: DataFrame, key: str, tokens: Column, idf: DataFrame) -> DataFrame:
    """(key, token, weight) with tf = 1 + ln(count), scaled to unit length."""
    return weighted(token_counts(df, key, tokens), key, idf)


def weighted(counts: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """(key, token, weight) from token counts, scaled to unit length."""
    raw = counts.join(idf, "token").withColumn("w", (1 + F.log("n")) * F.col("idf"))
    norms = materialize(raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "norms")
    return raw.join(norms, key).select(key, "token", (F.col("w") / F.col("norm")).alias("weight"))


#: Tokens that are looked up by broadcast where they are frequent, at most.
OFTEN = 100_000


def counted_tokens(df: DataFrame, key: str, tokens: Callable[[DataFrame], Column]) -> DataFrame:
    """token_counts of large tables: rows are dealt by key to small tasks, so that texts are shuffled and not their tokens. Written."""
    session = df.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, 4 * df.rdd.getNumPartitions())
    dealt = df.repartition(tasks, key)
    return materialize(token_counts(dealt, key, tokens(dealt)), "token-counts")


def token_norms(counts: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """(key, norm) of token counts weighed by idf (token, df, idf). Frequent tokens, of which there are at most OFTEN, are looked up where the
    counts lie; only the rows of others are shuffled. Written."""
    total = idf.agg(F.sum("df")).first()[0] or 0
    often = materialize(idf.filter(F.col("df") * OFTEN >= total).select("token", F.col("idf").alias("_idf")), "often")
    found = counts.join(F.broadcast(often), "token", "left")
    square = lambda w: ((1 + F.log("n")) * w * (1 + F.log("n")) * w).alias("_square")
    squares = found.filter("_idf IS NOT NULL").select(key, square(F.col("_idf")))
    rest = found.filter("_idf IS NULL").select(key, "token", "n").join(idf.filter(F.col("df") * OFTEN < total).select("token", "idf"), "token").select(key, square(F.col("idf")))
    return materialize(squares.unionByName(rest).groupBy(key).agg(F.sqrt(F.sum("_square")).alias("norm")), "norms")


def cosine_pairs(left: DataFrame, right: DataFrame, l_key: str, r_key: str) -> DataFrame:
    """(l_key, r_key, cosine) of all pairs with a token in common, from weight tables."""
    other = right.select(F.col(r_key).alias("_r"), "token", F.col("weight").alias("_w"))
    return left.join(other, "token").groupBy(l_key, F.col("_r").alias(r_key)).agg(F.sum(F.col("weight") * F.col("_w")).alias("cosine"))


def best_candidate(pairs: DataFrame, probe: str, candidate: str, score: str) -> DataFrame:
    """The best candidate of each probe by a partial aggregate; the smallest among equals, one without a score last."""
    rest = [c for c in pairs.columns if c not in (probe, candidate)]
    order = F.struct(F.col(score).isNull().alias("_none"), (-F.col(score)).alias("_low"), F.col(candidate), *rest)
    return pairs.groupBy(probe).agg(F.min(order).alias("_b")).select(*[F.col(c) if c == probe else F.col(f"_b.{c}") for c in pairs.columns])


def mutual_best(pairs: DataFrame, a: str, b: str, score: str, least: float) -> DataFrame:
    """Pairs (a, b, score) in which either side is the other's best and the score reaches `least`. Every pair is
    seen from both sides by one partial aggregate, so nothing is sorted and pairs are made once."""
    view = lambda side, own, other: F.struct(F.lit(side).alias("side"), F.col(own).alias("own"), F.struct((-F.col(score)).alias("low"), F.col(other).alias("other")).alias("best"))
    both = pairs.filter(F.col(score).isNotNull()).select(F.explode(F.array(view("a", a, b), view("b", b, a))).alias("v")).groupBy("v.side", "v.own").agg(F.min("v.best").alias("best"))
    mine = both.filter("side = 'a'").select(F.col("own").alias(a), F.col("best.other").alias(b), (-F.col("best.low")).alias(score))
    theirs = both.filter("side = 'b'").select(F.col("best.other").alias(a), F.col("own").alias(b))
    return mine.join(theirs, [a, b]).filter(F.col(score) >= least)


def exact_groups(products: DataFrame, key: list[Column], store: str, product: str) -> DataFrame:
    """Products of several stores with the same composite key: the key, stores, and the first product of each."""
    named = [k.alias(f"k{i}") for i, k in enumerate(key)]
    keys = [f"k{i}" for i in range(len(key))]
    firsts = products.select(*named, store, product).dropna(subset=keys).groupBy(*keys, store).agg(F.min(product).alias("first"))
    grouped = firsts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(store, "first"))).alias("m"))
    return grouped.filter(F.size("m") >= 2).select(*keys, F.array_join(F.col(f"m.{store}"), ",").alias("stores"), F.array_join(F.transform("m.first", lambda x: x.cast("string")), ",").alias("products"))


@dataclass(frozen=True)
class MatchRules:
    """Fixed values of the scored matcher."""

    threshold: float = 0.5
    brand_boost: float = 0.15
    cpg_boost: float = 0.10
    cpg: tuple[str, ...] = ("personal_care", "household", "laundry", "dishwasher", "deodorant", "lip_care")
    unknown_brand: float = 0.85
    same_size: float = 0.05
    wrong_size_same_brand: float = 0.7
    wrong_size: float = 0.4
    same_category: float = 0.12
    other_category: float = 0.06
    category_penalty: float = 0.85
    rescue_trigram: float = 0.65
    rescue_base: float = 0.3

    @property
    def least_base(self) -> float:
        """Below this blend no rule keeps a pair."""
        return self.threshold * 0.6


def matcher_score(pairs: DataFrame, rule: MatchRules | None = None) -> DataFrame:
    """Scores pairs of structs l and r (free, brand, category, amount, types) with their trigram and base, as
    candidates.blended_pairs gives them for rule.least_base. Adds brand_class, quantity_class and score; pairs that a rule drops are gone."""
    rule = rule or MatchRules()
    c = F.col
    scored = pairs.withColumn("brand_class", similarity.brand_class(c("l.brand"), c("r.brand"))).withColumn("quantity_class", quantity.amounts_class(c("l.amount"), c("r.amount")))
    match = c("brand_class") == "match"
    scored = scored.filter((c("brand_class") != "reject") & (c("base") >= F.when(match, rule.least_base).otherwise(rule.threshold * 0.7)))
    scored = scored.filter(~(match & rules.types_conflict(c("l.types"), c("r.types"))))
    scored = scored.filter(~(match & ~F.coalesce(F.arrays_overlap("l.free", "r.free"), F.lit(False)) & (c("base") < 0.35)))
    cpg = c("l.category").isin(*rule.cpg) | c("r.category").isin(*rule.cpg)
    same = c("l.category").eqNullSafe(c("r.category"))
    # every step takes the score before it once, times one number, plus another, and holds it at 1 where it adds: so the
    # expression stays small enough to be compiled wherever the optimizer puts it
    brand = c("brand_class")
    held = lambda x, when: F.least(x, F.when(when, 1.0).otherwise(float("inf")))
    one_unknown = F.when(brand == "one_unknown", rule.unknown_brand).otherwise(1.0)
    s = held(c("base") * one_unknown + F.when(match, F.lit(rule.brand_boost)).otherwise(0.0) + F.when(match & cpg, rule.cpg_boost).otherwise(0.0), match)
    same_size = c("quantity_class") == "same_size"
    wrong_size = F.when(c("quantity_class") == "incompatible", F.when(match, rule.wrong_size_same_brand).otherwise(rule.wrong_size)).otherwise(1.0)
    s = held(s * wrong_size + F.when(same_size, rule.same_size).otherwise(0.0), same_size)
    s = held(s + F.when(match, F.when(same, rule.same_category).otherwise(rule.other_category)).otherwise(0.0), match)
    s = s * F.when(same, 1.0).otherwise(rule.category_penalty)
    rescue = (c("trigram") >= rule.rescue_trigram) & (c("base") >= rule.rescue_base)
    # a pair to be rescued passes at any score; the others by their own
    scored = scored.withColumn("s", s).filter(rescue | (c("s") >= rule.threshold))
    return scored.withColumn("score", F.when(c("s") < rule.threshold, rule.threshold + 0.01).otherwise(c("s"))).drop("s")


def first_and_count(rows: DataFrame, block: list[str], key: str, size: str, fits: Callable[[Column, Column], Column]) -> DataFrame:
    """(a, b, n): of each key, the smallest other key of its block whose size fits its own, and how many rows have one. Sizes
    of a block are compared once: each brings its two smallest keys, of which one is another's, and its rows."""
    rows = rows.select(*block, F.col(key).alias("a"), F.col(size).alias("_x")).dropna()
    # a key may have several rows, which are none of its others
    own = rows.groupBy("a", *block).agg(F.collect_list("_x").alias("_own"))
    least = rows.groupBy(*block, "_x").agg(F.min("a").alias("_low"), F.count("*").alias("_n"))
    second = rows.join(least.select(*block, "_x", "_low"), [*block, "_x"]).filter("a > _low").groupBy(*block, "_x").agg(F.min("a").alias("_next"))
    offered = materialize(least.join(second, [*block, "_x"], "left"), "sizes")
    met = offered.select(*block, "_x").join(offered.withColumnRenamed("_x", "_y"), block).filter(fits(F.col("_x"), F.col("_y")))
    low = met.groupBy(*block, "_x").agg(F.sum("_n").alias("_n"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array("_low", "_next")))))), 1, 2).alias("_keys"))
    each = own.select("a", *block, "_own", F.explode("_own").alias("_x")).join(low, [*block, "_x"])
    found = each.select("a", F.get(F.filter("_keys", lambda k: k != F.col("a")), F.lit(0)).alias("b"), (F.col("_n") - F.size(F.filter("_own", lambda y: fits(F.col("_x"), y)))).alias("n"))
    return found.filter("n > 0").groupBy("a").agg(F.min("b").alias("b"), F.sum("n").alias("n"))


def attribute_tier(brand_a, brand_b, type_a, type_b, size_a, size_b) -> Column:
    """.95 brand, type and size; .80 brand and type; .65 type and size; .50 type; else null."""
    brand, kind, size = brand_a == brand_b, type_a == type_b, quantity.within_share(size_a, size_b)
    return F.when(brand & kind & size, 0.95).when(brand & kind, 0.80).when(kind & size, 0.65).when(kind, 0.50)


def tier_counts(products: DataFrame) -> DataFrame:
    """(tier, n_pairs) of the pairs of products of one type and name. Products alike in brand and size too are paired once and counted."""
    classes = products.groupBy("type", "name", "brand", "size").agg(F.count("*").alias("n"))
    l, r = (classes.select(F.col("type").alias(f"_t{s}"), F.col("name").alias(f"_n{s}"), F.struct("*").alias(s)) for s in "lr")
    pairs = l.join(r, (F.col("_tl") == F.col("_tr")) & (F.col("_nl") == F.col("_nr")))
    tier = attribute_tier(F.col("l.brand"), F.col("r.brand"), F.col("l.type"), F.col("r.type"), F.col("l.size"), F.col("r.size"))
    # both orders are made, and a product is no pair with itself
    twice = F.col("l.n") * (F.col("r.n") - F.col("l").eqNullSafe(F.col("r")).cast("int"))
    return pairs.groupBy(tier.alias("tier")).agg((F.sum(twice) / 2).cast("long").alias("n_pairs")).filter("n_pairs > 0")


#: How many rows of a token, a brand, and a token of the last step the short form of fast_match takes.
FAST_CAPS = {"token_cap": 100, "brand_cap": 50, "spelling_cap": 30}
#: How many rows of a brand and of a token the short form of multi_pass_match takes.
MULTI_PASS_CAPS = {"brand_cap": 100, "token_cap": 50}


def fast_match(products: DataFrame, catalogue: DataFrame, least: float = 0.40, token_cap: int | None = None, brand_cap: int | None = None, spelling_cap: int | None = None) -> DataFrame:
    """products (id, name, barcode, size, maybe brand), catalogue (off_id, off_name, off_barcode, off_size, maybe
    off_brand): barcode first; else shared tokens, .6 Jaccard + .3 hits per token + .15 for close sizes, confidence
    score + .2 up to .95. A brand inside the other or of ratio above .7 proposes its rows and adds two hits.
    What is left goes by spelling: .8 times sequence ratio with the rows of each of its first three tokens. Caps, where given, take
    only the first rows of each token, brand, and token of the last step (FAST_CAPS are those of the short form)."""
    codes = catalogue.filter("off_barcode is not null").groupBy("off_barcode").agg(F.min("off_id").alias("off_id"))
    by_code = products.join(codes, products.barcode == codes.off_barcode).select("id", "off_id", F.lit(1.0).alias("confidence"), F.lit("barcode").alias("method"))
    rest = products.join(by_code, "id", "left_anti")
    mine, theirs = (["name", "size", "brand"], ["off_name", "off_size", "off_brand"]) if "brand" in products.columns and "off_brand" in catalogue.columns else (["name", "size"], ["off_name", "off_size"])
    if token_cap is brand_cap is spelling_cap is None:
        firsts = first_of_class(catalogue, "off_id", theirs)
        return by_code.unionByName(for_each_class(rest, "id", mine, lambda p: _fast_whole(p, firsts, least)))
    return by_code.unionByName(for_each_class(rest, "id", mine, lambda p: _fast_rest(p, catalogue, least, token_cap, brand_cap, spelling_cap)))


def _fast_score(jaccard: Column, shared: Column, n: Column, close: Column) -> Column:
    return 0.6 * jaccard + 0.3 * shared / n + F.when(close, 0.15).otherwise(0.0)


def _close_sizes() -> Column:
    return F.coalesce(F.least("size", "off_size") / F.greatest("size", "off_size") > 0.8, F.lit(False))


def _fast_whole(rest: DataFrame, catalogue: DataFrame, least: float) -> DataFrame:
    """fast_match, without caps, of distinct products without a barcode that is known. A score depends on the two names, on whether the brands are
    close and on whether the sizes are: names are compared once, and of the catalogue rows of a name only the first for each answer meets a product."""
    tokens = lambda name: F.array_distinct(text.words(text.normal_name(F.col(name)), 2))
    of = lambda df, c: text.normal_name(F.col(c)) if c in df.columns else F.lit(None).cast("string")
    p = materialize(rest.select("id", "name", "size", of(rest, "brand").alias("_b")), "fast-products")
    o = materialize(catalogue.select("off_id", "off_name", "off_size", of(catalogue, "off_brand").alias("_token")), "fast-catalogue")
    mine, theirs = (materialize(df.select(c).distinct().withColumn(t, tokens(c)), "fast-names") for df, c, t in ((p, "name", "t"), (o, "off_name", "o")))
    shared = shared_token_pairs(postings(mine, "name", F.col("t")), postings(theirs, "off_name", F.col("o")), "name", "off_name")
    named = shared.join(mine, "name").join(theirs, "off_name").select("name", "off_name", "shared", similarity.jaccard(F.col("t"), F.col("o")).alias("_jaccard"), F.size("t").alias("_n"))
    named = materialize(named, "fast-pairs")
    brands = [df.select(c).distinct().filter(F.length(c) > 0) for df, c in ((p, "_b"), (o, "_token"))]
    alike = materialize(containing_pairs(*brands, "_b", "_token").union(alike_pairs(*brands, "_b", "_token", 0.7)).distinct().withColumn("_like", F.lit(True)), "fast-brands")
    # the first row of a catalogue name for each answer, of the names, brands and sizes that are asked for; brands and sizes may be missing
    asked = materialize(named.select("name", "off_name").join(p.select("name", "_b", "size").distinct(), "name").select("off_name", F.struct("_b").alias("_of"), F.struct("size").alias("_at")).distinct(), "fast-asked")
    sized = asked.select("off_name", "_at", "_at.size").distinct().join(o, "off_name").groupBy("off_name", "_at", "_token", _close_sizes().alias("_close")).agg(F.min("off_id").alias("off_id"))
    met = asked.select("*", "_of._b").join(sized, ["off_name", "_at"]).join(alike, ["_b", "_token"], "left").withColumn("_like", F.coalesce("_like", F.lit(False)))
    first = met.groupBy("off_name", "_of", "_at", "_like", "_close").agg(F.min("off_id").alias("off_id"))
    wanted = p.select("id", "name", F.struct("_b").alias("_of"), F.struct("size").alias("_at"))
    by_name = wanted.join(named, "name").join(first, ["off_name", "_of", "_at"])
    by_name = by_name.select("id", "off_id", _fast_score(F.col("_jaccard"), F.col("shared") + F.when(F.col("_like"), 2).otherwise(0), F.col("_n"), F.col("_close")).alias("score"))
    # rows of a close brand, as if no token were shared: those that share some are above with a better score
    offered = o.groupBy("_token", "off_size").agg(F.min("off_id").alias("off_id"))
    close = p.select("_b", "size").distinct().join(alike, "_b").join(offered, "_token").groupBy("_b", F.struct("size").alias("_at"), _close_sizes().alias("_close")).agg(F.min("off_id").alias("off_id"))
    sizes = mine.select("name", F.size("t").alias("_n")).filter("_n > 0")
    by_brand = wanted.select("id", "name", "_of._b", "_at").join(sizes, "name").join(close, ["_b", "_at"]).select("id", "off_id", _fast_score(F.lit(0.0), F.lit(2), F.col("_n"), F.col("_close")).alias("score"))
    ranked = best_candidate(by_name.union(by_brand), "id", "off_id", "score").withColumn("confidence", F.least(F.col("score") + 0.2, F.lit(0.95)))
    by_token = materialize(ranked.filter(F.col("confidence") >= least).select("id", "off_id", "confidence", F.lit("token").alias("method")), "fast-found")
    left = materialize(p.join(by_token, "id", "left_anti").join(mine, "name").filter(F.size("t") >= 2).select("id", "name", "t"), "fast-left")
    near = shared_token_pairs(postings(left.select("name", "t").distinct(), "name", F.slice("t", 1, 3)), postings(theirs, "off_name", F.col("o")), "name", "off_name")
    ratio = similarity.sequence_ratio(text.normal_name(F.col("name")), text.normal_name(F.col("off_name")))
    spelt = near.select("name", "off_name", (ratio * 0.8).alias("confidence")).join(o.groupBy("off_name").agg(F.min("off_id").alias("off_id")), "off_name")
    by_spelling = best_candidate(spelt.select("name", "off_id", "confidence"), "name", "off_id", "confidence").filter(F.col("confidence") >= least)
    return by_token.unionByName(left.select("id", "name").join(by_spelling, "name").select("id", "off_id", "confidence", F.lit("fuzzy").alias("method")))


def _fast_rest(rest: DataFrame, catalogue: DataFrame, least: float, token_cap: int | None, brand_cap: int | None, spelling_cap: int | None) -> DataFrame:
    """fast_match, with caps, of products without a barcode that is known."""
    tokens = lambda name: text.words(text.normal_name(F.col(name)), 2)
    shared = shared_token_pairs(postings(rest, "id", tokens("name")), postings(catalogue, "off_id", tokens("off_name"), token_cap), "id", "off_id")
    if "brand" in rest.columns and "off_brand" in catalogue.columns:
        hits = shared.unionByName(_brand_hits(rest.filter(F.size(tokens("name")) > 0), catalogue, brand_cap))
        shared = hits.groupBy("id", "off_id").agg(F.sum("shared").alias("shared"))
    full = shared.join(rest.select("id", "size", tokens("name").alias("t")), "id").join(catalogue.select("off_id", "off_size", tokens("off_name").alias("o")), "off_id")
    score = _fast_score(similarity.jaccard(F.array_distinct("t"), F.array_distinct("o")), F.col("shared"), F.size(F.array_distinct("t")), _close_sizes())
    ranked = best_candidate(full.select("id", "off_id", score.alias("score")), "id", "off_id", "score").withColumn("confidence", F.least(F.col("score") + 0.2, F.lit(0.95)))
    by_token = ranked.filter(F.col("confidence") >= least).select("id", "off_id", "confidence", F.lit("token").alias("method"))
    left = rest.join(by_token, "id", "left_anti").withColumn("t", F.array_distinct(tokens("name"))).filter(F.size("t") >= 2)
    near = shared_token_pairs(postings(left, "id", F.slice("t", 1, 3)), postings(catalogue, "off_id", tokens("off_name"), spelling_cap), "id", "off_id")
    ratio = similarity.sequence_ratio(text.normal_name(F.col("name")), text.normal_name(F.col("off_name")))
    spelt = near.join(left.select("id", "name"), "id").join(catalogue.select("off_id", "off_name"), "off_id").select("id", "off_id", (ratio * 0.8).alias("confidence"))
    by_spelling = best_candidate(spelt, "id", "off_id", "confidence").filter(F.col("confidence") >= least)
    return by_token.unionByName(by_spelling.select("id", "off_id", "confidence", F.lit("fuzzy").alias("method")))


def containing_pairs(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (a, b) of which one holds the other, both not empty. A text that stands in another has its first (up to)
    three letters there, so pairs meet by equality on them and are then checked: no pair is missed, none is made in vain by a product."""
    shorter = lambda df, c: df.select(c).filter(F.length(c) > 0).distinct().withColumn("_gram", F.substring(c, 1, 3))
    grams = F.flatten(F.array(*[text.ngrams(F.col("_t"), n) for n in (1, 2, 3)]))
    longer = lambda df, c: df.select(c).filter(F.length(c) > 0).distinct().withColumn("_t", F.col(c)).withColumn("_gram", F.explode(grams)).drop("_t")
    one = shorter(left, a).join(longer(right, b), "_gram").filter(F.contains(b, a)).select(a, b)
    other = longer(left, a).join(shorter(right, b), "_gram").filter(F.contains(a, b)).select(a, b)
    return one.union(other).distinct()


def alike_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """Distinct (a, b), both not empty, whose sequence ratio is over `least`."""
    return spelling.spelt_pairs(left, right, a, b, least).filter(F.col("ratio") > least).select(a, b)


def _brand_hits(products: DataFrame, catalogue: DataFrame, cap: int | None, least: float = 0.7) -> DataFrame:
    """(id, off_id, shared = 2) for the rows, or the first `cap`, of every catalogue brand that is close to the product's."""
    mine = products.select("id", text.normal_name(F.col("brand")).alias("b")).filter(F.length("b") > 0)
    theirs = postings(catalogue, "off_id", F.array(text.normal_name(F.col("off_brand"))), cap).filter(F.length("token") > 0)
    alike = containing_pairs(mine, theirs, "b", "token").union(alike_pairs(mine, theirs, "b", "token", least)).distinct()
    return mine.join(alike, "b").join(theirs, "token").select("id", "off_id", F.lit(2).cast("long").alias("shared"))


def multi_pass_match(products: DataFrame, catalogue: DataFrame, least: float = 0.55, brand_cap: int | None = None, token_cap: int | None = None) -> DataFrame:
    """products (id, name, brand, size), catalogue (off_id, off_name, off_brand, off_size): score .40 brand (same 1, inside
    .8, else half the ratio) + .35 name + .25 size (same 1, within a tenth .9, within three tenths .5). Pass 1 takes
    candidates of the same brand and size, pass 2 those (or the first `brand_cap`) of the brand, pass 3 those with two tokens in
    common (among the first `token_cap` of each); a product that a pass settles (.70) leaves the next ones."""
    if brand_cap is token_cap is None:
        catalogue = first_of_class(catalogue, "off_id", ["off_name", "off_brand", "off_size"])
    return for_each_class(products, "id", ["name", "brand", "size"], lambda p: _multi_pass(p, catalogue, least, brand_cap, token_cap))


def _multi_pass(products: DataFrame, catalogue: DataFrame, least: float, brand_cap: int | None, token_cap: int | None) -> DataFrame:
    """multi_pass_match of distinct products."""
    tokens = lambda name: F.array_distinct(text.words(text.normal_name(F.col(name)), 1))
    p = products.withColumn("t", tokens("name"))
    o = catalogue.withColumn("o", tokens("off_name"))
    brand = F.when(F.col("brand") == F.col("off_brand"), 1.0).when(F.contains("brand", "off_brand") | F.contains("off_brand", "brand"), 0.8).otherwise(0.5 * similarity.sequence_ratio(F.col("brand"), F.col("off_brand")))
    brand = F.when(F.col("brand").isNotNull() & F.col("off_brand").isNotNull(), brand).otherwise(0.0)
    name = 0.6 * similarity.overlap(F.col("t"), F.col("o")) + 0.4 * similarity.sequence_ratio(F.col("name"), F.col("off_name"))
    apart = F.abs(F.col("size") - F.col("off_size")) / F.greatest("size", "off_size")
    size = F.when(F.col("size") == F.col("off_size"), 1.0).when(apart < 0.1, 0.9).when(apart < 0.3, 0.5).otherwise(0.0)
    score = 0.40 * brand + 0.35 * name + 0.25 * size

    def settle(pairs: DataFrame, number: int, bonus: float) -> DataFrame:
        best = best_candidate(pairs.select("id", "off_id", score.alias("score")), "id", "off_id", "score").filter("score >= 0.70")
        confidence = F.least(F.col("score") + bonus, F.lit(0.95)) if bonus else F.col("score")
        return best.select("id", "off_id", confidence.alias("confidence"), F.lit(number).alias("pass"))

    first = settle(p.join(o, (F.col("brand") == F.col("off_brand")) & (F.col("size") == F.col("off_size"))), 1, 0.1)
    left = p.join(first, "id", "left_anti")
    branded = postings(o.filter("off_brand is not null"), "off_id", F.array("off_brand"), brand_cap).withColumnRenamed("token", "brand")
    second = settle(left.join(branded, "brand").join(o, "off_id"), 2, 0.0)
    left = left.join(second, "id", "left_anti")
    shared = shared_token_pairs(postings(left, "id", F.col("t")), postings(o, "off_id", F.col("o"), token_cap), "id", "off_id", 2)
    third = settle(shared.join(left, "id").join(o, "off_id"), 3, 0.0)
    return first.unionByName(second).unionByName(third).filter(F.col("confidence") >= least)


def _priced_pairs(products: DataFrame, name: Column, least: float, classed: dict[str, Column], keyed: dict[str, Column], free: Column, theirs: list[str], also: Column | None = None) -> DataFrame:
    """Pairs of keys a and b, in both orders, with the ratio: products of one category and different stores, prices positive, whose names have the
    sequence ratio `least` and whose quantities are within a fifth, unless `free` of it. free sees classes l and r of products alike in store,
    category, name, _unit, _known (quantity and unit are) and `classed`; `also` is a further condition on them. Keys are structs of id, price, _value and `keyed` (of b `theirs`): what
    tells nearly all products apart is left to pairs of keys, so that classes stay few. Ratios are taken once for two names of a category."""
    amount, known = quantity.amount(F.col("quantity"), F.col("unit")), F.coalesce((F.col("quantity") > 0) & (F.length("unit") > 0), F.lit(False))
    key = F.struct("id", "price", amount["value"].alias("_value"), *[c.alias(n) for n, c in keyed.items()])
    rows = products.filter("price > 0").select("store", "category", name.alias("_name"), amount["unit"].alias("_unit"), known.alias("_known"), *[c.alias(n) for n, c in classed.items()], key.alias("key"))
    classes = materialize(members(rows, "key"), "priced")
    other = classes.withColumn("keys", F.transform("keys", lambda k: F.struct(*[k[c].alias(c) for c in theirs])))
    names = materialize(classes.select("class.category", "class._name").distinct(), "priced-names")
    side = lambda c: names.select("category", F.col("_name").alias(c))
    empty = names.filter("_name = ''").select("category", F.col("_name").alias("_a"), F.col("_name").alias("_b"), F.lit(1.0).alias("ratio"))
    alike = spelling.spelt_pairs(side("_a"), side("_b"), "_a", "_b", least, ["category"]).unionByName(empty)
    links = materialize(alike.select(F.col("category").alias("_l_category"), F.col("_a").alias("_l__name"), F.col("category").alias("_r_category"), F.col("_b").alias("_r__name"), "ratio"), "priced-links")
    met = classes_met(classes, other, ["category", "_name"], links).filter(F.col("l.store") != F.col("r.store"))
    met = met if also is None else met.filter(also)
    same_unit = F.col("l._known") & F.col("r._known") & F.coalesce(F.col("l._unit") == F.col("r._unit"), F.lit(False))
    pairs = each_two(met.filter(free | same_unit).select("_a", "_b", "ratio", free.alias("_free")))
    return pairs.filter((F.col("a.id") < F.col("b.id")) & (F.col("_free") | (F.col("a._value") / F.col("b._value")).between(0.8, 1.2))).drop("_free")


def _near_prices(pairs: DataFrame, most_apart: float) -> DataFrame:
    """Pairs of keys a and b whose prices are at most so many percent apart, with savings_pct."""
    low, high = F.least("a.price", "b.price"), F.greatest("a.price", "b.price")
    return pairs.filter((high - low) / low * 100 <= most_apart).withColumn("savings_pct", _tenths((high - low) / high * 100))


def _tenths(share: Column) -> Column:
    """F.round(share, 1) of numbers from 0 to 100. Only what lies near the middle of two tenths is rounded by its decimals, which takes much longer."""
    tenfold = share * 10
    return F.when(F.abs(tenfold - F.floor(tenfold) - 0.5) > 1e-6, F.floor(tenfold + 0.5) / 10).otherwise(F.round(share, 1))


def ratio_match(products: DataFrame, least: float = 0.7, most_apart: float = 200.0, other: str = "other") -> DataFrame:
    """products (id, store, category, name, quantity, unit, price): pairs of a category (but `other`) of different stores whose
    names have the sequence ratio, whose quantities are within a fifth (or unknown), and whose prices are near. Gives a, b, score, savings_pct."""
    free = ~(F.col("l._known") & F.col("r._known"))
    pairs = _priced_pairs(products.filter(F.col("category") != other), F.lower(F.coalesce("name", F.lit(""))), least, {}, {}, free, ["id", "price", "_value"])
    return _near_prices(pairs, most_apart).select("a.id", "b.id", "ratio", "savings_pct").toDF("a", "b", "score", "savings_pct")


def sign_match(products: DataFrame, signs: list[str], least: float = 0.65, most_apart: float = 150.0, other: str = "other") -> DataFrame:
    """products (id, store, category, name, brand, quantity, unit, price): names of three letters with equal size signs; both
    per kilogram, or quantities that agree (of a missing one only outside `other`); then .3 brand + .7 name ratio (from .85 and
    .55 on), else the name ratio from `least` on. Gives a, b, score, method, savings_pct."""
    classed = {
        "_kilo": quantity.per_kilo(F.col("name"), F.col("quantity"), quantity.unit_name(F.col("unit"))),
        "_signs": F.filter(F.array(*[F.when(F.contains(F.lower("name"), F.lit(x)), F.lit(x)) for x in sorted(signs)]), lambda x: x.isNotNull()),
    }
    rows = products.filter(F.length("name") >= 3).withColumn("_brand", rules.known_brand(F.col("brand")))
    brands = materialize(rows.select("_brand").dropna().distinct().withColumn("_number", F.monotonically_increasing_id()), "brands")
    # of each brand, the ratios of those from .85 on by their numbers
    named = lambda c, n: brands.select(F.col("_brand").alias(c), F.col("_number").alias(n))
    alike = spelling.spelt_pairs(named("_x", "_n"), named("_y", "_m"), "_x", "_y", 0.85)
    close = alike.join(named("_y", "_m"), "_y").groupBy("_x").agg(F.collect_list(F.struct("_m", "ratio")).alias("_close"))
    rows = rows.join(brands.join(close, F.col("_brand") == F.col("_x"), "left").drop("_x"), "_brand", "left")
    kilo, known = ([F.col(f"{s}.{c}") for s in "lr"] for c in ("_kilo", "_known"))
    free = (kilo[0] & kilo[1]) | (~known[0] & ~known[1]) | ((known[0] != known[1]) & (F.col("l.category") != other))
    keyed = {"brand": F.col("_number"), "close": F.col("_close._m"), "ratios": F.col("_close.ratio")}
    pairs = _priced_pairs(rows, text.normal_name(F.col("name")), min(0.55, least), classed, keyed, free, ["id", "price", "_value", "brand"], F.col("l._signs") == F.col("r._signs"))
    m = F.get("a.ratios", (F.array_position("a.close", F.col("b.brand")) - 1).cast("int"))
    both = m.isNotNull() & (F.col("ratio") >= 0.55)
    score = F.when(both, 0.3 * m + 0.7 * F.col("ratio")).when(F.col("ratio") >= least, F.col("ratio"))
    found = _near_prices(pairs.filter((F.col("ratio") >= least) | both), most_apart)
    return found.select("a.id", "b.id", score, F.when(both, "brand+name").otherwise("name_only"), "savings_pct").toDF("a", "b", "score", "method", "savings_pct")


def offline_match(products: DataFrame, catalogue: DataFrame, least: float = 0.6, first: int | None = None) -> DataFrame:
    """products (id, name, brand), catalogue (off_id, off_name, off_brand): .5 for a brand inside the other (.4 for a ratio over
    .8) + .3 word overlap + .2 sequence ratio. Candidates share a brand word of three letters; a product without any takes the
    catalogue (or its `first` rows), of which only those of a close brand can reach `least`."""
    if first is None:
        catalogue = first_of_class(catalogue, "off_id", ["off_name", "off_brand"])
    return for_each_class(products, "id", ["name", "brand"], lambda p: _offline(p, catalogue, least, first))


def _offline(products: DataFrame, catalogue: DataFrame, least: float, first: int | None) -> DataFrame:
    """offline_match of distinct products."""
    brand = lambda c: F.nullif(F.replace(F.lower(F.col(c)), F.lit("-"), F.lit(" ")), F.lit(""))
    parts = lambda c: F.filter(F.split(F.lower(F.col(c)), r"\s+"), lambda w: F.length(w) > 2)
    p, o = products.withColumn("b", brand("brand")), catalogue.withColumn("ob", brand("off_brand"))
    by_word = shared_token_pairs(postings(p, "id", parts("brand")), postings(o, "off_id", parts("off_brand")), "id", "off_id").select("id", "off_id")
    rest = p.join(by_word, "id", "left_anti").filter("b is not null")
    head = (o if first is None else o.orderBy("off_id").limit(first)).filter("ob is not null")
    near = containing_pairs(rest, head, "b", "ob").union(alike_pairs(rest, head, "b", "ob", 0.8)).distinct()
    by_brand = rest.join(near, "b").join(head, "ob").select("id", "off_id")
    inside = F.contains("ob", "b") | F.contains("b", "ob")
    close = F.when(inside, 0.5).when(similarity.sequence_ratio(F.col("b"), F.col("ob")) > 0.8, 0.4).otherwise(0.0)
    n, m = text.normal_name(F.col("name")), text.normal_name(F.col("off_name"))
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) > 0))
    pairs = by_word.union(by_brand).join(p, "id").join(o, "off_id")
    score = F.coalesce(close, F.lit(0.0)) + 0.3 * similarity.overlap(words(n), words(m)) + 0.2 * similarity.sequence_ratio(n, m)
    best = best_candidate(pairs.select("id", "off_id", F.least(score, F.lit(1.0)).alias("confidence")), "id", "off_id", "confidence")
    return best.filter(F.col("confidence") >= least)


def with_tiers(matches: DataFrame, score: str, tiers: list[tuple[float, str]]) -> DataFrame:
    """matches that reach the lowest tier, with the name of the highest they reach; tiers from the highest down."""
    name = F.coalesce(*[F.when(F.col(score) >= low, F.lit(tier)) for low, tier in tiers])
    return matches.withColumn("tier", name).filter("tier is not null")


def match_key(brand: Column, kind: Column, size: Column, variants: Column) -> Column:
    """brand:type:size:variants, null where brand or type is missing."""
    parts = [F.lower(brand), kind, F.coalesce(size.cast("string"), F.lit("")), F.array_join(F.array_sort(variants), "+")]
    return F.when(brand.isNotNull() & kind.isNotNull(), F.concat_ws(":", *parts))


def like_prices(rows: DataFrame, block: list[str], price: str, most_ratio: float) -> DataFrame:
    """rows with the smallest price of their block in place of theirs, where no two prices of it are further apart than the ratio: to strict_match,
    which asks for no more, they are alike. Prices that are missing or not positive stay."""
    paid = F.when(F.col(price) > 0, F.col(price))
    near = rows.groupBy(*block).agg(F.min(paid).alias("_low"), F.max(paid).alias("_high")).filter(F.col("_high") / F.col("_low") <= most_ratio)
    near = near.select(*[F.col(c).alias(f"_{c}") for c in block], "_low")
    found = rows.join(near, [F.col(c) == F.col(f"_{c}") for c in block], "left")
    return found.withColumn(price, F.when((F.col(price) > 0) & F.col("_low").isNotNull(), F.col("_low")).otherwise(F.col(price))).select(*rows.columns)


def strict_match(pairs: DataFrame, least: float = 0.60, most_ratio: float = 2.5) -> DataFrame:
    """Pairs of structs l and r (id, name, types, quantity, price): types meet, quantities within .75 to
    1.25, prices within the ratio unless quantities are within 10 %, two common words, .6 Jaccard + .4
    sequence ratio of at least `least`. Gives left, right, score."""
    c = F.col
    tokens = lambda side: F.array_distinct(text.words(text.normal_name(c(f"{side}.name")), 2))
    cheap = pairs.filter(F.arrays_overlap(c("l.types"), c("r.types"))).filter(F.coalesce(quantity.ratio_between(c("l.quantity"), c("r.quantity"), 0.75, 1.25, True), F.lit(True)))
    near = F.coalesce(quantity.ratio(c("l.quantity"), c("r.quantity")) <= 1.1, F.lit(False))
    cheap = cheap.filter(near | (quantity.ratio(c("l.price"), c("r.price")) <= most_ratio)).filter(F.size(F.array_intersect(tokens("l"), tokens("r"))) >= 2)
    score = 0.6 * similarity.jaccard(tokens("l"), tokens("r")) + 0.4 * similarity.sequence_ratio(F.lower(c("l.name")), F.lower(c("r.name")))
    return cheap.withColumn("score", score).filter(F.col("score") >= least).select(c("l.id").alias("left"), c("r.id").alias("right"), "score")
