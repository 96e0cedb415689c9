"""Rule tables of any size: brands, categories and types looked up in names by joins.

A rule table has one row per term: term, and whatever it stands for. Distinct names are
cut into their word n-grams (or, for terms that may stand inside words, into the
substrings that have a term's length) once, and meet the distinct terms by equality, so that neither the plan nor
the work per name grows with the number of rules, however often they are listed. Spark broadcasts the rules while
they are small; a name or term that stands out is split by adaptive skew joins.

Terms and names are compared in lower case, letters and digits only, other
characters as one space between words. Empty terms stand nowhere; null names have no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import rules
from tallyframe.session import materialize, spread


def plain_words(text: Column) -> Column:
    """Lower-cased words of letters and digits, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def word_grams(text: Column, most: int) -> Column:
    """The distinct runs of one to `most` words of a text in plain_words form."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))

    def runs(n: int) -> Column:
        return F.transform(F.filter(starts, lambda i: i + n - 1 <= F.size(words)), lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.array_distinct(F.flatten(F.array(*[runs(n) for n in range(1, most + 1)])))


def substrings(text: Column, lengths: list[int]) -> Column:
    """The distinct substrings of the given lengths."""

    def of_length(n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))

    return F.array_distinct(F.flatten(F.array(*[of_length(n) for n in lengths])))


def _names(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of these columns, the text first, without null texts. They are written, so that rows are read once for them."""
    return materialize(rows.select(*columns).filter(F.col(columns[0]).isNotNull()).distinct(), "dictionary-names")


def _known(terms: DataFrame, within: list[str], anywhere: bool) -> DataFrame:
    """terms with `hit`, what is looked up, and its `letters`; columns of within as _of_<name>."""
    form = F.lower if anywhere else plain_words
    return terms.withColumn("hit", form(F.col("term"))).filter("hit <> ''").withColumn("letters", F.length("hit")).withColumnsRenamed({c: f"_of_{c}" for c in within})


def _hits(names: DataFrame, text: str, known: DataFrame, within: list[str], anywhere: bool) -> DataFrame:
    """dictionary_hits of distinct names and terms as of _known. Terms are written first, so that Spark knows how few they are."""
    form = F.lower if anywhere else plain_words
    known = materialize(known, "dictionary-terms")
    if anywhere:
        lengths = known.agg(F.collect_set("letters")).first()[0]
        grams = substrings(form(F.col(text)), sorted(lengths) or [1])
    else:
        grams = word_grams(form(F.col(text)), known.agg(F.coalesce(F.max(F.size(F.split("hit", " "))), F.lit(1))).first()[0])
    each = spread(names).withColumn("_gram", F.explode(grams))
    fits = F.col("_gram") == F.col("hit")
    for c in within:
        fits = fits & (F.col(f"_of_{c}").isNull() | (F.col(f"_of_{c}") == F.col(c)))
    return each.join(known, fits).drop("_gram")


def dictionary_hits(rows: DataFrame, text: str, terms: DataFrame, within: list[str] | None = None, anywhere: bool = False) -> DataFrame:
    """Distinct (text, within..., hit, letters and the columns of terms) of the terms that stand in a text: between word limits,
    or with `anywhere` also inside words. terms: term, ...; with `within`, of columns that rows and terms both
    have, a term counts for rows of its own value, or for all where it is null. One row of sizes comes to the driver."""
    within = within or []
    return _hits(_names(rows, [text, *within]), text, _known(terms, within, anywhere), within, anywhere)


def _best(names: DataFrame, text: str, terms: DataFrame, out: str, value: str = "value", order: list[str] | None = None, within: list[str] | None = None, anywhere: bool = False) -> DataFrame:
    """(text, within..., out) of the distinct names that have a term. Of terms that are looked up alike only the first can be chosen, so
    that a term listed many times meets a name once."""
    within = within or []
    known, own = _known(terms, within, anywhere), [f"_of_{c}" for c in within]
    by = order or ["ord"]
    first = known.groupBy("hit", "letters", *own).agg(F.min_by(F.struct(F.col(value).alias("value"), *[F.col(c).alias(f"by{i}") for i, c in enumerate(by)]), F.struct(*by)).alias("first"))
    hits = _hits(names, text, first, within, anywhere)
    places = [F.col(f"first.by{i}").alias(f"by{i}") for i in range(len(by))]
    rank = F.struct(*[F.col(c).isNull().alias(f"own{i}") for i, c in enumerate(own)], *([] if order else [(-F.col("letters")).alias("long")]), *places)
    return hits.groupBy(text, *within).agg(F.min_by("first.value", rank).alias(out))


def _joined(rows: DataFrame, found: DataFrame, text: str, within: list[str]) -> DataFrame:
    """rows with the columns found for their text; null where there are none. What is found is written first, so that Spark knows its size."""
    renamed = materialize(found, "dictionary-found").withColumnsRenamed({c: f"_by_{c}" for c in (text, *within)})
    on = [rows[c].eqNullSafe(renamed[f"_by_{c}"]) for c in within]
    return rows.join(renamed, [rows[text] == renamed[f"_by_{text}"], *on], "left").drop(*[f"_by_{c}" for c in (text, *within)])


def with_best_term(rows: DataFrame, text: str, terms: DataFrame, out: str, value: str = "value", order: list[str] | None = None, within: list[str] | None = None, anywhere: bool = False) -> DataFrame:
    """rows with `out`: the value of the longest term that stands in the text, of the first (by ord) among equals. With `order`,
    the first by those columns instead. With `within`, terms of the row's own value come before those of all."""
    within = within or []
    return _joined(rows, _best(_names(rows, [text, *within]), text, terms, out, value, order, within, anywhere), text, within)


def _firsts(terms: DataFrame, value: str, anywhere: bool) -> DataFrame:
    """(hit, letters, value, ord): what is looked up, once for each value."""
    return _known(terms, [], anywhere).groupBy("hit", "letters", value).agg(F.min("ord").alias("ord"))


def with_terms(rows: DataFrame, text: str, terms: DataFrame, out: str, value: str = "value") -> DataFrame:
    """rows with `out`: the distinct values of the terms that stand in the text, by their smallest ord; empty where there are none."""
    hits = _hits(_names(rows, [text]), text, _firsts(terms, value, False), [], False)
    firsts = hits.groupBy(text, value).agg(F.min("ord").alias("ord"))
    found = firsts.groupBy(text).agg(F.array_sort(F.collect_list(F.struct("ord", value)))[value].alias(out))
    joined = _joined(rows, found, text, [])
    return joined.withColumn(out, F.coalesce(out, F.array().cast(joined.schema[out].dataType)))


def with_scored_term(rows: DataFrame, text: str, terms: DataFrame, out: str, value: str = "value", weigh: bool = True) -> DataFrame:
    """rows with `out`, struct(value, score): the value whose terms, anywhere in the text, are longest in sum (or most); the first by
    ord among equals. A term that is listed several times for a value counts once."""
    hits = _hits(_names(rows, [text]), text, _firsts(terms, value, True), [], True)
    scores = hits.groupBy(text, value).agg(F.sum(F.col("letters") if weigh else F.lit(1)).alias("score"), F.min("ord").alias("ord"))
    best = scores.groupBy(text).agg(F.min_by(F.struct(value, "score"), F.struct(-F.col("score"), "ord")).alias(out))
    return _joined(rows, best, text, [])


def with_category(rows: DataFrame, text: str, terms: DataFrame, out: str, least: int = 5) -> DataFrame:
    """rows with `out`: the first category (by ord) with a keyword between word limits; else the first with a keyword of `least`
    letters anywhere."""
    names = _names(rows, [text])
    strict = materialize(_best(names, text, terms, out, order=["ord"]).filter(F.col(out).isNotNull()), "dictionary-strict")
    left = materialize(names.join(strict, text, "left_anti"), "dictionary-left")
    loose = _best(left, text, terms.filter(F.length("term") >= least), out, order=["ord"], anywhere=True)
    return _joined(rows, strict.unionByName(loose), text, [])


def with_house_brand(rows: DataFrame, text: str, store: str, brands: DataFrame, out: str) -> DataFrame:
    """rows with `out`: the longest brand of the row's own store, else the longest of all stores' (brands: term, value, ord, and the
    store's column, null for brands of all), between word limits, else anywhere."""
    names = _names(rows, [text, store])
    strict = materialize(_joined(names, _best(names, text, brands, "_strict", within=[store]), text, [store]), "dictionary-strict")
    left = materialize(strict.filter(F.col("_strict").isNull()).select(text).distinct(), "dictionary-left")
    general = brands.filter(F.col(store).isNull()).drop(store)
    found = _joined(strict, _best(left, text, general, "_loose", anywhere=True), text, []).select(text, store, F.coalesce("_strict", "_loose").alias(out))
    return _joined(rows, found, text, [store])


def with_resolved_brand(rows: DataFrame, text: str, aliases: DataFrame, house: DataFrame, patterns: dict[str, str], out: str) -> DataFrame:
    """rows with `out`, struct(brand, method, confidence): first alias (by ord) .95, else pattern .90, else longest house brand .85,
    else Latin prefix .80. aliases, house: term, value, ord, of any number; patterns: a few regular expressions."""
    names = _names(rows, [text])
    found = _joined(_joined(names, _best(names, text, aliases, "_alias", order=["ord"]), text, []), _best(names, text, house, "_house"), text, [])
    row = lambda brand, method, confidence: F.when(brand.isNotNull(), F.struct(brand.alias("brand"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence")))
    regex = F.coalesce(*[F.when(F.col(text).rlike("(?iu)" + p), F.lit(b)) for p, b in patterns.items()], F.lit(None).cast("string"))
    best = F.coalesce(row(F.col("_alias"), "alias", 0.95), row(regex, "regex", 0.90), row(F.col("_house"), "house", 0.85), row(rules.latin_prefix(F.col(text)), "prefix", 0.80))
    return _joined(rows, found.select(text, best.alias(out)).filter(F.col(out).isNotNull()), text, [])


def with_normal_brand(rows: DataFrame, brand: str, variants: DataFrame, out: str) -> DataFrame:
    """rows with `out`: the brand without trade-mark signs and legal form (rules.normal_brand), in the usual spelling that the table
    of variants (term, value) has for it; of several the first by value."""
    usual = variants.groupBy(F.col("term").alias("_variant")).agg(F.min("value").alias("_usual"))
    found = rows.withColumn("_plain", rules.normal_brand(F.col(brand), {"": ""}))
    return found.join(usual, F.col("_plain") == F.col("_variant"), "left").withColumn(out, F.coalesce("_usual", "_plain")).drop("_plain", "_variant", "_usual")
