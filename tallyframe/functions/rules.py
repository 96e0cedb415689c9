"""Brands, categories and validation codes from ordered rule tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as no brand.
NO_BRAND = ("", "no_brand", "unknown", "generic", "none", "n/a")


def known_brand(brand: Column, ignore: tuple[str, ...] = NO_BRAND) -> Column:
    """Lower-cased brand without trade-mark signs; null where it is none."""
    name = F.trim(F.regexp_replace(F.lower(F.trim(brand)), "[®™©]", ""))
    return F.when(~name.isin(*ignore), name)


def _bounded(word: Column | str, text: Column) -> Column:
    """Whether the word occurs in the text between characters that are no letters or digits."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    return F.contains(padded, F.concat(F.lit(" "), word if isinstance(word, Column) else F.lit(word), F.lit(" ")))


def longest_brand(text: Column, brands: list[str], bounded: bool = True) -> Column:
    """The longest listed brand in the text (first listed among equals), null if none."""
    ordered = sorted(brands, key=lambda b: -len(b))
    hit = lambda b: _bounded(b.lower(), text) if bounded else F.contains(F.lower(text), F.lit(b.lower()))
    return F.coalesce(*[F.when(hit(b), F.lit(b)) for b in ordered])


def house_then_longest(text: Column, store: Column, house: dict[str, list[str]], brands: list[str]) -> Column:
    """A store's own brands first, then all brands by length."""
    own = F.coalesce(*[F.when(store == s, longest_brand(text, names)) for s, names in house.items()])
    return F.coalesce(own, longest_brand(text, brands), longest_brand(text, brands, bounded=False))


def latin_prefix(text: Column, most: int = 3) -> Column:
    """Up to three leading Latin words that start with a capital, else null."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"^((?:[A-Z][A-Za-z&'.-]+\s*){{1,{most}}})", 1)), F.lit(""))


def resolve_brand(text: Column, aliases: dict[str, str], patterns: dict[str, str], house: list[str]) -> Column:
    """struct(brand, method, confidence): alias .95, pattern .90, house brand .85, Latin prefix .80."""
    row = lambda brand, method, confidence: F.when(brand.isNotNull(), F.struct(brand.alias("brand"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence")))
    alias = F.coalesce(*[F.when(_bounded(a, text), F.lit(b)) for a, b in aliases.items()], F.lit(None).cast("string"))
    regex = F.coalesce(*[F.when(text.rlike("(?iu)" + p), F.lit(b)) for p, b in patterns.items()], F.lit(None).cast("string"))
    own = longest_brand(text, house) if house else F.lit(None).cast("string")
    return F.coalesce(row(alias, "alias", 0.95), row(regex, "regex", 0.90), row(own, "house", 0.85), row(latin_prefix(text), "prefix", 0.80))


def first_category(text: Column, rules: list[tuple[str, list[str]]], least: int = 5) -> Column:
    """The first category with a keyword between word limits; else the first with a keyword of `least` letters anywhere."""
    bounded = [F.when(reduce(lambda a, b: a | b, [_bounded(k, text) for k in words]), F.lit(c)) for c, words in rules]
    loose = [F.when(reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(k)) for k in words if len(k) >= least]), F.lit(c)) for c, words in rules if any(len(k) >= least for k in words)]
    return F.coalesce(*bounded, *loose)


def scored_category(text: Column, rules: list[tuple[str, list[str]]], weigh: bool = True) -> Column:
    """struct(category, score): the category whose keywords in the text are longest in sum (or most); first listed among equals."""
    scores = [F.struct(reduce(lambda a, b: a + b, [F.when(F.contains(F.lower(text), F.lit(k)), len(k) if weigh else 1).otherwise(0) for k in words]).alias("score"), F.lit(-i).alias("ord"), F.lit(c).alias("category")) for i, (c, words) in enumerate(rules)]
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] > 0, F.struct(best["category"].alias("category"), best["score"].alias("score")))


def categories_fit(a: Column, b: Column, wild: str = "other") -> Column:
    return (a == b) | (a == wild) | (b == wild) | a.isNull() | b.isNull()


def product_types(text: Column, types: dict[str, list[str]]) -> Column:
    """The types of which a keyword stands in the text between word limits, in the table's order."""
    found = [F.when(reduce(lambda a, b: a | b, [_bounded(k, text) for k in words]), F.lit(t)) for t, words in types.items()]
    return F.filter(F.array(*found), lambda t: t.isNotNull())


def types_conflict(a: Column, b: Column) -> Column:
    """Both have types and share none."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def has_keyword(text: Column, keywords: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(k)) for k in keywords], F.lit(False))


def checked_price(price: Column, old: Column, discount: Column) -> Column:
    """struct(price, old_price, discount, ok): implausible prices are rejected, implausible old prices dropped."""
    bad = price.isNull() | (price <= 0) | (price > 200) | ((price == F.floor(price)) & (price > 100))
    bad_old = (old > 4 * price) | (old > 200) | ((old == F.floor(old)) & (old > 100))
    steep = F.coalesce(discount > 75, F.lit(False))
    kept_old = F.when(steep, F.lit(0.0)).when(~F.coalesce(bad_old, F.lit(False)), old)
    return F.struct(F.when(~bad, price).alias("price"), kept_old.alias("old_price"), F.when(steep, F.lit(0.0)).otherwise(discount).alias("discount"), (~bad).alias("ok"))


def error_codes(rules: list[tuple[str, Column]]) -> Column:
    """Codes of the rules that hold, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(code)) for code, when in rules]), lambda c: c.isNotNull())


def sane_old_price(price: Column, old: Column, most: float = 3.0) -> Column:
    return F.when((old > price) & (old < most * price), old)


def cents_repaired(price: Column, store: Column, food: Column, stores: list[str], limit: float = 50.0) -> Column:
    return F.when(store.isin(*stores) & food & (price > limit), price / 100).otherwise(price)


def confident(value: Column, confidence: Column, least: float = 0.9) -> Column:
    """The value where confidence suffices, else null."""
    return F.when(confidence >= least, value)


def availability(text: Column) -> Column:
    """sold_out, scheduled, upcoming or in_store from a page's wording."""
    low = F.lower(text)
    return F.when(low.rlike("sold ?out|изчерпан|разпродаден"), "sold_out").when(low.rlike(r"(from|от) \d{1,2}\.\d{1,2}"), "scheduled").when(low.rlike("soon|очаквайте|предстои"), "upcoming").otherwise("in_store")


def included(text: Column, include: list[str], exclude: list[str], otherwise: bool = False) -> Column:
    """False with a word to exclude, else true with one to include, else `otherwise`."""
    return F.when(has_keyword(text, exclude), False).when(has_keyword(text, include), True).otherwise(otherwise)


def card_text(text: Column, terms: list[str], least: int = 3) -> Column:
    """Whether a card's text is a product: long enough and without any of the terms."""
    return F.coalesce((F.length(F.trim(text)) >= least) & ~has_keyword(text, terms), F.lit(False))


def longest_keyword_category(text: Column, rules: list[tuple[str, list[str]]], otherwise: str | None = None) -> Column:
    """The category of the longest keyword between word limits; the first listed among equals."""
    ordered = sorted(((k, c) for c, words in rules for k in words), key=lambda kc: -len(kc[0]))
    return F.coalesce(*[F.when(_bounded(k, text), F.lit(c)) for k, c in ordered], F.lit(otherwise).cast("string"))


def category_or_brand(text: Column, brand: Column, rules: list[tuple[str, list[str]]], by_brand: dict[str, str]) -> Column:
    """The first category with a keyword anywhere in the text, else the brand's."""
    table = F.create_map(*[F.lit(x) for pair in by_brand.items() for x in pair])
    return F.coalesce(*[F.when(has_keyword(text, words), F.lit(c)) for c, words in rules], F.try_element_at(table, F.lower(brand)))


def category_code(category: Column, codes: dict[str, str], otherwise: str = "99000000") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), category), F.lit(otherwise))


def product_variants(text: Column, kinds: list[str]) -> Column:
    """Sorted variants: the percentage, if there is one, and the listed kinds that stand in the text."""
    percent = F.nullif(F.replace(F.regexp_extract(text, r"(\d+(?:[.,]\d+)?)\s*%", 1), F.lit(","), F.lit(".")), F.lit(""))
    return F.array_sort(F.filter(F.array(F.concat(percent, F.lit("%")), *[F.when(_bounded(k, text), F.lit(k)) for k in kinds]), lambda v: v.isNotNull()))


def brand_in_scan(scan: Column, name: Column, brands: list[str], most: int = 20) -> Column:
    """Brand from the text of a scanned package: the longest listed one that the name lacks, else the first line, if it is
    short and begins with a capital."""
    named = F.coalesce(*[F.when(_bounded(b.lower(), scan) & ~_bounded(b.lower(), name), F.lit(b)) for b in sorted(brands, key=lambda b: -len(b))], F.lit(None).cast("string"))
    line = F.trim(F.substring_index(scan, "\n", 1))
    return F.coalesce(named, F.when(line.rlike(r"^\p{Lu}") & (F.length(line) <= most), line))


def normal_brand(brand: Column, variants: dict[str, str], suffixes: tuple[str, ...] = ("ltd", "llc", "gmbh", "inc", "ad", "ood", "ад", "оод", "еоод"), ignore: tuple[str, ...] = NO_BRAND) -> Column:
    """known_brand without its legal form, in its usual spelling."""
    name = F.trim(F.regexp_replace(known_brand(brand, ignore), rf"[\s,]+(?:{'|'.join(suffixes)})\.?$", ""))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in variants.items() for x in pair]), name), name)


def alias_brand(brand: Column, aliases: dict[str, str]) -> Column:
    """The brand behind an alias, as written without hyphens and spaces, else as transliterated; null if there is none."""
    from tallyframe.functions.text import to_latin

    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    plain = F.regexp_replace(F.lower(brand), r"[\s-]", "")
    return F.coalesce(F.try_element_at(table, plain), F.try_element_at(table, to_latin(plain)))
