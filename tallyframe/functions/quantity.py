"""Quantities, units, prices and discounts. Every parser takes the first of its ordered patterns that matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of units.
UNITS = {
    "ml": "ml", "мл": "ml", "milliliter": "ml", "millilitre": "ml",
    "l": "l", "л": "l", "liter": "l", "litre": "l", "литра": "l", "литър": "l",
    "g": "g", "г": "g", "gram": "g", "грам": "g", "грама": "g", "гр": "g", "gr": "g",
    "kg": "kg", "кг": "kg", "kilogram": "kg", "килограм": "kg", "килограма": "kg",
    "pcs": "pcs", "бр": "pcs", "броя": "pcs", "брой": "pcs", "шт": "pcs", "pc": "pcs", "piece": "pcs", "pieces": "pcs",
    "mg": "mg", "мг": "mg", "cl": "cl", "сл": "cl", "dl": "dl", "дл": "dl",
}

#: Factor to and name of the base unit.
BASE = {"l": (1000.0, "ml"), "cl": (10.0, "ml"), "dl": (100.0, "ml"), "ml": (1.0, "ml"), "kg": (1000.0, "g"), "mg": (0.001, "g"), "g": (1.0, "g"), "pcs": (1.0, "pcs")}

#: The older of two rates in use is 1.9558.
BGN_PER_EUR = 1.95583

AMOUNT = "struct<value:double,unit:string>"
_NUMBER = r"(\d+(?:[.,]\d+)?)"
_TIMES = r"\s*[xх×]\s*"


def _spellings(*names: str) -> str:
    """A group of all spellings of the units, the longest first."""
    return "(" + "|".join(sorted((s for s, unit in UNITS.items() if unit in names), key=lambda s: (-len(s), s))) + ")"


_WEIGHT, _VOLUME = _spellings("g", "kg"), _spellings("ml", "l")
_UNIT, _COUNTED = _spellings("g", "kg", "ml", "l"), _spellings("g", "kg", "ml", "l", "pcs")


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def unit_name(unit: Column) -> Column:
    """The standard name of a unit; unknown ones are lower-cased, null is ''."""
    lowered = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    return F.coalesce(F.try_element_at(_map(UNITS), lowered), lowered)


def number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def amount(value: Column, unit: Column) -> Column:
    """Value and unit in base units."""
    name = unit_name(unit)
    factor = F.coalesce(F.try_element_at(_map({k: v[0] for k, v in BASE.items()}), name), F.lit(1.0))
    base = F.coalesce(F.try_element_at(_map({k: v[1] for k, v in BASE.items()}), name), name)
    return F.struct((value * factor).alias("value"), F.nullif(base, F.lit("")).alias("unit"))


def _once(found: Column) -> Column:
    """amount() of a struct (value, unit) that is computed only once."""
    return F.try_element_at(F.transform(F.array(found), lambda x: F.when(x.isNotNull(), amount(x["value"], x["unit"]))), F.lit(1))


def _raw(value: Column, unit: Column) -> Column:
    return F.struct(value.alias("value"), unit.alias("unit"))


def _found(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, pattern, n)


def parse_quantity(text: Column) -> Column:
    """struct(value, unit) in base units of the first quantity: packs with a unit, packs
    without, decimals, whole numbers; null if there is none."""
    clean = F.lower(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), "&[a-z]+;", " "))
    pack, bare = rf"(\d+){_TIMES}{_NUMBER}\s*{_UNIT}", rf"(\d+){_TIMES}{_NUMBER}"
    plain = [rf"({form})\s*{_COUNTED}" for form in (r"\d+[.,]\d+", r"\d+")]
    times = lambda p: number(_group(clean, p, 1)) * number(_group(clean, p, 2))
    found = F.when(_found(clean, pack), _raw(times(pack), _group(clean, pack, 3)))
    found = found.when(_found(clean, bare), _raw(times(bare), _group(clean, _UNIT, 1)))
    for p in plain:
        found = found.when(_found(clean, p), _raw(number(_group(clean, p, 1)), _group(clean, p, 2)))
    return _once(found)


def largest_quantity(text: Column) -> Column:
    """A pack if there is one, else the largest single quantity in base units."""
    clean = F.lower(text)
    unit = _spellings("kg", "mg", "ml", "g", "cl", "dl", "l")
    pack, single = rf"(\d+){_TIMES}{_NUMBER}\s*{unit}", rf"{_NUMBER}\s*{unit}(?![\p{{L}}])"
    values = F.regexp_extract_all(clean, F.lit(single), F.lit(1))
    units = F.regexp_extract_all(clean, F.lit(single), F.lit(2))
    each = F.arrays_zip(values.alias("v"), units.alias("u"))
    all_found = F.transform(each, lambda x: amount(number(x["v"]), x["u"]))
    return F.when(_found(clean, pack), amount(number(_group(clean, pack, 1)) * number(_group(clean, pack, 2)), _group(clean, pack, 3))).when(F.size(all_found) > 0, F.array_max(all_found))


def unit_price_quantity(text: Column) -> Column:
    """Weight pack, volume pack, weight, volume: the first that matches, in g or ml."""
    clean, found = F.lower(text), None
    for packed, unit in ((p, u) for p in (True, False) for u in (_WEIGHT, _VOLUME)):
        pattern = (_NUMBER + _TIMES if packed else "") + _NUMBER + r"\s*" + unit
        value = number(_group(clean, pattern, 1)) * (number(_group(clean, pattern, 2)) if packed else F.lit(1.0))
        option = _found(clean, pattern), _raw(value, _group(clean, pattern, 3 if packed else 2))
        found = F.when(*option) if found is None else found.when(*option)
    return _once(found)


def raw_quantity(text: Column) -> Column:
    """Value and unit as written, pieces and centimetres included."""
    pattern = rf"{_NUMBER}\s*{_COUNTED[:-1]}|cm|см)(?![\p{{L}}])"
    clean = F.lower(text)
    return F.when(_found(clean, pattern), F.struct(number(_group(clean, pattern, 1)).alias("value"), unit_name(_group(clean, pattern, 2)).alias("unit")))


def added_packs(text: Column) -> Column:
    """Pieces of an additive pack ("32+8 бр."), else null."""
    pattern = r"(\d+)\s*\+\s*(\d+)\s*(?:бр|pcs)"
    clean = F.lower(text)
    return F.when(_found(clean, pattern), number(_group(clean, pattern, 1)) + number(_group(clean, pattern, 2)))


def range_start(text: Column) -> Column:
    """The lower end of a range such as "250-300 г" in base units, else null."""
    pattern = rf"{_NUMBER}\s*-\s*{_NUMBER}\s*{_UNIT}"
    clean = F.lower(text)
    return F.when(_found(clean, pattern), amount(number(_group(clean, pattern, 1)), _group(clean, pattern, 3)))


def is_bulk(text: Column, signs: list[str], least: int = 2) -> Column:
    """At least so many of the patterns occur."""
    return sum((text.rlike("(?iu)" + s).cast("int") for s in signs), F.lit(0)) >= least


def per_kilo(text: Column, value: Column, unit: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(r"(за|per|/)\s*1?\s*(кг|kg)"), F.lit(False)) | F.coalesce((unit == "kg") & (value == 1), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b))


def quantity_class(q1: Column, u1: Column, q2: Column, u2: Column) -> Column:
    """amounts_class of two quantities with units. For many pairs of few rows, make each row's amount first."""
    return amounts_class(amount(q1, u1), amount(q2, u2))


def amounts_class(a: Column, b: Column) -> Column:
    """Of amounts in base units: same_size up to 1.3 times, different_size up to 5 times, incompatible beyond; unknown if it can't be told."""
    r = ratio(a["value"], b["value"])
    known = a["unit"].isin("g", "ml", "pcs") & (a["unit"] == b["unit"]) & r.isNotNull()
    return F.when(~F.coalesce(known, F.lit(False)), "unknown").when(r <= 1.3, "same_size").when(r <= 5.0, "different_size").otherwise("incompatible")


def quantities_agree(q1: Column, u1: Column, q2: Column, u2: Column, tolerance: float = 0.25) -> Column:
    """Within the tolerance, in base units; a missing quantity agrees with all."""
    a, b = amount(q1, u1), amount(q2, u2)
    missing = F.coalesce(q1, F.lit(0.0)).eqNullSafe(0.0) | F.coalesce(q2, F.lit(0.0)).eqNullSafe(0.0)
    return F.when(missing, True).otherwise(F.coalesce(a["unit"].eqNullSafe(b["unit"]) & (ratio(a["value"], b["value"]) <= 1 + tolerance), F.lit(False)))


def ratio_between(q1: Column, q2: Column, low: float, high: float, missing: bool | None) -> Column:
    """q1 / q2 inside [low, high]; `missing` where either is missing or zero."""
    return F.when((q1 > 0) & (q2 > 0), (q1 / q2).between(low, high)).otherwise(F.lit(missing).cast("boolean"))


def within_share(q1: Column, q2: Column, share: float = 0.15) -> Column:
    """The difference is at most a share of the larger; false if either is missing."""
    return F.coalesce(F.abs(q1 - q2) <= share * F.greatest(q1, q2), F.lit(False))


def unit_price(price: Column, value: Column, unit: Column) -> Column:
    """Price per kilogram or litre, rounded to cents; null without a quantity."""
    return F.when((value > 0) & unit.isin("g", "ml"), F.round(price / value * 1000, 2))


def price_per_100(price: Column, value: Column) -> Column:
    return F.when(value >= 100, F.round(price / value * 100, 2))


def discount_percent(old: Column, new: Column, mode: str = "round1") -> Column:
    """Percent off where old > new > 0. mode: trunc, round, even (half to even) or round1 (one decimal)."""
    raw = (old - new) / old * 100
    shaped = {"trunc": F.floor(raw).cast("double"), "round": F.round(raw, 0), "even": F.bround(raw, 0), "round1": F.round(raw, 1)}[mode]
    return F.when((old > new) & (new > 0), shaped)


def to_euro(leva: Column, rate: float = BGN_PER_EUR) -> Column:
    return F.round(leva / rate, 2)


def to_leva(euro: Column, rate: float = BGN_PER_EUR) -> Column:
    return F.round(euro * rate, 2)


def parse_price(text: Column) -> Column:
    """The first number of a text such as "12,38 ЛВ."."""
    return number(F.nullif(F.regexp_extract(text, r"(\d+(?:[.,]\d+)?)", 1), F.lit("")))


def parse_discount(text: Column) -> Column:
    """42 of "-42%"."""
    return F.nullif(F.regexp_extract(text, r"-?\s*(\d+)\s*%", 1), F.lit("")).try_cast("int")


def price_ratio_flag(low: Column, high: Column, limit: float = 3.0) -> Column:
    return F.coalesce(ratio(low, high) > limit, F.lit(False))


def format_quantity(value: Column, unit: Column) -> Column:
    """Whole numbers without decimals."""
    shown = F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))
    return F.concat_ws(" ", shown, unit)


def listed_quantity(text: Column, patterns: list[str], pick: str = "first", base: bool = True) -> Column:
    """struct(value, unit) by a list of patterns, each with a number and a unit as its groups. pick: first (the first
    pattern that matches, its first match) or max (the largest of all matches). base: in base units, else as written."""
    clean = F.lower(text)
    shape = amount if base else lambda v, u: F.struct(v.alias("value"), unit_name(u).alias("unit"))
    each = lambda p: F.transform(F.arrays_zip(F.regexp_extract_all(clean, F.lit(p), F.lit(1)).alias("v"), F.regexp_extract_all(clean, F.lit(p), F.lit(2)).alias("u")), lambda x: shape(number(x["v"]), x["u"]))
    if pick == "max":
        return F.array_max(F.flatten(F.array(*[each(p) for p in patterns])))
    return F.coalesce(*[F.try_element_at(each(p), F.lit(1)) for p in patterns])


def name_quantity(text: Column) -> Column:
    """The parsers put together: additive packs, the lower end of ranges, then the first quantity."""
    packs = added_packs(text)
    return F.coalesce(F.when(packs.isNotNull(), F.struct(packs.alias("value"), F.lit("pcs").alias("unit"))), range_start(text), parse_quantity(text))


def extended_measures(text: Column) -> Column:
    """struct(area, diameter, watts, washes, parts) of a text: "20x30 cm" is 600, Ø24, 60 W, 40 washes, 3 parts; null where absent."""
    clean = F.lower(text)
    one = lambda pattern, n=1: number(F.nullif(F.regexp_extract(clean, pattern, n), F.lit("")))
    sides = rf"{_NUMBER}{_TIMES}{_NUMBER}\s*(?:cm|см)"
    return F.struct(
        (one(sides) * one(sides, 2)).alias("area"), one(rf"[øф]\s*{_NUMBER}").alias("diameter"), one(rf"{_NUMBER}\s*(?:watts?|w|вт)(?![\p{{L}}])").alias("watts"),
        one(r"(\d+)\s*(?:washes|wash|пранета|пране)").alias("washes"), one(r"(\d+)\s*(?:parts|части|piece set)").alias("parts"),
    )


def spec_table(html: Column, labels: dict[str, str]) -> Column:
    """struct of the named fields from a page's specification rows: the cell or text that follows each label."""
    cell = lambda label: F.nullif(F.trim(F.regexp_extract(html, rf"(?isu){label}\s*:?\s*(?:</[a-z]+>\s*)*(?:<[^>]+>\s*)*([^<]+)", 1)), F.lit(""))
    return F.struct(*[cell(label).alias(name) for name, label in labels.items()])


_PACK = r"(?iu)\s*\(?(\d+)\s*(?:pack|pcs|бр\.?|броя)(?:\s*/?\s*(?:pack|пакет))?\)?"


def pack_phrase(text: Column) -> Column:
    """struct(pack, rest): the pieces of a pack phrase, and the text without it."""
    return F.struct(F.nullif(F.regexp_extract(text, _PACK, 1), F.lit("")).try_cast("int").alias("pack"), F.trim(F.regexp_replace(text, _PACK, "")).alias("rest"))


def packaging(text: Column) -> Column:
    """struct(clean, value, unit) of a packaging text such as "per 500 g": it must be a quantity and nothing else."""
    clean = F.trim(F.regexp_replace(F.lower(text), r"^(?:per|pro|за)\s+|[.\s]+$", ""))
    pattern = rf"^{_NUMBER}\s*{_COUNTED}\.?$"
    found = F.when(clean.rlike(pattern), amount(number(F.regexp_extract(clean, pattern, 1)), F.regexp_extract(clean, pattern, 2)))
    return F.struct(clean.alias("clean"), found["value"].alias("value"), found["unit"].alias("unit"))
