"""Cleaning of names by the phrases that stores put around them. The phrases are tables; patterns are made from them by rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of the stores' promotions, in the order in which they are taken off.
OFFER = "king оферта"
OFFER_KINDS = ["супер цена", "само с billa card", "сега в billa", "ново в billa"]
LOW_PRICE = "ниска цена"
COUNTER_PHRASES = ["от топлата витрина", "от деликатесната витрина", "от нашата пекарна", "от billa пекарна"]
ORIGIN, ORIGIN_OF = "произход", "произход - българия"
VARIETIES = ["видове", "вкусове", "размери", "цветове"]
BULK = [("1", "кг", 1000, "g"), ("1", "бр", 1, "бр"), ("100", "г", 100, "g")]

DASH, GAP, END = r"\s*-\s*", r"\s+", r"\s*$"


def phrase(words: str) -> str:
    """The pattern of a phrase: any white space between words, and any or none around a dash."""
    return DASH.join(GAP.join(re.escape(w) for w in part.split()) for part in words.split(" - "))


def _any(words: list[str]) -> str:
    return f"(?:{'|'.join(phrase(w) for w in words)})"


def bulk_pattern(count: str, unit: str) -> str:
    """'за <count> <unit>' at the end; pieces may have a dot, and a hundred grams are also written in one word."""
    return rf"{GAP}за{GAP}{count}{GAP if count == '1' else r'\s*'}{unit}{r'\.?' if unit == 'бр' else ''}{END}"


def billa_patterns() -> list[str]:
    """Offers and their kinds before the name, shares off the price, then notes of which all to the end of the line goes, the
    store's own name, and the units of goods sold loose."""
    first = [f"{OFFER} - {kind}" for kind in OFFER_KINDS] + [OFFER]
    before = [f"^{phrase(p)}{DASH}" for p in first]
    before += [rf"^{phrase(OFFER_KINDS[0])}\s*[-–]\s*", f"^{phrase(LOW_PRICE)}{DASH}", rf"^промо{GAP}-?\s*", rf"^-\d+%{DASH}", rf"^\d+%{GAP}-\s*"]
    before += [f"^{phrase(kind)}{DASH}" for kind in OFFER_KINDS[1:]]
    notes = [rf"продукт,?{GAP}{phrase('маркиран със синя зв')}", *[phrase(p) for p in COUNTER_PHRASES]]
    notes += [rf"до{GAP}\d+\s*{unit}{GAP}на{GAP}клиент" for unit in ("кг", r"бр\.?")] + [phrase(ORIGIN_OF), phrase(ORIGIN)]
    return before + [rf"{GAP}{note}[^\n]*$" for note in notes] + [rf"{GAP}billa{END}"] + [bulk_pattern(c, u) for c, u, _, _ in BULK]


def lidl_patterns() -> list[str]:
    return [rf"\s*\|\s*lidl{END}"]


def common_patterns() -> list[str]:
    """For rows of any store: counters and offers in their shorter forms, notes of validity, dates, varieties, limits and origin."""
    counters = [rf"{phrase('от нашата')}{GAP}(?:пекарна|витрина)", rf"{phrase('от свежата')}{GAP}витр(?:ина)?", rf"{phrase('от деликатес')}(?:ната{GAP}витрина|нат)?"]
    offers = [rf"^{phrase(OFFER)}{DASH}[^-]+-\s*", rf"^{phrase(OFFER)}{DASH}", rf"^\s*продукт,{GAP}маркиран{GAP}(?:с|със){GAP}{phrase('синя звезда')}[^А-Яа-яA-Za-z]*", rf"^{phrase(OFFER_KINDS[0])}{DASH}"]
    notes = [r"\*+\s*валидно[^*]+\*+", r"\d{2}\.\d{2}\.\d{4}", rf"{GAP}{phrase(COUNTER_PHRASES[-1])}"]
    ends = [rf"различни{GAP}{_any(VARIETIES)}", phrase("избрани видове"), rf"до{GAP}\d+\s*{phrase('кг на покупка')}"]
    return [*lidl_patterns(), *[f"{GAP}{c}{END}" for c in counters], *offers, *notes, *[f"{GAP}{e}{END}" for e in ends], rf"{GAP}{ORIGIN}[^,]*$"]


#: Patterns by store, as text.clean_by_store and standard_products take them.
STORE_PATTERNS = {"Billa": billa_patterns(), "Lidl": lidl_patterns()}


def cleaned(text: Column, patterns: list[str]) -> Column:
    """Each pattern in turn is cut out, in the letters and white space of any language and without regard to case; then white space is
    squeezed. Null stays null."""
    for pattern in patterns:
        text = F.regexp_replace(text, "(?iU)" + pattern, "")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def store_name(text: Column, store: Column) -> Column:
    """The name without its store's phrases; rows of other stores by the patterns common to all. Branches are alternatives of one
    expression, so that a row is only matched against its own store's patterns."""
    found = F
    for name, patterns in STORE_PATTERNS.items():
        found = found.when(store == name, cleaned(text, patterns))
    return found.otherwise(cleaned(text, common_patterns()))


def bulk_size(text: Column) -> Column:
    """struct(value, unit) of goods sold loose, null for others; told before cleaning, which takes it off."""
    found = F
    for count, unit, value, base in BULK:
        found = found.when(F.rlike(F.lower(text), F.lit("(?U)" + bulk_pattern(count, unit))), F.struct(F.lit(value).alias("value"), F.lit(base).alias("unit")))
    return found.otherwise(F.lit(None))
