"""Names: cleaning, normal forms, tokens, n-grams and transliteration. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions import quantity

#: Bulgarian letters and their Latin spelling.
CYRILLIC_TO_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sht", "ъ": "a", "ь": "y", "ю": "yu", "я": "ya",
}

#: Latin sequences and their Cyrillic spelling; longer sequences win.
LATIN_TO_CYRILLIC = {
    "sht": "щ", "zh": "ж", "ch": "ч", "sh": "ш", "ts": "ц", "yu": "ю", "ya": "я",
    "a": "а", "b": "б", "v": "в", "g": "г", "d": "д", "e": "е", "f": "ф", "h": "х", "i": "и", "j": "дж", "k": "к",
    "l": "л", "m": "м", "n": "н", "o": "о", "p": "п", "r": "р", "s": "с", "t": "т", "u": "у", "w": "у", "x": "кс", "y": "и", "z": "з",
}


def squeeze(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_markup(text: Column) -> Column:
    """Tags and named entities become spaces."""
    return squeeze(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), "&[a-zA-Z]+;", " "))


def unescape_entities(text: Column) -> Column:
    """The five basic entities, the non-breaking space, and decimal references of printable ASCII characters; the rest
    stays as it is."""
    for code in (33, 35, *range(40, 48), 58, 63, 64, 91, 93, 95, 124):
        text = F.replace(text, F.lit(f"&#{code};"), F.lit(chr(code)))
    for name, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def strip_patterns(text: Column, patterns: list[str]) -> Column:
    """Each pattern in turn is cut out, without regard to case, then spaces are squeezed."""
    for pattern in patterns:
        text = F.regexp_replace(text, "(?iu)" + pattern, "")
    return squeeze(text)


def display_name(text: Column, suffixes: list[str]) -> Column:
    """Line breaks become spaces and promotional suffixes go."""
    return strip_patterns(F.regexp_replace(text, r"[\r\n]+", " "), [s + "$" for s in suffixes])


def clean_by_store(text: Column, store: Column, rules: dict[str, list[str]], common: list[str]) -> Column:
    """Patterns of the row's store, then patterns for all stores."""
    cleaned = text
    for name, patterns in rules.items():
        cleaned = F.when(store == name, strip_patterns(text, patterns)).otherwise(cleaned)
    return strip_patterns(cleaned, common)


def scrub_with_fallback(text: Column, patterns: list[str], least: int = 3) -> Column:
    """The scrubbed text, or the original where fewer than `least` characters are left."""
    scrubbed = strip_patterns(text, patterns)
    return F.when(F.length(scrubbed) < least, text).otherwise(scrubbed)


def normal_name(text: Column) -> Column:
    """Lower case; all but letters, digits, underscores and spaces becomes a space; squeezed."""
    return squeeze(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "))


def normal_without(text: Column, phrases: list[str]) -> Column:
    """normal_name without filler phrases between word limits."""
    name = normal_name(text)
    for phrase in phrases:
        name = F.regexp_replace(name, rf"(^| ){phrase}(?= |$)", "$1")
    return squeeze(name)


def group_key(text: Column, drop: list[str], most: int = 35) -> Column:
    """Normal name without quantities, percents and given words, cut to `most` characters."""
    name = F.regexp_replace(F.lower(text), r"\d+(?:[.,]\d+)?\s*(?:%|kg|кг|g|гр|г|ml|мл|l|л|бр)(?![\p{L}\p{N}])", " ")
    return F.trim(F.substring(normal_without(name, drop), 1, most))


def words(text: Column, longer_than: int = 1, stop: list[str] = ()) -> Column:
    """Words of a normal form longer than so many characters, without stop words."""
    found = F.filter(F.split(text, " "), lambda w: F.length(w) > longer_than)
    return F.filter(found, lambda w: ~w.isin(list(stop))) if stop else found


def plain_tokens(text: Column) -> Column:
    """The words of normal_name in one pass, as they are, with empty ones at the ends."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}_]+")


def token_set(tokens: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens))


def ngrams(text: Column, n: int = 3) -> Column:
    """The distinct character n-grams; none where the text is shorter."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def to_latin(text: Column) -> Column:
    """Cyrillic to Latin letters, lower-cased; letters with several Latin ones first, then one pass for the others."""
    text = F.lower(text)
    for letter, latin in CYRILLIC_TO_LATIN.items():
        if len(latin) > 1:
            text = F.replace(text, F.lit(letter), F.lit(latin))
    single = {k: v for k, v in CYRILLIC_TO_LATIN.items() if len(v) == 1}
    return F.translate(text, "".join(single), "".join(single.values()))


def to_cyrillic(text: Column) -> Column:
    """Latin to Cyrillic letters, lower-cased; from the left, the longest sequence wins."""
    longer = [s for s in LATIN_TO_CYRILLIC if len(s) > 1]
    pieces = F.regexp_extract_all(F.lower(text), F.lit(f"(?s)({'|'.join(longer)}|.)"), F.lit(1))
    spelling = F.create_map(*[F.lit(x) for pair in LATIN_TO_CYRILLIC.items() for x in pair])
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(spelling, p), p)), "")


def has_cyrillic(text: Column) -> Column:
    return text.rlike("[а-яА-Я]")


def has_latin(text: Column) -> Column:
    return text.rlike("[a-zA-Z]")


def expand_tokens(tokens: Column, synonyms: dict[str, str] | None = None) -> Column:
    """Tokens with their transliterations (from four letters on) and synonyms; single letters go."""
    both = F.transform(tokens, lambda t: F.array(t, F.when(F.length(t) >= 4, F.when(has_cyrillic(t), to_latin(t)).otherwise(to_cyrillic(t)))))
    grown = F.flatten(both)
    if synonyms:
        table = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
        grown = F.concat(grown, F.transform(tokens, lambda t: F.try_element_at(table, t)))
    return token_set(F.filter(grown, lambda t: t.isNotNull() & (F.length(t) > 1)))


def concept(token: Column) -> Column:
    """The form under which spellings of one word meet."""
    return to_latin(token)


def substitute_terms(text: Column, terms: dict[str, str]) -> Column:
    """Fixed phrases replaced one after another, in the order given."""
    text = F.lower(text)
    for old, new in terms.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def slug_title(slug: Column) -> Column:
    """A URL's last part as a title."""
    return F.initcap(F.replace(F.url_decode(slug), F.lit("-"), F.lit(" ")))


def first_line(text: Column) -> Column:
    return F.trim(F.substring_index(text, "\n", 1))


def without_prefix(name: Column, brand: Column) -> Column:
    """The name without its leading brand, if it has one and something follows."""
    rest = F.trim(F.substr(name, F.length(brand) + 1))
    return F.when(F.startswith(F.lower(name), F.concat(F.lower(brand), F.lit(" "))) & (F.length(rest) > 0), rest).otherwise(name)


#: Short spellings of the units of sizes, and how they are read: a number, a spelling, and no letter after it.
_SIZE_UNITS = {spelling: unit for spelling, unit in quantity.UNITS.items() if unit in ("kg", "g", "l", "ml") and len(spelling) <= 2}
_SIZE = rf"(?iu)(\d+(?:[.,]\d+)?)\s*({'|'.join(sorted(_SIZE_UNITS, key=len, reverse=True))})(?!\p{{L}})"


def normalise_size(text: Column) -> Column:
    """Sizes in one Latin spelling: decimal points, kg, g, l and ml next to their number. Longer words, such as grams in full,
    stay. The text is taken apart once, into sizes, decimal numbers and single characters."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s){_SIZE}|\d+,\d+|."), F.lit(0))
    units = F.create_map(*[F.lit(x) for pair in _SIZE_UNITS.items() for x in pair])

    def spelt(piece):
        number = F.replace(F.regexp_extract(piece, _SIZE, 1), F.lit(","), F.lit("."))
        unit = F.try_element_at(units, F.lower(F.regexp_extract(piece, _SIZE, 2)))
        return F.when(unit.isNotNull(), F.concat(number, unit)).when(F.length(piece) > 1, F.replace(piece, F.lit(","), F.lit("."))).otherwise(piece)

    return F.array_join(F.transform(pieces, spelt), "")


def squeezed_name(text: Column) -> Column:
    """normal_name of a text that is squeezed first: line breaks and tabs count as spaces before punctuation goes."""
    return squeeze(F.regexp_replace(squeeze(F.lower(text)), r"[^\p{L}\p{N}_ ]", " "))


def without_quantities(text: Column, words_: list[str]) -> Column:
    """Normal name without quantities and without given words (such as organic) between word limits."""
    return normal_without(F.regexp_replace(F.lower(text), r"\d+(?:[.,]\d+)?\s*(?:kg|кг|g|гр|г|ml|мл|l|л|бр|pcs)(?![\p{L}\p{N}])", " "), words_)


def group_title(text: Column, drop: list[str], most: int = 50) -> Column:
    """The group key as it is shown: more of it, each word with a capital."""
    return F.initcap(group_key(text, drop, most))


def comparison_tokens(text: Column, noise: list[str], stop: list[str], synonyms: dict[str, str] | None = None) -> Column:
    """Expanded tokens of a name after noise patterns, quantities, percents and ranges are cut out."""
    plain = F.lower(text)
    for pattern in (r"\d+\s*-\s*\d+", r"\d+(?:[.,]\d+)?\s*%", *noise):
        plain = F.regexp_replace(plain, "(?iu)" + pattern, " ")
    return expand_tokens(words(without_quantities(plain, []), 1, stop), synonyms)


def strip_marks(text: Column) -> Column:
    """Without trade-mark signs, quotation marks and surrounding punctuation."""
    return squeeze(F.regexp_replace(F.regexp_replace(text, "[®™©\"„“”«»]", ""), r"^[\s.,;:-]+|[\s.,;:-]+$", ""))
