"""Fields of web pages: URL parts, cards, JSON-LD, embedded arrays, marker-split and look-ahead extraction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyframe.functions.quantity import parse_price
from tallyframe.operators.relational import keep_first


def _some(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def url_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, language folder and trailing item number of the URL."""
    u = F.col(url)
    return pages.withColumns(
        {
            "host": F.regexp_extract(u, "^[a-z]+://([^/?#]+)", 1),
            "lang": _some(F.regexp_extract(u, "^[a-z]+://[^/]+/([a-z]{2})/", 1)),
            "item": _some(F.regexp_extract(u, "/([0-9]+)/?(?:[?#].*)?$", 1)).try_cast("long"),
        }
    )


def page_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with title, language and number of links."""
    h = F.col(html)
    return pages.withColumns(
        {
            "title": _some(F.regexp_extract(h, "<title>([^<]*)</title>", 1)),
            "lang": _some(F.regexp_extract(h, '<html lang="([a-z]+)"', 1)),
            "n_links": F.size(F.regexp_extract_all(h, F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long"),
        }
    )


#: Fixed format: the parts of a product in JSON-LD that are used.
PRODUCT = "struct<`@type`:string,name:string,sku:string,brand:struct<name:string>,offers:struct<price:string,priceCurrency:string,availability:string>>"
_LD = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.+?)</script>'


def json_ld_products(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Products of each page's JSON-LD blocks: single objects, arrays, @graph and itemListElement[].item."""
    blocks = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(_LD), F.lit(1))).alias("block", "json"))
    one = lambda c: F.from_json(c, PRODUCT)
    many = lambda c: F.from_json(c, f"array<{PRODUCT}>")
    graph = F.from_json("json", f"struct<`@graph`:array<{PRODUCT}>>")["@graph"]
    listed = F.transform(F.from_json("json", f"struct<itemListElement:array<struct<item:{PRODUCT}>>>")["itemListElement"], lambda x: x["item"])
    empty = F.array().cast(f"array<{PRODUCT}>")
    found = F.concat(F.array(one(F.col("json"))), F.coalesce(many(F.col("json")), empty), F.coalesce(graph, empty), F.coalesce(listed, empty))
    rows = blocks.select(key, "block", F.posexplode(F.filter(found, lambda p: p["@type"] == "Product")).alias("pos", "p"))
    flat = rows.select(key, "block", "pos", F.col("p.name").alias("name"), F.col("p.sku").alias("sku"), F.col("p.brand.name").alias("brand"), F.col("p.offers.price").try_cast("double").alias("price"), F.col("p.offers.priceCurrency").alias("currency"))
    return keep_first(flat, [key, "name"], ["block", "pos"]).drop("block", "pos")


#: A string, closed or not, or a bracket outside of one.
_BRACKETS = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)|[\[\]]', re.DOTALL)


def bracketed(text: str | None, marker: str, window: int | None = None) -> str | None:
    """The JSON array that follows the marker, by bracket matching outside of strings."""
    start = (text or "").find(marker)
    if start < 0:
        return None
    begin = text.find("[", start + len(marker) - 1)
    if begin < 0:
        return None
    depth = 0
    for token in _BRACKETS.finditer(text, begin, len(text) if window is None else min(len(text), begin + window)):
        if text[token.start()] == "[":
            depth += 1
        elif text[token.start()] == "]":
            depth -= 1
            if not depth:
                return text[begin : token.end()]
    return None


#: Characters in which the short forms look for the end of an array, and for the fields of a chunk, and chunks of a page they take.
ARRAY_WINDOW, CHUNK_WINDOW, CHUNKS = 500_000, 2000, 300


def embedded_array(html: Column, marker: str = '"offers":[', window: int | None = None) -> Column:
    """The array behind a marker inside a page, as JSON text; with a window, only if it ends within so many characters."""

    @F.pandas_udf(StringType())
    def find(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in pages:
            yield series.map(lambda t: bracketed(t, marker, window))

    return find(html)


def embedded_offers(pages: DataFrame, schema: str, key: str, unique: str, html: str = "html", marker: str = '"offers":[') -> DataFrame:
    """Rows of an embedded offer array; the first row of each `unique` on a page stays."""
    rows = pages.select(key, F.posexplode(F.from_json(embedded_array(F.col(html), marker), f"array<{schema}>")).alias("pos", "o"))
    return keep_first(rows.select(key, "pos", "o.*"), [key, unique], ["pos"]).drop("pos")


def after_marker(pages: DataFrame, key: str, marker: str, fields: dict[str, str | list[str]], html: str = "html", window: int | None = None, most: int | None = None) -> DataFrame:
    """Each chunk that follows a marker (or the first `most`, up to `window` characters of each), with fields by regular expression; of several
    expressions the first that finds something (a nested price, then a flat one)."""
    chunks = pages.select(key, F.posexplode(F.split(F.col(html), re.escape(marker))).alias("pos", "chunk"))
    near = chunks.filter(F.col("pos") >= 1 if most is None else F.col("pos").between(1, most))
    near = near if window is None else near.withColumn("chunk", F.substring("chunk", 1, window))
    each = lambda p: F.coalesce(*[_some(F.regexp_extract("chunk", x, 1)) for x in ([p] if isinstance(p, str) else p)])
    return near.select(key, "pos", *[each(p).alias(n) for n, p in fields.items()])


def look_ahead(pages: DataFrame, key: str, marker: str, fields: dict[str, str], reach: int, html: str = "html", name: str = "id") -> DataFrame:
    """(key, name, *fields): for each place where `marker` fits, what its group holds, and what each field's expression first finds in the
    `reach` characters from there on, which may run past the next marker; null where it finds nothing. Of places with the same name on a
    page the first one holds, whether or not it has the fields. Contexts overlap, so that they are found by an expression that
    looks ahead and takes the marker only; fields are taken from them where they are found, so that contexts are not sorted or shuffled.
    Null pages and pages without markers have no rows."""
    ungrouped = re.sub(r"[(](?![?])", "(?:", marker)
    context = f"(?s)(?=({ungrouped}.{{0,{reach}}})){ungrouped}"
    places = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(context), F.lit(1))).alias("pos", "context"))
    near = F.substring("context", 1, reach)
    named = places.select(key, F.regexp_extract("context", marker, 1).alias(name), F.struct("pos", *[_some(F.regexp_extract(near, x, 1)).alias(f"_{i}") for i, x in enumerate(fields.values())]).alias("_place"))
    first = named.groupBy(key, name).agg(F.min("_place").alias("_place"))
    return first.select(key, name, *[F.col(f"_place._{i}").alias(n) for i, n in enumerate(fields)])


def flat_array_values(pages: DataFrame, key: str, json: Column, window: int) -> DataFrame:
    """Elements of a flat JSON array with their positions, for positional look-back."""
    return pages.select(key, F.posexplode(F.from_json(json, "array<string>")).alias("pos", "value")).withColumn("window", F.lit(window))


def decoded_products(values: DataFrame, key: str, is_id: Column, fields: dict[str, tuple[Column, int]]) -> DataFrame:
    """values (key, pos, value) of a flat array, in which a product's fields follow its id: per id each field's first value
    (a condition on `value`, and how many positions it may stand behind the nearest id)."""
    ids = values.filter(is_id & (F.col("pos") > 0)).select(key, F.col("value").alias("id")).distinct()
    for name, (is_field, back) in fields.items():
        w = Window.partitionBy(key).orderBy("pos").rowsBetween(-back, -1)
        near = values.withColumn("id", F.last(F.when(is_id & (F.col("pos") > 0), F.col("value")), ignorenulls=True).over(w)).filter(is_field & F.col("id").isNotNull())
        ids = ids.join(near.groupBy(key, "id").agg(F.min_by("value", "pos").alias(name)), [key, "id"], "left")
    return ids


#: Fixed format: the parts of a grid item that are used.
GRID = "struct<gridbox:struct<data:struct<productId:string,fullTitle:string,showBrand:boolean,brand:struct<name:string>,price:struct<price:double,oldPrice:double>,priceSecond:struct<price:double>>>>"


def grid_products(items: DataFrame, json: str, bgn_per_eur: float = 1.95583) -> DataFrame:
    """items with the product in a grid item's JSON: id, name, brand (only if it is to be shown), prices in euro and leva."""
    d = F.col("_d")
    euro = d["price"]["price"]
    rows = items.withColumn("_d", F.from_json(json, GRID)["gridbox"]["data"])
    return rows.withColumns(
        {
            "product_id": d["productId"], "name": d["fullTitle"], "brand": F.when(d["showBrand"], d["brand"]["name"]), "price_eur": euro, "old_price_eur": F.nullif(d["price"]["oldPrice"], F.lit(0.0)),
            "price_bgn": F.coalesce(d["priceSecond"]["price"], F.round(euro * bgn_per_eur, 2)),
        }
    ).drop("_d")


#: Fixed format: an offer with its price as text, deep inside.
OFFER = "struct<klNr:string,title:string,subtitle:string,prices:struct<alternative:struct<formatted:struct<standard:string,old:string>>>>"


def offer_products(offers: DataFrame, json: str) -> DataFrame:
    """offers with sku, name (title and subtitle), price and old price of an offer's JSON."""
    o = F.col("_o")
    shown = o["prices"]["alternative"]["formatted"]
    rows = offers.withColumn("_o", F.from_json(json, OFFER))
    return rows.withColumns({"sku": o["klNr"], "name": title_subtitle(o["title"], o["subtitle"]), "price": parse_price(shown["standard"]), "old_price": parse_price(shown["old"])}).drop("_o")


def priced_page(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with title, price (JSON-LD first, then inline), old price, brand, category and size, by regular expression."""
    h = F.col(html)
    one = lambda *patterns: F.coalesce(*[_some(F.trim(F.regexp_extract(h, p, 1))) for p in patterns])
    return pages.withColumns(
        {
            "title": one("(?s)<h1[^>]*>([^<]+)", "<title>([^<|]*)"),
            "price": parse_price(one(r'"price"\s*:\s*"?(\d+(?:[.,]\d+)?)', r'(?s)class="[^"]*price[^"]*"[^>]*>\s*(\d+(?:[.,]\d+)?)')),
            "old_price": parse_price(one(r'(?s)class="[^"]*old[^"]*"[^>]*>\s*(\d+(?:[.,]\d+)?)', r"(?s)<(?:s|del)>\s*(\d+(?:[.,]\d+)?)")),
            "brand": one(r'"brand"\s*:\s*(?:\{[^}]*?"name"\s*:\s*)?"([^"]+)"'),
            "category": one(r'"category"\s*:\s*"([^"]+)"'),
            "size": one(r"(?iu)(\d+(?:[.,]\d+)?\s*(?:kg|кг|g|гр|г|ml|мл|l|л))(?![\p{L}])"),
        }
    )


def label_prices(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with old_price and price of a card: prices behind the labels of the old and the new price, else the highest and
    the lowest of all prices in it."""
    h, euro = F.col(html), r"(\d+(?:[.,]\d+)?)\s*(?:€|EUR|лв)"
    behind = lambda label: parse_price(_some(F.regexp_extract(h, rf"(?isu){label}\s*</div>\s*<div[^>]*>\s*{euro}", 1)))
    every = F.transform(F.regexp_extract_all(h, F.lit(euro), F.lit(1)), lambda p: parse_price(p))
    old, new = F.coalesce(behind("old price"), F.array_max(every)), F.coalesce(behind("new price"), F.array_min(every))
    return pages.withColumns({"price": new, "old_price": F.when(old > new, old)})


def repaired_names(rows: DataFrame, patch: DataFrame, key: str, name: str = "name") -> DataFrame:
    """rows whose name is put together anew where the patch (key, title, subtitle) has one."""
    better = patch.select(key, F.nullif(F.trim(title_subtitle(F.col("title"), F.col("subtitle"))), F.lit("")).alias("_better"))
    return rows.join(better, key, "left").withColumn(name, F.coalesce("_better", name)).drop("_better")


def title_subtitle(title: Column, subtitle: Column) -> Column:
    return F.concat_ws(" ", title, subtitle)


def key_facts(html: Column) -> Column:
    """struct(features, fat, origin) from a list of key facts."""
    items = F.transform(F.regexp_extract_all(html, F.lit("<li>([^<]+)</li>"), F.lit(1)), lambda x: F.trim(x))
    fat = F.try_element_at(F.filter(items, lambda x: x.rlike(r"\d+(?:[.,]\d+)?\s*%")), F.lit(1))
    origin = F.try_element_at(F.filter(items, lambda x: F.lower(x).rlike("^(произход|origin)")), F.lit(1))
    return F.struct(items.alias("features"), fat.alias("fat"), origin.alias("origin"))
