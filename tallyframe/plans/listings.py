"""Queries on names, quantities, money and rules of listings, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import ids, quantity, rules, similarity, text
from tallyframe.operators import relational, standardise
from tallyframe.plans.catalog import register
from tallyframe.plans.names import CATEGORIES
from tallyframe.session import read_table


def _q(name: str, sql: str):
    def wrap(f):
        register(name, f, sql)
        return f

    return wrap


def _part(spark, d):
    return read_table(spark, d, "part")


def text_of(*parts):
    """Columns by name and literal texts by '=', put together; numbers as they print."""
    return F.concat(*[F.lit(p[1:]) if isinstance(p, str) and p.startswith("=") else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])


@_q("q_active_products", "SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 11 <> 0")
def q_active_products(spark, d):
    """Not deleted, of status active or none, and available; states are made from the key."""
    k = F.col("p_partkey")
    status = F.when(k % 5 == 0, "archived").when(k % 5 > 1, "active")
    return _part(spark, d).filter(relational.active(F.when(k % 7 == 0, F.current_timestamp()), status, (k % 11 != 0,))).select("p_partkey")


@_q("q_price_nulls_first", "SELECT p_partkey AS product_id, low FROM part LEFT JOIN (SELECT l_partkey, min(l_extendedprice) AS low FROM lineitem WHERE l_discount >= 0.095 GROUP BY 1) ON l_partkey = p_partkey ORDER BY low ASC NULLS FIRST, product_id LIMIT 100")
def q_price_nulls_first(spark, d):
    low = read_table(spark, d, "lineitem").filter("l_discount >= 0.095").groupBy("l_partkey").agg(F.min("l_extendedprice").alias("low"))
    priced = _part(spark, d).join(low, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("p_partkey").alias("product_id"), "low")
    return relational.page(priced, [F.col("low").asc_nulls_first(), "product_id"], 100)


@_q("q_group_ids", "SELECT p_type || ':' || p_name AS group_key, count(*) AS n_members, 'g' || row_number() OVER (ORDER BY count(*) DESC, p_type || ':' || p_name) AS group_id FROM part GROUP BY 1")
def q_group_ids(spark, d):
    groups = _part(spark, d).groupBy(F.concat_ws(":", "p_type", "p_name").alias("group_key")).agg(F.count("*").alias("n_members"))
    return relational.numbered(groups, [F.col("n_members").desc(), F.col("group_key")]).select("group_key", "n_members", text_of("=g", "n").alias("group_id"))


@_q("q_typeahead", r"SELECT DISTINCT array_to_string(string_split_regex(trim(text), '\s+')[1:3], ' ') AS prefix FROM documents WHERE length(array_to_string(string_split_regex(trim(text), '\s+')[1:3], ' ')) > 0 ORDER BY 1")
def q_typeahead(spark, d):
    return relational.name_prefixes(read_table(spark, d, "documents"), "text")


@_q(
    "q_item_rules",
    "SELECT p_partkey, CASE WHEN contains(p_name, 'screw') THEN FALSE ELSE contains(p_name, 'red') OR contains(p_name, 'bolt') END AS included, length(p_name) >= 9 AND NOT contains(p_name, 'nail') AS card, contains(p_name, 'gear') OR contains(p_name, 'blue') AS excluded, p_size % 2 = 0 OR p_size = 1 AS kilo, (p_size > 9)::INT + contains(p_name, 'red')::INT >= 2 AS bulk FROM part",
)
def q_item_rules(spark, d):
    name = F.col("p_name")
    label = text_of("p_name", "= ", "p_size", F.when(F.col("p_size") % 2 == 0, "= per kg").otherwise(""))
    return _part(spark, d).select(
        "p_partkey", rules.included(name, ["red", "bolt"], ["screw"]).alias("included"), rules.card_text(name, ["nail"], 9).alias("card"), rules.has_keyword(name, ["gear", "blue"]).alias("excluded"),
        quantity.per_kilo(label, F.col("p_size"), F.lit("kg")).alias("kilo"), quantity.is_bulk(text_of("p_name", "= ", "p_size"), [r" \d\d", "red"]).alias("bulk"),
    )


_BOUNDED = "contains(' ' || lower(p_name) || ' ', ' {0} ')"
_LONGEST = "CASE " + " ".join(f"WHEN {_BOUNDED.format(k)} THEN '{c}'" for k, c in sorted(((k, c) for c, ks in CATEGORIES for k in ks), key=lambda x: -len(x[0]))) + " END"


@_q("q_category_fallbacks", f"SELECT p_partkey, longest, fallback, coalesce(MAP {{'fasteners': '10', 'parts': '20'}}[longest], '99000000') AS code FROM (SELECT p_partkey, {_LONGEST} AS longest, CASE WHEN contains(p_name, 'bolt') THEN 'fasteners' WHEN lower(p_brand) = 'brand#12' THEN 'own' WHEN lower(p_brand) = 'brand#23' THEN 'bought' END AS fallback FROM part)")
def q_category_fallbacks(spark, d):
    longest = rules.longest_keyword_category(F.col("p_name"), CATEGORIES)
    fallback = rules.category_or_brand(F.col("p_name"), F.col("p_brand"), [("fasteners", ["bolt"])], {"brand#12": "own", "brand#23": "bought"})
    return _part(spark, d).select("p_partkey", longest.alias("longest"), fallback.alias("fallback"), rules.category_code(longest, {"fasteners": "10", "parts": "20"}).alias("code"))


@_q(
    "q_product_types",
    f"SELECT p_partkey, array_to_string(list_filter([CASE WHEN {_BOUNDED.format('bolt')} OR {_BOUNDED.format('nail')} THEN 'holding' END, CASE WHEN {_BOUNDED.format('ring')} THEN 'turning' END], lambda t: t IS NOT NULL), ',') AS types, array_to_string(list_sort(list_filter([p_size || '%', CASE WHEN {_BOUNDED.format('red')} THEN 'red' END, CASE WHEN {_BOUNDED.format('blue')} THEN 'blue' END], lambda t: t IS NOT NULL)), ',') AS variants FROM part",
)
def q_product_types(spark, d):
    types = rules.product_types(F.col("p_name"), {"holding": ["bolt", "nail"], "turning": ["ring"]})
    variants = rules.product_variants(text_of("p_name", "= ", "p_size", "= %"), ["red", "blue"])
    return _part(spark, d).select("p_partkey", F.array_join(types, ",").alias("types"), F.array_join(variants, ",").alias("variants"))


@_q("q_scan_brand", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 'Nordwind' WHEN p_partkey % 3 = 0 THEN 'Acme Tools' END AS brand FROM part")
def q_scan_brand(spark, d):
    k = F.col("p_partkey")
    scan = F.concat(F.when(k % 3 == 0, "Acme Tools").otherwise("from here"), F.lit("\nmade "), F.when(k % 2 == 1, "by NORDWIND!").otherwise("by hand"))
    return _part(spark, d).select("p_partkey", rules.brand_in_scan(scan, F.col("p_name"), ["Nordwind", "red"]).alias("brand"))


@_q("q_brand_forms", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Acme' WHEN 2 THEN lower(p_brand) WHEN 3 THEN 'ко-ла' END AS normal, CASE p_partkey % 4 WHEN 3 THEN 'Kola' END AS alias, CASE p_partkey % 4 WHEN 0 THEN 'acme ltd.' WHEN 2 THEN lower(p_brand) || ' gmbh' WHEN 3 THEN 'ко-ла' END AS known FROM part")
def q_brand_forms(spark, d):
    brand = F.element_at(F.array(F.lit("ACME® Ltd."), F.lit("Generic"), F.concat("p_brand", F.lit(" GmbH")), F.lit("Ко-ла")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _part(spark, d).select("p_partkey", rules.normal_brand(brand, {"acme": "Acme"}).alias("normal"), rules.alias_brand(brand, {"kola": "Kola"}).alias("alias"), rules.known_brand(brand).alias("known"))


@_q(
    "q_brand_resolve",
    f"SELECT p_partkey, CASE WHEN {_BOUNDED.format('red')} THEN 'Rot|alias|0.95' WHEN regexp_matches(p_name, 'b[lo]') THEN 'B|regex|0.9' WHEN {_BOUNDED.format('ring')} THEN 'ring|house|0.85' WHEN p_size % 2 = 0 THEN 'Acme Co|prefix|0.8' END AS resolved, CASE WHEN p_brand = 'Brand#12' AND {_BOUNDED.format('gear')} THEN 'gear' WHEN {_BOUNDED.format('bolt')} THEN 'bolt' WHEN {_BOUNDED.format('red')} THEN 'red' WHEN contains(p_name, 'widg') THEN 'widg' WHEN contains(p_name, 'bolt') THEN 'bolt' WHEN contains(p_name, 'red') THEN 'red' END AS housed FROM part",
)
def q_brand_resolve(spark, d):
    shown = F.concat(F.when(F.col("p_size") % 2 == 0, "Acme Co ").otherwise(""), F.col("p_name"))
    found = rules.resolve_brand(shown, {"red": "Rot"}, {"b[lo]": "B"}, ["ring"])
    housed = rules.house_then_longest(F.col("p_name"), F.col("p_brand"), {"Brand#12": ["gear"]}, ["widg", "bolt", "red"])
    return _part(spark, d).select("p_partkey", F.concat_ws("|", found["brand"], found["method"], found["confidence"].cast("string")).alias("resolved"), housed.alias("housed")).withColumn("resolved", F.nullif("resolved", F.lit("")))


@_q(
    "q_category_fit",
    f"SELECT p_partkey, n_hits, CASE WHEN n_hits > 0 THEN least(1.0::DOUBLE, n_hits * 0.3::DOUBLE + 0.5) END AS confidence, a = 'other' OR b = 'other' OR a = b AS fit FROM (SELECT p_partkey, CASE WHEN {_BOUNDED.format('bolt')} THEN 'x' ELSE 'other' END AS a, CASE WHEN {_BOUNDED.format('red')} THEN 'x' ELSE 'y' END AS b, nullif(greatest(contains(p_name, 'bolt')::INT + contains(p_name, 'red')::INT, contains(p_name, 'ring')::INT), 0) AS n_hits FROM part)",
)
def q_category_fit(spark, d):
    best = rules.scored_category(F.col("p_name"), [("x", ["bolt", "red"]), ("y", ["ring"])], weigh=False)
    a = rules.longest_keyword_category(F.col("p_name"), [("x", ["bolt"])], "other")
    b = rules.longest_keyword_category(F.col("p_name"), [("x", ["red"])], "y")
    return _part(spark, d).select("p_partkey", best["score"].alias("n_hits"), F.when(best["score"].isNotNull(), F.least(F.lit(1.0), best["score"] * 0.3 + 0.5)).alias("confidence"), rules.categories_fit(a, b).alias("fit"))


@_q(
    "q_listed_quantity",
    "SELECT p_partkey, p_size * 1000.0::DOUBLE AS first_value, greatest(p_size * 1000.0::DOUBLE, 250.0) AS max_value, p_size || 'kg' AS raw_value, CASE p_partkey % 3 WHEN 0 THEN '40.0pcs' WHEN 1 THEN '250.0g' ELSE p_size || '000.0ml' END AS named, p_size * 1000.0::DOUBLE AS largest, p_size || 'g' AS written FROM part",
)
def q_listed_quantity(spark, d):
    label = text_of("p_name", "= 250 g, ", "p_size", "= kg")
    patterns = [r"(\d+)\s*(kg)", r"(\d+)\s*(g)"]
    other = F.element_at(F.array(F.lit("set 32+8 pcs"), F.lit("fish 250-300 g"), text_of("p_size", "= l")), (F.col("p_partkey") % 3 + 1).cast("int"))
    named, raw, written = quantity.name_quantity(other), quantity.listed_quantity(label, patterns, base=False), quantity.raw_quantity(text_of("p_name", "= ", "p_size", "= g"))
    return _part(spark, d).select(
        "p_partkey", quantity.listed_quantity(label, patterns)["value"].alias("first_value"), quantity.listed_quantity(label, patterns, "max")["value"].alias("max_value"),
        F.concat(raw["value"].cast("int").cast("string"), raw["unit"]).alias("raw_value"), F.concat(named["value"].cast("string"), named["unit"]).alias("named"),
        quantity.largest_quantity(text_of("=1 g, ", "p_size", "= kg"))["value"].alias("largest"), F.concat(written["value"].cast("int").cast("string"), written["unit"]).alias("written"),
    )


@_q("q_extended_measures", "SELECT p_partkey, p_size * 30.0::DOUBLE AS area, p_size::DOUBLE AS diameter, CASE WHEN p_size % 2 = 0 THEN 60.0::DOUBLE END AS watts, 40.0::DOUBLE AS washes, 3.0::DOUBLE AS parts FROM part")
def q_extended_measures(spark, d):
    m = quantity.extended_measures(text_of("p_size", "=x30 cm Ø", "p_size", F.when(F.col("p_size") % 2 == 0, " 60 W").otherwise(""), "= 40 washes 3 parts"))
    return _part(spark, d).select("p_partkey", F.expr("1").alias("_"), m.alias("m")).select("p_partkey", "m.*")


@_q("q_spec_table", "SELECT p_partkey, p_size || ' g' AS weight, CAST(p_partkey AS VARCHAR) AS article, NULL::VARCHAR AS volume FROM part")
def q_spec_table(spark, d):
    page = text_of("=<table><tr><td>Weight:</td> <td> ", "p_size", "= g</td></tr></table><li>Article no. <b>", "p_partkey", "=</b></li>")
    return _part(spark, d).select("p_partkey", quantity.spec_table(page, {"weight": "Weight", "article": "Article no\\.", "volume": "Volume"}).alias("s")).select("p_partkey", "s.*")


@_q("q_pack_phrase", "SELECT p_partkey, p_size AS pack, p_name AS rest, p_size || ' kg' AS clean, p_size * 1000.0::DOUBLE AS value, 'g' AS unit, p_size + 8.0::DOUBLE AS added, p_size * 1.0::DOUBLE AS low FROM part")
def q_pack_phrase(spark, d):
    found, wrapped = quantity.pack_phrase(text_of("p_name", "= (", "p_size", "= pack)")), quantity.packaging(text_of("=per ", "p_size", "= KG."))
    return _part(spark, d).select("p_partkey", found["pack"].alias("pack"), found["rest"].alias("rest"), wrapped["clean"].alias("clean"), wrapped["value"].alias("value"), wrapped["unit"].alias("unit"), quantity.added_packs(text_of("p_size", "=+8 pcs")).alias("added"), quantity.range_start(text_of("p_size", "=-99 g"))["value"].alias("low"))


@_q(
    "q_money",
    """SELECT p_partkey, CAST(floor(x / 1.95583::DOUBLE * 100 + 0.5) AS BIGINT) AS euro_cents, CAST(floor(x * 1.95583::DOUBLE * 100 + 0.5) AS BIGINT) AS leva_cents, CASE WHEN p_size * 10 + 3 >= 100 THEN CAST(floor(x / (p_size * 10.0::DOUBLE + 3) * 10000 + 0.5) AS BIGINT) END AS per_100,
 floor(50 / o * 100) AS off_trunc, round(50 / o * 100) AS off_round, round_even(50 / o * 100, 0) AS off_even, CAST(floor(50 / o * 1000 + 0.5) AS BIGINT) AS off_tenths, x + 0.25 AS price, CAST(p_partkey % 90 AS INTEGER) AS off
 FROM (SELECT *, (p_partkey % 1000 + 1)::DOUBLE AS x, (p_partkey % 50 + 60)::DOUBLE AS o FROM part)""",
)
def q_money(spark, d):
    x, old = (F.col("p_partkey") % 1000 + 1).cast("double"), (F.col("p_partkey") % 50 + 60).cast("double")
    cents = lambda c, n=100: F.floor(c * n + 0.5)
    off = lambda mode: quantity.discount_percent(old, old - 50, mode)
    return _part(spark, d).select(
        "p_partkey", cents(quantity.to_euro(x)).alias("euro_cents"), cents(quantity.to_leva(x)).alias("leva_cents"), cents(quantity.price_per_100(x, F.col("p_size") * 10.0 + 3)).alias("per_100"),
        off("trunc").alias("off_trunc"), off("round").alias("off_round"), off("even").alias("off_even"), cents(off("round1"), 10).alias("off_tenths"),
        quantity.parse_price(text_of(x.cast("int"), "=,25 ЛВ.")).alias("price"), quantity.parse_discount(text_of("=-", F.col("p_partkey") % 90, "=%")).alias("off"),
    )


@_q(
    "q_price_rules",
    """SELECT p_partkey, CASE WHEN NOT bad THEN price END AS price, CASE WHEN off > 75 THEN 0.0 WHEN NOT (old > 4 * price OR old > 200 OR old > 100 AND old = floor(old)) THEN old END::DOUBLE AS old_price, CASE WHEN off > 75 THEN 0 ELSE off END::DOUBLE AS discount, NOT bad AS ok,
 CASE WHEN old > price AND old < 3 * price THEN old END AS sane_old, CASE WHEN p_partkey % 2 = 0 AND price > 50 THEN price / 100 ELSE price END AS repaired, CASE WHEN off >= 50 THEN p_name END AS confident, least(price, old) AS low, CASE WHEN price <> old THEN greatest(price, old) END AS high,
 ['sold_out', 'scheduled', 'upcoming', 'in_store'][CAST(p_partkey % 4 + 1 AS INTEGER)] AS available, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 3 = 1 ELSE FALSE END AS readable
 FROM (SELECT *, price <= 0 OR price > 200 OR price > 100 AND price = floor(price) AS bad FROM (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 250 ELSE p_size + 0.5 END::DOUBLE AS price, (p_partkey % 300)::DOUBLE AS old, (p_partkey % 100)::DOUBLE AS off FROM part))""",
)
def q_price_rules(spark, d):
    k = F.col("p_partkey")
    price, old, off = F.when(k % 5 == 0, (k % 250).cast("double")).otherwise(F.col("p_size") + 0.5), (k % 300).cast("double"), (k % 100).cast("double")
    c, pair = rules.checked_price(price, old, off), standardise.ordered_prices(price, old)
    wording = F.element_at(F.array(F.lit("Sold out!"), F.lit("from 12.10."), F.lit("Coming soon"), F.lit("now")), (k % 4 + 1).cast("int"))
    written = F.element_at(F.array(F.lit("  "), F.lit("fine"), F.lit(" Loading...")), (k % 3 + 1).cast("int"))
    return _part(spark, d).select(
        "p_partkey", c["price"].alias("price"), c["old_price"].alias("old_price"), c["discount"].alias("discount"), c["ok"].alias("ok"), rules.sane_old_price(price, old).alias("sane_old"),
        rules.cents_repaired(price, F.when(k % 2 == 0, "Lidl").otherwise("x"), F.lit(True), ["Lidl"]).alias("repaired"), rules.confident(F.col("p_name"), off, 50.0).alias("confident"), pair["price"].alias("low"), pair["old_price"].alias("high"),
        rules.availability(wording).alias("available"), standardise.valid_text(written).alias("readable"),
    )


@_q(
    "q_ids",
    """SELECT p_partkey, substring(md5(p_name), 1, 12) AS short, md5('{"p_name":"' || p_name || '","p_partkey":' || p_partkey || '}') AS content, CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size / 2.0::DOUBLE AS VARCHAR) END || ' kg' AS shown, least(power(2, p_partkey % 8), 60)::DOUBLE AS delay,
 TRUE AS jittered, CASE WHEN contains(p_name, 'red') THEN 'r.png' WHEN contains(p_name, 'bolt') THEN 'b.png' ELSE 'none.png' END AS image, array_to_string(list_filter([CASE WHEN contains(p_name, 'bolt') THEN 'bolt' END, CASE WHEN contains(p_name, 'red') THEN 'red' END], lambda x: x IS NOT NULL), ',') AS signs FROM part""",
)
def q_ids(spark, d):
    n = (F.col("p_partkey") % 8).cast("double")
    full, equal, next_ = ids.backoff_seconds(n, jitter="full", seed=1), ids.backoff_seconds(n, jitter="equal", seed=2), ids.decorrelated_backoff(n, seed=3)
    plain = ids.backoff_seconds(n)
    return _part(spark, d).select(
        "p_partkey", ids.short_id(F.col("p_name")).alias("short"), ids.content_hash(["p_partkey", "p_name"]).alias("content"), quantity.format_quantity(F.col("p_size") / 2, F.lit("kg")).alias("shown"), plain.alias("delay"),
        (full.between(0, plain) & equal.between(plain / 2, plain) & next_.between(0, 60)).alias("jittered"), standardise.image_of(F.col("p_name"), [("red", "r.png"), ("bolt", "b.png")], "none.png").alias("image"),
        F.array_join(standardise.size_signs(F.col("p_name"), ["red", "bolt"]), ",").alias("signs"),
    )


_TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@_q(
    "q_text_forms",
    f"""SELECT p_partkey, p_name || ' zed ' || p_size || ' kg 20 organic' AS squeezed, p_name || ' zed 20' AS without, substring(p_name, 1, 35) AS key, {_TITLE} AS title, p_name AS marks, p_name AS display, p_name || ' now' AS filled, CASE WHEN length(p_name) - 4 < 6 AND starts_with(p_name, 'red ') THEN p_name WHEN starts_with(p_name, 'red ') THEN substring(p_name, 5) ELSE p_name END AS scrubbed,
 {_TITLE} || '!' AS slug, p_name AS first_line, 'pack' AS rest, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Promo ' || p_name END AS by_store, '<' || p_name || '> & #' AS entities, replace(p_name, 'red', 'rot') AS terms, contains(p_name, 'я') AS cyrillic, TRUE AS latin FROM part""",
)
def q_text_forms(spark, d):
    t = text_of("=  ", "p_name", "= «Zed»\n ", "p_size", "= kg 20% organic")
    return _part(spark, d).select(
        "p_partkey", text.squeezed_name(t).alias("squeezed"), text.without_quantities(t, ["organic"]).alias("without"), text.group_key(t, ["organic", "zed"]).alias("key"), text.group_title(t, ["organic", "zed"]).alias("title"),
        text.strip_marks(text_of("=„", "p_name", "=™“ - ")).alias("marks"), text.display_name(text_of("p_name", "=\nSUPER price"), ["super price"]).alias("display"), text.normal_without(text_of("p_name", "= only now"), ["only"]).alias("filled"),
        text.scrub_with_fallback(F.col("p_name"), ["^red "], 6).alias("scrubbed"), text.slug_title(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("%21"))).alias("slug"), text.first_line(text_of("p_name", "=\nmore")).alias("first_line"),
        text.without_prefix(text_of("p_brand", "= pack"), F.col("p_brand")).alias("rest"), text.clean_by_store(text_of("=Promo ", "p_name"), F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b"), {"a": ["^promo"]}, ["sale$"]).alias("by_store"),
        text.unescape_entities(text_of("=&lt;", "p_name", "=&gt; &amp; &#35;")).alias("entities"), text.substitute_terms(F.col("p_name"), {"red": "rot"}).alias("terms"), text.has_cyrillic(F.col("p_name")).alias("cyrillic"), text.has_latin(F.col("p_name")).alias("latin"),
    )


_MAP = "MAP {{" + ", ".join(f"'{k}': '{v}'" for k, v in text.LATIN_TO_CYRILLIC.items()) + "}}"
_TO_CYR = "array_to_string(list_transform(regexp_extract_all(lower({0}), '(?s)(sht|zh|ch|sh|ts|yu|ya|.)'), lambda p: coalesce(" + _MAP + "[p], p)), '')"
_TO_LAT = "lower({0})"
for _k, _v in text.CYRILLIC_TO_LATIN.items():
    _TO_LAT = f"replace({_TO_LAT}, '{_k}', '{_v}')"
_PLAIN = "regexp_replace(regexp_replace(lower(p_name), 'red', ' ', 'g'), '\\s+', ' ', 'g')"


@_q(
    "q_translit_names",
    f"""SELECT p_partkey, c AS cyrillic, {_TO_LAT.format('c')} AS latin, array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform(string_split(p_name, ' '), lambda t: [t, CASE WHEN length(t) >= 4 THEN {_TO_CYR.format('t')} END, CASE WHEN t = 'red' THEN 'rot' END])), lambda t: t IS NOT NULL AND length(t) > 1))), ',') AS grown
 FROM (SELECT *, {_TO_CYR.format('p_name')} AS c FROM part)""",
)
def q_translit_names(spark, d):
    cyrillic = text.to_cyrillic(F.col("p_name"))
    return _part(spark, d).select("p_partkey", cyrillic.alias("cyrillic"), text.to_latin(cyrillic).alias("latin"), F.array_join(text.expand_tokens(F.split("p_name", " "), {"red": "rot"}), ",").alias("grown"))


_WORDS_OF_NAME = "list_filter(string_split(p_name, ' '), lambda t: length(t) > 1 AND t <> 'red')"


@_q(
    "q_comparison_tokens",
    f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat({_WORDS_OF_NAME}, list_transform(list_filter({_WORDS_OF_NAME}, lambda t: length(t) >= 4), lambda t: {_TO_CYR.format('t')}), CASE WHEN contains(p_name, 'ring') THEN ['hoop'] ELSE [] END))), ',') AS tokens FROM part",
)
def q_comparison_tokens(spark, d):
    """Words with their transliterations (from four letters on) and synonyms, after ranges, percents, noise and quantities are gone."""
    tokens = text.comparison_tokens(text_of("p_name", "= 250-300 g 20% offer 5 kg"), ["offer"], ["red"], {"ring": "hoop"})
    return _part(spark, d).select("p_partkey", F.array_join(tokens, ",").alias("tokens"))


@_q("q_size_spelling", "SELECT p_partkey, p_name || ' ' || p_size || '.5l ' || p_size || 'g ' || p_size || 'kg 1.5' AS spelt FROM part")
def q_size_spelling(spark, d):
    return _part(spark, d).select("p_partkey", text.normalise_size(text_of("p_name", "= ", "p_size", "=,5 Л ", "p_size", "= гр ", "p_size", "= КГ 1,5")).alias("spelt"))


@_q("q_concept_overlap", f"SELECT p_partkey, CAST(len(list_intersect(a, b)) AS DOUBLE) / greatest(len(list_distinct(list_concat(a, b))), 1) AS score FROM (SELECT p_partkey, list_distinct(string_split({_TO_LAT.format(_TO_CYR.format('p_name'))}, ' ')) AS a, list_distinct(string_split(p_name, ' ')) AS b FROM part)")
def q_concept_overlap(spark, d):
    """Names against their own transliteration: words meet by concept."""
    concepts = lambda c: F.transform(F.split(c, " "), text.concept)
    score = similarity.jaccard(F.array_distinct(concepts(text.to_cyrillic(F.col("p_name")))), F.array_distinct(concepts(F.col("p_name"))))
    return _part(spark, d).select("p_partkey", score.alias("score"))
