"""Names with the phrases of the stores around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tallyframe.functions import stores
from tallyframe.plans.catalog import register
from tallyframe.session import materialize, read_table, spread

#: What stands before and after a name; every part gets each of them, in every store.
AROUND = [
    ("", ""), ("King оферта - Супер цена - ", ""), ("KING ОФЕРТА-Само с Billa Card- ", " Billa"), ("King оферта - Нещо друго - ", " Произход - България"), ("Супер цена – ", " за 1 кг"), ("Супер цена - ", " | LIDL"),
    ("Промо ", " За 100г"), ("-25% - ", " за 1 бр."), ("25% - ", " до 3 кг на клиент днес"), ("25%- ", " от нашата пекарна"), ("Ново в Billa - Супер цена - ", "  от  деликатес"), ("Ниска цена - промо - ", " различни видове"),
    ("Продукт, маркиран със синя звезда ** ", " * валидно до 01.02.2025 *"), ("Само с Billa card - ", " Продукт маркиран със синя звезда"), ("", " от Billa пекарна избрани видове"), ("", " произход Гърция, клас 1"), ("", " от свежата витрина"), ("", "| Lidl "),
]
NAMES = ("Billa", "Lidl", "Kaufland")


def q_store_names(spark, d):
    """Each name is cleaned once in each form and store, by all cores, whichever and however many parts bear it."""
    around = F.array(*[F.struct(F.lit(i).alias("form"), F.lit(a).alias("before"), F.lit(b).alias("behind")) for i, (a, b) in enumerate(AROUND)])
    parts = read_table(spark, d, "part").select("p_partkey", "p_name", F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % 3 + 1).cast("int")).alias("store"))
    rows = spread(parts.select("p_name", "store").distinct()).select("p_name", "store", F.explode(around).alias("a"))
    raw = F.concat("a.before", "p_name", "a.behind")
    bulk = stores.bulk_size(raw)
    cleaned = rows.select(F.col("p_name").alias("_name"), F.col("store").alias("_store"), "a.form", stores.store_name(raw, F.col("store")).alias("name"), bulk.value.alias("bulk_value"), bulk.unit.alias("bulk_unit"))
    cleaned = materialize(cleaned, "store-names")
    same = F.col("p_name").eqNullSafe(F.col("_name")) & F.col("store").eqNullSafe(F.col("_store"))
    return spread(parts).join(cleaned, same).select("p_partkey", "form", "store", "name", "bulk_value", "bulk_unit")


def _chain(patterns: list[str]) -> str:
    cut = reduce(lambda sql, p: f"regexp_replace({sql}, '{p}', '', 'gi')", patterns, "raw")
    return rf"trim(regexp_replace({cut}, '\s+', ' ', 'g'))"


_BULK = [f"WHEN regexp_matches(lower(raw), '{stores.bulk_pattern(c, u)}') THEN" for c, u, _, _ in stores.BULK]
register(
    "q_store_names",
    q_store_names,
    f"""WITH a(form, before, behind) AS (VALUES {", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(AROUND))}),
 r AS (SELECT p_partkey, form, before || p_name || behind AS raw, CASE p_partkey % 3 WHEN 0 THEN 'Billa' WHEN 1 THEN 'Lidl' ELSE 'Kaufland' END AS store FROM part, a)
 SELECT p_partkey, form, store, CASE store WHEN 'Billa' THEN {_chain(stores.billa_patterns())} WHEN 'Lidl' THEN {_chain(stores.lidl_patterns())} ELSE {_chain(stores.common_patterns())} END AS name,
 CASE {" ".join(f"{w} {v}" for w, (_, _, v, _) in zip(_BULK, stores.BULK, strict=True))} END AS bulk_value, CASE {" ".join(f"{w} '{u}'" for w, (_, _, _, u) in zip(_BULK, stores.BULK, strict=True))} END AS bulk_unit FROM r""",
)
