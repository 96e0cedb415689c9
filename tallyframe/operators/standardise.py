"""Rows to standard products, rule mining, images, and reports on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import quantity, rules, text
from tallyframe.operators.relational import cap_per_key


def standard_products(raw: DataFrame, brands: list[str], categories: list[tuple[str, list[str]]], store_rules: dict[str, list[str]], default_category: str = "other") -> DataFrame:
    """raw (sku, store, name, price, old_price) as clean rows with brand, category, quantity, unit price,
    discount and error codes. A bad row keeps its errors and never fails the batch."""
    named = raw.withColumn("clean_name", text.clean_by_store(text.strip_markup(F.col("name")), F.col("store"), store_rules, []))
    typed = named.withColumn("q", quantity.parse_quantity(F.col("clean_name"))).withColumn("brand", rules.longest_brand(F.col("clean_name"), brands))
    typed = typed.withColumn("category", F.coalesce(rules.first_category(F.col("clean_name"), categories), F.lit(default_category)))
    price, old = F.col("price").try_cast("double"), F.col("old_price").try_cast("double")
    errors = rules.error_codes([("name:missing", F.length(F.coalesce("clean_name", F.lit(""))) < 3), ("price:missing", price.isNull()), ("price:range", (price <= 0) | (price > 10000)), ("discount:deep", quantity.discount_percent(old, price) > 90)])
    return typed.select(
        "sku", "store", F.col("name").alias("raw_name"), "clean_name", "brand", "category", price.alias("price"), rules.sane_old_price(price, old).alias("old_price"), F.col("q.value").alias("quantity"), F.col("q.unit").alias("unit"),
        quantity.unit_price(price, F.col("q.value"), F.col("q.unit")).alias("unit_price"), quantity.discount_percent(old, price).alias("discount"), errors.alias("errors"),
    )


def valid_text(column: Column, placeholder: str = "loading") -> Column:
    return (F.length(F.trim(column)) > 0) & ~F.startswith(F.lower(F.trim(column)), F.lit(placeholder))


def size_signs(name: Column, signs: list[str]) -> Column:
    """The size signs that occur in a name, in order; names match only if these are equal."""
    return F.filter(F.array(*[F.when(F.contains(F.lower(name), F.lit(s)), F.lit(s)) for s in sorted(signs)]), lambda s: s.isNotNull())


def ordered_prices(a: Column, b: Column, least: float = 1.0, most: float = 90.0) -> Column:
    """struct(price, old_price, discount): the larger is the old price; a discount outside the limits is none."""
    low, high = F.least(a, b), F.greatest(a, b)
    off = F.when(high > low, F.round((high - low) / high * 100, 0))
    return F.struct(low.alias("price"), F.when(high > low, high).alias("old_price"), F.when(off.between(least, most), off).alias("discount"))


def mined_words(labelled: DataFrame, label: str, name: str, most: int = 30, least: int = 2) -> DataFrame:
    """The commonest words of each label with their counts: material for keyword rules."""
    terms = labelled.select(label, F.explode(F.regexp_extract_all(F.lower(name), F.lit("[а-яa-z]{3,}"), F.lit(0))).alias("word"))
    counted = terms.groupBy(label, "word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return cap_per_key(counted, [label], [F.col("n").desc(), "word"], most)


def samples(rows: DataFrame, key: str, value: str, order: list, most: int = 3) -> DataFrame:
    """Up to `most` values of each key as an array."""
    capped = cap_per_key(rows.select(key, value, *[c for c in order if isinstance(c, str) and c not in (key, value)]), [key], order, most)
    return capped.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("samples"))


def image_of(name: Column, images: list[tuple[str, str]], default: str) -> Column:
    """The image of the first keyword in the name."""
    return F.coalesce(*[F.when(F.contains(F.lower(name), F.lit(k)), F.lit(i)) for k, i in images], F.lit(default))


def table_counts(spark: SparkSession, tables: dict[str, DataFrame | None]) -> DataFrame:
    """Rows per table; a missing one has 0."""
    parts = [t.agg(F.lit(n).alias("table_name"), F.count("*").alias("n_rows")) if t is not None else spark.range(1).select(F.lit(n).alias("table_name"), F.lit(0).cast("long").alias("n_rows")) for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def storage_report(metrics: DataFrame, warn_mb: float = 500.0, stop_mb: float = 1000.0, growth_mb: float = 50.0) -> DataFrame:
    """metrics (recorded_at, size_bytes): size, growth per day over the last week, and a level."""
    latest = metrics.agg(F.max("recorded_at")).first()[0]
    week = metrics.filter(F.col("recorded_at") >= F.lit(latest) - F.expr("INTERVAL 7 DAYS"))
    seconds = F.unix_timestamp(F.max("recorded_at")) - F.unix_timestamp(F.min("recorded_at"))
    ends = week.agg(F.max_by("size_bytes", "recorded_at").alias("size"), (F.max_by("size_bytes", "recorded_at") - F.min_by("size_bytes", "recorded_at")).alias("grown"), seconds.alias("seconds"))
    mb = ends.select((F.col("size") / 1048576).alias("size_mb"), F.coalesce(F.col("grown") / 1048576 / F.nullif(F.col("seconds") / 86400, F.lit(0.0)), F.lit(0.0)).alias("growth_mb_per_day"))
    return mb.withColumn("level", F.when(F.col("size_mb") > stop_mb, "critical").when((F.col("size_mb") > warn_mb) | (F.col("growth_mb_per_day") > growth_mb), "warning").otherwise("ok"))
