"""Price history: change detection, validity intervals, upserts, delisting, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def price_changes(prices: DataFrame, keys: list[str], order: list, price: str, tolerance) -> DataFrame:
    """Each observation with the one before, the difference, and whether it differs by more than the tolerance."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return prices.withColumn("previous", F.lag(price).over(w)).withColumn("change", F.col(price) - F.col("previous")).withColumn("changed", F.coalesce(F.abs("change") > tolerance, F.lit(False)))


def validity_intervals(prices: DataFrame, keys: list[str], order: list, price: str, at: str, least) -> DataFrame:
    """Versions of a price: a new one begins where it differs by `least` or more from the
    observation before; valid_to is the next version's start, null for the current one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(price).over(w)
    starts = prices.withColumn("_before", before).filter(F.col("_before").isNull() | (F.abs(F.col(price) - F.col("_before")) >= least))
    return starts.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w)).drop("_before")


def classify_sync(current: DataFrame, incoming: DataFrame, keys: list[str], price: str, tolerance, spike: float = 1.0) -> DataFrame:
    """incoming with the known price and an outcome: new, increase, decrease or unchanged, and whether it is a spike."""
    known = current.select(*keys, F.col(price).alias("known_price"))
    difference = F.col(price) - F.col("known_price")
    outcome = F.when(F.col("known_price").isNull(), "new").when(F.abs(difference) <= tolerance, "unchanged").when(difference > 0, "increase").otherwise("decrease")
    return incoming.join(known, keys, "left").withColumn("outcome", outcome).withColumn("spike", F.coalesce(F.abs(difference) > spike * F.col("known_price"), F.lit(False)))


def delisted(seen: DataFrame, keys: list[str], group: list[str], at: str, days: int) -> DataFrame:
    """Keys last seen more than so many days before their group's latest observation."""
    last = seen.groupBy(*keys).agg(F.max(at).alias("last_seen"))
    latest = seen.groupBy(*group).agg(F.max(at).alias("latest"))
    return last.join(latest, group).filter(F.col("last_seen") < F.col("latest") - F.expr(f"INTERVAL {days} DAYS"))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Full merge: new values win where they are not null; `action` tells kept, updated or inserted."""
    t, s = target.select(*keys, *columns).alias("t"), source.select(*keys, *columns).alias("s")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    merged = t.withColumn("_t", F.lit(True)).alias("t").join(s.withColumn("_s", F.lit(True)).alias("s"), on, "full")
    action = F.when(F.col("_t").isNull(), "inserted").when(F.col("_s").isNull(), "kept").otherwise("updated")
    return merged.select(*[F.coalesce(f"t.{k}", f"s.{k}").alias(k) for k in keys], *[F.coalesce(f"s.{c}", f"t.{c}").alias(c) for c in columns], action.alias("action"))


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target and those rows of source whose key it lacks (source keys are unique)."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti"))


def fill_missing(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str], empty: str | None = "") -> DataFrame:
    """Missing values of target from source: null, and `empty` where given."""
    s = source.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    own = lambda c: F.nullif(F.col(c), F.lit(empty)) if empty is not None else F.col(c)
    joined = target.join(s, keys, "left")
    return joined.withColumns({c: F.coalesce(own(c), F.col(f"_new_{c}"), F.col(c)) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def split_retention(df: DataFrame, at: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, archived) rows."""
    return df.filter(F.col(at) >= cutoff), df.filter(F.col(at) < cutoff)


def price_statistics(prices: DataFrame, keys: list[str], at: str, price: str, as_of: Column, deal: float = 0.25) -> DataFrame:
    """Averages of the last 30 and 90 days, extremes, volatility, trend per day, and the price below which an offer is a
    deal (`deal` of the way from the lowest to the average), per key."""
    since = lambda days: F.col(at) > as_of - F.expr(f"INTERVAL {days} DAYS")
    day = F.unix_date(F.col(at).cast("date")).cast("double")
    return prices.filter(F.col(at) <= as_of).groupBy(*keys).agg(
        F.avg(F.when(since(30), F.col(price))).alias("avg_30d"),
        F.avg(F.when(since(90), F.col(price))).alias("avg_90d"),
        F.min(price).alias("min_ever"),
        F.max(price).alias("max_ever"),
        F.stddev_samp(price).alias("volatility"),
        F.regr_slope(F.col(price), day).alias("trend"),
        (F.min(price) + (F.avg(price) - F.min(price)) * deal).alias("deal_threshold"),
    )


def current_versions(rows: DataFrame, versions: DataFrame, keys: list[str], valid_to: str = "valid_to") -> DataFrame:
    """rows with the version that is valid now, if they have one."""
    return rows.join(versions.filter(F.col(valid_to).isNull()).drop(valid_to), keys, "left")


def touch(target: DataFrame, seen: DataFrame, keys: list[str], first: str = "first_seen", last: str = "last_seen") -> DataFrame:
    """target after another sight of some keys: the first time seen stays the earliest, the last becomes the latest; new keys are added."""
    both = target.select(*keys, first, last).unionByName(seen.select(*keys, first, last))
    return both.groupBy(*keys).agg(F.min(first).alias(first), F.max(last).alias(last))


def insert_replace(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """source and those rows of target whose key it lacks (source keys are unique)."""
    return source.unionByName(target.join(source.select(*keys), keys, "left_anti"))
