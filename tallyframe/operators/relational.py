"""Filters, ranked selections, pages, windows over events: the relational surface."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import materialize


def all_of(conditions: list[Column]) -> Column:
    """Conjunction of optional filters; with none, every row passes."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def contains_text(column: Column, term: str) -> Column:
    """Substring search without regard to case; wildcards in the term are plain text."""
    return F.contains(F.lower(column), F.lit(term.lower()))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    return cap_per_key(df, keys, order, 1)


def cap_per_key(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """Up to `most` rows of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def last_values(df: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """Values of the last row of each key by a partial aggregate; nothing is sorted."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_v")).select(*keys, "_v.*")


def best_per_pair(df: DataFrame, a: str, b: str, score: str, order: list) -> DataFrame:
    """The row of the best score of each unordered pair, by a partial aggregate; `order` (columns, rising) settles ties."""
    rest = [c for c in df.columns if c not in order]
    first = F.min(F.struct(F.col(score).isNull().alias("_none"), (-F.col(score)).alias("_low_score"), *order, *[F.col(c) for c in rest])).alias("_b")
    return df.groupBy(F.least(a, b).alias("_x"), F.greatest(a, b).alias("_y")).agg(first).select(*[f"_b.{c}" for c in df.columns])


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def first_source(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of sources of falling priority; the first source with a key provides its row (which is unique per source)."""
    ranked = [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    union = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), ranked)
    return keep_first(union, keys, ["_rank"]).drop("_rank")


def moving(df: DataFrame, keys: list[str], order: list, column: Column, rows: int, name: str) -> DataFrame:
    """Average over the last `rows` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name, F.avg(column).over(w))


def failure_streaks(df: DataFrame, keys: list[str], order: list, failed: Column, name: str = "streak") -> DataFrame:
    """How many failures in a row end at each event."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    islands = df.withColumn("_failed", failed.cast("int")).withColumn("_island", F.sum(1 - F.col("_failed")).over(w))
    inside = Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn(name, F.sum("_failed").over(inside)).drop("_failed", "_island")


def nearest_before(df: DataFrame, keys: list[str], order: list, column: Column, rows: int, name: str) -> DataFrame:
    """The nearest preceding non-null value within so many rows."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-rows, -1)
    return df.withColumn(name, F.last(column, ignorenulls=True).over(w))


def coverage(df: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """Rows per key and the share of rows for which each condition holds."""
    shares = [(F.count_if(c) / F.count("*")).alias(n) for n, c in columns.items()]
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *shares)


def bucketed_counts(df: DataFrame, value: Column, limits: list[tuple[str, float]], rest: str) -> DataFrame:
    """Rows per named bucket; limits are lower bounds, highest first."""
    name = reduce(lambda c, lim: c.when(value >= lim[1], lim[0]), limits, F.when(F.lit(False), "")).otherwise(rest)
    return df.groupBy(name.alias("bucket")).agg(F.count("*").alias("n_rows"))


def active(deleted_at: Column | None = None, status: Column | None = None, flags: tuple[Column, ...] = ()) -> Column:
    """Rows that live: not deleted, of status active or none, with all flags set."""
    alive = deleted_at.isNull() if deleted_at is not None else F.lit(True)
    if status is not None:
        alive = alive & (status.isNull() | (status == "active"))
    return reduce(lambda a, b: a & F.coalesce(b.cast("boolean"), F.lit(False)), flags, alive)


def numbered(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """df with consecutive numbers from 1 in a total order. Rows are dealt by ranges and numbered inside them, on top of
    the sizes of the ranges before: no task holds them all."""
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_held")).withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0))).drop("_held")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_inside", inside).join(sizes, "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def name_prefixes(df: DataFrame, name: str, words: int = 3) -> DataFrame:
    """The distinct beginnings of names, in order, for completion while typing."""
    start = F.array_join(F.slice(F.split(F.trim(name), r"\s+"), 1, words), " ")
    return df.select(start.alias("prefix")).filter(F.length("prefix") > 0).distinct().orderBy("prefix")


def accepted_source(sources: list[tuple[str, DataFrame]], least: int, share: float = 0.5) -> DataFrame:
    """The rows of the first source that has the given share of the least number of rows, with its name; if none has, those
    of the last one (a cache). Sources are counted, not collected."""
    counts = reduce(DataFrame.unionByName, [s.agg(F.count("*").alias("held")).withColumn("_rank", F.lit(i)) for i, (_, s) in enumerate(sources)])
    enough = counts.filter((F.col("held") >= share * least) | (F.col("_rank") == len(sources) - 1)).agg(F.min("_rank").alias("_chosen"))
    rows = reduce(DataFrame.unionByName, [s.withColumns({"source_name": F.lit(n), "_rank": F.lit(i)}) for i, (n, s) in enumerate(sources)])
    return rows.join(F.broadcast(enough), F.col("_rank") == F.col("_chosen")).drop("_rank", "_chosen")  # one row

