"""Windows over keys of any size. A plain window sorts all rows of a key in one task; here the rows are dealt by ranges of keys and
order, each range is summarised, and what a key brings into a range from the ranges before it is carried in.

All need an order that is total within a key; rows equal in it may be taken either way round. Null keys and null order columns are values as
in any sort. The columns of df are kept; names that begin with `_r_` are used meanwhile and must not be among them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyframe.session import materialize


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with the number of its range, `_r_range`, growing with (keys, order). Written once, so that all that is made from it sees the
    same ranges."""
    taken = [c for c in df.columns if c.startswith("_r_")]
    if taken:
        raise ValueError(f"names in use: {taken}")
    return materialize(df.repartitionByRange(*keys, *order).withColumn("_r_range", F.spark_partition_id()), "ranges")


def _carried(rows: DataFrame, summaries: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with the columns of their key's and range's summary, null without one. Only a key that begins in an earlier range has a
    summary, and a range has one such key at most: there are fewer summaries than ranges, whatever the data."""
    s = summaries.select(F.col("_r_range").alias("_r_at"), *[F.col(k).alias(f"_r_key{i}") for i, k in enumerate(keys)], *columns)
    same = [F.col("_r_range") == F.col("_r_at")] + [F.col(k).eqNullSafe(F.col(f"_r_key{i}")) for i, k in enumerate(keys)]
    return rows.join(F.broadcast(s), reduce(lambda a, b: a & b, same), "left").drop("_r_at", *[f"_r_key{i}" for i in range(len(keys))])


def _numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    sizes = rows.groupBy(*keys, "_r_range").agg(F.count("*").alias("_r_rows"))
    before = Window.partitionBy(*keys).orderBy("_r_range").rowsBetween(Window.unboundedPreceding, -1)
    summaries = sizes.withColumn("_r_before", F.sum("_r_rows").over(before)).filter("_r_before IS NOT NULL")
    inside = F.row_number().over(Window.partitionBy(*keys, "_r_range").orderBy(*order))
    numbered = _carried(rows.withColumn("_r_inside", inside), summaries, keys, ["_r_before"])
    return numbered.withColumn(name, F.coalesce("_r_before", F.lit(0)) + F.col("_r_inside")).drop("_r_before", "_r_inside")


def placed(df: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """df with the place of each row within its key, from 1. No keys: within all rows."""
    return _numbered(dealt(df, keys, order), keys, order, name).drop("_r_range")


def framed(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, Callable[[WindowSpec], Column]], reach: int, ahead: int = 0, block: int = 100_000) -> DataFrame:
    """df with window functions whose frames reach at most `reach` rows back and `ahead` rows on; a column is a function of the ordered
    window, as `lambda w: F.avg("x").over(w.rowsBetween(-19, 0))`, or with F.lag and F.lead. Keys are cut into blocks of so many rows, to which
    the rows in reach of their edges are added and afterwards taken away."""
    if block < max(reach, ahead):
        raise ValueError("a block must hold the rows that a frame reaches")
    rows = _numbered(dealt(df, keys, order), keys, order, "_r_place").drop("_r_range").withColumn("_r_place", F.col("_r_place") - 1)
    own, at = (F.col("_r_place") / block).cast("long"), F.col("_r_place") % block
    copy = lambda shift, when: F.when(when, F.struct((own + shift).alias("block"), F.lit(False).alias("own")))
    places = F.array_compact(F.array(F.struct(own.alias("block"), F.lit(True).alias("own")), copy(1, at >= block - reach), copy(-1, (at < ahead) & (own > 0))))
    spread = rows.withColumn("_r_in", F.explode(places)).withColumn("_r_block", F.col("_r_in.block")).withColumn("_r_own", F.col("_r_in.own"))
    window = Window.partitionBy(*keys, "_r_block").orderBy("_r_place")
    found = spread.withColumns({name: f(window) for name, f in columns.items()})
    return found.filter("_r_own").drop("_r_in", "_r_block", "_r_own", "_r_place")


def streaks(df: DataFrame, keys: list[str], order: list[str], failed: Column, name: str = "streak") -> DataFrame:
    """df with how many failures in a row end at each row; a null is no failure. A range brings on what its key's last
    failures amount to: its own trailing ones if it has a success, else all of its rows on top of what came before."""
    cut = dealt(df, keys, order).withColumn("_r_bad", F.coalesce(failed, F.lit(False)).cast("long"))
    upto = Window.partitionBy(*keys, "_r_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.withColumn("_r_island", F.sum(1 - F.col("_r_bad")).over(upto))
    inside = Window.partitionBy(*keys, "_r_range", "_r_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_r_streak", F.sum("_r_bad").over(inside))

    # The last island's longest streak is the one that the range ends with.
    ends = rows.groupBy(*keys, "_r_range").agg(F.max(F.struct("_r_island", "_r_streak")).alias("_r_end"))
    key = Window.partitionBy(*keys).orderBy("_r_range")
    lives = ends.withColumn("_r_life", F.sum((F.col("_r_end._r_island") > 0).cast("long")).over(key.rowsBetween(Window.unboundedPreceding, 0)))
    life = Window.partitionBy(*keys, "_r_life").orderBy("_r_range").rowsBetween(Window.unboundedPreceding, 0)
    summaries = lives.withColumn("_r_total", F.sum("_r_end._r_streak").over(life)).withColumn("_r_brought", F.lag("_r_total").over(key)).filter("_r_brought > 0")
    brought = F.when(F.col("_r_island") == 0, F.coalesce("_r_brought", F.lit(0))).otherwise(0)
    return _carried(rows, summaries, keys, ["_r_brought"]).withColumn(name, F.col("_r_streak") + brought).drop("_r_range", "_r_bad", "_r_island", "_r_streak", "_r_brought")
