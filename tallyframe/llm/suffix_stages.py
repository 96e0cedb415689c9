"""The difference-cover suffix sort as Spark stages.

The same steps as in suffix_sort, on rows (ctx, i, s) of symbols: the triples
at positions 1 and 2 modulo 3 are named in their order, the string of names
is ranked by recursion, and the remaining suffixes are merged in by their
first symbol and the rank behind it. Every order is a range partitioning with
running totals over the ranges, so no task holds more than its range. A rank
is the number of smaller suffixes; suffixes that agree as far as is compared
(`depth` symbols at least) share theirs.

It moves some hundred bytes a byte of text through the shuffle (see the
README for measured figures), which is why it is not the default of op1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import materialize


def running(rows: DataFrame, keys: list[str], totals: dict[str, F.Column]) -> DataFrame:
    """keys and, for each aggregate, its sum over all smaller keys."""
    grouped = rows.groupBy(*keys).agg(*[c.cast("long").alias(n) for n, c in totals.items()])
    dealt = materialize(grouped.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "stages-totals")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = dealt.groupBy("_range").agg(*[F.sum(n).alias(n) for n in totals])  # a row for each range
    earlier = earlier.select("_range", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in totals])
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.select(*keys, "_range", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(n) for n in totals])
    return summed.join(earlier, "_range").select(*keys, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in totals])


def suffix_ranks(symbols: DataFrame, depth: int) -> DataFrame:
    """(ctx, i, rank) of the suffixes of many strings; symbols: ctx, i (from 0), s (from 1)."""
    here = Window.partitionBy("ctx").orderBy("i")
    ahead = lambda c, n: F.coalesce(F.lead(c, n).over(here), F.lit(0))
    triples = symbols.select("ctx", "i", "s", ahead("s", 1).alias("s1"), ahead("s", 2).alias("s2"))
    one = {"rank": F.max(F.lit(1))}
    if depth <= 3:
        return triples.join(running(triples, ["s", "s1", "s2"], one), ["s", "s1", "s2"]).select("ctx", "i", "rank")
    # one sampled position past the end keeps the two halves of the names apart
    sizes = symbols.groupBy("ctx").agg(F.count("*").alias("n"))
    past = sizes.filter("n % 3 = 1").select("ctx", F.col("n").cast("int").alias("i"), *[F.lit(0).cast("long").alias(c) for c in ("s", "s1", "s2")])
    triples = materialize(triples.unionByName(past), "stages-triples")
    sample = triples.filter("i % 3 > 0")
    names = running(sample, ["s", "s1", "s2"], {"name": F.max(F.lit(1))})
    ones = F.expr("(n + if(n % 3 = 1, 1, 0) + 1) div 3")
    place = F.when(F.col("i") % 3 == 1, F.expr("(i - 1) div 3")).otherwise(ones + F.expr("(i - 2) div 3")).cast("int")
    named = materialize(sample.join(names, ["s", "s1", "s2"]).join(sizes, "ctx").select("ctx", "i", place.alias("j"), (F.col("name") + 1).alias("s")), "stages-names")
    below = suffix_ranks(named.select("ctx", F.col("j").alias("i"), "s"), -(-depth // 3) + 1).withColumnRenamed("i", "j")
    ranked = named.select("ctx", "i", "j").join(below, ["ctx", "j"]).select("ctx", "i", (F.col("rank") + 1).alias("r"))
    whole = triples.join(ranked, ["ctx", "i"], "left").select("ctx", "i", "s", "s1", "r", ahead("r", 1).alias("r1"), ahead("r", 2).alias("r2"))
    whole = materialize(whole, "stages-ranked")
    kind = lambda k: F.count_if(F.col("i") % 3 == k)
    first = running(whole.filter("i % 3 < 2"), ["s", "r1"], {"a0": kind(0), "a1": kind(1)})
    second = running(whole.filter("i % 3 <> 1"), ["s", "s1", "r2"], {"b0": kind(0), "b2": kind(2)})
    own = running(whole.filter("r is not null"), ["r"], {"own": F.count("*")})
    joined = whole.join(first, ["s", "r1"], "left").join(second, ["s", "s1", "r2"], "left").join(own, ["r"], "left").join(sizes, "ctx").filter("i < n")
    rank = F.when(F.col("i") % 3 == 0, F.col("a0") + F.col("a1") + F.col("b2")).when(F.col("i") % 3 == 1, F.col("own") + F.col("a0")).otherwise(F.col("own") + F.col("b0"))
    return joined.select("ctx", "i", rank.alias("rank"))


def staged_marks(contexts: DataFrame, length: int) -> DataFrame:
    """(id, start, mask) for contexts (id, start, context): bit i is set if the `length` bytes at i also start earlier."""
    held = materialize(contexts.select(F.monotonically_increasing_id().alias("ctx"), "id", "start", "context"), "stages-contexts")
    byte = F.transform(F.sequence(F.lit(1), F.octet_length("context")), lambda p: F.conv(F.hex(F.substr("context", p, F.lit(1))), 16, 10).cast("long") + 1)
    symbols = held.select("ctx", F.posexplode(byte).alias("i", "s"))
    ranks = suffix_ranks(symbols, length)
    prefix = F.substr(F.col("context"), F.col("i") + 1, F.lit(length))
    strings = ranks.join(held, "ctx").filter(F.col("i") + length <= F.octet_length("context")).select("ctx", "i", "rank", "id", (F.col("start") + F.col("i")).alias("at"), F.hex(prefix).alias("prefix"))
    # neighbours in the order of suffixes, also across the edges of ranges: each with the string before it
    strings = materialize(strings, "stages-strings")
    by_rank = strings.groupBy("rank").agg(F.min("prefix").alias("prefix"))  # suffixes of one rank agree on `length` bytes
    dealt = materialize(by_rank.repartitionByRange("rank").withColumn("_range", F.spark_partition_id()), "stages-order")
    last = dealt.groupBy("_range").agg(F.max_by("prefix", "rank").alias("last")).select("_range", F.lag("last").over(Window.orderBy("_range")).alias("edge"))
    before = F.coalesce(F.lag("prefix").over(Window.partitionBy("_range").orderBy("rank")), F.col("edge"))
    new = dealt.join(last, "_range").select("rank", (~before.eqNullSafe(F.col("prefix"))).cast("long").alias("new"))
    groups = running(new, ["rank"], {"upto": F.max("new")}).join(new, "rank").select("rank", (F.col("upto") + F.col("new")).alias("same"))
    placed = strings.join(groups, "rank")
    earliest = placed.groupBy("same").agg(F.min(F.struct("id", "at")).alias("first"))
    later = placed.join(earliest, "same").filter(F.struct("id", "at") != F.col("first")).select("ctx", F.expr("shiftleft(1L, i)").alias("bit"))
    masks = later.groupBy("ctx").agg(F.bit_or("bit").alias("mask"))
    return held.join(masks, "ctx", "left").select("id", "start", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
