"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Documents of a source are put in a fixed pseudo-random order (the digest of
seed and key). A document's virtual finish time is the cumulative size of its
source up to and with it, over the source's target; its second copy comes
one whole pass later. All copies are ordered by virtual finish time and cut
where their total passes the budget.

Nothing sorts one source, or all rows, in one task: prefix sums run inside
(source, digest bucket) groups on top of bucket totals; the cut is found from
totals of cells of virtual time, and only the one cell that holds it is
sorted. The result does not depend on either grid.

Defined results: null texts have size 0 and are never taken; null sources
are one source, last in order; a null key is digested like any other, and rows
that tie in digest are ordered by key, size and digest of the text; repeated
rows count one by one, each with copies of its own; very long texts are counted
whole, one row at a time, and not moved; an empty table stays empty. Columns that are named like those
added stay, and the added ones get underscores.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.arrow import free_names
from tallyframe.session import materialize

#: Words of the contract: anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixRules:
    """weights: dealt to the sources by code point, again and again.
    share: the budget over the total size. most: copies of a document at most.
    seed: of the order inside a source. cells: of virtual time 0 to 1."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    seed: str = "mix"
    cells: int = 4096


def source_targets(sized: DataFrame, rules: MixRules) -> DataFrame:
    """Per source: source_rank, source_size, target. One row per source, so its windows are small."""
    everything = Window.partitionBy()
    weights = F.array(*[F.lit(float(w)) for w in rules.weights])
    by_ratio = everything.orderBy("ratio", "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    from_here = everything.orderBy("ratio", "source_rank").rowsBetween(0, Window.unboundedFollowing)
    cap = F.col("source_size") * float(rules.most)
    fits = F.col("capped")
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("source_rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(weights, (F.pmod(F.col("source_rank") - 1, F.lit(len(rules.weights))) + 1).cast("int")))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(rules.share))
        .withColumn("ratio", cap / F.col("weight"))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum(cap).over(by_ratio), F.lit(0.0))) / F.sum("weight").over(from_here))
        .withColumn("capped", F.col("level") * F.col("weight") >= cap)
        .withColumn("rest", F.col("budget") - F.coalesce(F.sum(F.when(fits, cap)).over(everything), F.lit(0.0)))
        .withColumn("open_weight", F.sum(F.when(~fits, F.col("weight"))).over(everything))
        .withColumn("target", F.when(fits, cap).otherwise(F.col("rest") / F.col("open_weight") * F.col("weight")))
        .select("source", "source_rank", "source_size", "budget", "target")
    )


def _scheduled(docs: DataFrame, rules: MixRules, key: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Every row with its virtual finish time (first copy), and the sources."""
    digest = F.md5(F.concat(F.lit(rules.seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    sized = materialize(
        docs.select(
            F.col(key).alias("key"),
            F.col(source).alias("source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            digest.alias("digest"),
            F.xxhash64(F.col(text)).alias("body"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "mix-sized",
    ).withColumn("bucket", F.substring("digest", 1, 3))
    sources = materialize(source_targets(sized, rules), "mix-sources")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        sized.groupBy("source", "bucket")
        .agg(F.sum("size").alias("held"))
        .withColumn("passed", F.coalesce(F.sum("held").over(before), F.lit(0)))
        .join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .drop("of", "held", "budget")
        .withColumnsRenamed({"source": "b_source", "bucket": "b_bucket"})
    )
    inside = Window.partitionBy("source", "bucket").orderBy("digest", "key", "size", "body", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        sized.withColumn("run", F.sum("size").over(inside))
        .join(buckets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
        .withColumn("served", F.col("passed") + F.col("run"))
        .select("key", "source", "size", "digest", "body", "row", "source_rank", "source_size", "target", "served")
    )
    return materialize(placed, "mix-placed"), sources


def _copy(number) -> F.Column:
    """The place of a copy in the global order, as a comparable struct; number counts from 0."""
    finish = (F.col("served") + F.col("source_size") * number) / F.col("target")
    return F.struct(finish.alias("finish"), F.col("source_rank"), F.col("digest"), F.col("key"), F.col("size"), F.col("body"), F.col("row"), number.alias("copy"))


def _cut(placed: DataFrame, sources: DataFrame, rules: MixRules) -> F.Column | None:
    """The place of the first copy beyond the budget; None if all fit. Three single rows come to the driver."""
    budget = sources.agg(F.max("budget")).first()[0]
    if budget is None:
        return None
    copies = placed.filter("size > 0").select(F.explode(F.array(*[_copy(F.lit(i)) for i in range(rules.most)])).alias("place"))
    # virtual time 4 and later share the last cell
    cell = F.least(F.floor(F.col("place.finish") * rules.cells), F.lit(4 * rules.cells)).cast("long")
    copies = copies.withColumn("cell", cell).withColumn("words", F.col("place.size"))
    up_to = Window.partitionBy().orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    crossing = copies.groupBy("cell").agg(F.sum("words").alias("held")).withColumn("total", F.sum("held").over(up_to)).filter(F.col("total") > budget).orderBy("cell").first()
    if crossing is None:
        return None
    order = Window.partitionBy("cell").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    inside = copies.filter(F.col("cell") == crossing.cell).withColumn("total", F.sum("words").over(order) + (crossing.total - crossing.held))
    cut = inside.filter(F.col("total") > budget).agg(F.min("place").alias("cut"))
    kind = cut.schema["cut"].dataType
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cut.first().cut, kind, strict=True)])


def mix_sources(docs: DataFrame, rules: MixRules | None = None, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: key, size, source_size, target, taken, virtual_finish (of its first copy)."""
    return _mixed(docs, rules or MixRules(), key, text, source).select(F.col("key").alias(key), "size", "source_size", "target", "taken", "virtual_finish")


def _mixed(docs: DataFrame, rules: MixRules, key: str, text: str, source: str) -> DataFrame:
    """One row per row of docs: key, source, body, row, size, source_size, target, taken, virtual_finish."""
    placed, sources = _scheduled(docs, rules, key, text, source)
    cut = _cut(placed, sources, rules)
    taken = [F.when(F.lit(True) if cut is None else _copy(F.lit(i)) < cut, F.col("size")).otherwise(0) for i in range(rules.most)]
    return placed.select("key", "source", "body", "row", "size", "source_size", "target", sum(taken[1:], taken[0]).alias("taken"), (F.col("served") / F.nullif(F.col("target"), F.lit(0.0))).alias("virtual_finish"))


def mixed_documents(docs: DataFrame, rules: MixRules | None = None, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents the mix takes, with all their columns, mix_copies (number of copies) and mix_finish (the first copy's
    virtual finish time; both names with underscores where docs has such columns), range-sorted by the latter. Rows that share key, source and text are numbered on both sides, so each
    gets the copies of its own place in the order."""
    mixed = _mixed(docs, rules or MixRules(), key, text, source)
    on_key, on_source, on_body, on_nth, body, nth, n_copies, finish = free_names(docs, "_mix_key", "_mix_source", "_mix_body", "_mix_nth", "_body", "_nth", "mix_copies", "mix_finish")
    same = Window.partitionBy("key", "source", "body").orderBy("virtual_finish", "row")
    copies = mixed.withColumn(on_nth, F.row_number().over(same)).filter("taken > 0")
    copies = copies.select(F.col("key").alias(on_key), F.col("source").alias(on_source), F.col("body").alias(on_body), on_nth, F.expr("taken div size").cast("int").alias(n_copies), F.col("virtual_finish").alias(finish))
    numbered = docs.withColumn(body, F.xxhash64(F.col(text))).withColumn(nth, F.row_number().over(Window.partitionBy(key, source, body).orderBy(F.lit(0))))
    found = numbered.join(copies, F.col(key).eqNullSafe(F.col(on_key)) & F.col(source).eqNullSafe(F.col(on_source)) & (F.col(body) == F.col(on_body)) & (F.col(nth) == F.col(on_nth)))
    return found.drop(on_key, on_source, on_body, on_nth, body, nth).orderBy(finish, key)
