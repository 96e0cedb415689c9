"""Near-duplicate groups with SetSketch registers.

1. Each text gets its set of word shingles, the set's 128-bit digest and a sketch.
   Equal sets fall into one class by digest; one document stands for it.
2. Bands of register values deal the representatives into buckets.
3. Buckets of at most `pair_limit` give their pairs; larger ones give pairs
   with two pivots only (the member with most company, and the smallest).
4. Pairs whose jointly estimated similarity is far below the threshold go;
   the others are verified on the full sets, made again from the texts with 128
   bits for each shingle. Components of what holds follow.
5. Large buckets that still hold several components are not sampled: all
   their members are joined by an exact prefix filter on the rarest shingles
   (two sets of Jaccard similarity t share one of their (1-t)n+1 rarest), and
   pairs from different components are verified. This loses no link.

All pairs of a large bucket are never formed, and no step gathers a group in
one task: groups that hold over 1/`hot_parts` of the rows, of which there are
fewer than `hot_parts`, are joined by broadcast and the others by shuffle.

Defined results: null or empty texts have empty sets and link with nothing;
rows that share a key are one document, of which keep_first_of_group keeps one
row; null keys stand alone; very long texts are taken a megabyte at a time, their
hashes as a whole; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm import setsketch
from tallyframe.llm.arrow import free_names, modest_batches, small_batches, text_bytes
from tallyframe.llm.setsketch import SketchRules, WordDigests
from tallyframe.operators.grouping import link_components
from tallyframe.session import materialize


@dataclass(frozen=True)
class NearRules:
    """percent: least intersection over union. doubt: estimates this far below it are not verified
    (over five standard deviations of the estimate). pair_limit: members of a bucket that gives all its
    pairs. hot_parts: groups with more than this part of the rows are joined by broadcast."""

    sketch: SketchRules = field(default_factory=SketchRules)
    percent: int = 80
    doubt: float = 0.20
    pair_limit: int = 24
    hot_parts: int = 1000


def sketches(docs: DataFrame, rules: NearRules, key: str, text: str) -> DataFrame:
    """One row per document: id, n, h1, h2 (128-bit digest of the set), regs."""
    sketch = rules.sketch

    def run(batches):
        digests = WordDigests()
        for batch in small_batches(batches, text):
            sets = setsketch.shingle_sets(text_bytes(batch.column(text)), sketch.words, digests)
            halves = np.frombuffer(b"".join([setsketch.set_digest(s) for s in sets] or [bytes(16)]), "<i8").reshape(-1, 2)[: len(sets)]
            regs = [setsketch.registers(s[0], sketch).tobytes() if len(s[0]) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(key).cast(pa.int64()), pa.array([len(s[0]) for s in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(regs, pa.binary())], ["id", "n", "h1", "h2", "regs"])

    return modest_batches(docs).select(key, text).mapInArrow(run, "id long, n long, h1 long, h2 long, regs binary")


def bands(reps: DataFrame, rules: NearRules) -> DataFrame:
    """(key, rep), one row per band."""
    sketch = rules.sketch

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                keys = setsketch.band_keys(regs, sketch)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("rep").to_numpy(), keys.shape[1]))], ["key", "rep"])

    return reps.select("rep", "regs").mapInArrow(run, "key long, rep long")


def likely_pairs(pairs: DataFrame, reps: DataFrame, rules: NearRules) -> DataFrame:
    """The pairs (a, b) whose sketches may belong to similar sets."""
    least = rules.percent / 100 - rules.doubt
    sketch = rules.sketch

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("regs_a", "regs_b"))
                n, m = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
                yield batch.select(["a", "b"]).filter(pa.array(setsketch.joint_similarity(a, b, n, m, sketch) >= least))

    side = lambda s: reps.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"regs_{s}"))
    sized = 100 * F.least("n_a", "n_b") >= rules.percent * F.greatest("n_a", "n_b")
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(sized).select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, rules: NearRules) -> DataFrame:
    """The pairs (a, b) whose full shingle sets meet the threshold. texts: (id, text)."""
    words, percent = rules.sketch.words, rules.percent

    def run(batches):
        last, held, digests = None, None, WordDigests()
        for whole in batches:
            for batch in small_batches([whole], "text_b"):
                a, keep = batch.column("a").to_pylist(), []
                sets = setsketch.shingle_sets(text_bytes(batch.column("text_b")), words, digests)
                for i, (left, other) in enumerate(zip(a, sets, strict=True)):
                    if left != last:
                        last, held = left, setsketch.shingle_sets(text_bytes(batch.column("text_a").slice(i, 1)), words, digests)[0]
                    common = setsketch.common(held, other)
                    keep.append(100 * common >= percent * (len(held[0]) + len(other[0]) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: texts.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], spread: str, total: int, rules: NearRules) -> DataFrame:
    """rows with the columns of their group, where it is among groups (keys, held, values). Fewer than `hot_parts`
    groups can hold over 1/hot_parts of the `total` rows; those are broadcast, and their rows are dealt by `spread`."""
    values = [c for c in groups.columns if c not in keys]
    hot = groups.filter(F.col("held") * rules.hot_parts > total).withColumnsRenamed({c: f"_hot_{c}" for c in groups.columns})
    cold = groups.filter(F.col("held") * rules.hot_parts <= total).withColumnsRenamed({c: f"_cold_{c}" for c in groups.columns})
    found = rows.join(F.broadcast(hot), [rows[k].eqNullSafe(hot[f"_hot_{k}"]) for k in keys], "left")
    on = F.when(F.col("_hot_held").isNull(), F.col(keys[-1])).otherwise(F.xxhash64(spread))
    on = [F.col(k) == F.col(f"_cold_{k}") for k in keys[:-1]] + [on == F.col(f"_cold_{keys[-1]}")]
    joined = found.join(cold, on, "left").select(*rows.columns, *[F.coalesce(f"_hot_{v}", f"_cold_{v}").alias(v) for v in values])
    return joined.filter("held is not null")


def ordered(a, b) -> tuple[F.Column, F.Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def bucket_pairs(links: DataFrame, total: int, rules: NearRules) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a < b), and the (key, rep) rows of large buckets. links: key, rep, held."""
    small = links.filter(F.col("held") <= rules.pair_limit).select("key", "rep")
    close = small.join(small.withColumnRenamed("rep", "other"), "key").filter("rep < other").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    company = links.groupBy("rep").agg(F.sum("held").alias("company"))
    large = links.filter(F.col("held") > rules.pair_limit).select("key", "rep")
    rank = F.struct(F.col("company"), -F.col("rep"))
    pivots = large.join(company, "rep").groupBy("key").agg(F.count("*").alias("held"), F.array(-F.max(rank)["col2"], F.min("rep")).alias("pivots"))
    star = with_group(large, pivots, ["key"], "rep", total, rules).select("rep", F.explode("pivots").alias("pivot"))
    star = star.filter("rep <> pivot").select(*ordered(F.col("rep"), F.col("pivot")))
    return close.union(star).distinct(), large


def rare_shingle_pairs(members: DataFrame, texts: DataFrame, rules: NearRules) -> DataFrame:
    """Candidate pairs (a < b) of members (id, label) with different labels, by an
    exact prefix filter: every pair that meets the threshold is among them."""
    words, percent = rules.sketch.words, rules.percent

    def run(batches):
        digests = WordDigests()
        for whole in batches:
            for batch in small_batches([whole], "text", 1 << 20):
                sets = [s[0] for s in setsketch.shingle_sets(text_bytes(batch.column("text")), words, digests)]
                sizes = np.array([len(s) for s in sets], np.int64)
                cells = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), sizes) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int64()), pa.array(cells[1], pa.int64()), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], ["id", "label", "n", "shingle"])

    exploded = materialize(members.join(texts, "id").mapInArrow(run, "id long, label long, n long, shingle long"), "near-shingles")
    counts = exploded.groupBy("shingle", "label").agg(F.count("*").alias("held")).groupBy("shingle").agg(F.sum("held").alias("df"), F.max(F.struct("held", "label")).alias("most"), F.count("*").alias("labels"))
    counts = counts.select("shingle", "df", "labels", F.col("most.label").alias("main"))
    # a shingle of one component gives no pairs, but still takes its place in the order
    rarity = Window.partitionBy("id").orderBy("df", "shingle")
    placed = exploded.join(counts, "shingle").withColumn("place", F.row_number().over(rarity))
    prefix = placed.filter(100 * (F.col("place") - 1) <= (100 - percent) * F.col("n")).filter("labels > 1")
    prefix = materialize(prefix.select("shingle", "id", "label", "n", "place", (F.col("label") == F.col("main")).alias("in_main")), "near-prefix")
    other = prefix.select("shingle", F.col("id").alias("other"), F.col("label").alias("label_o"), F.col("n").alias("n_o"), F.col("place").alias("place_o"), F.col("in_main").alias("main_o"))
    # the rows of a shingle's main component never meet each other, and two rows meet once
    fits = (F.col("label") != F.col("label_o")) & (F.col("main_o") | (F.col("id") < F.col("other")))
    # what follows the first common shingle must suffice for the intersection that the threshold asks for
    most_common = 1 + F.least(F.col("n") - F.col("place"), F.col("n_o") - F.col("place_o"))
    fits = fits & ((100 + percent) * most_common >= percent * (F.col("n") + F.col("n_o")))
    return prefix.filter("not in_main").join(other, "shingle").filter(fits).select(*ordered(F.col("id"), F.col("other"))).distinct()


def near_groups(docs: DataFrame, rules: NearRules | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest key reachable over links)."""
    rules = rules or NearRules()
    sketched = materialize(sketches(docs, rules, key, text), "near-sketches")
    full = sketched.filter("n > 0 and id is not null")
    digest = ["n", "h1", "h2"]
    # partial minima: however many copies a class has, each task sends one row of it
    first = F.min(F.struct("id", "regs"))
    classes = materialize(full.groupBy(*digest).agg(F.count("*").alias("held"), first.alias("first")).select(*digest, "held", F.col("first.id").alias("rep"), F.col("first.regs").alias("regs")), "near-classes")
    reps = classes.select("rep", "n", "regs")
    n_docs, n_reps = classes.agg(F.coalesce(F.sum("held"), F.lit(0)), F.count("*")).first()
    rows = bands(reps, rules)
    n_bands = rules.sketch.registers // rules.sketch.rows
    held = rows.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1")
    links = materialize(with_group(rows, held, ["key"], "rep", n_reps * n_bands, rules), "near-links")
    pairs, large = bucket_pairs(links, n_reps * n_bands, rules)
    pairs = materialize(likely_pairs(pairs, reps, rules), "near-pairs")
    wanted = large.select(F.col("rep").alias("id")).union(pairs.select("a")).union(pairs.select("b")).distinct()
    texts = materialize(docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(wanted, "id"), "near-texts")
    edges = materialize(verified(pairs, texts, rules), "near-edges")
    labels = link_components(edges)
    known = large.join(labels, large.rep == labels.node, "left").select("key", F.col("rep").alias("id"), F.coalesce("label", "rep").alias("label"))
    known = materialize(known, "near-known")
    torn = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    members = materialize(known.join(torn, "key").select("id", "label").distinct(), "near-torn")
    more = materialize(verified(rare_shingle_pairs(members, texts, rules), texts, rules), "near-more")
    labels = link_components(edges.union(more))
    groups = classes.join(labels, F.col("rep") == F.col("node"), "left").select(*digest, "held", F.coalesce("label", "rep").alias("component"))
    placed = with_group(full.select("id", *digest), groups, digest, "id", n_docs, rules).select("id", "n", "component")
    alone = sketched.filter("not (n > 0 and id is not null)").select("id", "n", F.col("id").alias("component"))
    return placed.unionByName(alone).select("id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def near_duplicates(docs: DataFrame, rules: NearRules | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles, component_id, kept."""
    found = near_groups(docs, rules, key, text)
    return found.select(F.col("id").alias(key), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first_of_group(docs: DataFrame, rules: NearRules | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: the smallest key of each group, once, even where rows repeat
    (rows of one key differ in nothing the operator knows; any one of them stays). Rows with a null key all stay."""
    found = materialize(near_groups(docs, rules, key, text), "near-groups")
    gone_name, twin_name = free_names(docs, "_gone", "_twin")
    gone = found.filter("id <> component_id").select(F.col("id").alias(gone_name)).distinct()
    twins = materialize(found.filter("id = component_id").groupBy(F.col("id").alias(twin_name)).agg(F.count("*").alias("held")).filter("held > 1").select(twin_name), "near-twins")
    left = docs.join(gone, F.col(key).cast("long") == F.col(gone_name), "left_anti")
    if twins.isEmpty():
        return left
    is_twin = F.col(key).cast("long") == F.col(twin_name)
    return left.join(twins, is_twin, "left_anti").unionByName(left.join(twins, is_twin, "left_semi").dropDuplicates([key]))
