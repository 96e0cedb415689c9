"""Groups from scored links: greedy choice, serial choice, components, validation."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import similarity
from tallyframe.operators import matching
from tallyframe.session import materialize


#: Links of a component that one task settles, at most; larger components go by rounds.
AT_ONCE = 200_000
#: Members and links of classes of a component that one task settles, at most; it holds the right keys among them.
MEMBERS_AT_ONCE = 1_000_000


def _settled(rows: DataFrame, component: str, order: list[Column], pick: Callable, schema: str, at_once: int) -> tuple[DataFrame, DataFrame]:
    """What pick gives for the rows of each component of at most at_once rows, taken in `order`, and the rows of larger ones. A task
    takes its components one after the other, so it holds what is taken of one of them at a time."""
    counted = rows.join(rows.groupBy(component).agg(F.count("*").alias("_links")), component)
    counted = materialize(counted, "settle")
    names = [c for c in rows.columns if c != component]

    def run(batches):
        taken, last = set(), None
        for batch in batches:
            found = []
            for label, *row in zip(*(batch.column(c).to_pylist() for c in (component, *names)), strict=True):
                if label != last:
                    taken, last = set(), label
                chosen = pick(row, taken)
                if chosen is not None:
                    found.append(chosen)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), batch.select(names).schema, strict=True)], names) if found else batch.select(names).slice(0, 0)

    small = counted.filter(F.col("_links") <= at_once).drop("_links").repartition(component).sortWithinPartitions(component, *order)
    return small.mapInArrow(run, schema), counted.filter(F.col("_links") > at_once).drop("_links", component)


def greedy_groups(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """edges: id, members (array of long), score. Edges are taken by score, then id; one
    keeps its members not yet taken, and counts if two or more are left. Components of edges are settled
    one by one where they have at most at_once edges, others by rounds, in each of which every edge that comes first for
    all of its free members is settled; either way equal to going through all edges. Returns id, members (those it got), score."""
    rows = edges.select("id", F.array_sort(F.array_distinct("members")).alias("members"), "score").filter(F.size("members") >= 2)
    rows = materialize(rows, "greedy-edges")
    labels = link_components(rows.select(F.element_at("members", 1).alias("a"), F.explode("members").alias("b")))
    labelled = rows.withColumn("_first", F.element_at("members", 1)).join(labels.withColumnRenamed("label", "_component"), F.col("_first") == F.col("node")).drop("_first", "node")

    def pick(row: list, taken: set) -> tuple | None:
        number, members, score = row
        free = [m for m in members if m not in taken]
        if len(free) < 2:
            return None
        taken.update(free)
        return number, free, score

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    settled, large = _settled(labelled.select("_component", *rows.columns), "_component", [F.col("score").desc(), F.col("id")], pick, kinds, at_once)
    return settled if large.isEmpty() else settled.unionByName(_greedy_rounds(large))


def greedy_similar(rows: DataFrame, key: str, block: list[str], words: str, least: float, wide: int = 1_000_000_000) -> DataFrame:
    """greedy_groups of the pairs of a block whose word sets have a Jaccard similarity over `least`, their ids key * wide + other key, smaller
    key first (keys below `wide`). Equal sets score highest, so that greedy choice pairs their rows two by two in order of keys; only one row
    that may be left of each set is compared with others."""
    alike = Window.partitionBy(*block, words).orderBy(key)
    placed = rows.filter(F.col(words).isNotNull() & (F.size(words) > 0)).dropna(subset=block).withColumn("_place", F.row_number().over(alike)).withColumn("_next", F.lead(key).over(alike))
    placed = materialize(placed.filter("_place % 2 = 1"), "greedy-places")
    edge = lambda a, b, score: ((F.col(a) * wide + F.col(b)).alias("id"), F.array(a, b).alias("members"), score.alias("score"))
    two = placed.filter("_next IS NOT NULL").select(*edge(key, "_next", F.lit(1.0)))
    single = placed.filter("_next IS NULL").select(key, *block, words)
    near = matching.similar_pairs(single, key, block, F.col(words), least)
    scored = near.select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"), similarity.jaccard(F.col(f"l.{words}"), F.col(f"r.{words}")).alias("score"))
    return two.unionByName(greedy_groups(scored.filter(F.col("score") > least).select(*edge("a", "b", F.col("score")))))


def similar_components(rows: DataFrame, key: str, block: list[str], words: str, least: float) -> DataFrame:
    """link_components of the pairs of a block whose word sets have a Jaccard similarity over `least` (below 1). Rows of equal sets
    are linked with their first one only, and sets by their first rows."""
    classes, members = matching.similar_classes(rows, key, block, F.col(words), similarity.jaccard, least)
    near = classes.filter((F.col("score") > least) & (F.col("a") <= F.col("b")))
    own = near.filter("a = b").select("a").join(members, F.col("a") == F.col("rep")).select("a", F.explode("keys").alias("b"))
    return link_components(own.filter("a <> b").union(near.filter("a < b").select("a", "b")))


def _greedy_rounds(edges: DataFrame) -> DataFrame:
    """greedy_groups by rounds."""
    taken = None
    done = []
    turn = 0
    free = materialize(edges, "greedy-0")
    while True:
        turn += 1
        rows = free.select("id", "score", F.explode("members").alias("member"))
        rank = F.row_number().over(Window.partitionBy("member").orderBy(F.col("score").desc(), "id"))
        settled = rows.withColumn("rank", rank).groupBy("id").agg(F.max("rank").alias("worst")).filter("worst = 1").select("id")
        now = materialize(free.join(settled, "id", "left_semi"), f"greedy-chosen-{turn}")
        if now.isEmpty():
            break
        done.append(now)
        taken = now.select(F.explode("members").alias("member")).distinct()
        left = free.join(settled, "id", "left_anti").select("id", "score", F.explode("members").alias("member")).join(taken, "member", "left_anti")
        free = materialize(left.groupBy("id", "score").agg(F.array_sort(F.collect_list("member")).alias("members")).filter(F.size("members") >= 2).select("id", "members", "score"), f"greedy-{turn}")
    out = edges.select("id", "members", "score").limit(0)
    for part in done:
        out = out.unionByName(part)
    return out


def serial_choice(candidates: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """candidates: left, right (whole numbers), score. Lefts choose in order the best right still free (then the
    smallest). Components of candidates are settled one by one where they have at most at_once rows, others by
    rounds of deferred acceptance: every left proposes to its best right that no smaller left holds; the same
    result. Returns left, right, score."""
    rows = materialize(candidates.select("left", "right", "score"), "serial-all")
    labels = link_components(rows.select((F.col("left") * 2).alias("a"), (F.col("right") * 2 + 1).alias("b")))
    labelled = rows.join(labels.withColumnRenamed("label", "_component"), F.col("left") * 2 == F.col("node")).select("_component", *rows.columns)

    def pick(row: list, taken: set) -> tuple | None:
        left, right, _ = row
        if ("left", left) in taken or right in taken:
            return None
        taken.update((("left", left), right))
        return tuple(row)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    settled, large = _settled(labelled, "_component", [F.col("left"), F.col("score").desc(), F.col("right")], pick, kinds, at_once)
    return settled if large.isEmpty() else settled.unionByName(_serial_rounds(large))


def serial_choice_by_class(links: DataFrame, lefts: DataFrame, rights: DataFrame, at_once: int = MEMBERS_AT_ONCE) -> DataFrame:
    """serial_choice of the members of classes. links: left, right (classes, by their smallest keys), score; lefts, rights: members as of
    matching.represented. Members of a class are taken in order of keys, so that a task keeps only how far each right class
    is taken, and pairs of members are never made. Components of more than at_once members and links go by pairs and rounds."""
    links = materialize(links.select("left", "right", "score"), "serial-links")
    labels = materialize(link_components(links.select((F.col("left") * 2).alias("a"), (F.col("right") * 2 + 1).alias("b"))), "serial-labels")
    of = lambda c, odd: labels.filter(F.pmod("node", F.lit(2)) == odd).select(F.col("label").alias("_component"), F.floor(F.col("node") / 2).cast("long").alias(c))
    row = lambda kind, key, of_class, score: ("_component", F.lit(kind).alias("kind"), F.col(key).cast("long").alias("key"), F.col(of_class).cast("long").alias("class"), score.cast("double").alias("score"))
    chunks = lefts.select("rep", "keys").join(of("rep", 0), "rep").withColumn("kind", F.lit(2)).unionByName(rights.select("rep", "keys").join(of("rep", 1), "rep").withColumn("kind", F.lit(1)))
    linked = links.join(of("left", 0), "left")
    sizes = chunks.select("_component", F.size("keys").cast("long").alias("n")).union(linked.select("_component", F.lit(1).cast("long"))).groupBy("_component").agg(F.sum("n").alias("_n"))
    large = materialize(sizes.filter(F.col("_n") > at_once).select("_component"), "serial-large")
    each = chunks.select("_component", "kind", F.explode("keys").alias("key"), F.col("rep").alias("class"))
    rows = linked.select(*row(0, "left", "right", F.col("score"))).unionByName(each.select("_component", "kind", F.col("key").cast("long"), F.col("class").cast("long"), F.lit(None).cast("double").alias("score")))

    def run(batches):
        last = None
        for batch in batches:
            found = []
            for component, kind, key, of_class, score in zip(*(batch.column(c).to_pylist() for c in ("_component", "kind", "key", "class", "score")), strict=True):
                if component != last:
                    last, wished, held, at, heaps = component, {}, {}, {}, {}
                if kind == 0:
                    wished.setdefault(key, {}).setdefault(score, []).append(of_class)
                elif kind == 1:
                    held.setdefault(of_class, []).append(key)
                else:
                    if of_class not in heaps:
                        # by score, a heap of the next free key of each right class
                        heaps[of_class] = [(s, sorted((held[c][at.get(c, 0)], c) for c in classes if at.get(c, 0) < len(held[c]))) for s, classes in sorted(wished[of_class].items())]
                    choice = heaps[of_class]
                    while choice:
                        best, heap = choice[-1]
                        while heap and heap[0][0] != (now := held[heap[0][1]][at.get(heap[0][1], 0)] if at.get(heap[0][1], 0) < len(held[heap[0][1]]) else None):
                            # others have taken of this class since
                            heapq.heappop(heap) if now is None else heapq.heapreplace(heap, (now, heap[0][1]))
                        if heap:
                            right, its = heap[0]
                            at[its] = at.get(its, 0) + 1
                            found.append((key, right, best))
                            break
                        choice.pop()
            columns = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["left", "right", "score"])

    small = rows.join(large, "_component", "left_anti").repartition("_component").sortWithinPartitions("_component", "kind", "key")
    settled = small.mapInArrow(run, "left long, right long, score double")
    if large.isEmpty():
        return settled
    pairs = matching.expanded(linked.join(large, "_component").select("left", "right", "score"), lefts, "left", "right", rights)
    return settled.unionByName(_serial_rounds(pairs.select(F.col("left").cast("long"), F.col("right").cast("long"), F.col("score").cast("double"))))


def _serial_rounds(candidates: DataFrame) -> DataFrame:
    """serial_choice by rounds."""
    alive = materialize(candidates, "serial-0")
    turn = 0
    while True:
        turn += 1
        best = alive.groupBy("left").agg(F.min(F.struct((-F.col("score")).alias("low"), "right")).alias("b")).select("left", "b.right", (-F.col("b.low")).alias("score"))
        holder = best.groupBy("right").agg(F.min("left").alias("holder"))
        lost = materialize(best.join(holder, "right").filter("left <> holder").select("left", "right"), f"serial-lost-{turn}")
        if lost.isEmpty():
            return best
        alive = materialize(alive.join(lost, ["left", "right"], "left_anti"), f"serial-{turn}")


def link_components(edges: DataFrame) -> DataFrame:
    """(node, label) of undirected edges (a, b): the smallest node reachable."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct().toDF("src", "dst"), "link-edges")
    labels = materialize(both.groupBy("dst").agg(F.min("src").alias("low")).select(F.col("dst").alias("node"), F.least("dst", "low").alias("label")), "link-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("near"))
        hop = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = labels.join(near, "node").withColumn("new", F.least("label", "near")).join(hop, F.col("new") == F.col("via"), "left").select("node", "label", F.least("new", "far").alias("new"))
        step = materialize(step, f"link-{turn}")
        labels = step.select("node", F.col("new").alias("label"))
        if step.filter("label <> new").isEmpty():
            return labels


def finalise_groups(members: DataFrame, least: int = 2) -> DataFrame:
    """members: group_id, store, price. Per group its size, stores, extremes and savings; groups of
    fewer than two members or stores go."""
    low, high = F.min("price"), F.max("price")
    return (
        members.groupBy("group_id")
        .agg(F.count("*").alias("n_members"), F.array_join(F.array_sort(F.collect_set("store")), ",").alias("stores"), F.count_distinct("store").alias("n_stores"), low.alias("min_price"), high.alias("max_price"))
        .filter((F.col("n_members") >= least) & (F.col("n_stores") >= least))
        .withColumn("savings", F.col("max_price") - F.col("min_price"))
        .withColumn("suspicious", F.col("max_price") > 3 * F.col("min_price"))
    )


def integrity_violations(members: DataFrame) -> DataFrame:
    """Counts of three violations: product in several groups, group of one product, group of one store."""
    by_product = members.groupBy("product_id").agg(F.count_distinct("group_id").alias("n")).filter("n > 1").agg(F.count("*").alias("n_violations")).select(F.lit("product_in_groups").alias("rule"), "n_violations")
    sizes = members.groupBy("group_id").agg(F.count_distinct("product_id").alias("p"), F.count_distinct("store").alias("s"))
    return by_product.union(sizes.agg(F.count_if(F.col("p") < 2)).select(F.lit("single_product"), "*")).union(sizes.agg(F.count_if(F.col("s") < 2)).select(F.lit("single_store"), "*"))


def orphan_groups(groups: DataFrame, members: DataFrame, key: str = "group_id", claimed: str = "n_stores", store: str = "store") -> DataFrame:
    """Groups without members, or with other than the claimed number of stores: key, claimed, actual, problem."""
    actual = members.groupBy(F.col(key).alias("_key")).agg(F.count_distinct(store).alias("actual"))
    found = groups.join(actual, F.col(key) == F.col("_key"), "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    problem = F.when(F.col("actual") == 0, "orphan").when(F.col("actual") != F.col(claimed), "stores")
    return found.select(key, F.col(claimed).alias("claimed"), "actual", problem.alias("problem")).filter("problem is not null")


def constraint_violations(df: DataFrame, unique: list[list[str]], checks: dict[str, Column], references: dict[str, tuple[str, DataFrame, str]]) -> DataFrame:
    """(rule, n_violations) of UNIQUE keys (rows beyond the first of a key), CHECKs (rows for which they are false) and
    foreign keys (rows whose value the other table lacks; null values refer to nothing)."""
    parts = [df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_violations")).select(F.lit("unique:" + ",".join(keys)).alias("rule"), "n_violations") for keys in unique]
    parts += [df.agg(F.count_if(~rule).alias("n_violations")).select(F.lit("check:" + name).alias("rule"), "n_violations") for name, rule in checks.items()]
    for name, (column, other, key) in references.items():
        missing = df.filter(F.col(column).isNotNull()).join(other.select(F.col(key).alias("_ref")), F.col(column) == F.col("_ref"), "left_anti")
        parts.append(missing.agg(F.count("*").alias("n_violations")).select(F.lit("reference:" + name).alias("rule"), "n_violations"))
    return reduce(DataFrame.unionByName, parts)


def valid_groups(rows: DataFrame, key: str, like: str, good: Callable[[Column, Column], Column], price: str, most_ratio: float = 2.5) -> DataFrame:
    """(key, valid, n_pairs) of groups of two rows and more: valid if every pair is good by `like` and positive prices are within
    the ratio, null if no pair can be told. Pairs are made of the distinct values of `like` only, and counted by their rows."""
    paid = F.when(F.col(price) > 0, F.col(price))
    sums = rows.groupBy(key).agg(F.count("*").alias("_n"), F.count(paid).alias("_paid"), (F.max(paid) / F.min(paid)).alias("_ratio")).filter("_n > 1")
    classes = rows.groupBy(key, F.col(like).alias("_x")).agg(F.count("*").alias("_m"))
    pairs = classes.join(classes.select(key, F.col("_x").alias("_y")), key).filter(~F.col("_x").eqNullSafe(F.col("_y")) | (F.col("_m") > 1))
    bad = pairs.filter(~F.coalesce(good(F.col("_x"), F.col("_y")), F.lit(True))).select(key).distinct().withColumn("_bad", F.lit(True))
    valid = F.when(F.col("_bad") | ((F.col("_paid") > 1) & ~(F.col("_ratio") <= most_ratio)), False).when(F.col("_paid") > 1, True)
    return sums.join(bad, key, "left").select(key, valid.alias("valid"), (F.col("_n") * (F.col("_n") - 1) / 2).cast("long").alias("n_pairs"))


def repaired_groups(members: DataFrame, pairs_match: DataFrame, most_ratio: float = 2.5) -> DataFrame:
    """members (group_id, product_id, store, price) of groups after repair: members that match fewer than half of the others
    go (pairs_match: group_id, a, b, matches), then groups that are left with one store, or with prices beyond the ratio."""
    seen = pairs_match.select("group_id", F.explode(F.array("a", "b")).alias("product_id"), "matches")
    kept = seen.groupBy("group_id", "product_id").agg(F.count_if("matches").alias("yes"), F.count("*").alias("n")).filter(2 * F.col("yes") >= F.col("n")).select("group_id", "product_id")
    return _repaired(members.join(kept, ["group_id", "product_id"]), most_ratio)


def repaired_by_class(members: DataFrame, like: str, matches: Callable[[Column, Column], Column], most_ratio: float = 2.5) -> DataFrame:
    """repaired_groups where two members match by `like`, a column of members: its distinct values are paired, and the members of each counted."""
    classes = members.groupBy("group_id", F.col(like).alias("_x")).agg(F.count("*").alias("_m"))
    other = classes.select("group_id", F.col("_x").alias("_y"), F.col("_m").alias("_k"))
    # a member is none of its others
    others = F.col("_k") - F.col("_x").eqNullSafe(F.col("_y")).cast("int")
    counted = classes.join(other, "group_id").groupBy("group_id", "_x").agg(F.sum(F.when(matches(F.col("_x"), F.col("_y")), others).otherwise(0)).alias("_yes"), F.sum(others).alias("_n"))
    kept = counted.filter((F.col("_n") > 0) & (2 * F.col("_yes") >= F.col("_n"))).select(F.col("group_id").alias("_g"), "_x")
    left = members.join(kept, (F.col("group_id") == F.col("_g")) & F.col(like).eqNullSafe(F.col("_x")), "left_semi")
    return _repaired(left.drop(like), most_ratio)


def _repaired(left: DataFrame, most_ratio: float) -> DataFrame:
    """The members of groups of several stores with prices within the ratio."""
    fine = left.groupBy("group_id").agg(F.count_distinct("store").alias("s"), (F.max("price") <= most_ratio * F.min("price")).alias("ok")).filter((F.col("s") >= 2) & F.col("ok")).select("group_id")
    return left.join(fine, "group_id", "left_semi")
