"""Pairs and choices by classes of equal rows: as many rows as the classes ask for, results as of all pairs."""

import random

from pyspark.sql import functions as F

from tallyframe.functions import similarity
from tallyframe.operators import grouping, matching, phases


def rows_made(df):
    """Rows that come out of each join and expansion of a plan that has run."""
    df.collect()
    found, waiting = [], [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            node = node.executedPlan()
        if "QueryStage" in node.nodeName():
            node = node.plan()
        made = node.metrics().get("numOutputRows")
        if made.isDefined() and ("Join" in node.nodeName() or "Generate" in node.nodeName()):
            found.append(made.get().value())
        waiting += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_first_fit_joins_classes(spark):
    """A thousand products and a thousand catalogue rows of one brand: a few pairs of sizes, not a million pairs."""
    draw = random.Random(1)
    p = [(i, "b", draw.choice([None, 1.0, 5.0, 10.0, 11.0])) for i in range(1000)]
    c = [(i, "b", draw.choice([None, 1.0, 10.0, 50.0]), -i) for i in range(1000)]
    near = lambda x, y: x is not None and y is not None and abs(x - y) <= 0.15 * max(x, y)
    want = {i: min((not near(s, t), o, k) for k, _, t, o in c) for i, _, s in p}
    df = phases.first_fit(spark.createDataFrame(p, "id long, brand string, size double"), spark.createDataFrame(c, "off_id long, off_brand string, off_size double, ord long"))
    assert {r.id: (not r.fits, r.off_id) for r in df.collect()} == {i: (w[0], w[2]) for i, w in want.items()}
    assert max(rows_made(df)) <= 1000


def test_valid_groups_pair_distinct_words(spark):
    """Five groups of 400 rows: equal to all pairs, nulls included, from a few pairs of word sets."""
    draw = random.Random(2)
    words = {"a": ["x y", "y z"], "b": ["x y"], "c": ["x y", "z w"], "d": ["x y", None], "e": ["x y"]}
    prices = {"a": [1.0, 2.0], "b": [1.0, 3.0], "c": [1.0], "d": [1.0], "e": [None, -1.0]}
    rows = [(g, draw.choice(words[g]), draw.choice(prices[g])) for g in words for _ in range(400)] + [("f", "x", 1.0)]

    def good(a, b):
        x, y = set((a[1] or "").split()), set((b[1] or "").split())
        alike = a[1] is not None and b[1] is not None and len(x & y) / len(x | y) >= 0.3
        near = max(a[2], b[2]) / min(a[2], b[2]) <= 2.5 if (a[2] or 0) > 0 and (b[2] or 0) > 0 else None
        return False if not alike or near is False else near

    want = {}
    for g in words:
        own = [r for r in rows if r[0] == g]
        told = {good(a, b) for i, a in enumerate(own) for b in own[:i]} - {None}
        want[g] = (all(told) if told else None, len(own) * (len(own) - 1) // 2)
    df = grouping.valid_groups(spark.createDataFrame(rows, "g string, name string, price double").select("g", F.split("name", " ").alias("w"), "price"), "g", "w", lambda x, y: similarity.jaccard(x, y) >= 0.3, "price")
    assert {r.g: (r.valid, r.n_pairs) for r in df.collect()} == want and {v for v, _ in want.values()} == {True, False, None}
    assert max(rows_made(df)) <= 100


def test_repaired_by_class_equals_pairs(spark):
    draw = random.Random(3)
    rows = [(g, i * 10 + g, draw.choice("ns"), draw.choice([1.0, 2.0, 9.0]), draw.choice([["x"], ["x", "y"], ["y", "z"], ["w"], None])) for g in range(4) for i in range(150 if g else 1)]
    p = spark.createDataFrame(rows, "group_id long, product_id long, store string, price double, w array<string>")
    pairs = matching.blocked_pairs(p, p, ["group_id"], "product_id").select("l.group_id", F.col("l.product_id").alias("a"), F.col("r.product_id").alias("b"), F.arrays_overlap("l.w", "r.w").alias("matches"))
    df = grouping.repaired_by_class(p, "w", F.arrays_overlap, 100.0)
    want = {tuple(r) for r in grouping.repaired_groups(p.drop("w"), pairs, 100.0).collect()}
    assert {tuple(r) for r in df.collect()} == want and 0 < len(want) < len(rows)
    assert max(rows_made(df)) <= len(rows)


def test_tier_counts_equal_pairs(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice("tu"), draw.choice(["n", "m", None]), draw.choice(["b", "c", None]), draw.choice([1.0, 10.0, 11.0, None])) for i in range(600)]
    p = spark.createDataFrame(rows, "id long, type string, name string, brand string, size double")
    tier = matching.attribute_tier(F.col("l.brand"), F.col("r.brand"), F.col("l.type"), F.col("r.type"), F.col("l.size"), F.col("r.size"))
    want = matching.blocked_pairs(p, p, ["type", "name"], "id").groupBy(tier.alias("tier")).agg(F.count("*").alias("n_pairs"))
    df = matching.tier_counts(p)
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in want.collect()} and df.count() == 4
    assert max(rows_made(df)) <= 1000


def blocks_of(draw, n):
    return [(i, draw.choice("tuv"), draw.choice(["red ring", "ring red", "red bolt", "old gear", "hot old gear", None])) for i in range(n)]


def test_pairs_by_class_score_classes_once(spark, monkeypatch):
    """Some 30,000 pairs, of which only those of distinct names are scored; equal to all pairs, also where classes and blocks are cut."""
    rows = spark.createDataFrame(blocks_of(random.Random(5), 450), "id long, block string, name string")
    words = lambda s: F.split(F.col(f"{s}.name"), " ")
    want = matching.blocked_pairs(rows, rows, ["block"], "id").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), similarity.recall(words("l"), words("r")).alias("s"))
    want = sorted(tuple(r) for r in want.fillna(-1.0).collect())
    for keys, pairs in ((1000, 20_000_000), (7, 500)):
        monkeypatch.setattr(matching, "CLASS_KEYS", keys)
        monkeypatch.setattr(matching, "TASK_PAIRS", pairs)
        got = matching.pairs_by_class(rows, rows, ["block"], "id", lambda p: p.select("*", similarity.recall(words("l"), words("r")).alias("s"))).fillna(-1.0)
        assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 30_000
    monkeypatch.undo()
    seen = []
    matching.pairs_by_class(rows, rows, ["block"], "id", lambda p: seen.append(p.count()) or p.withColumn("s", F.lit(1.0)))
    assert seen[0] <= 3 * 6 * 6


def test_similar_classes_expand_to_all_pairs(spark, monkeypatch):
    rows = spark.createDataFrame(blocks_of(random.Random(6), 300), "id long, block string, name string")
    tokens = F.split("name", " ")
    words = lambda s: F.split(F.col(f"{s}.name"), " ")
    score = similarity.jaccard(words("l"), words("r"))
    want = matching.blocked_pairs(rows, rows, ["block"], "id").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), score.alias("s")).filter("s >= 0.3")
    want = sorted(tuple(r) for r in want.collect())
    for keys, pairs in ((1000, 20_000_000), (4, 100)):
        monkeypatch.setattr(matching, "CLASS_KEYS", keys)
        monkeypatch.setattr(matching, "TASK_PAIRS", pairs)
        classes, members = matching.similar_classes(rows, "id", ["block"], tokens, similarity.jaccard, 0.3)
        assert sorted(tuple(r) for r in matching.expanded(classes, members, "a", "b").collect()) == want
        assert classes.count() <= 3 * 15


def test_greedy_similar_and_components_equal_all_edges(spark):
    """Keys beyond a million too, whose ids fell together before."""
    draw = random.Random(7)
    rows = [(i * 37_003, b, sorted(set(n.split())) if n else None) for i, b, n in blocks_of(draw, 200)]
    df = spark.createDataFrame(rows, "id long, block string, words array<string>")
    jaccard = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    edges = [(-jaccard(x[2], y[2]), x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and x[2] and y[2] and jaccard(x[2], y[2]) > 0.3]
    taken, want = set(), set()
    for low, a, b in sorted(edges):
        if not {a, b} & taken:
            taken |= {a, b}
            want.add((a, b, round(-low, 9)))
    got = grouping.greedy_similar(df, "id", ["block"], "words", 0.3)
    assert {(*r.members, round(r.score, 9)) for r in got.collect()} == want and max(b for _, b, _ in want) > 1_000_000
    links = spark.createDataFrame([(a, b) for low, a, b in edges if -low > 0.6], "a long, b long")
    found = grouping.similar_components(df, "id", ["block"], "words", 0.6)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in grouping.link_components(links).collect()}


def test_matchers_compare_classes_once(spark, monkeypatch):
    """Forty times the same products and catalogue: the same matches for all, and no more pairs compared than for one."""
    compared, best = [], matching.best_candidate
    monkeypatch.setattr(matching, "best_candidate", lambda pairs, *args: compared.append(pairs.count()) or best(pairs, *args))
    names = ["red ring", "blue bolt", "green gear", "red gear", "old bolt"]
    p = [(2 * i, n, b, 10.0, None) for i, (n, b) in enumerate((n, b) for n in names for b in ("acme", "nord"))]
    o = [(2 * i + 1, n, b, 9.5) for i, (n, b) in enumerate((n, b) for n in names for b in ("acme", "nordic"))]
    many = lambda rows: [(r[0] + 1000 * i, *r[1:]) for i in range(40) for r in rows]
    product = lambda rows: spark.createDataFrame(rows, "id long, name string, brand string, size double, barcode string")
    offer = lambda rows: spark.createDataFrame(rows, "off_id long, off_name string, off_brand string, off_size double").withColumn("off_barcode", F.lit(None).cast("string"))
    for match in (matching.multi_pass_match, matching.offline_match, phases.hybrid_match, phases.transliterated_match):
        compared.clear()
        few = {r.id: r.off_id for r in match(product(p), offer(o)).collect()}
        once = max(compared)
        got = {r.id: r.off_id for r in match(product(many(p)), offer(many(o))).collect()}
        assert got == {k + 1000 * i: v for k, v in few.items() for i in range(40)} and few
        assert max(compared[len(compared) // 2:]) == once <= 100
