"""What nearly all rows differ in is left to the end: as many rows of classes as their other columns ask for, results as of all pairs."""

import random

from pyspark.sql import functions as F
from test_classes import rows_made

from tallyframe.operators import matching

PRODUCT = "id long, store long, category string, name string, brand string, quantity double, unit string, price double"


def products(n):
    """Products of one category, no two of the same price, quantity and brand."""
    draw = random.Random(n)
    return [(i, i % 2, "tools", draw.choice(["red bolt", "old red bolt"]), draw.choice(["acme", "acmes", "nord", None]), draw.choice([None, 1.0, 1.1, 5.0]) if i % 3 else None, "kg", 100 + i / 8) for i in range(n)]


def test_sign_match_meets_few_classes(spark):
    """400 products of distinct prices made 400 classes and all their pairs before."""
    from test_matchers_sources import ratio

    rows, want = products(400), {}
    for p in rows:
        for q in rows:
            if p[0] < q[0] and p[1] != q[1] and (q[7] - p[7]) / p[7] * 100 <= 30 and (not p[5] or not q[5] or 0.8 <= p[5] / q[5] <= 1.2):
                n, m = ratio(p[3], q[3]), ratio(p[4], q[4]) if p[4] and q[4] else 0
                if m >= 0.85 or n >= 0.9:
                    want[p[0], q[0]] = (round(0.3 * m + 0.7 * n, 9), "brand+name") if m >= 0.85 else (round(n, 9), "name_only")
    df = matching.sign_match(spark.createDataFrame(rows, PRODUCT), ["red"], 0.9, 30.0)
    assert {(r.a, r.b): (round(r.score, 9), r.method) for r in df.collect()} == want and len(want) > 5000
    # the last two are the expansions
    assert max(sorted(rows_made(df))[:-2]) <= 100


def test_tenths_are_rounded_as_by_decimals(spark):
    """F1, F8: the quick way gives what F.round does, in the middle of two tenths too."""
    values = [i / 1000 for i in range(0, 100_001, 7)] + [i / 20 for i in range(2001)] + [0.05 + 1e-9, 0.25 - 1e-12, 33.35, 100.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.filter(matching._tenths(F.col("v")) != F.round("v", 1)).count() == 0


def test_ratio_match_meets_few_classes(spark):
    """F8: pairs of classes were written, and where prices differ they are as many as the pairs."""
    rows = products(300)
    df = matching.ratio_match(spark.createDataFrame(rows, PRODUCT), 0.9, 30.0)
    near = lambda p, q: (q[7] - p[7]) / p[7] * 100 <= 30 and (not p[5] or not q[5] or 0.8 <= p[5] / q[5] <= 1.2)
    assert {(r.a, r.b) for r in df.collect()} == {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and p[1] != q[1] and p[3] == q[3] and near(p, q)}
    assert max(sorted(rows_made(df))[:-2]) <= 100


def test_first_and_count_compares_sizes(spark):
    """900 rows of a block made all their pairs before. Keys of several rows, and sizes or blocks that are missing."""
    draw = random.Random(6)
    rows = [(i if i % 50 else 7, draw.choice(["x", "y", None]), draw.choice([None, 0.0, 1.0, 1.2, 5.0, 6.0])) for i in range(900)] + [(1000, "z", 1.0), (1000, "z", 1.0), (1001, "w", 1.0), (1002, "w", 9.0)]
    df = spark.createDataFrame(rows, "id long, block string, size double")
    fits = lambda x, y: (x >= 0.8 * y) & (x <= 1.2 * y)
    pairs = matching.blocked_pairs(df, df, ["block"], "id", (F.col("l.id") != F.col("r.id")) & fits(F.col("l.size"), F.col("r.size")))
    want = pairs.groupBy("l.id").agg(F.min("r.id"), F.count("*"))
    got = matching.first_and_count(df, ["block"], "id", "size", fits)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() > 400
    assert max(rows_made(got)) <= 900


def test_like_prices_leave_few_classes(spark):
    """a price of its own made each part a class before; far, missing and free prices stay."""
    rows = [(i, "n", 100 + i / 9) for i in range(900)] + [(900, "n", None), (901, "n", 0.0), (902, "far", 1.0), (903, "far", 2.6), (904, None, 5.0)]
    got = {r.id: r.price for r in matching.like_prices(spark.createDataFrame(rows, "id long, block string, price double"), ["block"], "price", 2.5).collect()}
    assert got == {i: 100.0 if i < 900 else p for i, _, p in rows}


def sides(spark, n, names, brands):
    """Products and catalogue rows of few names and many sizes; some names, brands and sizes are missing."""
    draw = random.Random(n)
    row = lambda i: (i, draw.choice(names), draw.choice(brands), draw.choice([None, *range(1, 40)]), None)
    p, o = [row(2 * i) for i in range(n)], [row(2 * i + 1) for i in range(n)]
    kinds = "{0}id long, {0}name string, {0}brand string, {0}size double, {0}barcode string"
    real = lambda rows: [(*r[:3], None if r[3] is None else float(r[3]), r[4]) for r in rows]
    return real(p), real(o), spark.createDataFrame(real(p), kinds.format("")), spark.createDataFrame(real(o), kinds.format("off_"))


def test_api_best_meets_names_once(spark):
    """600 products met all catalogue rows of their brand before."""
    from test_matchers_sources import ratio

    from tallyframe.operators import phases

    p, o, products, catalogue = sides(spark, 600, ["red ring", "ring red", "old blue bolt", ""], ["acme", "nord", None])
    words, want = lambda n: {w for w in n.split() if len(w) > 2}, {}
    for a in p:
        scores = []
        for b in o:
            if a[2] is not None and a[2] == b[2]:
                apart = max(a[3], b[3]) / min(a[3], b[3]) if a[3] and b[3] else 9
                scores.append((-(0.4 + min(0.1 * len(words(a[1]) & words(b[1])), 0.4) + (0.2 if apart <= 1.1 else 0.1 if apart <= 1.5 else 0) + 0.2 * ratio(a[1], b[1])), b[0]))
        if scores and -min(scores)[0] >= 0.55:
            want[a[0]] = min(scores)
    got = phases.api_best(products, catalogue)
    assert {r.id: (-r.score, r.off_id) for r in got.collect()} == want and len(want) > 300
    assert max(rows_made(got)) <= 12_000


def test_fast_match_meets_names_once(spark):
    """as the form with caps that cut nothing, which meets all rows of a token or brand."""
    none = {"token_cap": 10**9, "brand_cap": 10**9, "spelling_cap": 10**9}
    for names, brands in ((["red ring", "ring red", "old blue bolt", "blue bolts", "zinc", "x", None], ["acme", "acme foods", "nord", "nort", "zz", None]), (["old blue bolt of brass", "bluish bolts bolt", "blue", "green of"], [None])):
        _, _, p, o = sides(spark, 300, names, brands)
        got = matching.fast_match(p, o)
        want = sorted(tuple(r) for r in matching.fast_match(p, o, **none).collect())
        assert sorted(tuple(r) for r in got.collect()) == want and want
        assert max(rows_made(got)) <= 5000
    plain = p.drop("brand"), o.drop("off_brand")
    assert sorted(tuple(r) for r in matching.fast_match(*plain).collect()) == sorted(tuple(r) for r in matching.fast_match(*plain, **none).collect())


def test_expansion_holds_one_keys_pairs(spark):
    """F5, F7, F9 to F13: both expansions were one compiled stage, which holds all rows that it makes of two classes. No partitions are joined for it."""
    met = spark.range(12, numPartitions=6).select(F.sequence(F.lit(0), "id").alias("_a"), F.sequence(F.col("id"), F.lit(12)).alias("_b"), (F.col("id") * 2).alias("s"))
    got = matching.each_two(met)
    assert sorted(tuple(r) for r in got.collect()) == sorted((a, b, 2 * i) for i in range(12) for a in range(i + 1) for b in range(i, 13))
    assert got.rdd.getNumPartitions() == 6
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert [x for x in ("Generate", "Coalesce") for _ in range(plan.count(x))] == ["Generate", "Generate", "Coalesce"]
    assert plan.index("Generate explode(_b") < plan.index("Coalesce") < plan.index("Generate explode(_a")
