"""Rule tables of thousands of terms against plain Python, and plans that do not grow with them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import rules
from tallyframe.operators import dictionary

WORDS = ["alpha", "beta", "gamma", "müsli", "сирене", "мляко", "x", "no", "1", "delta-force", "o'neil", "a&b"]


def plain(text):
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


@pytest.fixture(scope="module")
def table():
    draw = random.Random(7)
    terms = [" ".join(draw.choice(WORDS) + (str(draw.randrange(900)) if draw.random() < 0.7 else "") for _ in range(draw.choice([1, 1, 2, 3]))) for _ in range(10_000)]
    terms += ["", "  ", "!!", None, "Alpha", "ALPHA"]
    names = [" ".join([draw.choice(WORDS), draw.choice(terms[:500]).upper(), draw.choice(["/", "-", ", "]), draw.choice(terms[:9000]) + draw.choice(["", "s", "x1"])]) for _ in range(400)] + [None, "", "?", "alpha"]
    return terms, names


def brute(terms, name, best, stands):
    hits = [(t, i) for i, t in enumerate(terms) if t and plain(t) and stands(t, name)]
    return min(hits, key=best)[1] if hits else None


def between(term, name):
    return f" {plain(term)} " in f" {plain(name)} "


def frames(spark, terms, names):
    known = spark.createDataFrame([(t, f"v{i % 2500}", i) for i, t in enumerate(terms)], "term string, value string, ord long")
    return known, spark.createDataFrame(list(enumerate(names)), "id long, name string").withColumn("hit", F.lit("mine")).withColumn("letters", F.lit("mine"))


def test_ten_thousand_brands(spark, table):
    terms, names = table
    known, rows = frames(spark, terms, names)
    got = {r.id: r.brand for r in dictionary.with_best_term(rows, "name", known.withColumn("number", F.col("ord")), "brand", value="number").collect()}
    want = {i: None if n is None else brute(terms, n, lambda h: (-len(plain(h[0])), h[1]), between) for i, n in enumerate(names)}
    assert got == want and sum(v is not None for v in got.values()) > 300


def test_ten_thousand_terms_anywhere(spark, table):
    terms, names = table
    known, rows = frames(spark, terms, names)
    got = {r.id: r.brand for r in dictionary.with_best_term(rows, "name", known.withColumn("number", F.col("ord")), "brand", value="number", anywhere=True).collect()}
    inside = lambda t, n: t.lower() in n.lower()
    want = {}
    for i, n in enumerate(names):
        hits = [(-len(t), k) for k, t in enumerate(terms) if t and n is not None and inside(t, n)]
        want[i] = min(hits)[1] if hits else None
    assert got == want


def test_types_and_scores(spark, table):
    terms, names = table
    terms = terms[:3000]
    known, rows = frames(spark, terms, names)
    types = {r.id: r.types for r in dictionary.with_terms(rows, "name", known, "types").collect()}
    scored = {r.id: r.best for r in dictionary.with_scored_term(rows, "name", known, "best").collect()}
    for i, n in enumerate(names):
        firsts, scores, seen = {}, {}, set()
        for k, t in enumerate(terms):
            if t and n is not None and plain(t) and between(t, n):
                firsts.setdefault(f"v{k % 2500}", k)
            if t and n is not None and t.lower() in n.lower() and (k % 2500, t.lower()) not in seen:
                seen.add((k % 2500, t.lower()))
                length, first = scores.get(k % 2500, (0, k))
                scores[k % 2500] = (length + len(t), first)
        assert types[i] == sorted(firsts, key=firsts.get)
        best = min(scores.items(), key=lambda s: (-s[1][0], s[1][1])) if scores else None
        assert (scored[i] and (scored[i].value, scored[i].score)) == (best and (f"v{best[0]}", best[1][0]))


def test_small_tables_equal_the_list_functions(spark, table):
    """Where a list of brands and a table of them say the same."""
    names = table[1]
    brands = ["alpha", "beta gamma", "gamma", "Müsli", "delta", "a b"]
    known = spark.createDataFrame([(b, b, i) for i, b in enumerate(brands)], "term string, value string, ord long")
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    found = dictionary.with_best_term(rows, "name", known, "brand").withColumn("want", rules.longest_brand(F.col("name"), brands))
    assert all(r.brand == r.want for r in found.collect())


def test_plans_do_not_grow_with_the_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "some name")], "id long, name string")
    sizes = []
    for n in (10, 10_000):
        path = str(tmp_path / f"terms-{n}")
        spark.range(n).select(F.concat(F.lit("brand "), F.col("id").cast("string")).alias("term"), F.col("id").cast("string").alias("value"), F.col("id").alias("ord")).write.parquet(path)
        plan = dictionary.with_best_term(rows, "name", spark.read.parquet(path), "brand")._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(len(plan.splitlines()))
    assert sizes[0] == sizes[1] < 60


def test_empty_tables(spark):
    none = spark.createDataFrame([], "term string, value string, ord long")
    rows = spark.createDataFrame([(1, "some name"), (2, None)], "id long, name string")
    for anywhere in (False, True):
        assert [r.brand for r in dictionary.with_best_term(rows, "name", none, "brand", anywhere=anywhere).collect()] == [None, None]
    assert [r.types for r in dictionary.with_terms(rows, "name", none, "types").collect()] == [[], []]
    assert dictionary.with_best_term(rows.limit(0), "name", none, "brand").count() == 0
