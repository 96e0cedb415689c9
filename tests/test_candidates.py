"""Candidates by bounds: no pair is lost, few are compared, and results equal those of all pairs."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.operators import candidates, matching, phases, spelling
from tallyframe.sources import web

SYLLABLES = ["ma", "to", "ри", "ко", "sel", "an", "ž", "x", "mil", "k ", "bar", " 1"]


def words(seed, n, near=True):
    draw = random.Random(seed)
    found = ["".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, 9))) for _ in range(n)]
    if near:
        for w in found[: n // 2]:
            letters = list(w)
            for _ in range(draw.randint(0, 3)):
                i = draw.randrange(len(letters) + 1)
                letters[i : i + draw.randint(0, 1)] = draw.choice(["", "q", "a"])
            found.append("".join(letters))
    return [*found, "", "a", "aa", "aaaaaaaaaaaaaaaaaaaaaaaaa", "a" * 24, None]


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("least", [0.5, 0.7, 0.8, 0.85, 0.9, 0.95, 1.0])
def test_spelt_pairs_lose_none(spark, least):
    a, b = words(1, 80), words(1, 60) + words(2, 40)
    left, right = spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string")
    want = {(x, y) for x in a for y in b if x and y and ratio(x, y) >= least}
    got = [(r.a, r.b) for r in spelling.spelt_pairs(left, right, "a", "b", least).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 20


def test_bounds_spare_most_ratios(spark):
    """Pairs that reach Python, of 40,000 possible ones and of those of fitting lengths."""
    a, b = words(3, 133), words(4, 133)
    left, right = spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string")
    for least, share in ((0.7, 0.05), (0.9, 0.005)):
        sized = sum(1 for x in set(a) for y in set(b) if x and y and 2 * min(len(x), len(y)) >= least * (len(x) + len(y)))
        compared = spelling.spelt_candidates(left, right, "a", "b", least).count()
        needed = sum(1 for x in set(a) for y in set(b) if x and y and ratio(x, y) >= least)
        assert needed <= compared < share * len(a) * len(b) and compared < 0.3 * sized


def test_spelt_pairs_within_blocks(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["p", "q", None]), w) for w in words(6, 60)]
    left = spark.createDataFrame(rows, "block string, a string")
    want = {(g, x, y) for g, x in rows for h, y in rows if g is not None and g == h and x and y and ratio(x, y) >= 0.8}
    assert {(r.block, r.a, r.b) for r in spelling.spelt_pairs(left, left.withColumnRenamed("a", "b"), "a", "b", 0.8, ["block"]).collect()} == want


def test_ratio_match_equals_all_pairs(spark):
    """Products that share names, empty ones too; argument order of the ratio is by id."""
    draw = random.Random(8)
    names = [w.title() for w in words(9, 6) if w is not None] + [None]
    rows = [(i, draw.choice("ABC"), draw.choice(["x", "y", "other"]), draw.choice(names), draw.choice([None, 1.0, 1.1, 3.0]), "kg", draw.choice([0.0, 1.0, 2.0, 2.5, 9.0])) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, store string, category string, name string, quantity double, unit string, price double")
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] != b[1] and a[2] == b[2] != "other" and a[6] > 0 and b[6] > 0 and (max(a[6], b[6]) - min(a[6], b[6])) / min(a[6], b[6]) * 100 <= 200:
                r = ratio((a[3] or "").lower(), (b[3] or "").lower())
                if r >= 0.7 and (a[4] is None or b[4] is None or 0.8 <= (a[4] * 1000) / (b[4] * 1000) <= 1.2):
                    want[a[0], b[0]] = r
    got = {(r.a, r.b): r.score for r in matching.ratio_match(df).collect()}
    assert got == pytest.approx(want) and len(want) > 30


def test_blended_pairs_equal_all_pairs(spark):
    draw = random.Random(3)
    names = [" ".join(draw.choice(["red", "ring", "bolt", "rings", "мляко", "milk", "mlyako", "x1", "greenish"]) for _ in range(draw.randint(1, 4))) for _ in range(60)] + ["", "zz"]
    rows = [(i, draw.choice(names + [None]), draw.choice(["acme", "ring", None]), draw.choice("ab")) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, name string, brand string, block string").withColumn("tokens", F.filter(F.split("name", " "), lambda t: t != "")).withColumn("grams", text.ngrams(F.col("name")))
    grams = lambda n: {n[i : i + 3] for i in range(len(n) - 2)}
    latin = {r.t: r.c for r in spark.createDataFrame([(t,) for n in names for t in n.split()], "t string").distinct().select("t", text.concept(F.col("t")).alias("c")).collect()}
    concepts = lambda n: {latin[t] for t in n.split()}
    share = lambda x, y: len(x & y) / len(x | y) if x & y else 0.0
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[3] == b[3] and a[1] is not None and b[1] is not None:
                t = share(grams(a[1]), grams(b[1]))
                base = 0.6 * share(concepts(a[1]), concepts(b[1])) + 0.4 * t
                if base >= 0.3:
                    want[a[0], b[0]] = (t, base)
    got = candidates.blended_pairs(df, ["block"], "id", 0.3).select("l.id", F.col("r.id").alias("other"), "trigram", "base", "l.free", "l.brand", "l.name").collect()
    assert {(r.id, r.other): (r.trigram, r.base) for r in got} == want and len(got) == len(want) > 500
    assert all(set(r.free) == ({c for c in concepts(r.name) if c not in r.brand and r.brand not in c} if r.brand else set()) for r in got)


def test_best_by_cosine_equals_all_pairs(spark):
    draw = random.Random(11)
    vocabulary = [f"w{int(draw.paretovariate(0.7))}" for _ in range(400)]
    docs = [(i, [draw.choice(vocabulary) for _ in range(draw.randint(0, 40))]) for i in range(120)]
    docs += [(200 + i, docs[i][1]) for i in range(10)]
    items = [(i, draw.sample(docs[i][1], len(docs[i][1]) // 2) + [draw.choice(vocabulary)] * draw.randint(0, 3)) for i in range(60)] + [(900, ["w1"] * 3), (901, ["nowhere"]), (902, [])]
    weights = lambda rows, key: spark.createDataFrame(rows, f"{key} long, t array<string>")
    d, q = weights(docs, "doc"), weights(items, "item")
    counts = matching.token_counts(d, "doc", F.col("t"))
    idf = matching.inverse_frequencies(counts, "doc", len(docs)).select("token", "idf")
    left, right = matching.tfidf_weights(q, "item", F.col("t"), idf), matching.weighted(counts, "doc", idf)
    pairs = matching.cosine_pairs(left, right, "item", "doc")
    for scale in (10000, 100):
        want = matching.best_candidate(pairs.withColumn("cosine", F.floor(F.col("cosine") * scale + 0.5).cast("long")), "item", "doc", "cosine")
        for seeds in (1, 3):
            assert sorted(map(tuple, candidates.best_by_cosine(left, right, "item", "doc", scale, seeds).collect())) == sorted(map(tuple, want.collect()))


def unit(x):
    return x / np.sqrt((x * x).sum())


@pytest.mark.parametrize("size", [4, 16, 1024])
def test_nearest_equals_all_pairs(spark, size):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(6, 8))
    vectors = [centres[i % 6] + draw.normal(size=8) * 0.3 for i in range(150)]
    vectors[20] = vectors[21] = vectors[23]
    rows = [(i, "pq"[i % 7 == 0], [float(x) for x in v]) for i, v in enumerate(vectors)] + [(500, "p", None), (501, "p", [0.0] * 8), (502, "p", [float("nan")] * 8), (503, "p", [1.0, None] * 4), (504, "p", [1.0]), (505, None, [1.0] * 8), (506, "p", [1e200] * 8), (507, "p", [1e-200] * 8)]
    df = spark.createDataFrame(rows, "id long, block string, v array<double>")
    usable = [(i, g, unit(np.array(v) / np.abs(v).max())) for i, g, v in rows if g is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    for least in (0.0, 0.9):
        want = {}
        for side, own, others in (("a", 0, 1), ("b", 1, 0)):
            for i, g, v in usable:
                if i % 2 == own:
                    best = min(((-np.floor(v @ w * 1e6 + 0.5), j) for j, h, w in usable if j % 2 == others and h == g), default=None)
                    if best and -best[0] >= least * 1e6:
                        want[side, i] = (best[1], int(-best[0]))
        got = candidates.nearest(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), ["block"], "id", "v", least, size=size)
        assert {(r.side, r.own): (r.other, r.score) for r in got.collect()} == want and want
        mutual = {(a, b, s) for (side, a), (b, s) in want.items() if side == "a" and want.get(("b", b), (None,))[0] == a}
        assert {tuple(r) for r in candidates.mutual_nearest(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), ["block"], "id", "v", least).collect()} == mutual


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "id long, block string, v array<double>")
    some = spark.createDataFrame([(1, "p", [1.0, 2.0])], none.schema)
    assert candidates.nearest(none, some, ["block"], "id", "v", 0.0).count() == candidates.nearest(some, none, ["block"], "id", "v", 0.0).count() == 0


def test_phase_matcher_equals_plain_python(spark):
    """Four phases on what the earlier ones left; pairs of different stores, each side the other's best."""
    draw = random.Random(13)
    rng = np.random.default_rng(13)
    rows = [(i, draw.choice("ABC"), draw.choice(["Red Ring", "red  ring!", "blue bolt", "gear"]), draw.choice(["acme", "nord", None]), draw.choice(["x", "y"]), draw.choice([1.0, 2.0, None])) for i in range(60)]
    vectors = {i: rng.normal(size=3) for i in range(60) if i % 9}
    plain = lambda n: " ".join("".join(c if c.isalnum() else " " for c in n.lower()).split())
    left, want = {r[0]: (*r[:2], plain(r[2]), *r[3:]) for r in rows}, []

    def mutual(scored):
        best = {}
        for a, b, s in scored:
            for own, other in ((("a", a), b), (("b", b), a)):
                best[own] = min(best.get(own, (9.0, 0)), (-s, other))
        return [(a, b, s) for a, b, s in scored if best["a", a][1] == b and best["b", b][1] == a]

    for phase, keys, least in ((1, (3, 2, 5), None), (2, (2, 5), None), (3, (3,), 0.80), (4, (4,), 0.92)):
        scored = []
        for a in left.values():
            for b in left.values():
                if a[1] < b[1] and all(a[k] is not None and a[k] == b[k] for k in keys):
                    if least is None:
                        scored.append((a[0], b[0], {1: 1.0, 2: 0.98}[phase]))
                    elif a[0] in vectors and b[0] in vectors:
                        s = float(unit(vectors[a[0]]) @ unit(vectors[b[0]]))
                        scored.append((a[0], b[0], s))
        new = [m for m in mutual(scored) if least is None or m[2] >= least]
        want += [(a, b, round(s, 9), phase) for a, b, s in new]
        for a, b, _ in new:
            left.pop(a, None), left.pop(b, None)
    df = spark.createDataFrame(rows, "id long, store string, name string, brand string, category string, size double")
    e = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "id long, embedding array<double>")
    got = [(r.a, r.b, round(r.confidence, 9), r.phase) for r in phases.phase_matcher(df, e).collect()]
    assert sorted(got) == sorted(want) and {w[3] for w in want} >= {1, 3}


def test_no_caps_unless_asked_for(spark):
    """101 rows of one brand, token or spelling, of which the last is the best; arrays and chunks beyond the short forms' windows."""
    p = spark.createDataFrame([(1, "red ring large", None, "acme", 5.0)], "id long, name string, barcode string, brand string, size double")
    rows = [(i, "red thing", None, "acme", None) for i in range(300)] + [(300, "red ring large", None, "acme", 5.0)]
    c = spark.createDataFrame(rows, "off_id long, off_name string, off_barcode string, off_brand string, off_size double")
    assert [r.off_id for r in matching.fast_match(p, c).collect()] == [300]
    assert [r.off_id for r in matching.fast_match(p, c.filter("off_id <> 300").unionByName(c.filter("off_id = 300").withColumn("off_name", F.lit("red things"))), **matching.FAST_CAPS).collect()] != [300]
    hits = matching._brand_hits(p, c, None)
    assert hits.count() == 301 and matching._brand_hits(p, c, 50).count() == 50
    spelt = spark.createDataFrame([(i, "milk zz", None, None) for i in range(40)] + [(40, "milk abcdefgh jklmnoq", None, None)], "off_id long, off_name string, off_barcode string, off_size double")
    q = spark.createDataFrame([(1, "milk abcdefgx jklmnopp qqq rrrr sss tttt uuu", None, None)], "id long, name string, barcode string, size double")
    assert [r.off_id for r in matching.fast_match(q, spelt).collect()] == [40] and not matching.fast_match(q, spelt, spelling_cap=30, token_cap=30).filter("off_id = 40").count()
    far = spark.createDataFrame([(i, "w", f"brand{i:05d}") for i in range(1500)] + [(1500, "plain milk", "nordwindx")], "off_id long, off_name string, off_brand string")
    own = spark.createDataFrame([(1, "plain milk", "nordwind")], "id long, name string, brand string")
    assert [r.off_id for r in matching.offline_match(own, far).collect()] == [1500] and matching.offline_match(own, far, first=1000).count() == 0
    page = '{"offers":[' + ",".join(f'{{"n":{i},"t":"[{"x" * 40}"}}' for i in range(12_000)) + "]}"
    assert len(page) > web.ARRAY_WINDOW
    pages = spark.createDataFrame([(1, page)], "id long, html string")
    assert web.embedded_offers(pages, "struct<n:int,t:string>", "id", "n").count() == 12_000
    assert web.bracketed(page, '"offers":[', web.ARRAY_WINDOW) is None
    chunks = spark.createDataFrame([(1, "".join(f'MARK.{"y" * 2500}"t":"{i}"' for i in range(500)))], "id long, html string")
    assert [r.t for r in web.after_marker(chunks, "id", "MARK.", {"t": '"t":"([^"]*)"'}).orderBy("pos").collect()] == [str(i) for i in range(500)]
    assert web.after_marker(chunks, "id", "MARK.", {"t": '"t":"([^"]*)"'}, window=web.CHUNK_WINDOW, most=web.CHUNKS).filter("t is null").count() == 300


def test_transliterated_match_equals_plain_python(spark):
    """Names in either script; every variant of a name with every variant of a catalogue name that shares a word of three letters."""
    draw = random.Random(21)
    stock = ["мляко", "сирене", "mlyako", "sirene", "kafe", "кафе", "milk", "шоколад", "shokolad", "fresh", "на", "ab"]
    name = lambda: " ".join(draw.choice(stock).title() for _ in range(draw.randint(1, 4)))
    products, known = [(i, name()) for i in range(30)] + [(99, None)], [(i, name()) for i in range(40)] + [(98, None)]
    p, o = spark.createDataFrame(products, "id long, name string"), spark.createDataFrame(known, "off_id long, off_name string")
    forms = lambda df, c: {r[0]: {x for x in r[1:] if x is not None} for r in df.select(df.columns[0], F.lower(c), text.to_latin(F.col(c)), text.to_cyrillic(F.col(c))).collect()}
    left, right = forms(p, "name"), forms(o, "off_name")
    tokens = lambda v: {w for w in v.split() if len(w) > 2}
    share = lambda x, y: len(x & y) / len(x | y) if x & y else 0.0
    want = {}
    for i, mine in left.items():
        scores = {}
        near = {j for j, theirs in right.items() for v in mine for w in theirs if tokens(v) & tokens(w)}
        for j in near:
            scores[j] = max(0.6 * ratio(v, w) + 0.4 * share(tokens(v), tokens(w)) for v in mine for w in right[j])
        best = min(((-s, j) for j, s in scores.items()), default=None)
        if best and -best[0] >= 0.45:
            want[i] = (best[1], round(-best[0], 9), "confident" if -best[0] >= 0.85 else "likely" if -best[0] >= 0.75 else "low")
    got = {r.id: (r.off_id, round(r.score, 9), r.tier) for r in phases.transliterated_match(p, o).collect()}
    assert got == want and len({t for _, _, t in want.values()}) >= 2


def test_strict_match_equals_plain_python(spark):
    draw = random.Random(22)
    words = ["fresh", "whole", "milk", "cheese", "smoked", "aged", "x"]
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(2, 5))), draw.choice([["a"], ["b"], ["a", "b"], []]), draw.choice([None, 1.0, 1.05, 2.0]), draw.choice([1.0, 2.0, 6.0])) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, name string, types array<string>, quantity double, price double")
    pairs = matching.blocked_pairs(df.withColumn("k", F.lit(1)), df.withColumn("k", F.lit(1)), ["k"], "id")
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and set(a[2]) & set(b[2]):
                sized = a[3] is None or b[3] is None or 0.75 <= a[3] / b[3] <= 1.25
                near = a[3] is not None and b[3] is not None and max(a[3], b[3]) / min(a[3], b[3]) <= 1.1
                x, y = ({w for w in r[1].split() if len(w) > 2} for r in (a, b))
                if sized and (near or max(a[4], b[4]) / min(a[4], b[4]) <= 2.5) and len(x & y) >= 2:
                    score = 0.6 * len(x & y) / len(x | y) + 0.4 * ratio(a[1], b[1])
                    if score >= 0.60:
                        want[a[0], b[0]] = round(score, 9)
    got = {(r.left, r.right): round(r.score, 9) for r in matching.strict_match(pairs).collect()}
    assert got == want and len(want) > 20
