"""Whitening, filter audit and line dedup against brute-force versions, with nulls, ties, repeats, long texts and empty tables."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import filter_audit, line_dedup, whitening
from tallyframe.llm.whitening import Spread, WhitenRules

# 11 --------------------------------------------------------------------------------------------


def brute_whitening(vectors):
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = (n * x - total) / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    values, components = values[::-1], components[:, ::-1]
    return n, ((n * x - total) ** 2).sum(axis=1), values, centred @ components


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(5)
    base = draw.normal(size=(40, 12)) * np.linspace(3, 0.2, 12) @ draw.normal(size=(12, 12)) + 50
    base[:15] = base[0]  # one vector many times
    return [[float(np.float32(c)) for c in v] for v in base]


def check_report(got, vectors, components):
    n, deviation, values, projected = brute_whitening(vectors)
    by = collections.defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
    assert set(by) == set(range(len(vectors)))
    for i, rows in by.items():
        assert sorted(rows) == list(range(1, components + 1))
        for c, r in rows.items():
            assert r.n == n and r.deviation == deviation[i] and r.identity_error < 1e-9
            assert r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-8)
    for c in range(components):
        white = np.array([by[i][c + 1].whitened for i in sorted(by)])
        want = projected[:, c] / np.sqrt(values[c])
        assert np.allclose(white, want, atol=1e-6) or np.allclose(white, -want, atol=1e-6)


@pytest.mark.parametrize("rules,parts", [(WhitenRules(), 1), (WhitenRules(rows=3, fan_in=2, components=5), 7), (WhitenRules(rows=16, fan_in=3), 40)])
def test_whitening_equals_eigenvectors(spark, vectors, rules, parts):
    left_out = [(100, None), (101, [*vectors[0][:-1], None]), (102, [float("nan")] * 12), (103, [float("inf")] + [0.0] * 11), (104, []), (105, [1.0, 2.0]), (106, [1e30] * 12)]
    df = spark.createDataFrame(list(enumerate(vectors)) + left_out, "vec_id long, embedding array<float>").withColumn("whitened", F.lit("mine")).withColumn("n", F.lit(7)).repartition(parts)
    check_report(whitening.whitening_report(df, rules).collect(), vectors, min(12, rules.components))


def test_merging_loses_nothing(vectors):
    """In any order of merges, singular values, vectors and sums are those of all vectors at once."""
    block = np.floor(64 * np.array(vectors)).astype(np.int64)
    whole, draw = Spread.of_block(block), random.Random(4)
    for _ in range(20):
        cuts = sorted(draw.sample(range(1, len(block)), 6))
        states = [Spread.of_block(b) for b in np.split(block, cuts)]
        while len(states) > 1:
            a, b = states.pop(draw.randrange(len(states))), states.pop(draw.randrange(len(states)))
            states.append(b.merged(a))
        assert states[0].n == whole.n and states[0].sums == whole.sums
        assert np.allclose(states[0].values, whole.values, rtol=1e-10)
        gram = lambda s: (s.values[:, None] * s.vectors).T @ (s.values[:, None] * s.vectors)
        assert np.allclose(gram(states[0]), gram(whole), rtol=1e-9, atol=1e-6)


def test_whitening_of_few_constant_or_huge_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    one = whitening.whitening_report(spark.createDataFrame([(1, [1.0, 2.0])], kind)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)]
    flat = whitening.whitening_report(spark.createDataFrame([(None, [1.0, 0.0, 5.0]), (1, [3.0, 0.0, 5.0]), (1, [1.0, 0.0, 5.0])], kind)).collect()
    assert len(flat) == 9 and sum(r.vec_id is None for r in flat) == 3
    for r in flat:
        assert (r.whitened is not None, r.explained) == ((True, 1.0) if r.component == 1 else (False, 0.0)) and r.identity_error < 1e-12
    huge = whitening.whitening_report(spark.createDataFrame([(0, [2.0**33, 0.0]), (1, [-(2.0**33), 1.0]), (2, [0.0, 0.0])], kind)).collect()
    assert {r.vec_id: r.deviation for r in huge}[0] is None and len(huge) == 6
    assert whitening.whitening_report(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whitening_report(spark.createDataFrame([(1, None)], kind)).collect() == []


# 12 --------------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    smallest = {}
    for key, text, _ in rows:
        if key is not None:
            smallest[text or ""] = min(key, smallest.get(text or "", key))
    good, toxic = ({k for k, *v in labels if v[i] == 1 and k is not None} for i in (0, 1))
    failed = []
    for key, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": key is not None and key > smallest[t]}
        failed.append((part or "", {k for k, v in f.items() if v}, key in good, key in toxic))
    out, shapley = {}, collections.Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p for p, *_ in failed}:
            left = [x for x in failed if x[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                own = [x for x in failed if x[0] == part and letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                shapley[part, letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(own) - len(gone), sum(x[1] == {letter} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows():
    draw = random.Random(2)
    words = [w for w in "the quick Brown FOX jumps OVER lazy dogs #x 50% a|b über ÉTÉ".split()] + [f"w{i}" for i in range(200)]
    texts = [None, "", " ", "\x1c\x85 ", "ab", "A B C D " * 40, "é" * 30 + "ABCD", "x " * 60000]
    texts += [" ".join(draw.choice(words) for _ in range(draw.choice([5, 99, 100, 150, 400]))) for _ in range(50)]
    texts += [texts[20]] * 40 + [texts[draw.randrange(len(texts))] for _ in range(40)]
    rows = [(i, t, draw.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += [rows[3], (5000, texts[21], "en"), (5000, texts[21], "en"), (None, texts[22], "en"), (None, texts[22], "fr"), (None, None, None)]
    draw.shuffle(rows)
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in range(0, 130, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def audited(spark, rows, labels, parts):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("fp", F.lit("mine")).withColumn("mask", F.lit(1)).withColumn("part", F.lit(2)).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("lang", F.lit("zz"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = filter_audit.filter_audit(docs, known).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}


@pytest.mark.parametrize("parts", [1, 4, 60])
def test_audit_equals_brute_force(spark, parts):
    """With 60 ranges, the copies of one text span several of them."""
    rows, labels = audit_rows()
    got = audited(spark, rows, labels, parts)
    assert got == brute_audit(rows, labels) and len(got) == 600 * 4


def test_audit_of_nothing(spark):
    assert audited(spark, [], [], 2) == {}


@pytest.mark.parametrize("cut", [1, 2, 3, 5, 9])
def test_copies_across_tasks(cut):
    """The rows of one fingerprint dealt to tasks of `cut` rows, with two texts that share it and ids that repeat."""
    rows = sorted([(1, b"a", 1), (1, b"b", 1), (1, b"a", 2), (1, b"b", 3), (1, b"a", 3), (1, b"b", 3), (1, b"a", 4), (2, b"c", 1), (2, b"c", 1), (2, b"c", 5)], key=lambda r: (r[0], r[2]))
    found, ends = [], []
    for i in range(0, len(rows), cut):
        runs = filter_audit.Runs()
        for fp, text, key in sorted(rows[i : i + cut]):
            found.append((fp, text, key, *runs.add(fp, text, key)))
        ends += runs.close()
    first = {}
    for fp, digest, key in ends:
        first[fp, digest] = min(key, first.get((fp, digest), key))
    got = sorted((fp, text, key, copy or (digest is not None and first.get((fp, digest), key) < key)) for fp, text, key, copy, digest in found)
    assert got == sorted((fp, text, key, any(f == fp and t == text and k < key for f, t, k in rows)) for fp, text, key in rows)


# 13 --------------------------------------------------------------------------------------------


def brute_lines(rows):
    def key_of(line):
        key = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
        return re.sub("[A-Z]", lambda m: m[0].lower(), key)

    held = collections.defaultdict(set)
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                held[key_of(line)].add(doc)
    out = collections.Counter()
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(key_of(x)) < 20 or len(held[key_of(x)]) < 3 or max(held[key_of(x)]) == doc]
        out[doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def line_rows():
    draw = random.Random(6)
    pool = [f"This is line number {i} of the pool" for i in range(30)] + ["short line", "é" * 20, "é" * 19, "Ünï" * 7, "x" * 20, "y" * 19, " " * 40, "\x1cfs is no space, but it counts"]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "no repeats in this document at all")]
    for i in range(4, 80):
        lines = [draw.choice([str.upper, str.lower, str])(draw.choice(pool)) for _ in range(draw.randint(0, 12))] + [f"a line of document {i} alone"]
        rows.append((i, "\n".join(draw.choice(["", " ", "\t", "\r"]) + x + draw.choice(["", "\r", "\x0b "]) for x in lines)))
    rows += [(draw.randrange(5, 70), rows[10][1]), rows[11], rows[11], (None, rows[12][1]), (None, None), (900, "only in two documents, twice here\n" * 2), (901, "only in two documents, twice here")]
    return rows + [(1000, "one long line of many documents " * 4000), (1001, "one long line of many documents " * 4000), (1002, "\n".join(["one long line of many documents " * 4000] * 3))]


@pytest.mark.parametrize("rules", [line_dedup.LineRules(), line_dedup.LineRules(segment=64, most_bits=64, hot_parts=3), line_dedup.LineRules(segment=1 << 10, most_bits=1 << 12, hashes=2)])
def test_lines_equal_brute_force(spark, rules):
    """The second and third filters are full, so that nearly every line is suspected."""
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("mine")).withColumn("keys", F.lit(0)).repartition(5)
    got = collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_report(df, rules).collect())
    assert got == brute_lines(rows)


def test_lines_removed_keep_columns(spark):
    rows = line_rows()
    df = spark.createDataFrame([(d, t, len(t or "")) for d, t in rows], "doc_id long, text string, n_chars long")
    for name in ("_dropped_lines", "_lost_id", "_may_lose", "k1", "id", "keys"):
        df = df.withColumn(name, F.lit("mine"))
    out = line_dedup.remove_lines(df)
    assert out.columns == df.columns
    found = out.collect()
    assert all(len(r.text or "") == r.n_chars and r["_may_lose"] == r["_dropped_lines"] == r.k1 == "mine" for r in found)
    want = collections.Counter((doc, sha) for (doc, _, _, sha), n in brute_lines(rows).items() for _ in range(n))
    assert collections.Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in found) == want


def test_lines_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.line_report(none).count() == 0 and line_dedup.remove_lines(none).count() == 0


def test_filters_miss_no_repeat():
    """Whatever the size of the filters and however keys are dealt to tasks, each key of two documents is suspected."""
    draw = np.random.default_rng(3)
    for bits, keys in ((1 << 8, 200), (1 << 14, 1000)):
        pool = draw.integers(0, 2**63, keys, dtype=np.uint64)
        tasks = [draw.choice(pool, draw.integers(0, 60)) for _ in range(9)]
        once = twice = np.zeros(bits // 8, np.uint8)
        for task in tasks:
            both = line_dedup.SeenTwice(bits, 3)
            for chunk in np.array_split(task, 4):
                both.add(chunk)
            twice, once = twice | both.twice | (once & both.once), once | both.once
        counts = collections.Counter(np.concatenate(tasks).tolist())
        often = np.array([k for k, n in counts.items() if n > 1], np.uint64)
        assert len(often) and line_dedup.contains(twice, often, 3).all()
        if bits > 1 << 10:
            rare = np.array([k for k, n in counts.items() if n == 1], np.uint64)
            assert line_dedup.contains(twice, rare, 3).mean() < 0.1
