"""The pipeline against brute force, stage by stage, and the registered queries against their SQL."""

import collections
import hashlib
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_groups, brute_ratios, sentence

import corpus_pipeline
from tallyframe.llm import mixing, near_dup, quality_rules, registry

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, columns = docs, docs.columns
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count() <= before.count()
        if i < 4:
            assert docs.columns == columns
        if name == "quality_rules":
            assert all(r.text == rows[r.doc_id] for r in docs.collect())
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def brute_quality(rows, rules):
    def good(text, lang):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {j + k for j, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
        if len(words) < 50 or 100 * len(covered) > 50 * len(words):
            return False
        band = rules.bands[lang if lang in rules.bands else quality_rules.script_of(text.encode())]
        cpt, fallback, entropy = brute_ratios(text, lang, rules)
        return band.min_chars_per_token <= cpt <= band.max_chars_per_token and fallback <= band.max_fallback_share and entropy >= band.min_entropy

    return [r for r in rows if good(r[1] or "", r[2])]


def brute_near(rows):
    groups = brute_groups([(k, t) for k, t, *_ in rows], 5)
    seen, out = set(), []
    for r in rows:
        if groups[r[0]][1] == r[0] and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out


def brute_repeats(rows, length=100):
    seen, out = set(), []
    for r in sorted(rows):
        data = (r[1] or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        if not gone.any():
            out.append(r)
            continue
        # a character goes if all of its bytes do
        text, at = "", 0
        for c in r[1]:
            n = len(c.encode())
            text += "" if gone[at : at + n].all() else c
            at += n
        if text.strip():
            out.append((r[0], text, *r[2:]))
    return out


def brute_leaks(rows, items):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for t in items:
        w = word.findall((t or "").encode().lower())
        windows |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()
    out = []
    for r in rows:
        data = (r[1] or "").encode()
        at = [m.span() for m in word.finditer(data.lower())]
        w, hit = [data[a:b].lower() for a, b in at], set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
        if hit and len(hit) > 0.8 * len(w):
            continue
        drop = np.zeros(len(data), bool)
        for j in hit:
            end = at[j + 1][0] if j + 1 in hit else at[j][1]
            drop[at[j][0] : end] = True
        out.append((r[0], bytes(b for b, d in zip(data, drop, strict=True) if not d).decode(), *r[2:]) if hit else r)
    return out


def brute_mix(rows, rules):
    size = lambda r: len((r[1] or "").split())
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size(r) for r in rows if r[3] == s) for s in sources}
    weights = {s: float(rules.weights[i % 3]) for i, s in enumerate(sources)}
    budget, target, open_ = sum(sizes.values()) * rules.share, {}, set(sources)
    while True:
        rest = budget - sum(target.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not full:
            target.update(share)
            break
        target.update({s: 2.0 * sizes[s] for s in full})
        open_ -= full
    copies = []
    for n, s in enumerate(sources):
        served = 0
        for digest, k, z in sorted((hashlib.md5(f"{rules.seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[0], size(r)) for r in rows if r[3] == s):
            served += z
            copies += [((served + sizes[s] * c) / target[s], n, digest, k, z, c) for c in (0, 1) if z]
    taken, total = collections.Counter(), 0
    for c in sorted(copies):
        total += c[4]
        if total > budget:
            break
        taken[c[3]] += 1
    return taken


def brute_run(rows, items):
    rows = brute_leaks(brute_repeats(brute_near(brute_quality(rows, quality_rules.FertilityRules()))), items)
    taken = brute_mix(rows, mixing.MixRules())
    return {(r[0], r[1], r[2], r[3], taken[r[0]]) for r in rows if taken[r[0]]}


def test_run_equals_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.text, r.lang, r.source, r.mix_copies) for r in got} == brute_run(rows, items)
    assert all(len(r.text) == r.n_chars for r in got) and len(got) > 50


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows and columns that clash with the operators' own; then no rows at all."""
    import random

    draw = random.Random(4)
    text = [sentence(draw, n) for n in (90, 120, 150, 200, 70)]
    rows = [(1, text[0], "xx", "a"), (1, text[0], "xx", "a"), (2, text[1], None, None), (3, text[2], "xx", "b"), (None, text[3], None, None), (None, None, None, None), (4, "", "xx", "a"), (5, None, "xx", "b"), (6, f"{text[4]} {text[2]}", "xx", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for name in ("id", "key", "fp", "hot", "marks", "_gone", "_mix_key", "_cut_spans", "_leak_spans", "kept", "size", "mix_copies", "row"):
        docs = docs.withColumn(name, F.lit("mine"))
    bench = spark.createDataFrame([(1, None), (2, ""), (None, " ".join(text[3].split()[:12]))], "item_id long, text string")
    for folder, limit in (("rows", 100), ("none", 0)):
        docs.limit(limit).coalesce(1).write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        bench.limit(limit).coalesce(1).write.parquet(f"{tmp_path}/{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{folder}")
        found = out.collect()
        if not limit:
            assert found == [] and set(docs.columns) <= set(out.columns)
            continue
        assert sorted(r.doc_id for r in found if r.doc_id is not None) == [1, 2, 3, 6] and len(found) == 5
        assert {r._gone for r in found} == {r.hot for r in found} == {r._leak_spans for r in found} == {"mine"}
        left = {r.doc_id: r.text for r in found}
        assert left[1] == text[0] and left[6].startswith(text[4]) and text[2] not in left[6] and not left[None].startswith(text[3][:40])


def test_near_stage_keeps_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()}
    report = near_dup.near_duplicates(docs).collect()
    assert kept == {r.doc_id for r in report if r.kept}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got, want = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    at = [want.columns.index(c) for c in order]
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)


@pytest.mark.parametrize("table", ["documents", "pages", "conversations"])
def test_queries_run_on_empty_tables(spark, tmp_path, table):
    for f in os.listdir(SF):
        name = f.split(".")[0]
        if name in ("documents", "pages", "conversations", "benchmark", "labels"):
            df = spark.read.parquet(f"{SF}/{f}")
            (df.limit(0) if name == table else df).coalesce(1).write.parquet(str(tmp_path / f))
    uses = {"documents": ("op1", "op3", "op4", "op7", "op8", "op9"), "pages": ("op5", "op6", "op10"), "conversations": ("op2",)}[table]
    for name, query in registry.queries().items():
        if name.split("_")[0] in uses:
            assert query(spark, str(tmp_path)).count() == (1 if table == "conversations" else 0)
