"""Work that must not grow faster than its input: results against plain Python, and what is made on the way."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import candidates, dictionary, grouping, matching, phases
from tallyframe.plans import stores as store_plans
from tallyframe.sources import web
from tallyframe.streaming import stateful


def serial(rows):
    taken, out = set(), {}
    for left in sorted({r[0] for r in rows}):
        free = [(-s, right) for own, right, s in rows if own == left and right not in taken]
        if free:
            low, right = min(free)
            out[left] = (right, -low)
            taken.add(right)
    return out


@pytest.mark.parametrize("at_once", [0, 30, 1_000_000])
def test_serial_choice_by_class(spark, at_once):
    """By members in tasks, some of them, and by pairs; classes of one member and of many, several scores, keys that meet."""
    draw = random.Random(3)
    sides = []
    for _ in range(2):
        keys, classes = draw.sample(range(400), 120), {}
        for key in keys:
            classes.setdefault(draw.randrange(25), []).append(key)
        sides.append([sorted(c) for c in classes.values()])
    links = [(a, b, draw.choice([0.6, 0.8, 1.0])) for a in sides[0] for b in sides[1] if draw.random() < 0.06]
    want = serial([(x, y, s) for a, b, s in links for x in a for y in b])
    # large classes come in several rows
    member = lambda classes: [(c[0], 2, len(c), c[i::2]) for c in classes for i in range(2) if c[i::2]]
    frame = lambda classes: spark.createDataFrame(member(classes), "rep long, cuts long, n long, keys array<long>").withColumn("cuts", F.count("*").over(grouping.Window.partitionBy("rep")))
    linked = spark.createDataFrame([(a[0], b[0], s) for a, b, s in links], "left long, right long, score double")
    got = grouping.serial_choice_by_class(linked, frame(sides[0]), frame(sides[1]), at_once).collect()
    assert {r.left: (r.right, r.score) for r in got} == want and len(got) == len(want) > 40


def test_terms_listed_many_times_meet_a_name_once(spark, monkeypatch):
    """The first by ord of a term's rows counts, by store too, and the work is that of the distinct terms."""
    met, real = [], dictionary.materialize
    monkeypatch.setattr(dictionary, "materialize", lambda df, name: met.append((name, real(df, name))) or met[-1][1])
    terms = [(f"Brand#{i}", f"v{i}-{copy}", 100 * copy + i, "A" if i % 2 else None) for i in range(5) for copy in range(40)]
    known = spark.createDataFrame(terms, "term string, value string, ord long, store string")
    rows = spark.createDataFrame([(n, f"a brand {n % 7}{'x' if n % 5 == 4 else ''} b", "A" if n % 2 else "B") for n in range(70)] + [(70, None, None)], "id long, name string, store string")
    every = known.drop("store")
    best = {r.id: r.out for r in dictionary.with_best_term(rows, "name", every, "out").collect()}
    assert best == {n: f"v{n % 7}-0" if n < 70 and n % 5 < 4 and n % 7 < 5 else None for n in range(71)}
    house = {r.id: r.out for r in dictionary.with_house_brand(rows, "name", "store", known, "out").collect()}
    assert house == {n: best[n] if best[n] and (n % 7 % 2 == 0 or n % 2) else None for n in range(71)}
    inside = spark.createDataFrame([(1, "XBrand#3Y brand#1"), (2, None)], "id long, name string")
    scored = {r.id: r.out for r in dictionary.with_scored_term(inside, "name", every.withColumn("value", F.lower("term")), "out").collect()}
    assert tuple(scored[1]) == ("brand#1", 7) and scored[2] is None
    assert {r.id: r.out for r in dictionary.with_category(inside, "name", every, "out").collect()} == {1: "v1-0", 2: None}
    found = {r.id: r.found for r in dictionary.with_resolved_brand(rows, "name", every, every, {"brand 6": "six"}, "found").collect()}
    assert all((found[n] and found[n].brand) == (best[n] or ("six" if n < 70 and n % 7 == 6 else None)) for n in range(71))
    sizes = [df.count() for name, df in met if name == "dictionary-terms"]
    assert len(sizes) == 8 and max(sizes) == 5, sizes


def test_names_of_stores_are_cleaned_once(spark, tmp_path, monkeypatch):
    """Parts of one name in one store share its cleaned forms; parts without a name keep their rows."""
    cleaned, real = [], store_plans.materialize
    monkeypatch.setattr(store_plans, "materialize", lambda df, name: cleaned.append(real(df, name)) or cleaned[-1])
    names = ["red bolt", "hot  gear", None]
    spark.createDataFrame([(k, names[k // 3 % 3]) for k in range(90)], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = store_plans.q_store_names(spark, str(tmp_path)).collect()
    assert cleaned[0].count() == 3 * 3 * len(store_plans.AROUND) and len(got) == 90 * len(store_plans.AROUND)
    plain = {r.p_partkey: (r.store, r.name, r.bulk_value) for r in got if r.form == 0}
    assert plain == {k: (store_plans.NAMES[k % 3], names[k // 3 % 3] and names[k // 3 % 3].replace("  ", " "), None) for k in range(90)}


def test_look_ahead_sorts_no_contexts(spark):
    """Fields are taken before places of a name meet, so that the rows that meet are small."""
    pages = spark.createDataFrame([(1, '"k":"7","t":"a"' + "x" * 5000 + '"k":"7","t":"b"')], "page int, html string")
    found = web.look_ahead(pages, "page", '"k":"([0-9]+)"', {"t": '"t":"([^"]+)"'}, 2000)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("context" in line for line in plan.splitlines() if "Aggregate" in line), plan
    assert [tuple(r) for r in found.collect()] == [(1, "7", "a")]


def test_python_gets_few_chunks_at_once(spark, monkeypatch):
    """However many pairs of chunks a partition holds; the session's own setting is back afterwards."""
    name, seen, real = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, candidates.materialize
    before = spark.conf.get(name)
    monkeypatch.setattr(candidates, "materialize", lambda df, what: seen.setdefault(what, spark.conf.get(name)) and real(df, what))
    draw = random.Random(9)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    left, right = (spark.createDataFrame([r for r in rows if r[0] % 2 == s], "id long, v array<double>").withColumn("b", F.lit(1)) for s in (0, 1))
    got = {r.own: r.other for r in candidates.nearest(left, right, ["b"], "id", "v", -1.0, size=4).filter("side = 'a'").collect()}
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in rows}
    score = lambda a, b: int(sum(x * y for x, y in zip(unit[a], unit[b], strict=True)) * 1_000_000 + 0.5)
    assert all(score(a, b) >= max(score(a, c) for c in range(1, 60, 2)) - 1 for a, b in got.items()) and len(got) == 30
    assert {seen["vector-chunks"], seen["vector-best"]} == {str(candidates.CHUNKS_AT_ONCE)} and spark.conf.get(name) == before


def test_phases_make_few_pairs_of_equal_products(spark, monkeypatch):
    """Two hundred products alike in each of three stores: the firsts of stores are each other's, and no other pair is made."""
    made, real = [], phases.matching.mutual_best
    monkeypatch.setattr(phases.matching, "mutual_best", lambda pairs, *a: made.append(pairs.count()) or real(pairs, *a))
    rows = [(1000 * s + i, f"s{s}", "name", "brand", "kind", 1) for s in (2, 1, 3) for i in range(200)]
    products = spark.createDataFrame(rows, "id long, store string, name string, brand string, category string, size int")
    got = phases.phase_matcher(products, spark.createDataFrame([], "id long, embedding array<float>")).collect()
    assert {(r.a, r.b, r.phase) for r in got} == {(1000, 2000, 1), (1001, 2001, 2)} and made == [3, 3]


def test_monitor_tells_a_key_in_one_frame(spark, monkeypatch):
    """Ten events a day apart, each of which ends a silence: one frame of 19 rows."""
    got = []
    events = spark.createDataFrame([("a", 1, 1)], "who string, t long, event_id long").withColumn("ts", F.timestamp_seconds("t"))
    grouped = type(events.groupBy("who"))
    monkeypatch.setattr(grouped, "transformWithStateInPandas", lambda self, processor, *a, **k: got.append(processor) or events.limit(0).selectExpr("who AS key", "t AS at_us", "event_id AS tie", "t AS n_rows", "0.5D AS error_rate", "t AS streak", "true AS silent"))
    stateful.monitored(events, "who", F.lit(False), 3600.0)

    class Held:
        exists, update = lambda self: False, lambda self, row: None

    class Handle:
        getValueState, registerTimer = lambda self, *a: Held(), lambda self, at: None

    got[0].init(Handle())
    day = 86_400_000_000
    rows = pd.DataFrame({"at_us": [i * day for i in range(10)], "tie": range(10), "bad": [i % 2 == 1 for i in range(10)]})
    frames = list(got[0].handleInputRows(("a",), iter([rows]), None))
    assert len(frames) == 1 and frames[0]["silent"].tolist() == [False, True] * 9 + [False]
    assert frames[0]["tie"].tolist() == [x for i in range(9) for x in (i, None)] + [9] and set(frames[0]["n_rows"]) == {1}


@pytest.mark.parametrize("often", [0, 5, 100_000])
def test_norms_of_frequent_and_other_tokens(spark, monkeypatch, often):
    """By broadcast, by shuffle and by both; a key of several rows is one; the plan to count shuffles keys, not tokens."""
    monkeypatch.setattr(matching, "OFTEN", often)
    draw = random.Random(5)
    texts = [(i % 25, [draw.choice("aaaabbbcd") + draw.choice(["", "", str(draw.randrange(40))]) for _ in range(30)]) for i in range(30)]
    rows = spark.createDataFrame(texts, "id long, t array<string>")
    counts = matching.counted_tokens(rows, "id", lambda df: df["t"])
    want, df = {}, {}
    for key, words in texts:
        for w in words:
            want.setdefault(key, {}).setdefault(w, 0)
            want[key][w] += 1
    for found in want.values():
        for w in found:
            df[w] = df.get(w, 0) + 1
    assert {(r.id, r.token): r.n for r in counts.collect()} == {(k, w): n for k, found in want.items() for w, n in found.items()}
    idf = matching.inverse_frequencies(counts, "id", 25)
    norms = {r.id: r.norm for r in matching.token_norms(counts, "id", idf).collect()}
    for key, found in want.items():
        assert math.isclose(norms[key], sum(((1 + math.log(n)) * (math.log(26 / (df[w] + 1)) + 1)) ** 2 for w, n in found.items()) ** 0.5)
