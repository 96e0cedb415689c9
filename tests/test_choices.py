"""Greedy groups and serial choice against plain Python, by components and by rounds; long chains in a bounded number of steps."""

import random

import pytest

from tallyframe.operators import grouping


def greedy(edges):
    taken, out = set(), {}
    for number, members, score in sorted(edges, key=lambda e: (-e[2], e[0])):
        free = sorted(set(members) - taken)
        if len(set(members)) >= 2 and len(free) >= 2:
            out[number] = free
            taken |= set(free)
    return out


def serial(rows):
    taken, out = set(), {}
    for left in sorted({r[0] for r in rows}):
        free = [(-s, right) for own, right, s in rows if own == left and right not in taken]
        if free:
            low, right = min(free)
            out[left] = (right, -low)
            taken.add(right)
    return out


@pytest.mark.parametrize("at_once", [0, 4, 1000])
def test_greedy_groups(spark, at_once):
    """All by rounds, some, and all in tasks; ties in score, members that repeat, lone members."""
    draw = random.Random(4)
    edges = [(i, [draw.randrange(120) for _ in range(draw.randint(1, 4))], draw.choice([0.5, 0.7, 0.9])) for i in range(90)]
    edges += [(100 + i, [1000 + 10 * i, 1001 + 10 * i], 0.3) for i in range(20)]
    got = grouping.greedy_groups(spark.createDataFrame(edges, "id long, members array<long>, score double"), at_once)
    assert {r.id: sorted(r.members) for r in got.collect()} == greedy(edges)


@pytest.mark.parametrize("at_once", [0, 4, 1000])
def test_serial_choice(spark, at_once):
    draw = random.Random(5)
    rows = list({(draw.randrange(40), draw.randrange(40)): draw.choice([0.5, 0.7, 0.9]) for _ in range(110)}.items())
    rows = [(a, b, s) for (a, b), s in rows] + [(100, 200, 0.1), (101, 200, 0.9), (102, 201, 0.4)]
    got = grouping.serial_choice(spark.createDataFrame(rows, "left long, right long, score double"), at_once)
    assert {r.left: (r.right, r.score) for r in got.collect()} == serial(rows)


def test_choices_from_nothing(spark):
    assert grouping.greedy_groups(spark.createDataFrame([], "id long, members array<long>, score double")).count() == 0
    assert grouping.serial_choice(spark.createDataFrame([], "left long, right long, score double")).count() == 0


def test_chains_of_ten_thousand(spark, monkeypatch):
    """Every link waits for the one before it, which took a round each; now the steps are those of the components."""
    steps, real = [], grouping.materialize
    monkeypatch.setattr(grouping, "materialize", lambda df, name: steps.append(name) or real(df, name))
    n = 10_000
    edges = [(i, [i, i + 1], float(n - i)) for i in range(n)]
    got = grouping.greedy_groups(spark.createDataFrame(edges, "id long, members array<long>, score double"))
    assert {r.id for r in got.collect()} == set(range(0, n, 2))
    assert len(steps) < 40, len(steps)
    steps.clear()
    rows = [(i, i, 1.0) for i in range(n)] + [(i, i - 1, 2.0) for i in range(1, n)]
    got = {r.left: r.right for r in grouping.serial_choice(spark.createDataFrame(rows, "left long, right long, score double")).collect()}
    assert got == {i: i for i in range(n)} and len(steps) < 40, len(steps)
