"""Windows by ranges equal plain windows, with one key over all ranges, many keys in one, none, and no rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.operators import ranges, relational

DDL = "key string, at long, n long, x long, bad boolean"


def table(spark, rows, keys, seed=5):
    rng = random.Random(seed)
    made = [(rng.choice(keys), rng.choice([None, *range(rows // 3 + 1)]), i, rng.choice([None, rng.randrange(100)]), rng.choice([True, True, True, True, False, None])) for i in range(rows)]
    return spark.createDataFrame(made, DDL).repartition(7)


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


SHAPES = [(["a"], 500), (["a"] * 20 + ["b", "c", None], 500), ([f"k{i}" for i in range(60)] + [None], 400), (["a", None], 0), (["a"], 1), ([None], 50)]


@pytest.mark.parametrize("keys,size", SHAPES)
@pytest.mark.parametrize("by", [["key"], []])
def test_equal_to_plain_windows(spark, keys, size, by):
    df = table(spark, size, keys)
    plain = Window.partitionBy(*by).orderBy("at", "n")
    columns = {
        "mean": lambda w: F.sum("x").over(w.rowsBetween(-4, 0)),
        "near": lambda w: F.last("x", ignorenulls=True).over(w.rowsBetween(-6, -1)),
        "after": lambda w: F.lead("x", 2).over(w),
        "around": lambda w: F.max("x").over(w.rowsBetween(-3, 2)),
    }
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many ranges as partitions
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = ranges.framed(df, by, ["at", "n"], columns, reach=6, ahead=2, block=7)
        assert rows(got) == rows(df.withColumns({c: f(plain) for c, f in columns.items()}))
        assert rows(ranges.placed(df, by, ["at", "n"])) == rows(df.withColumn("place", F.row_number().over(plain)))
        want = relational.failure_streaks(df.withColumn("b", F.coalesce("bad", F.lit(False))), by, ["at", "n"], F.col("b")).drop("b")
        assert rows(ranges.streaks(df, by, ["at", "n"], F.col("bad"))) == rows(want)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_streak_over_many_ranges(spark):
    """All rows fail but the first: every range passes on what came before."""
    df = spark.range(5000).select(F.lit(1).alias("key"), F.col("id").alias("n"), (F.col("id") > 0).alias("bad"))
    found = ranges.streaks(df, ["key"], ["n"], F.col("bad"))
    assert found.filter("streak <> n").count() == 0


def test_one_key_is_spread_and_never_sorted_whole(spark):
    df = spark.range(40_000).select(F.lit("hot").alias("key"), F.hash("id").alias("at"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be put together
    try:
        cut = ranges.dealt(df, ["key"], ["at", "id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    most = cut.groupBy("_r_range").count().agg(F.max("count"), F.count("*")).first()
    assert most[1] == 4 and most[0] < 15_000
    plan = ranges.framed(df, ["key"], ["at", "id"], {"c": lambda w: F.count("*").over(w.rowsBetween(-9, 0))}, reach=9, block=1000)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan and "_r_block" in plan


def test_clashing_names_and_small_blocks(spark):
    df = spark.range(3).withColumn("_r_range", F.lit(1))
    with pytest.raises(ValueError):
        ranges.placed(df, [], ["id"])
    with pytest.raises(ValueError):
        ranges.framed(spark.range(3), [], ["id"], {}, reach=9, block=5)
