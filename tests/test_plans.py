"""Skew-safe joins and block prefixes against plain joins and windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkrecon.plans.joins import grid_join, hot_keys, lookup_join, salt_many, skew_join, spread_of
from sparkrecon.plans.lineage import checkpoint, scratch_path
from sparkrecon.plans.prefix import ordered_concat, running


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    left = [(0 if n % 3 == 0 else rng.randrange(1, 40), n) for n in range(900)] + [(None, 900 + n) for n in range(5)]
    right = [(k, k * 10) for k in range(0, 30)]
    return (
        spark.createDataFrame(left, "k int, a int"),
        spark.createDataFrame(right, "k int, b int"),
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(skewed, rows, how):
    left, right = skewed
    assert rows(skew_join(left, right, ["k"], how, hot_rows=20)) == rows(left.join(right, "k", how))


@pytest.mark.parametrize("how", [{}, {"hot_rows": 20}, {"small_rows": 5}])
def test_lookup_join_equals_plain_join(skewed, rows, how):
    left, right = skewed
    got = lookup_join(left, right, ["k"], "left", **how)
    assert rows(got) == rows(left.join(right, "k", "left"))


def test_hot_key_is_spread(skewed):
    left, _ = skewed
    slots = salt_many(left, ["k"], spread_of(left, ["k"], 20)).filter("k = 0").select("_slot").distinct().count()
    assert slots == 15
    assert hot_keys(left, ["k"], 100).count() == 1


def test_unsupported_join_kind(skewed):
    left, right = skewed
    with pytest.raises(ValueError):
        skew_join(left, right, ["k"], "full")


def test_grid_join_equals_plain_join(spark, rows):
    left = spark.createDataFrame([(0 if n % 3 == 0 else n % 7, n) for n in range(120)], "k int, a int")
    right = spark.createDataFrame([(0 if n % 2 == 0 else n % 7, n) for n in range(90)], "k int, b int")
    got = grid_join(left, right, ["k"], ["a"], ["b"], hot_rows=5)
    assert rows(got, "k", "a", "b") == rows(left.join(right, "k"), "k", "a", "b")


def test_building_a_join_runs_no_job(spark):
    df = spark.range(100).withColumn("k", F.raise_error(F.lit("it ran")).cast("string"))
    plan = lookup_join(df, df.select("k"), ["k"], "left_semi")
    assert "GlobalLimit" not in plan._jdf.queryExecution().executedPlan().toString()


def test_running_equals_window(spark, rows):
    rng = random.Random(3)
    data = [(k, p, rng.random() < 0.3, rng.randrange(100)) for k in ("a", "b") for p in range(1, 200)]
    df = spark.createDataFrame(data, "k string, p int, f boolean, v int")
    w = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    marked = F.when(F.col("f"), F.col("v"))
    want = df.select("*", F.sum(F.col("f").cast("long")).over(w).alias("s"), F.max(marked).over(w).alias("m"))
    got = running(df, ["k"], "p", sums={"s": F.col("f")}, maxima={"m": marked}, block=16)
    assert rows(got) == rows(want)


def test_ordered_concat_over_blocks(spark):
    df = spark.createDataFrame([("a", n, str(n)) for n in range(50)], "k string, p int, t string").repartition(7)
    got = ordered_concat(df, ["k"], "p", "t", ",", "out", block=8).first()["out"]
    assert got == ",".join(str(n) for n in range(50))


def test_checkpoint_cuts_lineage(spark):
    df = checkpoint(spark.range(10).groupBy((F.col("id") % 3).alias("g")).count())
    assert "Exchange" not in df._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_hot_vector_product_same_with_and_without_broadcast(spark, rows):
    from sparkrecon.operators.matrices import gemv

    a = spark.createDataFrame([(n, 0 if n % 3 == 0 else n % 11, 1.0) for n in range(300)], "i int, j int, v double")
    x = spark.createDataFrame([(n, float(n + 1)) for n in range(11)], "k int, v double")
    assert rows(gemv(a, x)) == rows(gemv(a, x, hot_rows=10))


def test_hot_keys_are_few_in_any_table(spark, monkeypatch):
    from sparkrecon.plans import joins

    monkeypatch.setattr(joins, "MOST_HOT", 10)
    df = spark.range(1000).selectExpr("CASE WHEN id < 300 THEN 0 ELSE id % 70 END AS k", "id AS v")
    hot = joins.hot_keys(df, ["k"], 5).collect()
    assert [r["k"] for r in hot] == [0]  # 70 keys have more than five rows, one has more than a tenth of all
    one = spark.range(70).selectExpr("id AS k", "id * 2 AS w")
    assert joins.skew_join(df, one, ["k"], hot_rows=5).count() == 1000
    assert joins.grid_join(df, one, ["k"], ["v"], ["w"], 5).count() == 1000
