"""Joins that split hot keys equal plain joins."""

import random

import pytest

from quirewell.operators.skew import hot_buckets, hot_sides, split_join


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_split_join_equals_join(spark, how):
    rnd = random.Random(1)
    a = spark.createDataFrame([("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(40)}", i % 90, "a") for i in range(400)] + [(None, 1, "a")] * 3, "k string, x int, z string")
    b = spark.createDataFrame([("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(60)}", i, "b") for i in range(60)] + [(None, 1, "b")], "k string, y int, w string")
    want = sorted(map(str, a.join(b, ["k"], how).collect()))
    assert sorted(map(str, split_join(a, b, ["k"], how, per_task=7).collect())) == want and want
    assert split_join(a.where("false"), b, ["k"], how, per_task=7).count() == 0


def test_no_task_holds_a_hot_key(spark):
    n = 40_000
    a = spark.range(n).selectExpr("if(id % 2 = 0, -1, id) as k", "id as x")
    b = spark.createDataFrame([(-1, 5)], "k long, y long")
    out = split_join(a, b, ["k"], per_task=1_000).repartition(1).sparkSession
    df = split_join(a, b, ["k"], per_task=1_000)
    out.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = df.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    finally:
        out.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == n // 2 and max(sizes) < n // 2


def test_hot_sides_are_counted_in_one_pass(spark):
    df = spark.range(1000).selectExpr("if(id % 2 = 0, 7, id) as k", "id % 4 = 0 as a", "id % 4 <> 0 as b")
    left, right = hot_sides(df, ["k"], "a", "b", per_task=100)
    assert left == hot_buckets(df.where("a"), ["k"], 100) and right == hot_buckets(df.where("b"), ["k"], 100) and list(left.values()) == [3]
