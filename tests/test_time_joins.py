"""As-of and interval joins against brute force, with hot keys, ties, nulls and empty sides."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import time_joins as T

DAY = dt.datetime(2024, 1, 1)


def sides(seed, n=400, m=500, span=3000):
    r = random.Random(seed)
    key = lambda: None if r.random() < 0.05 else 0 if r.random() < 0.4 else r.randrange(1, 20)
    time = lambda: None if r.random() < 0.05 else r.randrange(span)
    return [(i, key(), time()) for i in range(n)], [(key(), time(), i, r.choice([None, "x", "y"])) for i in range(m)]


def frames(spark, left, right):
    stamp = lambda t: None if t is None else DAY + dt.timedelta(seconds=t)
    a = spark.createDataFrame([(i, k, stamp(t)) for i, k, t in left], "left_id int, k int, at timestamp_ntz").repartition(5)
    b = spark.createDataFrame([(k, stamp(t), i, s) for k, t, i, s in right], "k int, seen timestamp_ntz, right_id int, said string").repartition(5)
    return a, b


def brute_asof(left, right, strict):
    out = []
    for i, k, t in left:
        held = [(u, j) for q, u, j, _ in right if None not in (k, t, q, u) and q == k and (u < t or (u == t and not strict))]
        out.append((i, max(held)[1] if held else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot_rows", [None, 1, 30])
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, hot_rows, strict):
    left, right = sides(1, span=300)  # many ties
    a, b = frames(spark, left, right)
    got = T.asof_join(a, b, ["k"], "at", "seen", ["right_id"], strict=strict, hot_rows=hot_rows)
    assert got.columns == ["left_id", "k", "at", "seen", "right_id", "said"]
    want = brute_asof(left, right, strict)
    assert sorted(((r["left_id"], r["right_id"]) for r in got.collect()), key=str) == want
    inner = T.asof_join(a, b, ["k"], "at", "seen", ["right_id"], how="inner", strict=strict, hot_rows=hot_rows)
    assert sorted(((r["left_id"], r["right_id"]) for r in inner.collect()), key=str) == [w for w in want if w[1] is not None]


def test_asof_carries_over_ranges_without_right_rows(spark):
    left = [(i, 0, 1000 + i) for i in range(3000)]
    right = [(0, 5, 1, "x"), (0, 2500, 2, "y")]
    a, b = frames(spark, left, right)
    got = T.asof_join(a, b, ["k"], "at", "seen", hot_rows=10).groupBy("right_id").count().collect()
    assert {r["right_id"]: r["count"] for r in got} == {1: 1500, 2: 1500}


def test_asof_edges(spark):
    left, right = sides(2)
    a, b = frames(spark, left, right)
    assert T.asof_join(a.limit(0), b, ["k"], "at", "seen").count() == 0
    empty = T.asof_join(a, b.limit(0), ["k"], "at", "seen")
    assert empty.count() == len(left)
    assert empty.where("right_id is not null").count() == 0
    with pytest.raises(ValueError, match="rename"):
        T.asof_join(a, b.withColumn("AT", F.lit(1)), ["k"], "at", "seen")
    with pytest.raises(ValueError, match="how"):
        T.asof_join(a, b, ["k"], "at", "seen", how="full")


def intervals(seed, n=200):
    r = random.Random(seed)
    out = []
    for i in range(n):
        start = r.randrange(-50, 3000)
        length = r.choice([0, 1, 3, 10, 40, 700, 5000, -5])
        out.append((i, None if r.random() < 0.05 else r.choice([0, 0, 1, 2, 3]), start, start + length))
    return out


@pytest.mark.parametrize("hot_rows", [None, 1, 7])
def test_intervals(spark, hot_rows):
    r = random.Random(4)
    own = intervals(3)
    points = [(None if r.random() < 0.05 else r.choice([0, 0, 0, 1, 2, 9]), None if r.random() < 0.05 else r.randrange(-60, 3200), i) for i in range(600)]
    a = spark.createDataFrame(own, "i int, k int, lo long, hi long")
    b = spark.createDataFrame(points, "k int, t long, p int")
    got = sorted((x["i"], x["p"]) for x in T.interval_join(a, b, ["k"], "lo", "hi", "t", hot_rows).collect())
    assert got == sorted((i, p) for i, k, lo, hi in own for q, t, p in points if None not in (k, q, t) and k == q and lo <= t < hi)
    no_key = sorted((x["i"], x["p"]) for x in T.interval_join(a.drop("k"), b.drop("k"), [], "lo", "hi", "t", hot_rows).collect())
    assert no_key == sorted((i, p) for i, _, lo, hi in own for _, t, p in points if t is not None and lo <= t < hi)


def test_interval_edges(spark):
    a = spark.createDataFrame(intervals(3), "i int, k int, lo long, hi long")
    b = spark.createDataFrame([(0, 5, 1)], "k int, t long, p int")
    assert T.interval_join(a.limit(0), b, ["k"], "lo", "hi", "t").count() == 0
    assert T.interval_join(a, b.limit(0), ["k"], "lo", "hi", "t").count() == 0
    same = spark.createDataFrame([(1, 0, 2.5, 2.5), (2, 0, 2.25, 2.75)], "i int, k int, lo double, hi double")
    assert [r["i"] for r in T.interval_join(same, spark.createDataFrame([(0, 2.5)], "k int, t double"), ["k"], "lo", "hi", "t").collect()] == [2]


def test_a_hot_key_is_dealt_out(spark):
    """No window of the as-of join holds more than a fraction of a key that has all rows."""
    left, right = [(i, 0, i) for i in range(4000)], [(0, i, i, "x") for i in range(4000)]
    a, b = frames(spark, left, right)
    plan = T.asof_join(a, b, ["k"], "at", "seen", hot_rows=100)._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan
    assert "SinglePartition" not in plan
