"""Digests of results in their order."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import sequences as S
from quarry.plans import sqlrun


def digest(frame):
    return S.sequence_digest(frame).first()["digest"]


def numbers(spark, n, parts, seed=0):
    r = random.Random(seed)
    rows = [(r.randrange(50), i, r.choice([None, "a", "b"])) for i in range(n)]
    return spark.createDataFrame(rows, "k int, i int, s string").repartition(parts, "i")


@pytest.mark.parametrize("n", [0, 1, 2, 777])
def test_same_order_same_digest(spark, n):
    one = numbers(spark, n, 3).orderBy("k", "i")
    two = numbers(spark, n, 7).where("i >= 0").orderBy("k", "i")
    alone = numbers(spark, n, 1).coalesce(1).sortWithinPartitions("k", "i")
    assert digest(one) == digest(two) == digest(alone)
    assert S.sequence_digest(one).first()["n_rows"] == n


def test_order_repetition_and_values_count(spark):
    base = numbers(spark, 500, 4)
    seen = [digest(base.orderBy("k", "i")), digest(base.orderBy(F.desc("k"), "i")), digest(base.union(base).orderBy("k", "i")), digest(base.orderBy("i")), digest(base.where("i < 499").orderBy("k", "i"))]
    seen += [digest(base.withColumn("s", F.coalesce("s", F.lit("null"))).orderBy("k", "i")), digest(base.select("i", "k", "s").orderBy("k", "i")), digest(base.select("k", "i").orderBy("k", "i"))]
    assert len(set(seen)) == len(seen)
    assert digest(base.withColumn("k", F.col("k").cast("double")).orderBy("k", "i")) == seen[0]  # 1 and 1.0 are equal, as in clusters


def test_one_range_or_many(spark):
    """Folding ranges in turn gives what one pass gives, by the definition of the polynomial."""
    rows = numbers(spark, 300, 1).coalesce(1).sortWithinPartitions("k", "i")
    said = [r[0] for r in rows.toDF("c0", "c1", "c2").select(F.to_json(F.struct(F.col("c0").cast("double").alias("c0"), F.col("c1").cast("double").alias("c1"), "c2"), {"ignoreNullFields": "false"})).collect()]
    hashes = [r[0] for r in spark.createDataFrame([(x,) for x in said], "x string").coalesce(1).select(F.xxhash64("x", F.lit(0))).collect()]
    value = 0
    for h in hashes:
        value = (value * S.BASES[0] + (h % 2**64) % S.PRIMES[0]) % S.PRIMES[0]
    folded = S.canonical(rows).select(*[F.xxhash64(F.to_json(F.struct("c0", "c1", "c2"), {"ignoreNullFields": "false"}), F.lit(i)).alias(f"l{i}") for i in range(S.LANES)]).mapInArrow(S._fold, S.FOLDED).collect()
    assert len(folded) == 1
    assert folded[0]["h0"] == value
    assert folded[0]["p0"] == pow(S.BASES[0], 300, S.PRIMES[0])


def test_which_queries_say_an_order(spark):
    numbers(spark, 20, 2).createOrReplaceTempView("seq")
    said = {
        "SELECT k FROM seq ORDER BY k, i": True, "SELECT k FROM seq": False, "SELECT k + 1 AS x FROM (SELECT * FROM seq ORDER BY i) AS t": True, "SELECT k, COUNT(*) FROM seq GROUP BY k": False,
        "SELECT k FROM seq ORDER BY i LIMIT 3": True, "SELECT k FROM seq LIMIT 3": False, "SELECT k, COUNT(*) AS n FROM seq GROUP BY k ORDER BY n DESC, k": True,
    }
    for sql, ordered in said.items():
        assert S.is_ordered(sqlrun.frame(spark, sql)) is ordered, sql


def test_votes_by_order(spark):
    numbers(spark, 60, 3).createOrReplaceTempView("seq")
    sqls = ["SELECT i FROM seq ORDER BY i DESC", "SELECT i FROM seq ORDER BY i", "SELECT t.i FROM seq AS t ORDER BY t.i ASC"]
    assert sqlrun.aggregate_sqls(spark, sqls) == sqls[1]  # sets: all three agree, the shortest wins
    assert sqlrun.aggregate_sqls(spark, [sqls[0], *sqls[1:]], ordered=True) == sqls[1]
    executed = sqlrun.execute_all(spark, [(0, i, s) for i, s in enumerate([*sqls, "SELECT i FROM seq UNION ALL SELECT i FROM seq", "SELECT i FROM seq"])], ordered=True)
    digests = [r["digest"] for r in executed.orderBy("ord").collect()]
    assert digests[1] == digests[2]
    assert len(set(digests)) == 4
    assert S.same_sequence(sqlrun.frame(spark, sqls[1]), sqlrun.frame(spark, sqls[2]))
    assert not S.same_sequence(sqlrun.frame(spark, sqls[0]), sqlrun.frame(spark, sqls[1]))
    assert S.same_sequence(sqlrun.frame(spark, sqls[0]), sqlrun.frame(spark, "SELECT i FROM seq"))  # one side says no order
