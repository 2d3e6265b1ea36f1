"""Findings of the third round, each with a case that failed before."""

import hashlib
import itertools
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline
from quarry import queries
from quarry.functions import text as T
from quarry.llm import near_copies
from quarry.operators import keys, profile, sequences, time_joins, vectors
from quarry.plans import sqlrun, table_functions
from quarry.sources.catalog import TABLES, Catalog, Constraints


def test_keyword_match_holds_all_kinds_of_keywords(spark, sf_dir):
    """Nested calls, a name in other words and a name among words, beside the keywords that are read off the tables."""
    got = {tuple(r) for r in queries.QUERIES["keyword_column_match"](spark, sf_dir).collect()}
    said = {("MAX(COUNT(o_orderkey))", "o_orderkey", "orders", "o_orderkey", 1.0), ("order status", "order status", "orders", "o_orderstatus", 0.95), ("the l_tax", "l_tax", "lineitem", "l_tax", 1.0)}
    assert said <= got
    assert len(got) > len(said) + 3


def test_packets_move_as_digests(spark, tmp_path):
    """Repeated texts count once, and no text of a packet is shuffled."""
    for t in TABLES:
        spark.createDataFrame([("one two = three",), ("one two = three",), ("a  b",), ("",), (None,)], "text string").write.parquet(f"{tmp_path}/{t}.parquet")
    frame = queries.QUERIES["sql_packets_function"](spark, str(tmp_path))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "distinct" not in plan.lower().replace("isdistinct", "")
    want = {}
    for text in ("one two = three", "a  b"):
        own = list(table_functions.search_texts(text))
        want[hashlib.md5(text.encode()).hexdigest()] = (len(own), max(map(len, own)), sum({len(x) for x in own}))
    assert {r["keyword"]: (r["n_packets"], r["longest"], r["lengths"]) for r in frame.collect()} == want


def test_bare_columns_of_tied_rows(spark):
    """All bare columns come from one of the tied rows, the same on every run; nulls are no extremes."""
    rows = [(1, "b", 2, 5.0), (1, "a", 9, 5.0), (1, "c", 1, 5.0), (1, "0", 0, None), (2, "x", 7, 8.0), (2, "x", 3, 8.0), (2, "y", 4, 7.0)]
    for order in (rows, rows[::-1]):
        spark.createDataFrame(order, "k int, name string, n int, x double").coalesce(1).createOrReplaceTempView("tied")
        assert [tuple(r) for r in sqlrun.frame(spark, "SELECT k, name, n, MIN(x) AS least FROM tied WHERE k = 1 GROUP BY k").collect()] == [(1, "a", 9, 5.0)]
        assert [tuple(r) for r in sqlrun.frame(spark, "SELECT k, n, MAX(x) AS most FROM tied WHERE k = 2 GROUP BY k").collect()] == [(2, 3, 8.0)]


def test_cuts_of_hot_keys_are_fixed(spark):
    """The steps of an as-of join share one set of cuts; estimates made twice may differ between executors."""
    left = spark.range(500).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("at"), F.col("id").alias("left_id"))
    right = spark.range(500).select(F.lit(1).alias("k"), (F.col("id") - 0.5).alias("seen"), F.col("id").alias("right_id"))
    joined = time_joins.asof_join(left, right, ["k"], "at", "seen", ["right_id"], hot_rows=10)
    assert "approx_percentile" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert all(r["left_id"] == r["right_id"] for r in joined.collect())


def test_vectors_meet_in_blocks(spark, monkeypatch):
    """Blocks of both sides give what every pair gives: ties after rounding, equal vectors, groups, nulls and vectors of other kinds."""
    r = random.Random(3)
    rows = [(i, [r.choice([0.1, 0.25, -0.5, 1.0 / 3]) for _ in range(3)], r.choice([None, 0, 1, 2])) for i in range(300)]
    rows += [(300 + i, rows[0][1], 1) for i in range(40)]
    rows += [(400, None, 1), (401, [1.0, None, 2.0], 2), (402, [1.0], 0), (403, [float("nan"), 1.0, 1.0], 2), (404, [1e200, 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 0), (405, [0.1000001, 0.1, 0.1], None)]
    own = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    asked = own.where("vec_id % 50 = 0 or vec_id > 398")
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 60)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vectors, "PRODUCTS", 100)
    pairs = own.alias("v").crossJoin(asked.alias("q")).where("v.vec_id <> q.vec_id")
    every = pairs.select(F.col("q.vec_id").alias("query_id"), "v.label", "v.vec_id", F.round(T.dot(F.col("v.embedding"), F.col("q.embedding")), 6).alias("score"))
    for k, within in ((5, None), (2, "label")):
        group = ["query_id", *([within] if within else [])]
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("score").desc(), "vec_id"))
        want = every.withColumn("rank", rank).where(F.col("rank") <= k).select(*group, "vec_id", "score", "rank")
        found = vectors.top_by_dot(own, asked, k, within)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    assert vectors.top_by_dot(own.limit(0), asked).count() == vectors.top_by_dot(own, asked.limit(0)).count() == 0


def test_interval_counts_equal_the_join(spark, monkeypatch):
    """Without pairs of one window's points: repeated ids and times, hot keys, repeated and null groups, other widths."""
    r = random.Random(11)
    points = [(r.choice([1, 1, 1, 2, None]), r.choice([None, *range(60)]), r.choice([None, *range(400)])) for _ in range(900)]
    spans = [(i, r.choice([1, 1, 2, 3, None]), x, x + 20) for i, x in enumerate(r.randrange(-20, 400) for _ in range(300))]
    spans += [(7, 1, 0, 20), (7, 1, 10, 30), (None, 2, 5, 25), (None, 2, 6, 26), (901, 1, 5, 6), (902, 1, 9, 90), (903, 1, 9, 9), (904, 1, None, 3)]
    a = spark.createDataFrame(spans, "g int, k int, lo long, hi long")
    b = spark.createDataFrame(points, "k int, p int, t long")
    joined = time_joins.interval_join(a, b, ["k"], "lo", "hi", "t")
    want = joined.groupBy("g").agg(F.count("*").alias("n_rows"), F.countDistinct("p").alias("n_distinct"), F.min("t").alias("first_at"), F.max("t").alias("last_at")).collect()
    for hot in (10_000, 50):
        monkeypatch.setattr(time_joins, "LEAST_HOT", hot)
        got = time_joins.interval_counts(a, b, ["k"], "g", "lo", "hi", "t", "p", 20)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want))
    assert time_joins.interval_counts(a, b.limit(0), ["k"], "g", "lo", "hi", "t", "p", 20).count() == 0


def test_statistics_move_numbers(spark, tmp_path):
    """Both zeros are one value, as in SQL; columns go by number, values by 128 bits at most; nested and empty columns count too."""
    rows = [(0.0, 1, "a", [1], None), (-0.0, 2, "b", [1], None), (None, 2, "", None, None)]
    spark.createDataFrame(rows, "x double, n int, s string, l array<int>, z string").write.parquet(f"{tmp_path}/t.parquet")
    found = profile.column_statistics(Catalog(spark, str(tmp_path), ("t",), Constraints()))
    assert "md5" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r)[1:6] for r in found.collect()} == {("x", 3, 2, 1, 1), ("n", 3, 3, 0, 2), ("s", 3, 3, 0, 3), ("l", 3, 2, 1, 1), ("z", 3, 0, 3, 0)}


def test_sets_of_a_level_are_counted_together(spark, tmp_path, monkeypatch):
    """A slice refutes, and two passes a level at most settle large tables; a set that repeats one pair outside the slice is refuted too."""
    n = 4000
    rows = [(i % 80, i // 80, f"s{i % 2000}", 0.5 * (i // 2)) for i in range(n)] + [(79, 49, "t", -1.0)]
    frame = spark.createDataFrame(rows, "a int, b long, s string, x double")
    passes, own = [], keys._repeated
    monkeypatch.setattr(keys, "FEW_ROWS", 10)
    monkeypatch.setattr(keys, "_repeated", lambda f, sets, slices: passes.append(slices) or own(f, sets, slices))
    found = keys.unique_sets(frame)
    want = [c for c in itertools.combinations("absx", 2) if len({tuple(r["absx".index(k)] for k in c) for r in rows}) == len(rows)]
    assert found == want and ("a", "b") not in found
    assert len(passes) <= 4


def test_inclusions_move_values_once(spark, tmp_path):
    spark.createDataFrame([(1, "1"), (2, "2"), (None, None)], "n int, s string").write.parquet(f"{tmp_path}/a.parquet")
    spark.createDataFrame([(1, "2", 7), (2, "1", 7), (3, "x", 7), (3, "x", 7)], "m long, t string, c int").write.parquet(f"{tmp_path}/b.parquet")
    found = keys.inclusions(Catalog(spark, str(tmp_path), ("a", "b"), Constraints()))
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("a", "n", "b", "m", 2), ("a", "s", "b", "t", 2)}


def test_near_copies_come_from_the_gray_index(spark, monkeypatch):
    """Without any MinHash bucket the pipeline's stage still finds what lies within the distance of fingerprints, checked exactly."""
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join([*base[:399], "other"]), " ".join(base[::-1]), " ".join(base).upper()]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").coalesce(1)
    own = near_copies._prints(docs).withColumn("buckets", F.expr("cast(array() as array<long>)"))
    monkeypatch.setattr(near_copies, "_prints", lambda documents: own)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == [0, 2]


def test_first_rows_are_not_found_by_sorting_all(spark):
    """hashes stay above a short LIMIT, so that each task keeps only its first rows; the digest is that of the same rows without a LIMIT."""
    spark.range(0, 1000, 1, 5).select((F.col("id") * 7 % 1000).alias("i"), (F.col("id") % 3).alias("k")).createOrReplaceTempView("f11")
    limited = sqlrun.frame(spark, "SELECT i, k FROM f11 ORDER BY k, i LIMIT 20")
    digest = sequences.sequence_digest(limited)
    plan = digest._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
    same = sqlrun.frame(spark, "SELECT i, k FROM f11 WHERE k = 0 AND i IN (SELECT i FROM f11 WHERE k = 0 ORDER BY i LIMIT 20) ORDER BY i")
    assert digest.first() == sequences.sequence_digest(same).first()
    assert digest.first()["n_rows"] == 20
    assert digest.first()["digest"] != sequences.sequence_digest(sqlrun.frame(spark, "SELECT i, k FROM f11 ORDER BY k, i DESC LIMIT 20")).first()["digest"]


def test_sequences_hash_values_not_their_json(spark):
    """numbers and texts are hashed as they are; what was equal and what was not stays so."""

    def digest(sql):
        return sequences.sequence_digest(spark.sql(sql)).first()["digest"]

    made = sequences.sequence_digest(spark.sql("SELECT id, CAST(id AS STRING) AS s FROM range(5) ORDER BY id"))
    assert "ToJson" not in made._jdf.queryExecution().optimizedPlan().toString()
    equal = [("SELECT 1 AS a, 'x' AS b", "SELECT 1.0 AS c, 'x' AS d"), ("SELECT NULL", "SELECT CAST(NULL AS DOUBLE)"), ("SELECT DATE '2020-01-02'", "SELECT '2020-01-02'"), ("SELECT true", "SELECT 1"), ("SELECT map('a', 1)", "SELECT struct(1 AS a)")]
    for a, b in equal:
        assert digest(a) == digest(b), (a, b)
    apart = ["SELECT NULL, 'a'", "SELECT 'a', NULL", "SELECT NULL, NULL", "SELECT 1, NULL", "SELECT NULL, 1", "SELECT 1, 1", "SELECT '1', '1'", "SELECT 'null', 'a'", "SELECT '', 'a'", "SELECT 0D, 1", "SELECT -0D, 1"]
    apart += ["SELECT array(1, NULL), 1", "SELECT array(NULL, 1), 1", "SELECT '[1,null]', 1", "SELECT map('a', 1), 1", "SELECT double('NaN'), 1", "SELECT 'ab', 'c'", "SELECT 'a', 'bc'"]
    assert len({digest(sql) for sql in apart}) == len(apart)


def test_sequences_of_any_size_do_not_run_out_of_time(spark, sf_dir, monkeypatch):
    """a query that takes over a minute is not taken for a failed one; queries run several at a time, with the results of one at a time."""
    limits, own = [], sqlrun.with_timeout
    monkeypatch.setattr(sqlrun, "with_timeout", lambda spark, work, timeout: limits.append(timeout) or own(spark, work, timeout))
    assert queries.QUERIES["ordered_clusters"](spark, sf_dir).count() == 8
    assert limits == [None] * 8
    candidates = [(q, i, f"SELECT id FROM range({n}) ORDER BY id{d}") for q in range(2) for i, (n, d) in enumerate([(5, ""), (5, " DESC"), (6, ""), (5, "")])] + [(1, 4, "SELECT broken")]
    known = {}
    several = sqlrun.execute_all(spark, candidates, None, known, ordered=True, threads=3).collect()
    assert len(known) == 4
    assert several == sqlrun.execute_all(spark, candidates, None, ordered=True).collect()
