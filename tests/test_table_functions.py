"""Table functions in SQL text, versioned predictions, places without a single task, bounded fetches."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import datasets, results
from quarry.plans import sqlrun, table_functions
from quarry.sources import files

TEXTS = ["c_mktsegment = BUILDING", "blue ring", "ab", " two  spaces ", "", " ", None, "a=b=c", "x y x y", "tab\tin it"]


def test_packets_equal_the_column_function(spark):
    spark.createDataFrame([(t, i) for i, t in enumerate(TEXTS)], "said string, n int").createOrReplaceTempView("said")
    table_functions.register(spark)
    got = spark.sql("SELECT keyword, substring FROM search_packets(TABLE(said), 'said')").collect()
    want = spark.table("said").where("said is not null").select(F.col("said").alias("keyword"), F.explode(T.search_texts(F.col("said"))).alias("substring")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    with pytest.raises(Exception, match="no column 'other' in said, n"):
        spark.sql("SELECT * FROM search_packets(TABLE(said), 'other')").collect()


def test_clusters_equal_the_operator(spark):
    rows = [(q, i, f"s{i}", None if i % 5 == 4 else f"d{(i * q) % 3}", "failed" if i % 5 == 4 else None) for q in (1, 2, 3) for i in range(9)]
    executed = spark.createDataFrame(rows, "question_id long, ord int, sql string, digest string, error string")
    executed.createOrReplaceTempView("executed")
    table_functions.register(spark)
    got = spark.sql("SELECT question, ord, cluster_size, cluster_first FROM result_clusters(TABLE(executed), 'question_id', 'ord', 'digest')").collect()
    want = results.clusters(executed).select(F.col("question_id").cast("string"), "ord", "cluster_size", "cluster_first").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_predictions_keep_versions(spark, tmp_path):
    kind = "question_id long, db_id string, sql string"
    path = f"file://{tmp_path}/p"
    assert files.read_predictions(spark, path).count() == 0
    assert files.commit_predictions(spark, spark.createDataFrame([(1, "db", "SELECT 1"), (2, "db", "SELECT 2")], kind), path) == 1
    early = files.read_predictions(spark, path)
    files.commit_predictions(spark, spark.createDataFrame([(2, "db", "SELECT 22"), (3, "db", None)], kind), path)
    now = {r["question_id"]: r["prediction"].split("\t")[0] for r in files.read_predictions(spark, path).collect()}
    assert now == {"1": "SELECT 1", "2": "SELECT 22", "3": "0"}
    assert early.count() == files.read_predictions(spark, path, 1).count() == 2


def test_numbered(spark):
    frame = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.col("id").alias("_part")).repartition(6)
    got = datasets.numbered(frame.withColumnRenamed("_part", "other"), ["k"]).orderBy("position").collect()
    assert [r["k"] for r in got] == list(range(500))
    assert [r["position"] for r in got] == list(range(500))
    assert datasets.numbered(frame.withColumnRenamed("_part", "other").limit(0), ["k"]).count() == 0


def test_fetch_is_bounded(spark):
    with pytest.raises(ValueError, match="over 10 rows"):
        sqlrun.run_sql(spark, "SELECT id FROM range(20)", most=10)
    assert len(sqlrun.run_sql(spark, "SELECT id FROM range(20)", most=None)) == 20
    assert len(sqlrun.run_sql(spark, "SELECT id FROM range(10)", most=10)) == 10
    assert sqlrun.run_sql(spark, "SELECT GROUP_CONCAT(id, '-' ORDER BY id DESC) FROM (SELECT 1 AS id UNION ALL SELECT 3 UNION ALL SELECT 2) AS t", "one") == ("3-2-1",)
