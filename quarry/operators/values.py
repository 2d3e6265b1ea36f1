"""The fuzzy value index: distinct values, their n-grams and signatures, and keyword lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.bounds import MOST_SMALL
from quarry.operators.profile import eligible
from quarry.sources.catalog import Catalog

TOP = 10


def unique_values(catalog: Catalog, columns: list[tuple[str, str]] | None = None) -> DataFrame:
    """table, column, value of all eligible columns (or those given), each value once.

    The gate is found first, from a profile that moves digests only; values are fetched for the columns that pass, whose
    names (a bounded list, no data) come to the driver.
    """
    chosen = columns if columns is not None else sorted((r[0], r[1]) for r in eligible(catalog).select("table", "column").collect())
    return catalog.long_text(chosen).distinct()


def signatures(values: DataFrame, slots: int = T.PERMUTATIONS, n: int = T.NGRAM) -> DataFrame:
    return values.withColumn("signature", T.signature(T.ngrams(F.col("value"), n), slots))


def write_index(values: DataFrame, path: str, slots: int = T.PERMUTATIONS, n: int = T.NGRAM) -> None:
    """Values with grams and signatures, sorted by table and column so that lookups of one column read little.

    Ranges end inside a column too, so a column with most of the values is dealt to many tasks.
    """
    dealt = values.repartitionByRange("table", "column", F.xxhash64("value")).sortWithinPartitions("table", "column")
    made = dealt.withColumn("grams", T.ngrams(F.col("value"), n)).withColumn("signature", T.signature(F.col("grams"), slots))
    made.write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _top(scored: DataFrame, score: str, top: int) -> DataFrame:
    order = Window.partitionBy("keyword").orderBy(F.col(score).desc(), "table", "column", "value")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def jaccard_top(values: DataFrame, keywords: DataFrame, top: int = TOP, n: int = T.NGRAM) -> DataFrame:
    """keyword, table, column, value, jaccard, rank: exact n-gram similarity, best first.

    Candidates meet on shared grams: the keywords' grams select those of the index, the counts of shared grams and the sets'
    sizes give the similarity, so no sets travel. ``keywords``: keyword string.
    """
    grams = values.withColumn("_grams", T.ngrams(F.col("value"), n))
    index = grams.select("table", "column", "value", F.size("_grams").alias("_n"), F.explode("_grams").alias("_gram"))
    asked = keywords.select("keyword").distinct().withColumn("_own", T.ngrams(F.col("keyword"), n))
    asked = asked.select("keyword", F.size("_own").alias("_m"), F.explode("_own").alias("_gram"))
    shared = index.join(asked, "_gram").groupBy("keyword", "table", "column", "value", "_n", "_m").agg(F.count("*").alias("_both"))
    scored = shared.withColumn("jaccard", F.round(F.col("_both") / (F.col("_n") + F.col("_m") - F.col("_both")), 6))
    return _top(scored, "jaccard", top).select("keyword", "table", "column", "value", "jaccard", "rank")


def signature_top(signed: DataFrame, keywords: DataFrame, top: int = TOP, slots: int = T.PERMUTATIONS, n: int = T.NGRAM) -> DataFrame:
    """The same by signatures: every value that shares a slot with a keyword is a candidate, the share of equal slots is the estimate.

    As each slot is a band of its own, the matches of the join count the equal slots, and no signature travels.
    """
    asked = keywords.select("keyword").distinct().withColumn("_asked", T.signature(T.ngrams(F.col("keyword"), n), slots))
    asked = asked.select("keyword", F.posexplode("_asked").alias("_slot", "_key"))
    if keywords.limit(MOST_SMALL // slots + 1).count() <= MOST_SMALL // slots:
        asked = F.broadcast(asked)  # then the index stays where it is
    index = signed.select("table", "column", "value", F.posexplode("signature").alias("_slot", "_key"))
    met = index.join(asked, ["_slot", "_key"]).groupBy("keyword", "table", "column", "value").agg((F.count("*") / slots).alias("estimate"))
    return _top(met, "estimate", top).select("keyword", "table", "column", "value", "estimate", "rank")


def by_column(found: DataFrame, score: str = "jaccard") -> DataFrame:
    """keyword, table, column and the values found, best first."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col("value").alias("v"))))
    return found.groupBy("keyword", "table", "column").agg(F.transform(listed, lambda e: e.v).alias("values"))


def value_exists(frame: DataFrame, column: str, value: str) -> bool:
    """Whether any row's column contains the value, without regard to case."""
    return not frame.where(F.contains(F.lower(column), F.lit(value.lower()))).limit(1).isEmpty()
