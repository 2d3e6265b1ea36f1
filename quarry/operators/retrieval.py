"""Retrieval for questions: similar columns, similar values, column context. All questions at once, in lazy plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.bounds import blocks_joined
from quarry.operators.values import jaccard_top
from quarry.operators.vectors import nearest_columns

EDIT_LEAST, EMBEDDING_LEAST, RELATIVE_LEAST, NAME_LEAST = 0.3, 0.6, 0.9, 0.9


def search_packets(keywords: DataFrame) -> DataFrame:
    """keyword, substring: what each keyword is looked up as; longer ones first within a keyword."""
    made = keywords.select("keyword", F.explode(T.search_texts(F.col("keyword"))).alias("substring"))
    return made.distinct().orderBy(F.col("keyword").desc(), F.length("substring").desc(), F.col("substring").desc())


def potential_names(keywords: DataFrame) -> DataFrame:
    """keyword, name: the keyword, its left side of "=", the insides of parentheses, its words."""
    names = F.concat(F.array("keyword"), F.filter(F.array(T.column_part(F.col("keyword"))), lambda x: x.isNotNull()), T.parenthesized("keyword"), F.split("keyword", r"\s+"))
    return keywords.select("keyword", F.explode(F.transform(names, F.trim)).alias("name")).where("name != ''").distinct()


def keyword_columns(keywords: DataFrame, columns: DataFrame, least: float = NAME_LEAST) -> DataFrame:
    """keyword, name, table, column, similarity of names that match column names, in their normal forms.

    Names are few and columns are metadata; their number is checked before they are sent around.
    """
    pairs = blocks_joined(potential_names(keywords), columns.select("table", "column"))
    scored = pairs.withColumn("similarity", T.ratio(T.normalized_name(F.col("name")), T.normalized_name(F.col("column"))))
    return scored.where(F.col("similarity") >= least).select("keyword", "name", "table", "column", F.round("similarity", 6).alias("similarity"))


def similar_columns(keywords: DataFrame, columns: DataFrame, question: str, hint: str) -> DataFrame:
    """table, column, score: matched columns by the likeness of their qualified name to question and hint, best first."""
    matched = keyword_columns(keywords, columns).select("table", "column").distinct()
    name = F.concat(F.lit("`"), F.col("table"), F.lit("`.`"), F.col("column"), F.lit("`"))
    scored = matched.withColumn("score", F.round(T.dot(T.embedding(name), T.embedding(F.lit(f"{question} {hint}"))), 6))
    return scored.groupBy("table", "column").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "table", "column")


def edit_filter(found: DataFrame, least: float = EDIT_LEAST, native: bool = False) -> DataFrame:
    """Rows (substring, value) that are alike enough, with edit_similarity."""
    score = T.edit_similarity(F.col("substring"), F.col("value")) if native else T.ratio("substring", "value")
    return found.withColumn("edit_similarity", score).where(F.col("edit_similarity") >= least)


def embedding_filter(found: DataFrame, least: float = EMBEDDING_LEAST) -> DataFrame:
    return found.withColumn("embedding_similarity", T.dot(T.embedding("substring"), T.embedding("value"))).where(F.col("embedding_similarity") >= least)


def near_the_best(found: DataFrame, score: str, group: list[str], share: float = RELATIVE_LEAST, small: bool = False) -> DataFrame:
    """Rows whose score is at least a share of the best of their group; a null in the group's columns is a group too.

    The groups' maxima are aggregated first and joined back, so rows of a large group need not meet in a task. ``small``:
    the rows are few and dear to compute; a window sees them once.
    """
    if small:
        best = F.max(score).over(Window.partitionBy(*group))
        return found.withColumn("_best", best).where(F.col(score) >= F.lit(share) * F.col("_best")).drop("_best")
    best = found.groupBy(*[F.col(c).alias(f"_{c}") for c in group]).agg(F.max(score).alias("_best"))
    met = F.col(score) >= F.lit(share) * F.col("_best")
    for c in group:
        met = met & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return found.join(best, met, "left_semi")


def similar_entities(keywords: DataFrame, values: DataFrame, top: int = 10) -> DataFrame:
    """keyword, substring, table, column, value and similarities: lookup, then edit, embedding and relative filters.

    The cheap, native steps come first; the Python ones see what is left, at most ``top`` values a substring.
    """
    packets = search_packets(keywords)
    found = jaccard_top(values, packets.select(F.col("substring").alias("keyword")), top).withColumnRenamed("keyword", "substring")
    met = found.join(packets, "substring")
    close = embedding_filter(edit_filter(met))
    group = ["table", "column"]
    kept = near_the_best(near_the_best(close, "edit_similarity", group, small=True), "embedding_similarity", group, small=True)
    return kept.select("keyword", "substring", "table", "column", "value", F.round("jaccard", 6).alias("jaccard"), F.round("edit_similarity", 6).alias("edit_similarity"), F.round("embedding_similarity", 6).alias("embedding_similarity"))


def entity_examples(entities: DataFrame) -> DataFrame:
    """table, column, examples found by the funnel."""
    return entities.groupBy("table", "column").agg(F.array_sort(F.collect_set("value")).alias("examples"))


def column_context(keywords: DataFrame, documents: DataFrame, question: str, hint: str, k: int = 5) -> DataFrame:
    """table, column and descriptions of the columns nearest to each keyword in the light of question and hint, by least distance."""
    texts = keywords.select(F.explode(F.array(*[F.concat(F.lit(f"{c} "), "keyword") for c in (question, hint)])).alias("query")).distinct()
    near = nearest_columns(documents, texts.withColumn("embedding", T.embedding("query")), k)
    kept = ("column_name", "column_description", "value_description")
    best = near.groupBy("table", "column").agg(F.min("distance").alias("distance"), F.min_by(F.struct(*kept), "distance").alias("d"))
    return best.select("table", "column", "distance", *[f"d.{c}" for c in kept])


@dataclass
class Retrieved:
    keywords: DataFrame
    context: DataFrame
    columns: DataFrame
    entities: DataFrame


def retrieve(keywords: DataFrame, columns: DataFrame, values: DataFrame, documents: DataFrame, question: str, hint: str, k: int = 5) -> Retrieved:
    """All retrieval for a question in one call."""
    return Retrieved(keywords, column_context(keywords, documents, question, hint, k), similar_columns(keywords, columns, question, hint), similar_entities(keywords, values))
