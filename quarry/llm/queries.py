"""The subpackage's queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import alignment, ann, html_text, itemsets, licenses, mixing, quality, sentencepiece, simhash, sketch, suffix, token_files, warc
from quarry.llm.common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score(documents, quality.train(documents, table(spark, sf_dir, "labels")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.of_documents(spark, sf_dir)


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_basket_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itemsets.of_sales(table(spark, sf_dir, "sale_lines"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_html_extraction, op2_quality_classifier, op3_license_scan, op4_warc_salvage, op5_simhash_near_dedup, op6_source_mixing, op7_document_fingerprints,
        op8_suffix_dedup, op9_sentencepiece, op10_nearest_neighbours, op11_token_alignment, op12_basket_itemsets, op13_token_files,
    )
    return {f.__name__: f for f in operators}


def oracle_sql() -> dict[str, str]:
    return {"op1_html_extraction": html_text.oracle_sql(), "op3_license_scan": licenses.oracle_sql(), "op4_warc_salvage": warc.oracle_sql(), "op12_basket_itemsets": itemsets.oracle_sql()}
