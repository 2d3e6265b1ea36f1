"""Readers and writers of the workflow's files: column descriptions, tasks, JSON lines, predictions, histories, statistics."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.versioned import VersionedTable

DESCRIPTION_FIELDS = ("original_column_name", "column_name", "column_description", "data_format", "value_description")
TASK_SCHEMA = "question_id long, db_id string, question string, evidence string, SQL string, difficulty string"
#: Fixed value: the mark between a predicted query and its database.
SEPARATOR = "\t----- bird -----\t"
#: Fixed value: a phrase that description files carry and that says nothing.
BOILERPLATE = "commonsense evidence:"


def clean_description(c: Column) -> Column:
    """Line ends become spaces, the boilerplate phrase and a leading "not useful" go."""
    flat = F.trim(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[\r\n]+", " "), F.lit(BOILERPLATE), F.lit("")))
    return F.trim(F.regexp_replace(flat, "(?i)^not useful", ""))


def joined_description(*parts: Column) -> Column:
    """The non-empty parts, by commas, with single spaces."""
    return F.regexp_replace(F.concat_ws(", ", *[F.nullif(F.trim(p), F.lit("")) for p in parts]), " {2,}", " ")


def read_descriptions(spark: SparkSession, directory: str) -> DataFrame:
    """table (lower-case file name) and the cleaned description fields of every CSV file of a directory.

    Files are UTF-8, with or without a mark; a file whose bytes are not is read as Windows-1252. Tasks read the files, so there may be many.
    """
    names = ["table", *DESCRIPTION_FIELDS]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    text = bytes(content).decode("utf-8-sig")
                except UnicodeDecodeError:
                    text = bytes(content).decode("cp1252", "replace")
                rows = ({(k or "").strip().lower(): v for k, v in row.items()} for row in csv.DictReader(io.StringIO(text, newline="")))
                table = unquote(path).rsplit("/", 1)[-1][: -len(".csv")].lower()
                yield pd.DataFrame([(table, *[own.get(f) or "" for f in DESCRIPTION_FIELDS]) for own in rows if "original_column_name" in own], columns=names)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(directory).select("path", "content")
    raw = found.mapInPandas(parse, ", ".join(f"`{n}` string" for n in names))
    return raw.select("table", *[(clean_description(F.col(f)) if f in ("column_description", "value_description") else F.trim(f)).alias(f) for f in DESCRIPTION_FIELDS])


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions; ids that are missing are their position in the array."""
    rows = spark.read.option("wholetext", True).text(path)
    parsed = rows.select(F.posexplode(F.from_json("value", f"array<struct<{TASK_SCHEMA.replace(' ', ':')}>>".replace(",:", ","), {"mode": "FAILFAST"})).alias("_at", "t"))
    return parsed.select("_at", "t.*").withColumn("question_id", F.coalesce("question_id", F.col("_at").cast("long"))).drop("_at")


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def prediction(sql: Column, db_id: Column) -> Column:
    """The exported form of a prediction; "0" where there is none."""
    return F.when(sql.isNull(), F.lit("0")).otherwise(F.concat(sql, F.lit(SEPARATOR), db_id))


def predicted_sql(value: Column) -> Column:
    return F.split_part(value, F.lit(SEPARATOR), F.lit(1))


def write_predictions(finals: DataFrame, path: str) -> None:
    """question_id, prediction in order of id: each run writes whole files, so nothing is locked or updated in place."""
    rows = finals.select(F.col("question_id").cast("string").alias("question_id"), prediction(F.col("sql"), F.col("db_id")).alias("prediction"))
    rows.orderBy(F.col("question_id").cast("long")).write.mode("overwrite").json(path)


def upsert_predictions(spark: SparkSession, finals: DataFrame, path: str) -> None:
    """Puts predictions in by question_id; those of other questions stay. The new set is written whole beside the old one
    first, so a run that breaks off leaves one of the two complete."""
    new = finals.select(F.col("question_id").cast("string").alias("question_id"), prediction(F.col("sql"), F.col("db_id")).alias("prediction"))
    if finished(spark, path) is not None:
        old = spark.read.schema("question_id string, prediction string").json(path)
        new = new.unionByName(old.join(new.select("question_id"), "question_id", "left_anti"))
    new.orderBy(F.col("question_id").cast("long")).write.mode("overwrite").json(f"{path}.next")
    spark.read.schema("question_id string, prediction string").json(f"{path}.next").orderBy(F.col("question_id").cast("long")).write.mode("overwrite").json(path)


def finished(spark: SparkSession, path: str) -> DataFrame | None:
    """question_id long of the predictions that lie there; None where nothing was written yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("question_id string, prediction string").json(path).select(F.col("question_id").cast("long").alias("question_id"))
    except AnalysisException:  # no such path
        return None


PREDICTED = "question_id string, prediction string"


def commit_predictions(spark: SparkSession, finals: DataFrame, path: str) -> int:
    """Puts predictions into a versioned table by question_id: runs that write at once lose nothing, readers see whole versions. Returns the version."""
    rows = finals.select(F.col("question_id").cast("string").alias("question_id"), prediction(F.col("sql"), F.col("db_id")).alias("prediction"))
    return VersionedTable(spark, path).upsert(rows, ["question_id"])


def read_predictions(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """question_id, prediction of a version, the last by default; none before the first."""
    table = VersionedTable(spark, path)
    return table.read(version) if table.versions() else spark.createDataFrame([], PREDICTED)


def write_json_array(frame: DataFrame, path: str, order: list[str]) -> None:
    """All rows as one JSON array in a text file: for what people read (statistics, schemas of a few questions), not for data."""
    kept = F.struct(*[F.col(c) for c in order], F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"}).alias("_json"))
    listed = F.transform(F.array_sort(F.collect_list(kept)), lambda r: r["_json"])
    frame.agg(F.concat(F.lit("["), F.array_join(listed, ",\n"), F.lit("]")).alias("value")).write.mode("overwrite").text(path)


def write_arguments(spark: SparkSession, arguments: dict[str, object], path: str) -> None:
    """The arguments of a run, as one JSON object."""
    import json

    spark.createDataFrame([(json.dumps(arguments, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_conversations(conversations: DataFrame, path: str) -> None:
    """What was asked and answered, appended."""
    conversations.write.mode("append").json(path)


def write_sql_text(predictions: DataFrame, path: str) -> None:
    """One query a line."""
    predictions.select(F.regexp_replace(predicted_sql(F.col("prediction")), r"\s*[\r\n]+\s*", " ").alias("value")).write.mode("overwrite").text(path)


def write_tool_sql(candidates: DataFrame, path: str) -> None:
    """For each stage its first query of each question, in a folder of the stage."""
    candidates.where("ord = 0").select("stage", "question_id", "sql").write.mode("overwrite").partitionBy("stage").json(path)


def write_schema_links(schemas: DataFrame, path: str) -> None:
    """Appends db_id, db_schema, question_id and other columns as JSON lines."""
    schemas.write.mode("append").json(path)


def write_structured_schemas(questions: DataFrame, path: str) -> None:
    """One JSON object a question: its own columns, and under ``schema`` the tables that ``schema_ops.structured_questions`` gives for it."""
    fields = ("table", "columns", "primary_keys", "foreign_keys")
    own = [c for c in questions.columns if c not in fields]
    listed = F.array_sort(F.collect_list(F.struct(*fields))).alias("schema")  # a question's tables
    questions.groupBy(*own).agg(listed).write.mode("overwrite").json(path)


def write_history(history: DataFrame, path: str) -> None:
    """Tool runs, one folder a database."""
    history.write.mode("append").partitionBy("db_id").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def write_statistics(statistics: DataFrame, path: str) -> None:
    statistics.write.mode("overwrite").json(path)


def run_directory(root: str, mode: str, setting: str, dataset: str, start: str) -> str:
    return "/".join(x.strip("/") if i else x.rstrip("/") for i, x in enumerate((root, mode, setting, dataset, start)))
