"""Post-processing of question sets: first occurrences, missing ids, overrides, matches."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quarry.sources.shared import shared_path


def first_occurrence(frame: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by an order that has no ties."""
    others = [c for c in frame.columns if c != key]
    return frame.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r")).select(key, *[f"_r.{c}" for c in others])


def missing_ids(spark: SparkSession, present: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """The ids of a closed range that are not there; ids and range meet in a shuffle, not on the driver."""
    return spark.range(start, end + 1).withColumnRenamed("id", key).join(present.select(F.col(key).cast("long")).distinct(), key, "left_anti")


def override(frame: DataFrame, newer: DataFrame, key: str, column: str) -> DataFrame:
    """The column's newer value where there is one."""
    right = newer.groupBy(key).agg(F.min(column).alias("_new"))
    return frame.join(right, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*frame.columns)


def first_match(left: DataFrame, right: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each left row with the first right row of its key; rows without one are left out (see ``unmatched``)."""
    return left.join(first_occurrence(right, key, order), key)


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_anti")


def numbered(frame: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Rows with their place in an order of unique keys: places within sorted ranges plus the rows of the ranges before, of which one number a range
    goes to the driver. The ranges are written once to the shared folder, so a task that runs again gives the same places."""
    spark, path = frame.sparkSession, shared_path(frame.sparkSession, "ranges")
    frame.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.schema(StructType([*frame.schema.fields, StructField("_part", IntegerType())])).parquet(path)
    sizes = sorted((r[0], r[1]) for r in dealt.groupBy("_part").count().collect())
    before = itertools.accumulate([n for _, n in sizes], initial=0)
    starts = spark.createDataFrame([(k, b) for (k, _), b in zip(sizes, before, strict=False)], "_part int, _before long")
    line = Window.partitionBy("_part").orderBy(*order)
    placed = dealt.withColumn(name, F.row_number().over(line) - 1).join(F.broadcast(starts), "_part")
    return placed.select(*frame.columns, (F.col(name) + F.col("_before")).alias(name))


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of two frames side by side, by their places in given orders."""
    return numbered(left, left_order).join(numbered(right, right_order), "position")


def random_pick(frame: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """One of the first n rows."""
    return frame.limit(n).orderBy(F.rand(seed)).limit(1)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Beyond the question tools: visits of a user without a longer gap."""
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    starts = F.when(F.col("ts") > F.lag("ts").over(line) + F.expr(f"interval {gap}"), 1).when(F.lag("ts").over(line).isNull(), 1).otherwise(0)
    return events.withColumn("_new", starts).withColumn("session", F.sum("_new").over(line)).groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total"))
