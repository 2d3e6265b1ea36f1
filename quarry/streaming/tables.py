"""Streams beyond the batch tools: windowed event counts with late data, and a value index kept up to date.

Tables arrive as Parquet files of a directory; each query runs over what is there and stops (availableNow), or goes on if asked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T


def read_stream(spark: SparkSession, sf_dir: str, table: str, files_per_trigger: int = 8) -> DataFrame:
    """A table as a stream: a directory of Parquet files, or the one file of that name."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{table}.parque[t]")


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by tumbling window and event type; works on batch and stream frames alike."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    marked = stamped.withWatermark("at", late) if events.isStreaming else stamped
    grouped = marked.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events", "total")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what a stream has now as Parquet, exactly once."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def index_new_values(stream: DataFrame, table: str, columns: list[str], path: str, checkpoint: str) -> None:
    """Adds the values of a stream that an index does not have yet, with their signatures."""
    spark = stream.sparkSession

    def add(batch: DataFrame, _: int) -> None:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
        seen = batch.select(F.explode(pairs).alias("e")).select(F.lit(table).alias("table"), "e.column", "e.value").where("value is not null").distinct()
        try:
            seen = seen.join(spark.read.parquet(path).select("table", "column", "value"), ["table", "column", "value"], "left_anti")
        except Exception as e:  # noqa: BLE001  the first batch finds no index
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        grams = T.ngrams(F.col("value"))
        seen.withColumn("grams", grams).withColumn("signature", T.signature(F.col("grams"))).write.mode("append").parquet(path)

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
