"""Helpers shared by the operators: table access, cut lineage in the shared folder, skew-safe lookups."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key counts as hot from this share of all rows; so at most HOT_SHARE keys are hot, which bounds what is broadcast.
HOT_SHARE = 256

#: Rows that a batch function gets at a time.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one in local mode where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), "quarry-checkpoints")
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame as Parquet in the shared folder and rereads it: lineage ends there, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._materialized = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_materialized", None):
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like the given one that the frame does not use, whatever columns its owner added."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in itertools.chain([name], (f"{name}_{i}" for i in itertools.count(1))) if n.lower() not in taken)


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """The frame with each row's place from 0 on in a global order of unique keys. Rows are sorted by ranges, and only one
    number a range goes to the driver."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = sorted((r[0], r[1]) for r in dealt.groupBy("_range").count().collect())
    before = dict(zip([k for k, _ in sizes], itertools.accumulate([m for _, m in sizes], initial=0), strict=False))
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]), F.col("_range").cast("long")) if before else F.lit(0)
    return dealt.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + offset).drop("_range")


def lookup(left: DataFrame, right: DataFrame, key: str, spread: Column, weight: str, total: int | None = None) -> DataFrame:
    """Left join to a frame with one row a key, where a key may hold any share of the left rows.

    ``right`` has ``key``, ``weight`` (how many left rows have the key) and the columns to add, and should be materialized unless the ``total`` of its weights is known.
    The keys with at least 1/HOT_SHARE of the weight, at most HOT_SHARE of them, are broadcast; their left rows meet no
    partner in the shuffled join and are dealt out by ``spread`` instead, so no task gets a hot key's rows.
    """
    added = [c for c in right.columns if c not in (key, weight)]
    total = right.agg(F.sum(weight)).first()[0] or 0 if total is None else total
    least = max(1000, total / HOT_SHARE)
    hot = right.where(F.col(weight) >= least).select(F.col(key), F.struct(*added).alias("_hot"), F.lit(True).alias("_is_hot"))
    cold = right.where(F.col(weight) < least).select(F.col(key).alias("_key"), F.lit(True).alias("_cold_key"), F.struct(*added).alias("_cold"))
    marked = left.join(F.broadcast(hot), key, "left").withColumn("_cold_side", F.col("_is_hot").isNull())
    as_key = F.xxhash64(spread).cast(right.schema[key].dataType) if right.schema[key].dataType.typeName() != "binary" else F.xxhash64(spread).cast("string").cast("binary")
    marked = marked.withColumn("_on", F.when(F.col("_cold_side"), F.col(key)).otherwise(as_key))
    out = marked.join(cold, (F.col("_on") == F.col("_key")) & (F.col("_cold_side") == F.col("_cold_key")), "left")
    picked = [F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in added]
    return out.select(*[F.col(c) for c in left.columns], *picked)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | list | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch, given at most BATCH_ROWS rows at a time so that what it makes stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                made = fn(batch.slice(start, BATCH_ROWS))
                if made is not None:
                    yield made
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives freed memory back to the system: workers live on between tasks, and their executor counts what they hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def utf8(texts: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as bytes, null as empty."""
    return [x or b"" for x in texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()]
