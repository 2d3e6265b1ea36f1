"""Column profiles and the gates of the value index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.catalog import Catalog

# Parts of a column's name that keep it out of the value index.
SKIPPED_NAMES = r"_id| id|url|email|web|time|phone|date|address"
MOST_CATEGORIES = 20
EXAMPLES, EXAMPLE_LENGTH = 3, 50
LONG_VALUE = 256


def text_profile(catalog: Catalog, columns: list[tuple[str, str]] | None = None) -> DataFrame:
    """table, column, n_distinct, sum_length, avg_length over the distinct values of string columns.

    The shuffle moves a digest and a length of each value, not the value.
    """
    values = catalog.long_text(columns).select("table", "column", F.md5("value").alias("digest"), F.length("value").alias("length"))
    distinct = values.groupBy("table", "column", "digest").agg(F.max("length").alias("length"))
    profile = distinct.groupBy("table", "column").agg(F.count("*").alias("n_distinct"), F.sum("length").cast("long").alias("sum_length"))
    return profile.withColumn("avg_length", F.round(F.col("sum_length") / F.col("n_distinct"), 6))


def name_allowed(column: Column, primary: list[str]) -> Column:
    """Whether a column's name lets it into the index: no key of any table, no skipped part."""
    return ~F.lower(column).isin([p.lower() for p in primary]) & ~F.lower(column).rlike(SKIPPED_NAMES) & ~column.rlike("Id$")


def size_allowed() -> Column:
    """Whether a profiled column is small or selective enough for the index."""
    named = F.lower("column").contains("name") & (F.col("sum_length") < 5_000_000)
    short = (F.col("sum_length") < 2_000_000) & (F.col("avg_length") < 25)
    return named | short | (F.col("n_distinct") < 100)


def skipped(profile: DataFrame) -> DataFrame:
    """The older rule: long columns that are no names are skipped."""
    rule = ~F.lower("column").contains("name") & (F.col("sum_length") > 50_000) & (F.col("avg_length") > 20)
    return profile.select("table", "column", rule.alias("skip"))


def eligible(catalog: Catalog) -> DataFrame:
    """The profile of all string columns that a value index takes."""
    primary = sorted({c for key in catalog.constraints.primary.values() for c in key})
    return text_profile(catalog).where(name_allowed(F.col("column"), primary) & size_allowed())


def _digest(c: str, kind: str) -> tuple[Column, Column]:
    """128 bits that tell a column's values apart, the first half null for null: whole numbers as they are, others by two independent hashes."""
    own = F.col(f"`{c}`")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return own.cast("long"), F.lit(0).cast("long")
    if kind.startswith(("array", "map", "struct")):
        own = F.when(own.isNotNull(), F.to_json(F.struct(own)))
    elif kind == "variant":
        own = F.to_json(own)
    return F.when(own.isNotNull(), F.xxhash64(own)), F.when(own.isNotNull(), F.xxhash64(F.lit(1), own))


def column_statistics(catalog: Catalog, tables: tuple[str, ...] | None = None) -> DataFrame:
    """table, column, n_rows, n_non_null, n_null, n_distinct and the text form of every column.

    One aggregation per table; distinct values are counted over 128 bits each, and columns go by number, so little moves.
    """
    out = None
    for t in tables or catalog.names:
        frame = catalog.table(t)
        pairs = F.array(*[F.struct(F.lit(i).alias("col"), h.alias("h"), g.alias("g")) for i, (h, g) in enumerate(_digest(c, kind) for c, kind in frame.dtypes)])
        counted = frame.select(F.explode(pairs).alias("e")).groupBy("e.col", "e.h", "e.g").agg(F.count("*").alias("n"))
        one = counted.groupBy("col").agg(
            F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("h").isNotNull(), F.col("n"))), F.lit(0)).alias("n_non_null"),
            F.coalesce(F.sum(F.when(F.col("h").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.count("h").alias("n_distinct"),
        )
        name = F.element_at(F.array(*map(F.lit, frame.columns)), F.col("col") + 1).alias("column")
        one = one.select(F.lit(t).alias("table"), name, "n_rows", "n_non_null", "n_null", "n_distinct")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("value_statics", F.format_string("Total count %d - Distinct count %d - Null count %d", "n_non_null", "n_distinct", "n_null"))


def categorical(statistics: DataFrame, most: int = MOST_CATEGORIES) -> DataFrame:
    """The columns with few values; null counts as one."""
    n = F.col("n_distinct") + F.when(F.col("n_null") > 0, 1).otherwise(0)
    return statistics.select("table", "column", n.alias("n_values")).where(F.col("n_values") < most)


def examples(catalog: Catalog, columns: list[tuple[str, str]] | None = None, n: int = EXAMPLES) -> DataFrame:
    """table, column, examples: the first n distinct values in order, for columns whose first one is short."""
    values = catalog.long_text(columns)
    own = values.groupBy("table", "column", "value").agg(F.lit(1).alias("one"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("table", "column").orderBy("value"))
    top = own.withColumn("rank", rank).where(F.col("rank") <= n)
    listed = top.groupBy("table", "column").agg(F.array_sort(F.collect_list("value")).alias("examples"))
    return listed.where(F.length(F.col("examples")[0]) < EXAMPLE_LENGTH)


def masked(value: Column) -> Column:
    """Long values are shown as null."""
    return F.when(F.length(value) < LONG_VALUE, value).otherwise("null")
