"""Schema algebra over (table, column, ...) frames; names match without regard to case.

Schemas are metadata: thousands of rows, not data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.profile import masked
from quarry.sources.catalog import Catalog

INFO_FIELDS = ("type", "is_primary", "examples", "column_name", "column_description", "value_description", "value_statics")


def from_map(spark: SparkSession, columns: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(t, c) for t, own in columns.items() for c in own], "table string, column string")


def from_tables(spark: SparkSession, tables: list[str]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in tables], "table string")


def with_examples(spark: SparkSession, examples: dict[str, dict[str, list[str]]]) -> DataFrame:
    return spark.createDataFrame([(t, c, x) for t, own in examples.items() for c, x in own.items()], "table string, column string, examples array<string>")


def with_descriptions(spark: SparkSession, descriptions: dict[str, dict[str, dict[str, str]]]) -> DataFrame:
    fields = ("column_name", "column_description", "value_description")
    return spark.createDataFrame([(t, c, *[d.get(f, "") for f in fields]) for t, own in descriptions.items() for c, d in own.items()], "table string, column string, " + ", ".join(f"{f} string" for f in fields))


def to_map(schema: DataFrame) -> dict[str, list[str]]:
    """The schema as a dictionary, for the edge of the library (metadata only)."""
    out: dict[str, list[str]] = {}
    for r in schema.select("table", "column").collect():
        out.setdefault(r[0], []).append(r[1])
    return out


def _keyed(schema: DataFrame) -> DataFrame:
    return schema.withColumn("_t", F.lower("table")).withColumn("_c", F.lower("column"))


def column_info(schema: DataFrame, table: str, column: str) -> DataFrame:
    return schema.where((F.lower("table") == table.lower()) & (F.lower("column") == column.lower()))


def primary_keys(schema: DataFrame, table: str) -> DataFrame:
    return schema.where((F.lower("table") == table.lower()) & F.col("is_primary")).select("column")


def subselect(full: DataFrame, selected: DataFrame) -> DataFrame:
    """The rows of a full schema that a selection names, in the full schema's spelling; unknown names are dropped."""
    chosen = selected.select(F.lower("table").alias("_t"), F.lower("column").alias("_c")).distinct()
    return _keyed(full).join(chosen, ["_t", "_c"], "left_semi").drop("_t", "_c")


def union(*schemas: DataFrame) -> DataFrame:
    """Columns of any of the schemas, each once; the first schema's spelling stays."""
    out = None
    for i, s in enumerate(schemas):
        one = s.select("table", "column", F.lit(i).alias("_at"))
        out = one if out is None else out.unionByName(one)
    first = F.min_by(F.struct("table", "column"), F.struct("_at", "table", "column"))
    return out.groupBy(F.lower("table").alias("_t"), F.lower("column").alias("_c")).agg(first.alias("s")).select("s.table", "s.column")


def canonical_union(full: DataFrame, *schemas: DataFrame) -> DataFrame:
    return subselect(full, union(*schemas)).select("table", "column")


def add_info(schema: DataFrame, info: DataFrame, fields: list[str]) -> DataFrame:
    """Fields of another schema laid over the first one's; columns it does not know keep theirs."""
    unknown = [f for f in fields if f not in INFO_FIELDS]
    if unknown:
        raise ValueError(f"unknown fields {unknown}; there are {INFO_FIELDS}")
    other = _keyed(info).groupBy("_t", "_c").agg(F.first(F.struct(*fields)).alias("_new"))
    joined = _keyed(schema).join(other, ["_t", "_c"], "left")
    for f in fields:
        joined = joined.withColumn(f, F.coalesce(F.col(f"_new.{f}"), F.col(f)) if f in schema.columns else F.col(f"_new.{f}"))
    return joined.drop("_t", "_c", "_new")


def connections(full: DataFrame, edges: DataFrame, working: DataFrame) -> DataFrame:
    """The columns of the working tables that connect: primary keys, both sides of foreign keys between working tables, and
    columns named like another working table's primary key. ``full``: table, column, is_primary."""
    tables = working.select(F.lower("table").alias("_w")).distinct()
    own = full.join(tables, F.lower("table") == F.col("_w")).select("table", "column", "is_primary")
    inside = edges.join(tables, F.lower("src_table") == F.col("_w"), "left_semi").join(tables, F.lower("dst_table") == F.col("_w"), "left_semi")
    keys = own.where("is_primary").select("table", "column")
    sources, targets = inside.select(F.col("src_table").alias("table"), F.col("src_column").alias("column")), inside.select(F.col("dst_table").alias("table"), F.col("dst_column").alias("column"))
    others = keys.select(F.lower("table").alias("_o"), F.lower("column").alias("_k"))
    named = own.join(others, (F.lower("column") == F.col("_k")) & (F.lower("table") != F.col("_o")), "left_semi").select("table", "column")
    return keys.unionByName(sources).unionByName(targets).unionByName(named).distinct()


def closure(full: DataFrame, edges: DataFrame, working: DataFrame) -> DataFrame:
    """The working schema and its connections."""
    return canonical_union(full, working.select("table", "column"), connections(full, edges, working))


def add_columns(working: DataFrame, selected: DataFrame) -> DataFrame:
    return union(working, selected)


def missing(gold: DataFrame, working: DataFrame) -> DataFrame:
    """table, column of a gold schema that the working one lacks; column is null where the whole table is."""
    tables = working.select(F.lower("table").alias("_w")).distinct()
    no_table = gold.select("table").distinct().join(tables, F.lower("table") == F.col("_w"), "left_anti").select("table", F.lit(None).cast("string").alias("column"))
    have = working.select(F.lower("table").alias("_w"), F.lower("column").alias("_c")).distinct()
    known = gold.join(tables, F.lower("table") == F.col("_w"), "left_semi")
    return no_table.unionByName(known.join(have, (F.lower("table") == F.col("_w")) & (F.lower("column") == F.col("_c")), "left_anti").select("table", "column").distinct())


def schema_status(gold: DataFrame, working: DataFrame) -> DataFrame:
    """One row: missing_tables, missing_columns (as table.column) and whether each is complete."""
    m = missing(gold, working)
    row = m.agg(F.array_sort(F.collect_set(F.when(F.col("column").isNull(), F.col("table")))).alias("missing_tables"), F.array_sort(F.collect_set(F.when(F.col("column").isNotNull(), F.concat_ws(".", "table", "column")))).alias("missing_columns"))
    state = lambda c: F.when(F.size(c) == 0, "correct").otherwise("incorrect")
    return row.withColumn("tables_status", state("missing_tables")).withColumn("columns_status", state("missing_columns"))


def merge_responses(responses: DataFrame) -> DataFrame:
    """``responses``: ord, table, column, reasoning. Columns of all responses, each once in its first spelling, and all reasonings."""
    first = Window.partitionBy(F.lower("table"), F.lower("column")).orderBy("ord", "table", "column")
    kept = responses.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("table", "column")
    said = responses.select("ord", "reasoning").distinct().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "reasoning"))), lambda r: r.reasoning), "\n----\n").alias("reasoning"))
    return kept.join(F.broadcast(said))


def column_comment(include_values: bool = True, include_statics: bool = False) -> Column:
    """The comment behind a column: examples, meaning, description, value description."""
    said = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    shown = F.array_join(F.transform("examples", lambda x: F.concat(F.lit("`"), masked(x), F.lit("`"))), ", ")
    parts = [
        F.when(F.size("examples") > 0, F.concat(F.lit("Example Values: "), shown)),
        F.when(F.lit(include_statics) & said("value_statics"), F.concat(F.lit("Value Statics: "), F.col("value_statics"))),
        F.when(said("column_name") & (F.lower("column_name") != F.lower("column")), F.concat(F.lit("Column Name Meaning: "), F.col("column_name"))),
        F.when(said("column_description"), F.concat(F.lit("Column Description: "), F.col("column_description"))),
        F.when(F.lit(include_values) & said("value_description"), F.concat(F.lit("Value Description: "), F.col("value_description"))),
    ]
    joined = F.concat_ws(" | ", *parts)
    return F.when(joined != "", F.concat(F.lit(" -- "), F.regexp_replace(joined, "[\r\n]+", " "))).otherwise("")


def _filled(schema: DataFrame) -> DataFrame:
    kinds = {"examples": "array<string>", "is_primary": "boolean", "ordinal": "int"}
    for f in ("ordinal", *INFO_FIELDS):
        if f not in schema.columns:
            schema = schema.withColumn(f, F.lit(None).cast(kinds.get(f, "string")))
    return schema


def render_tables(schema: DataFrame, edges: DataFrame, include_values: bool = True, include_statics: bool = False, seed: int | None = None, unique: DataFrame | None = None) -> DataFrame:
    """table, ddl: a CREATE TABLE text for each table with its columns' comments and its keys to tables of the schema.

    ``unique``: table, columns of unique keys; those whose columns are all in the schema are shown. With a seed, tables keep their names but columns come in a shuffled order.
    """
    schema = _filled(schema)
    order = F.col("ordinal").cast("long") if seed is None else F.xxhash64(F.lit(seed), "table", "column")
    line = F.concat(F.lit("    `"), F.col("column"), F.lit("` "), F.upper(F.coalesce("type", F.lit("string"))), F.lit(","), column_comment(include_values, include_statics))
    rows = schema.withColumn("_order", F.coalesce(order, F.lit(0))).withColumn("_line", line)
    sorted_lines = lambda c, k: F.transform(F.array_sort(F.collect_list(k)), lambda x: x[c])
    body = rows.groupBy("table").agg(
        sorted_lines("l", F.struct(F.col("_order").alias("o"), F.col("column").alias("c"), F.col("_line").alias("l"))).alias("lines"),
        F.array_sort(F.collect_list(F.when(F.col("is_primary"), F.concat(F.lit("`"), F.col("column"), F.lit("`"))))).alias("keys"),
    )
    present = schema.select(F.lower("table").alias("_w")).distinct()
    inside = edges.join(present, F.lower("dst_table") == F.col("_w"), "left_semi")
    reference = F.format_string("    FOREIGN KEY (`%s`) REFERENCES `%s` (`%s`),", "src_column", "dst_table", "dst_column")
    foreign = inside.groupBy(F.lower("src_table").alias("_s")).agg(F.array_sort(F.collect_set(reference)).alias("foreign"))
    key_line = F.when(F.size("keys") > 0, F.array(F.concat(F.lit("    PRIMARY KEY ("), F.array_join("keys", ", "), F.lit("),")))).otherwise(F.array().cast("array<string>"))
    full = body.join(foreign, F.lower("table") == F.col("_s"), "left").withColumn("all", F.concat("lines", key_line, F.coalesce("foreign", F.array().cast("array<string>"))))
    if unique is not None:
        told = unique.select(F.lower("table").alias("_u"), F.col("columns").alias("_key")).distinct()
        have = schema.groupBy(F.lower("table").alias("_u")).agg(F.collect_set(F.lower("column")).alias("_have"))
        shown = told.join(have, "_u").where(F.size(F.array_except(F.transform("_key", F.lower), "_have")) == 0)
        named = F.concat(F.lit("    UNIQUE (`"), F.array_join("_key", "`, `"), F.lit("`),"))
        full = full.join(shown.groupBy("_u").agg(F.array_sort(F.collect_list(named)).alias("_unique")), F.lower("table") == F.col("_u"), "left")
        full = full.withColumn("all", F.concat("all", F.coalesce("_unique", F.array().cast("array<string>"))))
    text = F.concat(F.lit("CREATE TABLE `"), F.col("table"), F.lit("` (\n"), F.array_join("all", "\n"), F.lit("\n);"))
    return full.select("table", text.alias("ddl"))


def schema_string(tables: DataFrame, seed: int | None = None) -> DataFrame:
    """One row: the texts of all tables, by name or, with a seed, shuffled."""
    order = F.col("table") if seed is None else F.xxhash64(F.lit(seed), "table").cast("string")
    return tables.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("ddl").alias("d")))), lambda x: x.d), "\n\n").alias("schema"))


def structured(schema: DataFrame, edges: DataFrame) -> DataFrame:
    """table, columns, primary_keys, foreign_keys of a schema, for the JSON export."""
    schema = _filled(schema)
    own = schema.groupBy("table").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("ordinal", F.lit(0)).alias("o"), F.col("column").alias("c")))), lambda x: x.c).alias("columns"), F.array_sort(F.collect_list(F.when(F.col("is_primary"), F.col("column")))).alias("primary_keys"))
    keys = edges.groupBy(F.col("src_table").alias("_s")).agg(F.array_sort(F.collect_list(F.struct("src_column", "dst_table", "dst_column"))).alias("foreign_keys"))
    return own.join(keys, F.lower("table") == F.lower("_s"), "left").drop("_s")


def structured_questions(full: DataFrame, edges: DataFrame, questions: DataFrame, selected: DataFrame) -> DataFrame:
    """A row a question and table of its schema: the questions' columns, then table, columns, primary_keys and foreign_keys (those whose both ends
    are in the question's schema). ``questions``: question_id, question, evidence and others; ``selected``: question_id, table, column."""
    chosen = selected.select("question_id", F.lower("table").alias("_t"), F.lower("column").alias("_c")).distinct()
    rows = _keyed(full).join(chosen, ["_t", "_c"])
    place = F.coalesce("ordinal", F.lit(0)) if "ordinal" in full.columns else F.lit(0)
    by_place = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("o"), F.col("column").alias("c")))), lambda x: x.c)
    own = rows.groupBy("question_id", "table").agg(by_place.alias("columns"), F.array_sort(F.collect_list(F.when(F.col("is_primary"), F.col("column")))).alias("primary_keys"))
    ends = edges.select("*", *[F.lower(c).alias(f"_{c}") for c in ("src_table", "src_column", "dst_table", "dst_column")])
    source = chosen.join(ends, (F.col("_t") == F.col("_src_table")) & (F.col("_c") == F.col("_src_column"))).drop("_t", "_c")
    target = chosen.select(F.col("question_id").alias("_q"), F.col("_t").alias("_dt"), F.col("_c").alias("_dc"))
    inside = source.join(target, (F.col("question_id") == F.col("_q")) & (F.col("_dst_table") == F.col("_dt")) & (F.col("_dst_column") == F.col("_dc")), "left_semi")
    keys = inside.groupBy(F.col("question_id").alias("_q"), F.col("_src_table").alias("_s")).agg(F.array_sort(F.collect_set(F.struct("src_column", "dst_table", "dst_column"))).alias("foreign_keys"))
    made = own.join(keys, (F.col("question_id") == F.col("_q")) & (F.lower("table") == F.col("_s")), "left").drop("_q", "_s")
    return questions.join(made, "question_id")


def column_profiles(schema: DataFrame, edges: DataFrame, with_keys: bool = False, with_references: bool = False) -> DataFrame:
    """table, column, profile: a text block for each column; key columns only if asked for."""
    schema = _filled(schema)
    out_keys = edges.groupBy(F.lower("src_table").alias("_t"), F.lower("src_column").alias("_c")).agg(F.array_sort(F.collect_set(F.format_string("`%s`.`%s`", "dst_table", "dst_column"))).alias("refers"))
    in_keys = edges.groupBy(F.lower("dst_table").alias("_t"), F.lower("dst_column").alias("_c")).agg(F.array_sort(F.collect_set(F.format_string("`%s`.`%s`", "src_table", "src_column"))).alias("referred"))
    rows = _keyed(schema).join(out_keys, ["_t", "_c"], "left").join(in_keys, ["_t", "_c"], "left")
    is_key = F.coalesce("is_primary", F.lit(False)) | F.col("refers").isNotNull() | F.col("referred").isNotNull()
    said = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    lines = [
        F.concat(F.lit("Table name: `"), F.col("table"), F.lit("`")), F.concat(F.lit("Original column name: `"), F.col("column"), F.lit("`")), F.concat(F.lit("Data type: "), F.upper("type")),
        F.when(said("column_name"), F.concat(F.lit("Expanded column name: "), F.col("column_name"))), F.when(said("column_description"), F.concat(F.lit("Description: "), F.col("column_description"))),
        F.when(said("value_description"), F.concat(F.lit("Value description: "), F.col("value_description"))),
        F.when(F.size("examples") > 0, F.concat(F.lit("Examples: "), F.array_join(F.transform("examples", masked), ", "))),
        F.when(F.lit(with_keys) & F.col("is_primary"), F.lit("Primary key")),
        F.when(F.lit(with_references) & F.col("refers").isNotNull(), F.concat(F.lit("Refers to: "), F.array_join("refers", ", "))),
        F.when(F.lit(with_references) & F.col("referred").isNotNull(), F.concat(F.lit("Referred to by: "), F.array_join("referred", ", "))),
    ]
    return rows.where(F.lit(with_keys) | ~is_key).select("table", "column", F.concat_ws("\n", *lines).alias("profile"))


def assembled(catalog: Catalog, working: DataFrame, examples: DataFrame | None = None, descriptions: DataFrame | None = None, statistics: DataFrame | None = None) -> DataFrame:
    """The working schema with everything known: types and keys, examples, descriptions, statistics."""
    out = subselect(catalog.columns(), working)
    for frame, fields in ((examples, ["examples"]), (descriptions, ["column_name", "column_description", "value_description"]), (statistics, ["value_statics"])):
        if frame is not None:
            out = add_info(out, frame, fields)
    return out


def example_ladder(found: DataFrame, categories: DataFrame, firsts: DataFrame) -> DataFrame:
    """table, column, examples: those retrieved, else up to five categories, else first values; columns with a date in the
    name always show first values."""
    joined = found.select("table", "column", F.col("examples").alias("a")).join(categories.select("table", "column", F.slice("examples", 1, 5).alias("b")), ["table", "column"], "full").join(firsts.select("table", "column", F.col("examples").alias("c")), ["table", "column"], "full")
    return joined.select("table", "column", F.when(F.lower("column").contains("date"), F.coalesce("c", "a", "b")).otherwise(F.coalesce("a", "b", "c")).alias("examples"))
