"""A database as a directory of Parquet tables: tables, columns, keys, DDL."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constraints:
    """Declared keys; Parquet carries none."""

    primary: dict[str, tuple[str, ...]] = field(default_factory=dict)
    foreign: tuple[tuple[str, str, str, str], ...] = ()
    unique: tuple[tuple[str, tuple[str, ...]], ...] = ()


STAR = Constraints(
    {
        "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "events": ("event_id",),
        "documents": ("doc_id",), "labels": ("doc_id",), "pages": ("page_id",), "benchmark": ("item_id",), "embeddings": ("vec_id",), "conversations": ("conv_id", "turn"),
    },
    (
        ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"),
        ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "customer", "c_custkey"),
    ),
)
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SHOP = ("clicks", "sales", "sale_lines", "clients", "client_changes", "vendors", "items", "stamps")
COLUMN_SCHEMA = "table string, column string, ordinal int, type string, is_primary boolean"
EDGE_SCHEMA = "src_table string, src_column string, dst_table string, dst_column string"


class Catalog:
    """Tables of a directory, read lazily; names are matched without regard to case."""

    def __init__(self, spark: SparkSession, path: str, tables: tuple[str, ...] = TABLES, constraints: Constraints = STAR):
        self.spark, self.path, self.names, self.constraints = spark, path, tables, constraints
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        name = next(t for t in self.names if t.lower() == name.lower())
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self._frames[name]

    def register(self) -> Catalog:
        """Makes every table a temporary view, for SQL text."""
        for name in self.names:
            self.table(name).createOrReplaceTempView(name)
        return self

    @cached_property
    def types(self) -> list[tuple[str, str, int, str, bool]]:
        return [(t, f.name, i, f.dataType.simpleString(), f.name in self.constraints.primary.get(t, ())) for t in self.names for i, f in enumerate(self.table(t).schema.fields)]

    def schema_map(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {t: [] for t in self.names}
        for t, c, *_ in self.types:
            out[t].append(c)
        return out

    def text_columns(self) -> list[tuple[str, str]]:
        return [(t, c) for t, c, _, kind, _ in self.types if kind == "string"]

    def columns(self) -> DataFrame:
        """table, column, ordinal, type, is_primary of every column."""
        return self.spark.createDataFrame(self.types, COLUMN_SCHEMA)

    def edges(self) -> DataFrame:
        """Declared foreign keys; a key without a target column points at the target's first primary key."""
        made = [(s, c, d, k or self.constraints.primary[d][0]) for s, c, d, k in self.constraints.foreign if s in self.names and d in self.names]
        return self.spark.createDataFrame(made, EDGE_SCHEMA)

    def unique_keys(self) -> DataFrame:
        """table, columns of the declared unique keys."""
        return self.spark.createDataFrame([(t, list(key)) for t, key in self.constraints.unique], "table string, columns array<string>")

    def ddl(self, table: str) -> str:
        """A CREATE TABLE text with keys, one item a line."""
        items = [f"`{c}` {kind.upper()}" for t, c, _, kind, _ in self.types if t == table]
        if key := self.constraints.primary.get(table):
            items.append(f"PRIMARY KEY ({', '.join(f'`{k}`' for k in key)})")
        items += [f"UNIQUE ({', '.join(f'`{k}`' for k in key)})" for t, key in self.constraints.unique if t == table]
        items += [f"FOREIGN KEY (`{c}`) REFERENCES `{d}` (`{k}`)" for s, c, d, k in self.constraints.foreign if s == table and d in self.names]
        return f"CREATE TABLE `{table}` (\n" + ",\n".join(f"    {x}" for x in items) + "\n)"

    def ddl_frame(self) -> DataFrame:
        return self.spark.createDataFrame([(t, self.ddl(t)) for t in self.names], "table string, ddl string")

    def orphans(self) -> DataFrame:
        """For each declared edge: rows whose key is set and rows of those without a partner."""
        out = None
        for s, c, d, k in self.constraints.foreign:
            child = self.table(s).where(F.col(c).isNotNull()).groupBy(F.col(c).cast("long").alias("k")).agg(F.count("*").alias("n"))  # the keys' distinct values move, not the rows
            parent = self.table(d).select(F.col(k).cast("long").alias("k"), F.lit(1).alias("found")).distinct()
            one = child.join(parent, "k", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("found").isNull(), F.col("n"))), F.lit(0)).alias("n_orphans"))
            one = one.select(F.lit(f"{s}.{c}").alias("src"), F.lit(f"{d}.{k}").alias("dst"), "n_rows", "n_orphans")
            out = one if out is None else out.unionByName(one)
        return out

    def long_text(self, columns: list[tuple[str, str]] | None = None) -> DataFrame:
        """table, column, value of all non-null values of string columns: one scan a table."""
        chosen = columns if columns is not None else self.text_columns()
        out = None
        for t in dict.fromkeys(t for t, _ in chosen):
            own = [c for s, c in chosen if s == t]
            pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in own])
            one = self.table(t).select(F.explode(pairs).alias("e")).select(F.lit(t).alias("table"), "e.column", "e.value").where("value is not null")
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "table string, column string, value string")

    def sample(self, table: str, rows: int, seed: int = 42, by: list[str] | None = None) -> DataFrame:
        """Exactly ``rows`` rows (all, if fewer) in random order; a top-k by a seeded hash of the row, or of the text of the columns ``by``, so a
        rerun takes the same."""
        frame = self.table(table)
        if by is not None:
            return frame.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by])), *by).limit(rows)
        return frame.orderBy(F.xxhash64(F.lit(seed), *frame.columns), *[c for c, k in frame.dtypes if not k.startswith("map")]).limit(rows)

    def write_sample(self, path: str, rows: int, seed: int = 42) -> None:
        """A smaller database of at most ``rows`` rows a table."""
        for t in self.names:
            self.sample(t, rows, seed).write.mode("overwrite").parquet(f"{path}/{t}.parquet")
