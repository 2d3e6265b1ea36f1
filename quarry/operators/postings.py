"""The fuzzy value index as an inverted index on disk: a lookup reads the files that hold its keys, not the index.

Every value has a signature of ``slots`` keys; a posting says which value has which key in which slot. Postings lie in folders of a cell, which
is a slot and a range of its keys, sorted by key, so the keys of a keyword name ``slots`` cells of ``slots * buckets``, and row groups that cannot hold
them are passed over. Values lie apart, in folders by a hash of their id, and only those that a lookup ranks highest are read.

Batches of values are appended as segments of a versioned table, new values only; ``compact`` makes one segment of all. Readers keep the
version they began with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.values import TOP
from quarry.sources.versioned import VersionedTable

#: Keywords looked up at a time: their cells go to the driver to choose files, MOST_KEYWORDS * slots numbers at most.
MOST_KEYWORDS = 2_000
POSTING = "key long, id binary, cell int"
VALUE = "id binary, `table` string, `column` string, value string, home int"


def value_id(table: str = "table", column: str = "column", value: str = "value") -> Column:
    """Sixteen bytes that stand for a value of a column."""
    return F.unhex(F.md5(F.to_json(F.struct(F.col(table), F.col(column), F.col(value)))))


class PostingIndex:
    """An index under a path. ``buckets``: ranges of keys in each slot; ``homes``: folders of values. Both are fixed when the index is made."""

    def __init__(self, spark: SparkSession, path: str, slots: int = T.PERMUTATIONS, n: int = T.NGRAM, buckets: int = 8, homes: int = 32):
        self.spark, self.table = spark, VersionedTable(spark, path)
        facts = self.table.manifest()["facts"] or {"slots": slots, "n": n, "buckets": buckets, "homes": homes}
        self.slots, self.n, self.buckets, self.homes = (facts[k] for k in ("slots", "n", "buckets", "homes"))

    @property
    def facts(self) -> dict:
        return {"slots": self.slots, "n": self.n, "buckets": self.buckets, "homes": self.homes}

    def _cell(self, slot: str, key: str) -> Column:
        """Keys are least hashes, so small ones are common; a hash of them deals them out evenly."""
        return (F.col(slot) * self.buckets + F.pmod(F.xxhash64(key), F.lit(self.buckets))).cast("int")

    def _home(self, id_: str) -> Column:
        return F.pmod(F.xxhash64(id_), F.lit(self.homes)).cast("int")

    def _segments(self, kind: str, manifest: dict) -> DataFrame | None:
        parts = [p for p in manifest["parts"] if p.startswith(kind)]
        frames = [self.spark.read.schema(POSTING if kind == "p" else VALUE).parquet(f"{self.table.path}/parts/{p}") for p in parts]
        out = frames[0] if frames else None
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def _write(self, kind: str, frame: DataFrame) -> str:
        """A segment: each cell sorted by key; a cell is dealt out by key as well, so that a large one is not one task's."""
        by, order = ("cell", "key") if kind == "p" else ("home", "id")
        name = kind + self.table.write_part(frame.repartitionByRange(F.col(by), F.col(order)).sortWithinPartitions(by, order), (by,))
        fs = self.table._files()
        fs.rename(self.table._at("parts", name[1:]), self.table._at("parts", name))
        return name

    def append(self, values: DataFrame) -> int:
        """Adds table, column and value of values that the index does not have yet; returns the version."""
        own = values.select("table", "column", "value").where("value is not null").distinct().withColumn("id", value_id())

        def change(m: dict) -> dict:
            held = self._segments("v", m)
            new = own if held is None else own.join(held.select("id"), "id", "left_anti")
            value_part = self._write("v", new.select("id", "table", "column", "value", self._home("id").alias("home")))
            stored = self.spark.read.schema(VALUE).parquet(f"{self.table.path}/parts/{value_part}")
            keys = stored.select("id", F.posexplode(T.signature(T.ngrams(F.col("value"), self.n), self.slots)).alias("slot", "key"))
            part = self._write("p", keys.select("key", "id", self._cell("slot", "key").alias("cell")))
            return m | {"parts": [*m["parts"], value_part, part], "schema": POSTING, "facts": self.facts}

        return self.table.commit(change)

    def compact(self) -> int:
        """One segment in place of those of now."""
        m = self.table.manifest()
        parts = [self._write(kind, self._segments(kind, m)) for kind in ("v", "p")]
        return self.table.replace(m["parts"], parts)

    def values(self, version: int | None = None) -> DataFrame:
        return self._segments("v", self.table.manifest(version)).select("table", "column", "value")

    def _asked(self, keywords: DataFrame) -> tuple[DataFrame, list[int]]:
        """keyword, cell and key of the keywords, and the cells."""
        own = keywords.select("keyword").where("keyword is not null").distinct().withColumn("_s", T.signature(T.ngrams(F.col("keyword"), self.n), self.slots))
        asked = own.select("keyword", F.posexplode("_s").alias("_slot", "key")).select("keyword", self._cell("_slot", "key").alias("cell"), "key")
        cells = sorted(r[0] for r in asked.select("cell").distinct().collect())  # at most slots * buckets
        return asked, cells

    def candidates(self, keywords: DataFrame, version: int | None = None) -> DataFrame:
        """keyword, id and shared (equal slots) of every value that shares a slot with a keyword."""
        asked, cells = self._asked(keywords)
        postings = self._segments("p", self.table.manifest(version))
        if postings is None:
            raise ValueError("the index is empty")
        found = postings.where(F.col("cell").isin(cells))  # files of other cells are not listed for reading
        if keywords.limit(MOST_KEYWORDS + 1).count() <= MOST_KEYWORDS:
            keys = sorted(r[0] for r in asked.select("key").distinct().limit(MOST_KEYWORDS * self.slots).collect())
            if len(keys) <= 10_000:
                found = found.where(F.col("key").isin(keys))  # row groups by their least and greatest keys
            asked = F.broadcast(asked)
        return found.join(asked, ["cell", "key"]).groupBy("keyword", "id").agg(F.count("*").alias("shared"))

    def top(self, keywords: DataFrame, top: int = TOP, version: int | None = None) -> DataFrame:
        """keyword, table, column, value, estimate, rank: the values with most slots in common, ties by their texts."""
        place = F.rank().over(Window.partitionBy("keyword").orderBy(F.col("shared").desc()))
        best = self.candidates(keywords, version).withColumn("_place", place).where(F.col("_place") <= top).drop("_place")  # with all ties of the last
        values = self._segments("v", self.table.manifest(version))
        met = best.withColumn("home", self._home("id")).join(values, ["home", "id"])
        order = Window.partitionBy("keyword").orderBy(F.col("shared").desc(), "table", "column", "value")
        ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return ranked.select("keyword", "table", "column", "value", (F.col("shared") / self.slots).alias("estimate"), "rank")


def files_read(frame: DataFrame) -> tuple[int, int]:
    """(files that the scans of a frame read, files of the tables they read from): runs the frame, and reads its scans' own counts."""
    frame.write.format("noop").mode("overwrite").save()
    run = frame.sparkSession._jsparkSession.sessionState().executePlan(frame._jdf.queryExecution().logical(), frame._jdf.queryExecution().mode())
    run.toRdd().count()
    todo, read, whole = [run.executedPlan()], 0, 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name in ("ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            read += node.metrics().apply("numFiles").value()
            whole += len(node.relation().location().inputFiles())
        children = node.children()
        todo.extend(children.apply(i) for i in range(children.size()))
    return read, whole
