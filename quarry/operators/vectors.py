"""Vector search over embeddings and over documents of the column catalog."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions import text as T
from quarry.operators.bounds import blocks_joined

#: Vectors and queries of a block; products held at once; the largest component of a vector in a matrix.
VECTOR_BLOCK, QUERY_BLOCK = 16_384, 4_096
PRODUCTS = 2_000_000
MOST_COMPONENT = 1e100


def _regular(c: Column, width: int) -> Column:
    """Whether a vector can go into a matrix: so many components, none null, NaN or so large that products overflow."""
    return F.coalesce((F.size(c) == width) & F.forall(c, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < MOST_COMPONENT)), F.lit(False))


def _search(k: int, grouped: bool):
    """A block of vectors (vec_id, vec, group) and one of queries (query_id, q) -> query_id, group, vec_id, score of pairs among which the k best of
    each group are, whatever ties the rounding of scores makes. Scores are added component by component, as ``T.dot`` does."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        code = left["group"].combine_chunks().dictionary_encode("encode").indices.to_numpy() if grouped else np.zeros(len(left), np.int32)
        order = np.argsort(code, kind="stable")
        left = left.take(pa.array(order))
        code = code[order]
        matrix = lambda x, n: x.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        ids, asked = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        vectors, queries = matrix(left["vec"], len(ids)), matrix(right["q"], len(asked))
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        widths = np.diff(np.r_[starts, len(code)])
        segment = np.repeat(np.arange(len(starts)), widths)
        reach = 8 * queries.shape[1] * np.finfo(np.float64).eps * float((np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0)) * queries.shape[1])
        found = []
        step = max(1, PRODUCTS // max(1, len(ids)))
        for at in range(0, len(asked), step):
            products = queries[at : at + step] @ vectors.T
            products[asked[at : at + step, None] == ids[None, :]] = -np.inf
            left_over, least = products.copy(), None
            for turn in range(k):  # equal products fall together, so the last bound is the k-th best or lower
                least = np.maximum.reduceat(left_over, starts, axis=1)
                if turn < k - 1:
                    left_over[left_over >= np.repeat(least, widths, axis=1)] = -np.inf
            row, col = np.nonzero((products >= np.repeat(least - 2e-6 - reach, widths, axis=1)) & (products > -np.inf))
            score = np.zeros(len(row))
            for i in range(queries.shape[1]):
                score += vectors[col, i] * queries[at + row, i]
            # Of equal scores only those of the k smallest ids can be wanted.
            best = np.lexsort((ids[col], -score, segment[col], row))
            row, col, score = row[best], col[best], score[best]
            new = np.r_[True, (row[1:] != row[:-1]) | (segment[col][1:] != segment[col][:-1]) | (score[1:] != score[:-1])] if len(row) else np.zeros(0, bool)
            heads = np.flatnonzero(new)
            nth = np.arange(len(row)) - np.repeat(heads, np.diff(np.r_[heads, len(row)]))
            kept = nth < k
            found.append((asked[at + row[kept]], col[kept], score[kept]))
        query, col, score = (np.concatenate(x) for x in zip(*found, strict=True))
        made = {"query_id": pa.array(query), "vec_id": pa.array(ids[col]), "score": pa.array(score)}
        if grouped:
            made["group"] = left["group"].combine_chunks().take(pa.array(col))
        return pa.table(made)

    return run


def top_by_dot(vectors: DataFrame, queries: DataFrame, k: int = 5, within: str | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: the k largest inner products, to six places, with each query vector. ``within``: rank inside the groups of this column.

    Every vector meets every query, in blocks of both: a task multiplies one block of each as matrices and gives out the best of the block, with all that
    may be as good after rounding, and a window ranks those. So memory is bounded by the blocks. Vectors and queries that no matrix holds (null, of
    another length, with null, NaN or huge components) meet as single pairs.
    """
    group = ["query_id", *([within] if within else [])]
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("q"))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"), *([F.col(within).alias("group")] if within else []))
    sizes = asked.agg(F.count("*").alias("n"), F.mode(F.size("q")).alias("width")).first()
    width = sizes["width"] or 0
    n_asked = max(1, -(-sizes["n"] // QUERY_BLOCK))
    n_own = max(1, -(-own.count() // VECTOR_BLOCK))
    fits, asks = _regular(F.col("vec"), width) & F.col("vec_id").isNotNull() & F.lit(width > 0), _regular(F.col("q"), width) & F.col("query_id").isNotNull() & F.lit(width > 0)
    visits = own.where(fits).withColumn("_v", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(n_own))).withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_asked - 1).cast("long"))))
    dealt = asked.where(asks).withColumn("_q", F.pmod(F.xxhash64("query_id", "q"), F.lit(n_asked))).withColumn("_v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_own - 1).cast("long"))))
    kind = f", group {vectors.schema[within].dataType.simpleString()}" if within else ""
    search = _search(k, within is not None)
    kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()} | ({"group": to_arrow_type(vectors.schema[within].dataType)} if within else {})
    names = list(kinds)

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({n: pa.array([], kinds[n]) for n in names})
        return search(left, right).select(names)

    found = visits.groupBy("_v", "_q").cogroup(dealt.groupBy("_v", "_q")).applyInArrow(met, f"query_id long, vec_id long, score double{kind}")
    score = T.dot(F.col("vec"), F.col("q"))
    apart = F.col("vec_id") != F.col("query_id")
    odd = blocks_joined(own.where(~fits), asked, apart).unionByName(blocks_joined(own.where(fits), asked.where(~asks), apart))
    odd = odd.select("query_id", "vec_id", score.alias("score"), *names[3:])
    pairs = found.unionByName(odd).withColumn("score", F.round("score", 6))
    if within:
        pairs = pairs.withColumnRenamed("group", within)
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*group, "vec_id", "score", "rank")


def catalog_documents(descriptions: DataFrame) -> DataFrame:
    """table, column, field, text and the descriptions: one document for each field that says something."""
    fields = ("column_name", "column_description", "value_description")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    made = descriptions.select("table", F.col("original_column_name").alias("column"), *fields, F.explode(pairs).alias("d"))
    return made.select("table", "column", "d.field", F.trim("d.text").alias("text"), *fields).where("text != ''")


def embedded(documents: DataFrame, embed: Column | None = None) -> DataFrame:
    return documents.withColumn("embedding", T.embedding("text") if embed is None else embed)


def nearest_columns(documents: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query, table, column, distance and descriptions: of the k nearest documents by squared distance, the best per column.

    ``documents``: embedded catalog documents; ``queries``: query, embedding. Both are metadata, not data.
    """
    asked = queries.select("query", F.col("embedding").alias("_q"))
    near = blocks_joined(documents, asked).withColumn("distance", T.squared_distance(F.col("embedding"), F.col("_q")))
    order = Window.partitionBy("query").orderBy("distance", "table", "column", "field")
    top = near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    kept = ("column_name", "column_description", "value_description")
    best = top.groupBy("query", "table", "column").agg(F.min("distance").alias("distance"), F.min_by(F.struct(*kept), "distance").alias("d"))
    return best.select("query", "table", "column", F.round("distance", 6).alias("distance"), *[f"d.{c}" for c in kept])
