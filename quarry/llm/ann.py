"""Approximate nearest neighbours by inner product: inverted file, product-quantised residuals, exact reranking.

The index is fitted on a bounded sample: coarse centroids, and for the residuals to them, in units of their list's spread so that
dense lists keep resolution, one codebook for each group of ``SUB`` dimensions. Every vector goes to the list of its nearest centroid with its residual's codes. A query visits the lists
of greatest reach (the centroid's product and the list's spread), as many as hold the share of the vectors that the sample's own
neighbours need for ``TARGET`` recall, so clustered data are probed narrowly and noise widely. Over the lists of a cell it adds
up the entries of its asymmetric distance tables, and ``RERANK`` times k of them, whatever the cell's size, are ranked again by
their exact products in double precision.

Vectors are dealt out in cells of bounded size: small lists share a cell, a list of many vectors is split by a hash of vec_id.
Where more queries meet a cell than one task should take, the cell comes in parts, each with its share of the queries. A query
goes once to each cell that holds a list it visits. Of equal vectors only the k + 1 rows of smallest vec_id can be among any k
nearest, and equal queries have one answer but for their own row, so a vector that many rows share costs what one does.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those of another
length than most of the sample; rows without a vec_id take no part; rows that repeat a vec_id are queries and candidates of
their own; ties go to the smaller vec_id; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import lookup, materialize

#: Rows that the index is fitted on at most, those of smallest hash.
MAX_SAMPLE = 16_384
MAX_LISTS = 4096
SUB = 4
#: Share of the sample's own neighbours that the visited lists must hold, the sample's queries that tell, and what a cell reranks, times k.
TARGET, JUDGES, RERANK = 0.97, 512, 4
#: Cells in all, and the vectors of one: at least, at most; queries that a cell meets before it comes in parts.
CELLS, CELL_LEAST, CELL_MOST, CELL_QUERIES = 200, 4096, 65_536, 131_072


@dataclass
class Index:
    centroids: np.ndarray
    spread: np.ndarray
    books: np.ndarray  # (groups, codes, SUB), of residuals over the spread

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centroids)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> list[bytes]:
        """Each vector's codes, and what they miss of its product with its centroid (four bytes): most of the error of queries near by."""
        rest = _padded((x - self.centroids[lists]) / self.spread[lists][:, None])
        codes = [_nearest(rest[:, g * SUB : (g + 1) * SUB], book) for g, book in enumerate(self.books)]
        missed = (_padded(self.centroids)[lists] * (rest - np.concatenate([book[c] for book, c in zip(self.books, codes, strict=True)], 1))).sum(1) * self.spread[lists]
        packed = np.concatenate([np.stack(codes, 1).astype(np.uint8), missed.astype(np.float32)[:, None].view(np.uint8)], 1)
        return [c.tobytes() for c in packed]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of every code with each query's groups: (groups, codes, queries)."""
        parts = _padded(q).reshape(len(q), len(self.books), SUB).transpose(1, 2, 0)
        return np.matmul(self.books.astype(np.float32), np.ascontiguousarray(parts, np.float32))

    def reach(self, q: np.ndarray) -> np.ndarray:
        return q @ self.centroids.T + np.linalg.norm(q, axis=1)[:, None] * self.spread


def _padded(x: np.ndarray) -> np.ndarray:
    extra = -x.shape[1] % SUB
    return np.pad(x, ((0, 0), (0, extra))) if extra else x


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    centers = centers.astype(np.float32)
    half = (centers * centers).sum(1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (x[i : i + 4096].astype(np.float32) @ centers.T - half).argmax(1)
    return out


def _k_means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centers)
        n = np.bincount(at, minlength=len(centers))
        sums = np.stack([np.bincount(at, x[:, d], len(centers)) for d in range(x.shape[1])], axis=1)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=len(centers))])
    return centers


def fit(sample: np.ndarray, lists: int, seed: int = 42) -> Index:
    centroids = _k_means(sample, lists, seed)
    at = _nearest(sample, centroids)
    rest = sample - centroids[at]
    far = (rest * rest).sum(1)
    # a list's spread counts one vector of the usual distance besides its own, as lists of few sample vectors tell little
    spread = np.sqrt((np.bincount(at, far, len(centroids)) + far.mean()) / (np.bincount(at, minlength=len(centroids)) + 1))
    spread = np.where(spread > 0, spread, 1.0)
    rest = _padded(rest / spread[at][:, None])
    groups = [_k_means(rest[:, g : g + SUB], 256, seed + 1 + g, 5) for g in range(0, rest.shape[1], SUB)]
    books = np.zeros((len(groups), 256, SUB))  # a small sample fills the first codes only
    for g, book in enumerate(groups):
        books[g] = book[np.arange(256) % len(book)]
    return Index(centroids, spread, books)


def probe_share(index: Index, sample: np.ndarray, k: int, target: float = TARGET) -> float:
    """The share of all vectors that a query's lists must hold so that they have ``target`` of the k nearest, judged by the sample's own."""
    q, at = sample[:JUDGES], index.nearest(sample)
    counts = np.bincount(at, minlength=len(index.centroids))
    order = np.argsort(-index.reach(q), axis=1, kind="stable")
    before = np.zeros(order.shape)
    np.put_along_axis(before, order, (counts[order].cumsum(1) - counts[order]) / len(sample), 1)
    score = q @ sample.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(sample) - 1)
    if not k:
        return 1.0
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return float(np.quantile(np.take_along_axis(before, at[near], 1), target))


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the dimension as double rows, and which rows of the column they are; they hold finite numbers only."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dim)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(at) == len(lengths):
        return flat.reshape(-1, dim), at
    starts = np.r_[0, lengths.cumsum()[:-1]][at]
    return flat[starts[:, None] + np.arange(dim)].reshape(-1, dim), at


@dataclass
class Deal:
    """Which cells hold a list's vectors: ``parts`` cells from ``base`` on; small lists share one. A cell comes ``query_parts`` times."""

    counts: np.ndarray
    base: np.ndarray
    parts: np.ndarray
    query_parts: int
    share: float
    least: int

    @staticmethod
    def of(counts: np.ndarray, queries: int, share: float, least: int) -> Deal:
        size = int(np.clip(counts.sum() // CELLS, CELL_LEAST, CELL_MOST))
        base, parts, now, room = np.zeros_like(counts), np.ones_like(counts), -1, 0
        for i, n in enumerate(counts):
            if n > size:
                base[i], parts[i] = now + 1, -(-n // size)
                now, room = now + int(parts[i]), 0
                continue
            if n > room:
                now, room = now + 1, size
            base[i] = max(now, 0)
            room -= int(n)
        return Deal(counts, base, parts, max(1, -(-int(queries * share) // CELL_QUERIES)), share, least)

    def visits(self, reach: np.ndarray) -> np.ndarray:
        """Which lists each query visits: those of greatest reach, up to the share of all vectors and at least ``least`` of them."""
        order = np.argsort(-reach, axis=1, kind="stable")
        held = self.counts[order].cumsum(1) - self.counts[order]
        out = np.zeros(reach.shape, bool)
        np.put_along_axis(out, order, (held <= self.share * self.counts.sum()) | (held < self.least), 1)
        return out


def _hash(ids: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return (((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.asarray(n, np.uint64)).astype(np.int64)


ROW_SCHEMA = "kind byte, id long, key binary, embedding array<double>"
CELL_SCHEMA = "cell long, kind byte, id long, key binary, lists binary, codes binary, vector binary"


def _cells(index: Index, deal: Deal):
    """Rows (kind, id, key, embedding) -> CELL_SCHEMA: each vector (kind 0) in its list's cell, each query (kind 1) in every cell where it visits lists."""
    names = [c.split()[0] for c in CELL_SCHEMA.split(", ")]

    def rows(cell, kind: int, ids, keys, lists, codes, vectors) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(cell), kind, np.int8)), pa.array(ids), keys, pa.array(lists, pa.binary()), pa.array(codes, pa.binary()), pa.array(vectors, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                x, at = _matrix(batch.column(3), index.dim)
                kinds, ids, keys = batch.column(0).to_numpy()[at], batch.column(1).to_numpy()[at], batch.column(2).take(pa.array(at))
                vectors = [v.tobytes() for v in x]
                own = np.flatnonzero(kinds == 0)
                if len(own):
                    lists = index.nearest(x[own])
                    codes = index.codes(x[own], lists)
                    named = [v.tobytes() for v in lists.astype(np.int32)]
                    cell = deal.base[lists] + _hash(ids[own], deal.parts[lists])
                    for part in range(deal.query_parts):
                        yield rows(cell * deal.query_parts + part, 0, ids[own], keys.take(pa.array(own)), named, codes, [vectors[i] for i in own])
                asks = np.flatnonzero(kinds == 1)
                if not len(asks):
                    continue
                row, to = np.nonzero(deal.visits(index.reach(x[asks])))
                parts = deal.parts[to]
                step = np.arange(parts.sum()) - np.repeat(parts.cumsum() - parts, parts)
                row, to, cell = np.repeat(row, parts), np.repeat(to, parts).astype(np.int32), np.repeat(deal.base[to], parts) + step
                order = np.lexsort((to, cell, row))
                row, to, cell = row[order], to[order], cell[order]
                heads = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])])
                visited = [to[a:b].tobytes() for a, b in zip(heads, [*heads[1:], len(row)], strict=True)]
                who = asks[row[heads]]
                part = _hash(np.frombuffer(b"".join(keys.take(pa.array(who)).to_pylist()), np.int64)[::2], deal.query_parts)
                yield rows(cell[heads] * deal.query_parts + part, 1, ids[who], keys.take(pa.array(who)), visited, [b""] * len(who), [vectors[i] for i in who])

    return run


FOUND_SCHEMA = "key binary, score double, vec_id long, vec_key binary"


def _search(index: Index, deal: Deal, k: int):
    """Partitions sorted by cell, kind and id -> FOUND_SCHEMA: each query's k best of every cell."""
    lists_all = len(index.centroids)

    def in_cell(ids, lists, codes, missed, x, q, visited) -> tuple[np.ndarray, ...]:
        """(query, score, row) of the k best for each of a batch of queries; vectors are in the order of their lists."""
        near = np.full((len(ids), len(q)), -np.inf, np.float32)
        tables, coarse = index.tables(q), (q @ index.centroids.T).T.astype(np.float32)
        along = coarse / np.maximum(1e-30, (index.centroids * index.centroids).sum(1))[:, None].astype(np.float32)
        heads = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
        for a, b in zip(heads, [*heads[1:], len(lists)], strict=True):
            go = np.flatnonzero(visited[lists[a]])
            if not len(go):
                continue
            some = len(go) * 2 < len(q)
            own = tables[:, :, go] if some else tables
            total = own[0][codes[a:b, 0]]
            for g in range(1, codes.shape[1]):
                total += own[g][codes[a:b, g]]
            total *= np.float32(index.spread[lists[a]])
            total += (coarse[lists[a]] + missed[a:b, None] * along[lists[a]])[:, go if some else slice(None)]
            near[a:b, go] = total if some or len(go) == len(q) else total[:, go]
        most = min(len(ids), k * RERANK)
        by_query = np.ascontiguousarray(near.T)
        picked = np.argpartition(-by_query, most - 1, axis=1)[:, :most] if most < len(ids) else np.repeat(np.arange(len(ids))[None], len(q), 0)
        exact = np.concatenate([np.einsum("qd,qmd->qm", q[i : i + 64], x[picked[i : i + 64]]) for i in range(0, len(q), 64)])
        exact[np.take_along_axis(by_query, picked, 1) == -np.inf] = -np.inf
        order = np.lexsort((ids[picked], -exact), axis=1)[:, :k]
        query, place = np.nonzero(np.take_along_axis(exact, order, 1) > -np.inf)
        row = picked[query, order[query, place]]
        return query, exact[query, order[query, place]], row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vectors, asks = None, [], []

        def settle() -> Iterator[pa.RecordBatch]:
            """Searches the open cell with the queries held."""
            if vectors and asks:
                if len(vectors) > 1 or not isinstance(vectors[0], tuple):
                    whole = pa.Table.from_batches(vectors).combine_chunks()
                    lists = np.frombuffer(b"".join(whole["lists"].to_pylist()), np.int32)
                    order = np.argsort(lists, kind="stable")
                    packed = np.frombuffer(b"".join(whole["codes"].to_pylist()), np.uint8).reshape(len(lists), -1)[order]
                    codes, missed = packed[:, :-4], np.ascontiguousarray(packed[:, -4:]).view(np.float32)[:, 0]
                    x = np.frombuffer(b"".join(whole["vector"].to_pylist()), np.float64).reshape(len(lists), -1)[order]
                    vectors[:] = [(whole["id"].to_numpy()[order], lists[order], codes, missed, x, whole["key"].combine_chunks().take(pa.array(order)))]
                ids, lists, codes, missed, x, keys = vectors[0]
                asked = pa.Table.from_batches(asks)
                step = int(np.clip(2_000_000 // len(ids), 16, 256))
                for i in range(0, len(asked), step):
                    part = asked.slice(i, step)
                    q = np.frombuffer(b"".join(part["vector"].to_pylist()), np.float64).reshape(len(part), -1)
                    visited = np.zeros((lists_all, len(part)), bool)
                    for j, packed in enumerate(part["lists"].to_pylist()):
                        visited[np.frombuffer(packed, np.int32), j] = True
                    query, score, row = in_cell(ids, lists, codes, missed, x, q, visited)
                    own = part["key"].combine_chunks()
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(query)), pa.array(score), pa.array(ids[row]), keys.take(pa.array(row))], [c.split()[0] for c in FOUND_SCHEMA.split(", ")])
            asks.clear()

        for batch in batches:
            cells, kinds = (batch.column(i).to_numpy() for i in range(2))
            edges = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])])
            for a, b in zip(edges, [*edges[1:], len(cells)], strict=True):
                if cells[a] != now:
                    yield from settle()
                    now = cells[a]
                    vectors.clear()
                (asks if kinds[a] else vectors).append(batch.slice(a, b - a))
                if kinds[a] and sum(v.num_rows for v in asks) > 16_384:
                    yield from settle()
        yield from settle()

    return run


def _valid(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) and key (a 128-bit hash of it) of every row that takes part."""
    component = lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id is not null and size(embedding) > 0").where(F.forall("embedding", component) & F.exists("embedding", lambda v: v != 0))
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(i), "embedding")), 16, "0") for i in range(2)]
    return rows.withColumn("key", F.unhex(F.concat(*halves)))


def find(embeddings: DataFrame, every: int = 20, k: int = 20, seed: int = 42) -> DataFrame | None:
    """key, best (its k + 1 nearest rows, its own included: score, vec_id, vec_key, the nearest first) and n (its queries) of each
    distinct vector among the queries, the rows whose vec_id is divisible by ``every``; None if there are none."""
    valid = _valid(embeddings)
    copies = Window.partitionBy("key").orderBy("vec_id")
    pool = valid.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k + 1).select(F.lit(0).cast("byte").alias("kind"), F.col("vec_id").alias("id"), "key", "embedding")
    asks = valid.where(F.col("vec_id") % every == 0).groupBy("key").agg(F.first("embedding").alias("embedding"), F.count("*").alias("n"))
    rows = materialize(pool.unionByName(asks.select(F.lit(1).cast("byte").alias("kind"), F.col("n").alias("id"), "key", "embedding")), "vectors")
    held = {r[0]: r[1] for r in rows.groupBy("kind").count().collect()}
    if len(held) < 2:
        return None
    sample = rows.where("kind = 0").orderBy(F.xxhash64("key", "id"), "key", "id").limit(MAX_SAMPLE).select("embedding").toArrow()  # the documented bound of the sample
    column = sample.column("embedding").combine_chunks()
    dim = int(np.bincount(column.value_lengths().to_numpy(zero_copy_only=False)).argmax())
    x, _ = _matrix(column, dim)
    index = fit(x, int(min(MAX_LISTS, max(1, held[0] ** 0.5), len(x))), seed)
    counts = np.zeros(len(index.centroids), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(index.centroids), np.int64)
        for batch in batches:
            n += np.bincount(index.nearest(_matrix(batch.column(0), dim)[0]), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["list", "n"])

    for at, m in rows.where("kind = 0").select("embedding").mapInArrow(count, "list long, n long").groupBy("list").agg(F.sum("n")).collect():  # at most MAX_LISTS rows
        counts[at] = m
    deal = Deal.of(counts, held[1], probe_share(index, x, k), k + 1)
    cells = rows.mapInArrow(_cells(index, deal), CELL_SCHEMA)
    found = cells.repartition("cell").sortWithinPartitions("cell", "kind", "id").mapInArrow(_search(index, deal, k + 1), FOUND_SCHEMA)
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), "vec_id", "vec_key")
    top = found.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k + 1)
    entry = F.struct("_at", "score", "vec_id", "vec_key")
    answers = top.groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("best"))
    return answers.join(rows.where("kind = 1").select("key", F.col("id").alias("n")), "key")


def search(embeddings: DataFrame, every: int = 20, k: int = 20, seed: int = 42) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found to each row whose vec_id is divisible by ``every``."""
    found = find(embeddings, every, k, seed)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = _valid(embeddings).where(F.col("vec_id") % every == 0).select("vec_id", "key")
    answered = lookup(queries, materialize(found, "answers"), "key", F.col("vec_id"), "n")
    own = F.array_position(F.transform("best", lambda b: (b.vec_id == F.col("vec_id")) & (b.vec_key == F.col("key"))), True)
    others = F.slice(F.filter("best", lambda b, i: i != F.col("_own") - 1), 1, k)
    out = answered.withColumn("_own", own).select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("_rank", "_b"))
    return out.select("query_id", (F.col("_rank") + 1).cast("int").alias("rank"), F.col("_b.vec_id").alias("vec_id"), F.col("_b.score").alias("score"))
