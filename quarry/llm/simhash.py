"""SimHash near-duplicates through a hierarchical index in Gray order.

Texts become 64-bit fingerprints; equal fingerprints are merged first, so groups of copies cost one entry. Two fingerprints
at most ``distance`` bits apart agree on at least ``blocks - distance`` of ``blocks`` bit blocks, so each choice of that many
blocks deals the entries into buckets that lose no link. Within a bucket the entries are sorted by Gray rank, where
neighbours share most bits; consecutive entries form nodes, and nodes form nodes, each with the mask of bits its members
share. A child keeps only the shared bits that its parent does not have yet, so a search adds up differences level by level
and leaves a whole group as soon as the sum exceeds the distance. Groups already linked with the query are left out too.

Defined cases: a null text counts as empty; texts without words get fingerprint zero and are linked like any other; rows with
a null doc_id take part but never name a component unless all its ids are null; repeated rows are returned each; an empty
table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lookup, map_batches, materialize, utf8
from quarry.llm.components import components

SHINGLE = 4
DISTANCE = 4
FANOUT = 8
#: Entries of a bucket that one search takes; larger buckets are split into chunks whose pairs are searched apart.
BUCKET_LIMIT = 100_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_digest
    set_bits = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        part = b"".join([digest(joined[a : b - 1], 42) for a, b in zip(starts[i : min(n, i + (1 << 15))], ends[i + min(shingle, len(words)) - 1 :], strict=False)])
        packed = np.unpackbits(np.frombuffer(part, np.uint8)).view(np.uint64).reshape(-1, 8)  # eight one-byte counters a word
        sums = np.add.reduceat(packed, np.arange(0, len(packed), 255), axis=0)
        set_bits += sums.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of every row."""

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(t) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], ["doc_id", "fp"])

    return map_batches(documents.select(F.col("doc_id").cast("long"), "text"), compute, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _reduce_labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels (a smaller index of the same component, itself at the root) after linking a to b."""
    while True:
        la, lb = label[a], label[b]
        far = la != lb
        if not far.any():
            return label
        a, b, la, lb = a[far], b[far], la[far], lb[far]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


class GrayIndex:
    """A forest over buckets of distinct fingerprints, one tree a bucket."""

    def __init__(self, bucket: np.ndarray, fp: np.ndarray, fanout: int = FANOUT):
        order = np.lexsort((gray_rank(fp), bucket))
        self.fp, bucket = fp[order], bucket[order]
        n = len(fp)
        self.levels: list[tuple[np.ndarray, ...]] = []  # first child, end child, shared pattern, own mask, first and last entry
        group, pattern, mask = bucket, self.fp, np.full(n, np.uint64(2**64 - 1))
        first, last = np.arange(n), np.arange(n)
        masks = [mask]
        while True:
            new = np.r_[True, group[1:] != group[:-1]]
            heads = np.flatnonzero(new)
            at = np.arange(len(group)) - np.repeat(heads, np.diff(np.r_[heads, len(group)]))
            starts = np.flatnonzero(new | (at % fanout == 0))
            ends = np.r_[starts[1:], len(group)]
            same = np.bitwise_and.reduceat(mask, starts) & ~(np.bitwise_or.reduceat(pattern, starts) ^ np.bitwise_and.reduceat(pattern, starts))
            self.levels.append((starts, ends, pattern[starts] & same, same, first[starts], last[ends - 1]))
            own = np.repeat(same, ends - starts)
            masks[-1] = mask & ~own  # what the parent shares already is counted there
            group, pattern, mask, first, last = group[starts], pattern[starts] & same, same, first[starts], last[ends - 1]
            masks.append(mask)
            if len(starts) == len(heads):
                break
        self.own_masks = masks
        self.root = np.repeat(np.arange(len(group)), last - first + 1)

    def link(self, distance: int, batch: int = 1 << 14) -> np.ndarray:
        """The smallest entry (in this index's order) that each entry reaches through links in its bucket."""
        n = len(self.fp)
        label = np.arange(n)
        todo = np.flatnonzero(np.bincount(self.root, minlength=len(self.own_masks[-1]))[self.root] > 1)
        at, step = 0, 64
        while at < len(todo):
            q = todo[at : at + step]
            at, step = at + step, min(batch, step * 2)
            low = [np.minimum.reduceat(label, lv[4]) for lv in self.levels]
            high = [np.maximum.reduceat(label, lv[4]) for lv in self.levels]
            node, top = self.root[q], len(self.levels)
            acc = np.zeros(len(q), np.int64)
            for k in range(top - 1, -1, -1):
                starts, ends, pattern, _, _, last = self.levels[k]
                acc = acc + np.bitwise_count((self.fp[q] ^ pattern[node]) & self.own_masks[k + 1][node])
                keep = (acc <= distance) & (last[node] > q) & ~((low[k][node] == high[k][node]) & (low[k][node] == label[q]))
                q, node, acc = q[keep], node[keep], acc[keep]
                width = ends[node] - starts[node]
                child = np.repeat(starts[node] - np.r_[0, width.cumsum()[:-1]], width) + np.arange(width.sum())
                q, acc, node = np.repeat(q, width), np.repeat(acc, width), child
            acc = acc + np.bitwise_count((self.fp[q] ^ self.fp[node]) & self.own_masks[0][node])
            keep = (acc <= distance) & (node > q)
            label = _reduce_labels(n, q[keep], node[keep], label)
        return label


def _search(distance: int, limit: int, split: bool):
    """Partitions sorted by bucket -> (a, b, bucket): links to the smallest member found, or, with null a, entries of buckets over the limit."""

    def edges(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        index = GrayIndex(bucket, fp.view(np.uint64))
        label = index.link(distance)
        far = np.flatnonzero(label != np.arange(len(label)))
        ids = index.fp.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]]), pa.nulls(len(far), pa.int64())], ["a", "b", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        over: int | None = None

        for batch in batches:
            bucket, fp = (batch.column(i).to_numpy() for i in (0, 1))
            if over is not None:
                more = bucket == over
                if more.any():
                    yield pa.RecordBatch.from_arrays([pa.nulls(int(more.sum()), pa.int64()), pa.array(fp[more]), pa.array(bucket[more])], ["a", "b", "bucket"])
                    bucket, fp = bucket[~more], fp[~more]
            if not len(bucket):
                continue
            held.append((bucket, fp))
            if sum(len(b) for b, _ in held) < limit:
                continue
            bucket, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            open_ = bucket == bucket[-1]
            if not open_.all():
                yield edges(bucket[~open_], fp[~open_])
            bucket, fp = bucket[open_], fp[open_]
            held = [(bucket, fp)]
            if split and len(bucket) >= limit:
                over, held = int(bucket[-1]), []
                yield pa.RecordBatch.from_arrays([pa.nulls(len(fp), pa.int64()), pa.array(fp), pa.array(bucket)], ["a", "b", "bucket"])
        if held:
            yield edges(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _bucket_keys(fp: str, blocks: int, same: int) -> list[Column]:
    width, extra = divmod(64, blocks)
    spans, low = [], 0
    for i in range(blocks):
        size = width + (i < extra)
        spans.append((low, size))
        low += size
    keys = []
    for i, chosen in enumerate(combinations(spans, same)):
        key = F.lit(i).cast("long")
        for at, size in chosen:
            key = F.shiftleft(key, size).bitwiseOR(F.shiftrightunsigned(F.col(fp), at).bitwiseAND(F.lit((1 << size) - 1)))
        keys.append(key)
    return keys


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int | None = None, limit: int = BUCKET_LIMIT) -> DataFrame:
    """``distinct``: fp long, each once. Returns links a, b that connect what lies within ``distance`` bits."""
    if blocks is None:  # wider keys for more entries, so that buckets stay small; every choice finds every link
        n = distinct.count()
        blocks = distance + (2 if n < 1 << 26 else 3 if n < 1 << 31 else 4)
    dealt = distinct.select("fp", F.explode(F.array(*_bucket_keys("fp", blocks, blocks - distance))).alias("bucket")).select("bucket", "fp")
    schema = "a long, b long, bucket long"
    found = materialize(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_search(distance, limit, True), schema), "found")
    over = found.where("a is null").select("bucket", F.col("b").alias("fp"))
    near = found.where("a is not null").select("a", "b")
    if over.isEmpty():
        return near
    chunks = F.ceil(F.col("n") * 4 / limit).cast("int") + 1
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    parts = over.join(over.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("chunks", chunks), "bucket").withColumn("own", own)
    pairs = parts.select("fp", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    keyed = pairs.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "fp")
    more = keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_search(distance, limit, False), schema)
    return near.unionByName(more.select("a", "b"))


def near_duplicates(documents: DataFrame, distance: int = DISTANCE, limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable through links) of every row."""
    prints = materialize(fingerprints(documents), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "distinct")
    reached = components(links(distinct.select("fp"), distance, limit=limit))
    rooted = distinct.join(reached, F.col("fp") == F.col("node"), "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = lookup(rooted, materialize(least, "least"), "root", F.col("fp"), "members")  # a root may hold any share of the fingerprints
    named = materialize(named.select("fp", "n", "component_id"), "named")
    return lookup(prints, named, "fp", F.coalesce("doc_id", F.rand(7) * 2**40).cast("long"), "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The documents without those that link to a document of smaller doc_id, directly or through others; all columns.

    Rows without a doc_id are kept. Rows that repeat a doc_id are merged to one.
    """
    found = materialize(near_duplicates(documents, distance), "near")
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    kept = documents.join(gone, "doc_id", "left_anti")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept.select(*documents.columns)
    once = kept.where("doc_id is not null").dropDuplicates(["doc_id"])
    return once.unionByName(kept.where("doc_id is null")).select(*documents.columns)
