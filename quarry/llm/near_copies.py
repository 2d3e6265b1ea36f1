"""Near copies by the similarity of their shingles: links from ``SIMILARITY`` on, candidates by SimHash and by MinHash bands, each link checked exactly.

A text is the set of its five-word shingles (as 64-bit hashes); texts with equal sets are merged first. The SimHash of each set goes
through the Gray index of ``simhash``: sets within its distance are candidates. It reaches few pairs of similarity 0.8 to 0.9, so
texts that agree in a whole band of MinHash slots are candidates too: a pair of Jaccard similarity 0.8 meets in one of the bands with probability 0.9994,
one of 0.85 with 0.999997. Every link is the exact similarity of two whole sets, and sets of sizes too unlike to reach it are not
compared. In a star round each text is compared with one text of each of its buckets, and linked texts count as one from then on.
Buckets that still hold several groups are searched in whole by one task each, which has the sets of its members and gives out no
more links than join them; buckets of many members come as pairs of chunks. So no pair that met is left out, and no pairs are made
into rows.

Defined cases: a null text counts as empty; texts without words are copies of each other; a text under five words is one shingle;
words are told apart by white space, without regard to case; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm.common import discard, free_name, lookup, map_batches, materialize, release, utf8
from quarry.llm.components import components
from quarry.llm.sketch import mixed

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 8
#: Members of a bucket, and shingles of their sets, that one search takes; larger buckets are split into chunks whose pairs are searched apart.
BUCKET_LIMIT = 4000
SET_LIMIT = 4_000_000
_RNG = np.random.default_rng(42)
_MULTIPLY = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_PLACE = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _RNG.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    digest = xxhash.xxh64_intdigest
    words = np.array([digest(w, 42) for w in text.lower().split()], np.uint64)
    if not len(words):
        return words
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = mixed(total + words[k : k + n] * _PLACE[k])
    return np.unique(total)


def buckets(own: np.ndarray) -> np.ndarray:
    """One bucket a band; none for a text without words."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(own), 2048):
        least = np.minimum(least, (own[at : at + 2048, None] * _MULTIPLY + _ADD).min(0))
    return mixed((least.reshape(BANDS, ROWS) * _FOLD).sum(1, dtype=np.uint64) + _BAND).view(np.int64)


def sketched(own: np.ndarray) -> int:
    """The SimHash of a set of shingles: a bit is 1 if set in over half of their hashes."""
    return int(np.packbits(np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1).sum(0) * 2 > max(1, len(own))).view(np.int64)[0]) if len(own) else 0


def _node(own: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _marked(documents: DataFrame) -> DataFrame:
    """doc_id, mark (a hash that tells rows of one doc_id apart by their text) and text."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def _prints(documents: DataFrame) -> DataFrame:
    """doc_id, mark, node (a hash of the set of shingles), size (of the set) and buckets of every row."""

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in utf8(batch.column(2))]
        columns = [batch.column(0), batch.column(1), pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([buckets(s) for s in sets], pa.list_(pa.int64())), pa.array([sketched(s) for s in sets], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "node", "size", "buckets", "fp"])

    return map_batches(_marked(documents), compute, "doc_id long, mark long, node long, size long, buckets array<long>, fp long")


def _by_fingerprint(distinct: DataFrame, least: float) -> DataFrame:
    """Candidates a, b by SimHash, from the Gray index of ``simhash``: texts of one fingerprint with the smallest of them, and that one with the
    smallest of the fingerprint that links lead to."""
    prints = materialize(distinct.where("size > 0").groupBy("fp").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.min_by("size", "node").alias("first_size")), "fingerprints")
    near = components(simhash.links(prints.select("fp")))
    heads = prints.select(F.col("fp").alias("root"), F.col("first").alias("root_first"), F.col("first_size").alias("root_size"))
    led = prints.join(near.withColumnRenamed("node", "fp"), "fp").where("root != fp").join(heads, "root").where(_alike("first_size", "root_size", least))
    same = lookup(distinct.where("size > 0").select("node", "size", "fp"), prints, "fp", F.col("node"), "n").where(F.col("node") != F.col("first")).where(_alike("size", "first_size", least))
    out = materialize(led.select(F.col("first").alias("a"), F.col("root_first").alias("b")).unionByName(same.select(F.col("node").alias("a"), F.col("first").alias("b"))), "gray")
    discard(prints)
    return out


def _sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, own (the set as bytes) of the nodes wanted. A task gives each of its sets once, however many copies it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, own = [], []
            for text in utf8(batch.column(0)):
                one = shingles(text)
                if (node := _node(one)) not in seen:
                    seen.add(node)
                    nodes.append(node)
                    own.append(one.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(own, pa.binary())], ["node", "own"])
        release()

    found = documents.select("text").mapInArrow(run, "node long, own binary")
    return found.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("own").alias("own"))


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs a, b whose sets are at least so similar."""

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (batch.column(i).to_pylist() for i in (2, 3))
        near = pa.array([similarity(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) >= least for p, q in zip(x, y, strict=True)], pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    asked = pairs.groupBy("b").agg(F.count("*").alias("n"))
    theirs = sets.withColumnRenamed("node", "b").withColumnRenamed("own", "y").join(asked, "b")
    first = pairs.join(sets.withColumnRenamed("node", "a").withColumnRenamed("own", "x"), "a")
    theirs = materialize(theirs, "theirs")
    both = lookup(first, theirs, "b", F.col("a"), "n")
    out = materialize(map_batches(both.select("a", "b", "x", "y"), compute, "a long, b long"), "links")
    discard(theirs)
    return out


def _alike(a: str, b: str, least: float) -> Column:
    """Whether sets of these sizes can be so similar."""
    return F.least(a, b) >= F.greatest(a, b) * least


def joining(sets: list[np.ndarray], roots: list[int], least: float) -> list[tuple[int, int]]:
    """Pairs of places that are at least so similar and join groups; pairs of a group already joined are left out."""
    names, group = np.unique(np.array(roots, np.int64), return_inverse=True)
    lengths = np.array([len(x) for x in sets])
    if len(names) < 2 or not lengths.all():
        return []
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, lengths.cumsum()[:-1]]
    mark, out = np.zeros(len(words), np.int32), []
    for i in range(len(sets)):
        if (group == group[i]).all():
            break
        own = flat[starts[i] : starts[i] + lengths[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat], starts)
        mark[own] = 0
        for j in np.flatnonzero((both / (lengths + lengths[i] - both) >= least) & (group != group[i])):
            if group[j] != group[i]:
                out.append((i, int(j)))
                group[group == group[j]] = group[i]
    return out


def _search(least: float):
    """Partitions sorted by bucket, with the sets of its members -> the links that join the groups in each bucket."""

    def links(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(rows)
        nodes = whole["node"].to_pylist()
        found = joining([np.frombuffer(x, np.uint64) for x in whole["own"].to_pylist()], whole["root"].to_pylist(), least)
        return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
                if keys[a] != now and held:
                    yield links(held)
                    held = []
                now = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield links(held)
        release()

    return run


def groups(documents: DataFrame, prints: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """node, root of the nodes that have a link: root is the smallest node that links reach."""
    distinct = prints.groupBy("node").agg(F.first("size").alias("size"), F.first("buckets").alias("buckets"), F.first("fp").alias("fp"))
    gray = _by_fingerprint(distinct, least)
    dealt = materialize(distinct.select("node", "size", F.explode("buckets").alias("bucket")), "dealt")
    # plain numbers, so that no row of the aggregate holds more than it must; a node is a hash itself
    shared = materialize(dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.min_by("size", "node").alias("first_size")).where("n > 1"), "shared")
    met = materialize(lookup(dealt, shared, "bucket", F.col("node"), "n").where("first is not null"), "met")
    discard(dealt, shared)
    ends = gray.select(F.col("a").alias("node")).unionByName(gray.select(F.col("b").alias("node")))
    nodes = materialize(met.select("node").unionByName(ends).distinct(), "nodes")
    sets = materialize(_sets(documents, nodes), "sets")
    pairs = materialize(met.where((F.col("node") != F.col("first")) & _alike("size", "first_size", least)).select(F.col("node").alias("a"), F.col("first").alias("b")).unionByName(gray).distinct(), "pairs")
    links = _linked(pairs, sets, least)
    found = components(links)
    label = materialize(nodes.join(found.withColumnRenamed("root", "_root"), "node", "left").select("node", F.coalesce("_root", "node").alias("root")), "label")
    discard(gray, pairs, links, found, nodes)
    rooted = met.select("bucket", "node", "size").join(label, "node")
    parts = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    chunks = F.ceil(F.greatest(F.col("n") / BUCKET_LIMIT, F.col("words") / SET_LIMIT)).cast("int").alias("chunks")
    open_ = materialize(parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.count("*").alias("roots")).where("roots > 1").select("bucket", "n", chunks), "open")
    alive = lookup(rooted, open_, "bucket", F.col("node"), "n").where("chunks is not null")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = alive.withColumn("chunk", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    key = F.when(F.col("chunks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("chunk", "other"), F.greatest("chunk", "other")))
    members = dealt.select(key.alias("bucket"), "node", "root").join(sets, "node").select("bucket", "node", "root", "own")
    more = members.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_search(least), "a long, b long")
    tied = label.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    out = components(tied.unionByName(more))
    discard(met, sets, label, open_)
    return out


def keep_one(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents without those that link to a document of smaller doc_id, directly or through others; all columns.

    Rows are told apart by doc_id and text: of the rows of a group that share its smallest doc_id one stays, of two texts that with the smaller
    hash; a row that is like no other stays whatever its doc_id. Rows without a doc_id are kept.
    """
    prints = materialize(_prints(documents), "prints")
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))
    counted = prints.groupBy("node").agg(F.count("*").alias("n"), F.min(key).alias("least"))
    grouped = groups(documents, prints, least)
    rooted = materialize(counted.join(grouped, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    first = materialize(rooted.groupBy("root").agg(F.min("least").alias("kept"), F.count("*").alias("members")), "first")
    named = materialize(lookup(rooted, first, "root", F.col("node"), "members").select("node", "n", "kept"), "named")
    found = lookup(prints.select("doc_id", "mark", "node"), named, "node", F.coalesce("doc_id", F.rand(7) * 2**40).cast("long"), "n")
    found = materialize(found.where("doc_id is not null").select("doc_id", "mark", (F.struct("doc_id", "mark") == F.col("kept")).alias("stays")), "near")
    discard(prints, grouped, rooted, first, named)
    doc_id, mark = free_name(documents, "_doc_id"), free_name(documents, "_mark")
    rows = documents.withColumns({doc_id: F.col("doc_id").cast("long"), mark: F.xxhash64("text")})
    gone = found.where("not stays").select(F.col("doc_id").alias(doc_id), F.col("mark").alias(mark)).distinct()
    kept = rows.join(gone, [doc_id, mark], "left_anti")
    if found.where("stays").groupBy("doc_id", "mark").count().where("count > 1").isEmpty():
        return kept.select(*documents.columns)
    once = kept.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id, mark])
    return once.unionByName(kept.where(F.col(doc_id).isNull())).select(*documents.columns)
