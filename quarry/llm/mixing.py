"""Mixing sources to target weights.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the words of all documents by weight; a
target stops at ``MOST`` times its source's words and the excess is shared again by weight. Each source's documents lie in
permuted blocks (by a hash of the document), of about ``BLOCK_WORDS`` words, but ``BLOCKS`` bound their number. A source is passed over in whole as often as fits its target, and a last pass
takes its first permuted blocks; within the one block that crosses the target, documents are taken in hash order up to the
nearest to it. A splitting tree divides the block copies of all sources among the output shards: each node draws its left
half's counts from a multivariate hypergeometric distribution over the sources, so each shard knows exactly how many blocks of
each source it gets and takes the next ones of the permutation; rows are shuffled within their shard.

Defined cases: a null text has size 0 and an empty one too; documents of size 0 take 0 words and are left out of the mix; null is a source of its own,
after the others; identical rows are taken equally often; an empty table gives an empty result. All draws depend on
``seed`` and the documents' ids and texts alone, so reruns agree. Other columns are left out of the plan, and kept by ``mix``,
whose own two columns come last and are named ``shard_1`` or ``position_1`` and so on where the documents have such columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import free_name, lookup, map_batches, materialize, utf8
from quarry.llm.common import ranked as in_order

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK_WORDS = 200_000
#: Blocks of a source: at least (so that small sources are drawn from by blocks, too), at most (so that one task can order them).
BLOCKS = (64, 1 << 20)
SHARD_WORDS = 1_000_000
#: Sources in the vector that the splitting tree draws; more sources than that share an entry by their index.
MAX_STRATA = 4096


def sizes(documents: DataFrame) -> DataFrame:
    """doc_id, source, size and mark (a hash that orders documents within their source)."""

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t.split()) for t in utf8(batch.column(2))], pa.int64()), batch.column(3)], ["doc_id", "source", "size", "text_hash"])

    return map_batches(documents.select(F.col("doc_id").cast("long"), "source", "text", F.xxhash64("doc_id", "text").alias("text_hash")), compute, "doc_id long, source string, size long, text_hash long")


def targets(sized: DataFrame) -> DataFrame:
    """source, idx (place in code-point order, null last), weight, source_size, target of every source."""
    totals = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "totals")
    ranked = in_order(totals, "idx", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("idx") % len(WEIGHTS) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight), "ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share, bound = 0.0, -1
    while True:  # each round caps at least one more source, and few rounds are needed: a cap only raises the others' share
        full = (F.col("weight") * share >= F.col("source_size") * MOST) if share else F.lit(False)
        capped, capped_words, open_weight = ranked.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("source_size") * MOST)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if capped == bound or not open_weight:
            break
        bound, share = capped, (total - capped_words) / open_weight
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(float(share)), (F.col("source_size") * MOST).cast("double")))


def _hash(*columns: Column | str | int) -> Column:
    return F.xxhash64(*[F.lit(c) if isinstance(c, int) else c for c in columns])


def plan(documents: DataFrame, seed: int = 42, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, idx, size, text_hash, source_size, target, block, passes (how often the mix takes the document) of every row."""
    sized = materialize(sizes(documents), "sizes")
    aimed = materialize(targets(sized), "targets")
    n_blocks = F.least(F.lit(BLOCKS[1]), F.greatest(F.lit(BLOCKS[0]), F.ceil(F.col("source_size") / block_words))).cast("long")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-12).cast("int")
    aimed = aimed.withColumn("n_blocks", n_blocks).withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("key")
    aimed = aimed.select(key, *[c for c in aimed.columns if c != "source"])
    keyed = sized.select("*", key)
    rows = keyed.join(F.broadcast(aimed.drop("n")), "key") if aimed.count() <= MAX_STRATA else lookup(keyed, materialize(aimed, "sources"), "key", F.col("text_hash"), "n")
    mark = _hash("text_hash", seed)
    rows = rows.withColumn("block", F.pmod(mark, F.col("n_blocks"))).withColumn("mark", _hash("text_hash", seed + 1))
    blocks = rows.groupBy("idx", "block", "rest").agg(F.sum("size").alias("words"))
    line = Window.partitionBy("idx").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("before", F.coalesce(F.sum("words").over(line), F.lit(0)))
    state = F.when(F.col("before") + F.col("words") <= F.col("rest"), 1).when(F.col("before") >= F.col("rest"), 0).otherwise(2)
    placed = materialize(placed.withColumn("state", state).select(F.col("idx").alias("_idx"), F.col("block").alias("_block"), "state", (F.col("rest") - F.col("before")).alias("room")), "blocks")
    # One block a source crosses its target, and only its documents are put in order: blocks have a bounded number of words.
    crossing = placed.where("state = 2").select("_idx", "_block", "room")
    inner = rows.where("size > 0").join(crossing, (F.col("idx") == F.col("_idx")) & (F.col("block") == F.col("_block")))
    alike = inner.groupBy("idx", "doc_id", "text_hash", "mark", "room").agg(F.sum("size").alias("words"))  # identical rows go in or stay out together
    running = Window.partitionBy("idx").orderBy("mark", "text_hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("words").over(running)
    taken = alike.withColumn("upto", upto).where(F.col("upto") - F.col("words") / 2 <= F.col("room"))  # what crosses goes in if that is nearer
    taken = taken.select(F.col("idx").alias("_i"), F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.lit(1).alias("_times"))
    last = materialize(taken, "crossing")
    done = placed.where("state = 1").select("_idx", "_block", F.lit(1).alias("_all"))
    out = rows.join(done, (F.col("idx") == F.col("_idx")) & (F.col("block") == F.col("_block")), "left")
    out = out.join(last, (F.col("idx") == F.col("_i")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left")
    passes = F.col("whole") + F.when(F.col("_all").isNotNull() | F.col("_times").isNotNull(), 1).otherwise(0)
    return out.select("doc_id", "source", "idx", "size", "text_hash", "source_size", "target", "block", F.least(passes, F.lit(MOST)).cast("int").alias("passes"))


def split_counts(counts: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, quota) of one shard by source: the path from the root of the splitting tree to its leaf.

    A node over shards [lo, hi) holds exact counts; its left half draws its share without replacement. Nodes seed their own
    draws, so any shard finds the same counts on its way down, and quotas of all shards add up to ``counts``.
    """
    lo, hi = 0, shards
    first, held = np.zeros_like(counts), counts.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        total = int(held.sum())
        draws = total * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(held, draws, method="marginals") if total else held
        if shard < mid:
            held, hi = left, mid
        else:
            first, held, lo = first + left, held - left, mid
    return first, held


def mix(documents: DataFrame, seed: int = 42, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, planned: DataFrame | None = None) -> DataFrame:
    """The mix: the documents' rows, each as often as the plan takes it, with shard and position (the order in the shard)."""
    planned = materialize(plan(documents, seed, block_words), "plan") if planned is None else planned
    spark = documents.sparkSession
    copies = planned.where("passes > 0 and size > 0").select("doc_id", "text_hash", "source", "idx", "block", "size", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("turn"))
    stratum = F.col("idx") % MAX_STRATA
    units = copies.groupBy(stratum.alias("stratum"), "idx", "block", "turn").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("stratum").orderBy("turn", _hash("idx", "block", "turn", seed + 2), "idx", "block")
    units = materialize(units.withColumn("place", F.row_number().over(order) - 1), "units")
    # At most MAX_STRATA numbers: the root of the splitting tree.
    counts = {r[0]: r[1] for r in units.groupBy("stratum").count().collect()}
    words = units.agg(F.sum("words")).first()[0] or 0
    root = np.zeros(max(counts, default=-1) + 1, np.int64)
    for k, n in counts.items():
        root[k] = n
    shards = max(1, min(int(root.sum()), -(-words // shard_words)))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, quota = split_counts(root, shards, shard, seed)
                own = np.flatnonzero(quota)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(first[own]), pa.array(quota[own]), pa.array(np.full(len(own), shard))], ["s", "first", "quota", "shard"])

    quotas = spark.range(shards).mapInArrow(leaves, "s long, first long, quota long, shard long")
    place = quotas.select(F.col("s").alias("stratum"), "shard", F.explode(F.sequence("first", F.col("first") + F.col("quota") - 1)).alias("place"))
    dealt = units.join(place, ["stratum", "place"]).select(F.col("idx").alias("_idx"), F.col("block").alias("_block"), F.col("turn").alias("_turn"), "shard")
    drawn = copies.join(dealt, (F.col("idx") == F.col("_idx")) & (F.col("block") == F.col("_block")) & (F.col("turn") == F.col("_turn")))
    where_to = drawn.select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"), F.col("source").alias("_source"), "shard", _hash("text_hash", "turn", seed + 3).alias("position")).distinct()
    h, shard, position = (free_name(documents, c) for c in ("_h", "shard", "position"))
    source = documents.withColumn(h, F.xxhash64(F.col("doc_id").cast("long"), "text")).alias("d")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("w._doc_id")) & F.col("d.source").eqNullSafe(F.col("w._source"))  # rows of two sources may agree in all else
    out = source.join(where_to.alias("w"), same & (F.col(f"d.{h}") == F.col("w._text_hash")))
    return out.select(*[F.col(f"d.`{c}`") for c in documents.columns], F.col("w.shard").alias(shard), F.col("w.position").alias(position))


def shuffled(mixed: DataFrame) -> DataFrame:
    """The mix with each shard's rows together in their shuffled order."""
    shard, position = mixed.columns[-2:]
    return mixed.repartition(shard).sortWithinPartitions(shard, position)


def taken(documents: DataFrame, seed: int = 42, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, passes of every row: ``taken`` counts the words that lie in the dealt and shuffled shards."""
    planned = materialize(plan(documents, seed, block_words), "plan")
    dealt = sizes(shuffled(mix(documents, seed, shard_words, block_words, planned)))
    words = dealt.groupBy("doc_id", "source", "text_hash").agg(F.sum("size").alias("words"))
    alike = planned.where("passes > 0 and size > 0").groupBy("doc_id", "source", "text_hash").agg(F.count("*").alias("rows"))
    counted = alike.withColumnsRenamed({"doc_id": "_d", "source": "_s", "text_hash": "_t"})
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("text_hash") == F.col("_t"))
    each = materialize(words.join(counted, same, "full").select(F.coalesce("doc_id", "_d").alias("_d"), F.coalesce("source", "_s").alias("_s"), F.coalesce("text_hash", "_t").alias("_t"), F.expr("words div greatest(rows, 1)").alias("taken")), "each")
    out = planned.join(each, same, "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "passes")
