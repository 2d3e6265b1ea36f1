"""Checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a side of a join may have to be sent to every executor: keywords, probes, catalog documents.
MOST_SMALL = 50_000


def blocks_joined(left: DataFrame, right: DataFrame, on=None, blocks: int = 64) -> DataFrame:
    """Every left row with every right row that meets ``on``, for a stated set ``right`` of any size.

    A small set is broadcast. A larger one is cut into blocks that left rows visit one by one, by an equi-join on the block,
    so no task holds more than a block of it.
    """
    if right.limit(MOST_SMALL + 1).count() <= MOST_SMALL:
        return left.join(F.broadcast(right), on) if on is not None else left.crossJoin(F.broadcast(right))
    own = right.withColumn("_block", F.pmod(F.xxhash64(*right.columns), F.lit(blocks)))
    visits = left.withColumn("_visit", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = F.col("_visit") == F.col("_block")
    return visits.join(own, met & on if on is not None else met).drop("_visit", "_block")
