"""Connected components of links between 64-bit nodes, by alternating large-star and small-star rounds.

Every round is a pair of pre-aggregated group minima and equi-joins on 16-byte rows, written to the shared folder, where it
replaces the last one; nothing is collected but a few numbers a round. Where a node has a large share of all links, as the centre
of a star does, its minimum is broadcast instead of gathering its links in one task. An empty edge table gives an empty result;
loops and repeated or reversed links are harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import HOT_SHARE, discard, lookup, materialize


def _star(edges: DataFrame, both_ways: bool, hot: int | None) -> DataFrame:
    """Links (a > b) after one star round: large (to neighbours above) or small (to neighbours below). ``hot``: the ends of all links, where some node has many."""
    around = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    if both_ways:
        around = around.unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
    least = around.groupBy("x").agg(F.least("x", F.min("y")).alias("m"), F.count("*").alias("n"))
    joined = lookup(around, least, "x", F.col("y"), "n", hot) if hot else around.join(least.select(F.col("x").alias("at"), "m"), F.col("x") == F.col("at"))
    if both_ways:
        moved = joined.where("y > x").select(F.col("y").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("m").alias("b")), F.struct(F.col("y").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return moved.where("a > b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges``: a, b long. Returns node, root long for every linked node: root is the smallest node it reaches."""
    links = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")

    def state(d: DataFrame) -> tuple[int, int, bool]:
        """How many ends of links there are, those of the node with most of them, and whether each node links to one root that links to none."""
        ends = d.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up")))).alias("e"))
        nodes = ends.groupBy("e.x").agg(F.count("*").alias("n"), F.sum("e.up").alias("up"))
        n, most, astray = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n"), F.count(F.when((F.col("up") > 1) | (F.col("up") == 1) & (F.col("n") > 1), 1))).first()
        return n, most or 0, not astray

    n, most, settled = state(links)
    for _ in range(rounds):
        if settled:
            break
        hot = n if most >= max(1000, n / HOT_SHARE) else None
        old, links = links, materialize(_star(_star(links, True, hot), False, hot), "links")
        discard(old)
        n, most, settled = state(links)
    else:
        raise RuntimeError("components did not settle")
    out = links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
    out._materialized = links._materialized  # what ``discard`` deletes once the result has been used
    return out
