"""The mix's rows: each document as often as the plan takes it, and op6 counts what was dealt."""

import random
from collections import Counter

from quarry.llm import mixing, queries
from tests.llm.test_operators import corpus, documents, words


def rows():
    r = random.Random(9)
    made = [(i, words(r, r.randint(0, 60)), "en", r.choice(["big"] * 30 + ["a", "b", "Ä", None]), 0) for i in range(600)] + corpus(1, 10)
    return made + [(7000, "the same text", "en", "a", 0), (7000, "the same text", "en", "big", 0)]


def test_mix_deals_every_copy_once(spark):
    docs = documents(spark, rows(), True)
    expect = Counter()
    for x in mixing.plan(docs, block_words=700).collect():
        expect[(x["doc_id"], x["source"], x["size"])] += x["passes"] if x["size"] else 0
    got = Counter((x["doc_id"], x["source"], len((x["text"] or "").encode().split())) for x in mixing.mix(docs, shard_words=3000, block_words=700).collect())
    assert got == +expect


def test_op6_counts_what_was_dealt(spark, monkeypatch):
    docs = documents(spark, rows())
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    whole = queries.op6_source_mixing(spark, "").collect()
    assert len(whole) == len(rows()) and all(x["taken"] == x["size"] * x["passes"] for x in whole)
    gone = next(x["doc_id"] for x in whole if x["taken"] and x["doc_id"] is not None and x["doc_id"] < 600)
    dealt = mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda *a, **k: dealt(*a, **k).where(~mixing.F.col("doc_id").eqNullSafe(gone)))
    assert [x["taken"] for x in queries.op6_source_mixing(spark, "").collect() if x["doc_id"] == gone] == [0]


def test_quotas_of_the_shards_are_what_is_taken(spark):
    """The blocks that the tree deals to the shards, added up by hand, are the words that op6 reports."""
    docs = documents(spark, rows())
    planned = mixing.plan(docs, block_words=700).collect()
    dealt = mixing.mix(docs, shard_words=3000, block_words=700).collect()
    by_shard: dict = {}
    for x in dealt:
        by_shard.setdefault(x["shard"], Counter())[x["source"]] += len((x["text"] or "").encode().split())
    assert len(by_shard) > 3 and len({x["block"] for x in planned if x["source"] == "big"}) > 10
    reported = Counter()
    for x in mixing.taken(docs, shard_words=3000, block_words=700).collect():
        reported[next(p["source"] for p in planned if (p["doc_id"], p["source_size"]) == (x["doc_id"], x["source_size"]))] += x["taken"]
    assert sum(by_shard.values(), Counter()) == +reported


def test_columns_of_the_same_names_are_kept(spark):
    docs = documents(spark, rows())
    for c in ("shard", "position", "_h", "_doc_id", "idx", "block", "_source"):
        docs = docs.withColumn(c, mixing.F.lit(5))
    mixed = mixing.mix(docs, shard_words=3000, block_words=700)
    assert mixed.columns == [*docs.columns, "shard_1", "position_1"]
    out = mixing.shuffled(mixed).collect()
    assert {x["shard"] for x in out} == {x["_h"] for x in out} == {5} and len({x["shard_1"] for x in out}) > 3
    assert mixing.shuffled(mixing.mix(docs.limit(0))).count() == 0


def test_many_sources_are_looked_up(spark, monkeypatch):
    docs = documents(spark, rows())
    few = sorted(map(str, mixing.plan(docs, block_words=700).collect()))
    monkeypatch.setattr(mixing, "MAX_STRATA", 2)
    assert sorted(map(str, mixing.plan(docs, block_words=700).collect())) == few
