"""The whole pipeline against a brute-force version of its stages, and the edges of stages that no other test has."""

import math
import random
from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import mixing, quality, sentencepiece, suffix
from tests.llm.test_near_copies import brute_kept, planted
from tests.llm.test_operators import brute_repeats, brute_targets, corpus, documents, words


def by_hand(model: quality.Model, text: str | None) -> float:
    """The model's score of one text, a table look-up at a time."""
    x = quality.features((text or "").encode())
    bins = [bisect_right(list(c), v) for c, v in zip(model.cuts, x, strict=False)]
    total = model.base + sum(float(t[b]) for t, b in zip(model.tables, bins, strict=True))
    total += sum(float(t[model.coarse[i][bins[i]]][model.coarse[j][bins[j]]]) for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
    return 1 / (1 + math.exp(-total))


@pytest.fixture(scope="module")
def sample(tmp_path_factory, spark):
    """A directory with documents of sf0.001, planted copies and passages, and labels."""
    own = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    base = 1 + max(r[0] for r in own)
    near = [(base + i, *rest) for i, *rest in planted(5, 6, 4)]
    shared = words(random.Random(8), 70)
    passages = [(base + 500 + i, f"{words(random.Random(i), 40)} {shared} {words(random.Random(-i), 30)}", "en", "s2", 0) for i in range(1, 6)]
    rows = own + near + passages + [(base + 900, own[3][1], "en", "s9", 0), (base + 901, "", "en", "s9", 0), (base + 902, None, None, None, 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_pipeline_against_brute_force(spark, sample):
    path, rows = sample
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    good = [r for r in rows if by_hand(model, r[1]) >= quality.THRESHOLD]
    assert len(good) > len(rows) // 2
    ids = set(brute_kept(good)[0])
    single = [r for r in good if r[0] in ids]
    assert len(single) < len(good)
    cut = {i: suffix.whole_characters(t, gone) for i, t, gone in brute_repeats(single)}
    assert any(len(cut[r[0]]) < len(r[1] or "") for r in single)
    left = [(r[0], cut[r[0]] if r[1] is not None else None, *r[2:]) for r in single]
    size_of: dict = {}
    for r in left:
        size_of[r[3]] = size_of.get(r[3], 0) + len((r[1] or "").encode().split())
    want = brute_targets(size_of)
    out = corpus_pipeline.run(spark, path).collect()
    times = Counter(r["doc_id"] for r in out)
    assert set(times) <= ids and max(times.values()) <= 3
    taken: Counter = Counter()
    for r in left:
        taken[r[3]] += times[r[0]] * len((r[1] or "").encode().split())
    for s in size_of:
        longest = max(len((r[1] or "").encode().split()) for r in left if r[3] == s)
        assert abs(taken[s] - want[s]) <= longest / 2 + 1, s
    with open(sentencepiece.MODEL_PATH, "rb") as f:
        tokenizer = sentencepiece.load(f.read())
    for r in out:
        assert tokenizer.decode(list(r["token_ids"])) == (cut[r["doc_id"]] or "") and r["n_tokens"] == len(r["token_ids"]) and r["round_trip"]


def test_scores_are_sums_of_table_entries(spark, sample):
    path, rows = sample
    model = quality.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    got = {r["doc_id"]: r for r in quality.score(documents(spark, rows), model).collect()}
    for r in rows:
        assert got[r[0]]["score"] == pytest.approx(by_hand(model, r[1])) and got[r[0]]["predicted"] == int(got[r[0]]["score"] >= quality.THRESHOLD)


def test_repeated_ids_are_learnt_once(spark):
    rows = [(i, words(random.Random(i), 20) if i % 2 else "$$ ## || " * (i + 1), "en", "s", 0) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    plain = quality.train(documents(spark, rows), labels)
    again = quality.train(documents(spark, rows + rows[:9] * 50), labels)
    x = np.array([quality.features(t.encode()) for _, t, *_ in rows])
    assert np.array_equal(plain.score(x), again.score(x))


def test_stage_edges(spark):
    docs = documents(spark, corpus(4, 15), True).withColumnRenamed("fp", "shard").withColumnRenamed("block", "position")
    assert mixing.shuffled(mixing.mix(docs.limit(0))).count() == 0
    mixed = corpus_pipeline.mixing_stage(spark, docs, "")
    assert mixed.columns == docs.columns and {(r["shard"], r["position"]) for r in mixed.collect()} == {(1, "x")}
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema and quality.keep_good(docs.limit(0), model).count() == 0
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, t, *_ in corpus(4, 15) if by_hand(model, t) >= quality.THRESHOLD)
