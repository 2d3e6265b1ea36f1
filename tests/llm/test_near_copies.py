"""The pipeline's near-duplicate stage against brute force over exact similarities."""

import random

import numpy as np

import corpus_pipeline
from quarry.llm import near_copies
from tests.llm.test_operators import brute_components, documents


def brute_shingles(text):
    own = (text or "").lower().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(seed, bases, copies):
    r = random.Random(seed)
    rows = []
    for _ in range(bases):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(20, 300))]
        rows.append(base)
        for _ in range(copies):
            own = list(base)
            for _ in range(r.randint(1, max(1, len(base) // 25))):
                own[r.randrange(len(own))] = f"new{r.randrange(10**6)}"
            rows.append(own)
    r.shuffle(rows)
    return [(i, " ".join(x), "en", "s1", 0) for i, x in enumerate(rows)]


def brute_kept(rows):
    sets = {i: brute_shingles(t) for i, t, *_ in rows}
    label = brute_components(sorted(sets), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    return sorted(i for i in sets if label[i] == i), sets


def test_stage_finds_planted_copies(spark):
    rows = planted(1, 40, 5) + [(900, "", "en", "s1", 0), (901, None, "en", "s1", 0), (902, "a b", "en", "s1", 0), (903, "A  b", "en", "s1", 0), (904, "a c", "en", "s1", 0)]
    want, sets = brute_kept(rows)
    close = [(a, b) for a in sets for b in sets if a < b and 0.8 <= jaccard(sets[a], sets[b]) < 0.95]
    assert len(close) > 100
    kept = corpus_pipeline.near_dedup_stage(spark, documents(spark, rows, True), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert kept.columns == documents(spark, rows, True).columns


def test_one_large_family(spark, monkeypatch):
    rows = planted(2, 1, 250)
    want, _ = brute_kept(rows)
    for each in (4000, 40):  # buckets in whole, and as pairs of chunks
        monkeypatch.setattr(near_copies, "BUCKET_LIMIT", each)
        assert sorted(r["doc_id"] for r in near_copies.keep_one(documents(spark, rows)).collect()) == want


def test_keep_one_edges(spark):
    rows = [(1, "x y z", "en", "s", 0), (1, "x y z", "en", "s", 0), (None, "x y z", "en", "s", 0), (None, "q", "en", "s", 0), (5, "X Y z", "en", "s", 0)]
    kept = near_copies.keep_one(documents(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "None", "None"]
    assert near_copies.keep_one(documents(spark, rows).limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    """Only near copies go: texts that share a doc_id with one stay."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "pqrs")
    rows = [(1, a, "en", "s", 0), (7, a + " more", "en", "s", 0), (7, b, "en", "s", 0), (9, c, "en", "s", 0), (9, c + " too", "en", "s", 0), (9, d, "en", "s", 0)]
    kept = sorted((r["doc_id"], r["text"]) for r in near_copies.keep_one(documents(spark, rows)).collect())
    assert len(kept) == 4
    assert (1, a) in kept and (7, b) in kept and (9, d) in kept
    assert sum(t in (c, c + " too") for _, t in kept) == 1


def test_many_exact_copies_and_very_long_texts(spark, monkeypatch):
    r = random.Random(5)
    long = [f"v{r.randrange(50_000)}" for _ in range(20_000)]
    near = [*long[:19_900], *(f"z{i}" for i in range(100))]
    rows = [(i, "one and the same short text of some words", "en", "s", 0) for i in range(10_000)]
    rows += [(20_000, " ".join(long), "en", "s", 0), (20_001, " ".join(near), "en", "s", 0), (20_002, " ".join(f"y{i}" for i in range(20_000)), "en", "s", 0)]
    monkeypatch.setattr(near_copies, "SET_LIMIT", 10_000)
    assert sorted(r["doc_id"] for r in near_copies.keep_one(documents(spark, rows)).collect()) == [0, 20_000, 20_002]


def test_bands_recall():
    rng, missed = np.random.default_rng(1), 0
    for _ in range(400):
        both = rng.integers(0, 2**63, 160, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, 20, dtype=np.uint64)])) for _ in range(2))
        assert 0.79 < near_copies.similarity(a, b) < 0.81
        missed += not (near_copies.buckets(a) == near_copies.buckets(b)).any()
    assert missed <= 3
