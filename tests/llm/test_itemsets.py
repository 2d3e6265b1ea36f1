"""Closed itemsets and rules against brute force, whole and with shards split at every level."""

import hashlib
import itertools
import random
from collections import Counter

import pytest

from quarry.llm import itemsets


def brute(rows, least, per, confidence=10):
    baskets = {}
    for sale, item in rows:
        if sale is not None and item is not None:
            baskets.setdefault(sale, set()).add(item)
    n = len(baskets)
    least = max(least, -(-n // per))
    level = {frozenset([i]): c for i, c in Counter(i for b in baskets.values() for i in b).items() if c >= least}
    single = {next(iter(k)): c for k, c in level.items()}
    every = dict(level)
    while level:
        wider = {a | {i} for a in level for i in single if i not in a}
        level = {s: c for s in wider if (c := sum(s <= b for b in baskets.values())) >= least}
        every |= level
    out = {}
    for own, c in every.items():
        if any(own < o and c == m for o, m in every.items()):
            continue
        rules = sorted((x, every[own - {x}], single[x]) for x in own if len(own) > 1 and 100 * c >= confidence * every[own - {x}] and c * n > every[own - {x}] * single[x])
        said = ";".join(f"{x}:{a}:{s}" for x, a, s in rules)
        out[",".join(map(str, sorted(own)))] = (len(own), c, len(rules), min(((a, x) for x, a, _ in rules), default=(0, None))[1], hashlib.sha256(said.encode()).hexdigest())
    return out


def run(spark, rows, **how):
    got = itemsets.itemsets(spark.createDataFrame(rows, "sale_id long, item_id long"), "sale_id", "item_id", **how).collect()
    assert len({r["items"] for r in got}) == len(got)
    return {r["items"]: (r["n_items"], r["support"], r["n_rules"], r["best_item"], r["rules_sha256"]) for r in got}


def sales(seed, n=300, items=14, bundles=6):
    r = random.Random(seed)
    kinds = [r.sample(range(items), r.randint(2, 6)) for _ in range(bundles)]
    rows = []
    for sale in range(n):
        own = set(r.choices(range(items), [2 ** -(i / 2) for i in range(items)], k=r.randint(1, 3)))
        own |= {i for i in r.choice(kinds) if r.random() < 0.85} if r.random() < 0.5 else set()
        rows += [(sale, i * 7 - 5) for i in own for _ in range(r.randint(1, 2))]
    rows += [(None, 2), (3, None), (None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("how", [{}, {"shard_rows": 3}, {"shard_rows": 20, "max_nodes": 6}])
def test_against_brute_force(spark, how):
    rows = sales(1)
    want = brute(rows, 8, 2000)
    assert max(v[0] for v in want.values()) >= 4
    assert any(v[2] for v in want.values())
    assert run(spark, rows, **how) == want


def test_least_support_is_a_share(spark):
    rows = sales(2, 400)
    assert run(spark, rows, per=20) == brute(rows, 8, 20)


def test_copies_and_hot_basket(spark):
    """Thousands of equal baskets, and one basket with every item."""
    rows = [(s, i) for s in range(3000) for i in (1, 2, 3)] + [(9000, i) for i in range(200)] + [(9001 + s, i) for s in range(12) for i in (3, 4)]
    assert run(spark, rows) == brute(rows, 8, 2000)


def test_empty(spark):
    assert run(spark, [(None, 1), (1, None)]) == {}
    assert run(spark, [(1, 1), (2, 1)]) == {}


def test_returned_lines_and_clashing_names(spark):
    rows = [(s, i, f, 0) for s in range(10) for i, f in ((1, "kept"), (2, None), (3, "returned"))]
    frame = spark.createDataFrame(rows, "sale_id long, item_id long, flag string, support int")
    got = itemsets.of_sales(frame).collect()
    assert [(r["items"], r["support"]) for r in got] == [("1,2", 10)]


def test_pruning_keeps_weights():
    r = random.Random(3)
    baskets = [tuple(sorted(r.sample(range(9), r.randint(1, 6)), reverse=True)) for _ in range(200)]
    merged = Counter(baskets)
    counts = Counter()
    for b, w in merged.items():
        counts.update({i: w for i in b})
    made = itemsets.Repository(8, Counter(counts))
    for k, (b, w) in enumerate(sorted(merged.items())):
        made.add(list(b), w, 1 << (k % 60), 0)
        made.prune()
    found = {frozenset(p): n for p, n, *_ in made.found()}
    for k in range(1, 7):
        for s in itertools.combinations(range(9), k):
            n = sum(w for b, w in merged.items() if set(s) <= set(b))
            if n >= 8:
                assert max(m for f, m in found.items() if set(s) <= f) == n
