"""Keys and references found in data, against brute force."""

import itertools
import random

import pytest

from quarry.operators import keys
from quarry.sources.catalog import Catalog, Constraints


def brute_sets(rows, names, most):
    found = []
    for size in range(1, most + 1):
        for own in itertools.combinations(range(len(names)), size):
            values = [tuple(r[i] for i in own) for r in rows]
            if rows and not any(None in v for v in values) and len(set(values)) == len(rows) and not any(set(k) <= set(own) for k in found):
                found.append(own)
    return [tuple(names[i] for i in own) for own in found]


@pytest.mark.parametrize("few", [keys.FEW_ROWS, 5])
def test_unique_sets(spark, monkeypatch, few):
    monkeypatch.setattr(keys, "FEW_ROWS", few)  # counted at once, or sketched first
    r = random.Random(1)
    names = ["a", "b", "c", "d", "e"]
    for n, tops in ((0, (3,) * 5), (1, (3,) * 5), (30, (6, 6, 40, 3, 9)), (200, (20, 20, 20, 400, 2)), (200, (15, 15, 9, 9, 9))):
        rows = [tuple(None if k == 4 and r.random() < 0.02 else r.randrange(t) for k, t in enumerate(tops)) for _ in range(n)]
        rows = [(*x[:3], i // 2 if n == 200 else x[3], x[4]) for i, x in enumerate(rows)]
        frame = spark.createDataFrame(rows, "a int, b int, c int, d int, e int")
        for most in (1, 2, 3):
            assert keys.unique_sets(frame, most) == brute_sets(rows, names, most)


def test_repeated_rows_and_odd_types(spark):
    frame = spark.createDataFrame([(1, [1], "x"), (1, [1], "x")], "a int, l array<int>, s string")
    assert keys.unique_sets(frame) == []
    assert keys.unique_sets(frame.select("l")) == []


def test_references(spark, tmp_path):
    people = [(i, f"name{i % 40}", i % 5) for i in range(50)]
    visits = [(i, i % 17, "name3", None if i % 3 else 2) for i in range(60)]
    kinds = [(k, f"k{k}") for k in range(6)]
    spark.createDataFrame(people, "p_id int, p_name string, p_kind int").write.parquet(f"{tmp_path}/people.parquet")
    spark.createDataFrame(visits, "visit long, v_id long, v_name string, v_kind int").write.parquet(f"{tmp_path}/visits.parquet")
    spark.createDataFrame(kinds, "kind int, label string").write.parquet(f"{tmp_path}/kinds.parquet")
    spark.createDataFrame([], "k_id int, none string").write.parquet(f"{tmp_path}/nothing.parquet")
    c = Catalog(spark, str(tmp_path), ("people", "visits", "kinds", "nothing"), Constraints())
    found = {tuple(r) for r in keys.discovered_references(c).collect()}
    assert ("visits", "v_id", "people", "p_id", 17) in found
    assert ("people", "p_kind", "kinds", "kind", 5) in found
    assert ("visits", "v_kind", "kinds", "kind", 1) in found
    assert not any(r[2] == "people" and r[3] == "p_name" for r in found)  # names repeat there
    assert not any("nothing" in r for r in found)
    data = {(t, col): {r[i] for r in rows if r[i] is not None} for t, cols, rows in (("people", ("p_id", "p_name", "p_kind"), people), ("visits", ("visit", "v_id", "v_name", "v_kind"), visits), ("kinds", ("kind", "label"), kinds)) for i, col in enumerate(cols)}
    single = {("people", "p_id"), ("visits", "visit"), ("kinds", "kind"), ("kinds", "label")}
    want = {(*a, *b, len(x)) for a, x in data.items() for b, y in data.items() if a != b and b in single and x and x <= y}
    assert found == want
    made = keys.with_discovered_keys(c)
    assert made.constraints.primary == {"people": ("p_id",), "visits": ("visit",), "kinds": ("kind",)}
    assert ("visits", "v_id", "people", "p_id") in made.constraints.foreign
    assert [r["n_orphans"] for r in made.orphans().collect()] == [0] * len(made.constraints.foreign)
    assert "PRIMARY KEY (`p_id`)" in made.ddl("people")
