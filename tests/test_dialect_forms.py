"""Forms of the SQLite dialect whose meaning hangs on types or on the SELECT list."""

import sqlite3

import pytest

from quarry.plans import sqlrun
from quarry.plans.dialect import bridge

ROWS = [(1, 7, 2.5, "a", None), (2, -7, 0.5, "B", 3), (3, 0, None, "b", 4), (4, 9007199254740995, 1e10, "hello", 2)]


@pytest.fixture(scope="module")
def both(spark):
    spark.createDataFrame(ROWS, "id long, n long, x double, s string, m int").createOrReplaceTempView("forms")
    con = sqlite3.connect(":memory:")
    con.execute("create table forms(id integer, n integer, x real, s text, m integer)")
    con.executemany("insert into forms values (?, ?, ?, ?, ?)", ROWS)
    return lambda sql: (sorted((tuple(r) for r in sqlrun.frame(spark, sql).collect()), key=repr), sorted(con.execute(sql).fetchall(), key=repr))


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT id, n / 2, n / 2.0, n % 3, x / 2, n / m, (n + 1) / (m - 2) FROM forms", "SELECT SUM(n) / COUNT(*), COUNT(*) / 3, AVG(m) / 2 FROM forms WHERE id < 4", "SELECT 7 / 2, -7 / 2, 7 / (6 / 2), 7 / 2 / 2, 7.0 / 2, 7 % 0",
        "SELECT id, 5.5 % 2, ROUND(x), ROUND(x, 1), ROUND(n) FROM forms WHERE id < 4", "SELECT 1.0 * 10 / 4, 1e2 / 8, .5 + 1", "SELECT id FROM forms ORDER BY id LIMIT 1, 2", "SELECT id FROM forms WHERE m IS NOT 3", "SELECT id FROM forms WHERE m IS 3",
        "SELECT id, m IS NULL, m IS NOT NULL FROM forms WHERE s IS 'a' OR s IS NOT 'B'", "SELECT id FROM forms WHERE s = 'b' COLLATE NOCASE", "SELECT UNICODE('é'), UNICODE('abc'), UNICODE('')", "SELECT id, QUOTE(s || '''x'), QUOTE(n), QUOTE(m) FROM forms",
        "SELECT SUBSTR('hello', 0, 3), SUBSTR('hello', 0), SUBSTR('hello', 2, 3), SUBSTR('hello', -3, 2), SUBSTR('hello', -7, 3), SUBSTR(s, id - 1, 2) FROM forms", "SELECT s, MAX(n) FROM forms", "SELECT id, MIN(x) AS least FROM forms WHERE x IS NOT NULL",
        "SELECT id % 2 AS odd, s, MAX(n) FROM forms GROUP BY id % 2", "SELECT id % 2 AS odd, s AS named, MIN(n), COUNT(*) FROM forms GROUP BY 1", "SELECT t.s, MAX(t.n) AS most FROM (SELECT * FROM forms WHERE id < 3) AS t", "SELECT id, (SELECT COUNT(*) FROM forms) AS every FROM forms",
        "SELECT s, COUNT(*) FROM forms GROUP BY s", "SELECT id, n FROM forms GROUP BY id", "SELECT id, MAX(n) OVER (ORDER BY id) FROM forms", "SELECT DISTINCT m FROM forms UNION SELECT MAX(m) FROM forms",
    ],
)
def test_as_sqlite(both, sql):
    mine, theirs = both(sql)
    as_number = lambda rows: [tuple(int(v) if isinstance(v, bool) else v for v in r) for r in rows]
    assert sorted(as_number(mine), key=repr) == theirs


def test_division_keeps_its_type(spark, both):
    kinds = dict(sqlrun.frame(spark, "SELECT n / 2 AS a, n / 2.0 AS b, n % 2 AS c, x % 2 AS d, n / m / 2 AS e, n / (x / 2) AS f FROM forms").dtypes)
    assert kinds == {"a": "bigint", "b": "double", "c": "bigint", "d": "double", "e": "bigint", "f": "double"}


def test_texts_that_stay():
    for sql in ("SELECT a, b FROM t", "SELECT * FROM t", "SELECT t.* FROM t GROUP BY a", "SELECT a FROM t WHERE b IS NOT NULL LIMIT 5"):
        assert bridge(sql) == sql
    assert bridge("SELECT a, MAX(b), MIN(b) FROM t") == "SELECT any_value(a) AS a, MAX(b), MIN(b) FROM t"


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT j.id, e.key, e.value, e.type FROM jsons AS j, json_each(j.doc) AS e", "SELECT j.id, e.value FROM jsons j, json_each(j.doc, '$.items') e WHERE e.key <> 0", "SELECT COUNT(*) FROM jsons AS j JOIN json_each(j.doc, '$.items') AS e",
        "SELECT j.id, COUNT(*) AS n, MAX(json_extract(e.value, '$.q')) FROM jsons AS j, json_each(j.doc, '$.items') AS e GROUP BY j.id", "SELECT x.key, x.value FROM json_each('[3, 4]') AS x",
    ],
)
def test_json_each(spark, sql):
    docs = [(1, '{"a": 1, "b": "x", "c": null, "d": true, "e": 2.5}'), (2, '{"items": [{"q": 5}, {"q": 7, "z": [1]}, 3]}'), (3, "[10, [20], {}]"), (4, None), (5, '{"items": []}')]
    spark.createDataFrame(docs, "id int, doc string").createOrReplaceTempView("jsons")
    con = sqlite3.connect(":memory:")
    con.execute("create table jsons(id integer, doc text)")
    con.executemany("insert into jsons values (?, ?)", docs)
    theirs = [tuple({"true": 1, "false": 0}.get(v, v) if i == 2 else v for i, v in enumerate(r)) for r in con.execute(sql).fetchall()]
    mine = [tuple({"true": "1", "false": "0"}.get(v, v) if i == 2 else v for i, v in enumerate(r)) for r in map(tuple, sqlrun.frame(spark, sql).collect())]
    key = lambda r: tuple("" if v is None else v for v in r)
    assert sorted(map(tuple, ([None if v is None else str(v).replace(" ", "") for v in r] for r in mine)), key=key) == sorted(map(tuple, ([None if v is None else str(v).replace(" ", "") for v in r] for r in theirs)), key=key)
