"""Compares a query with its SQL in DuckDB: names, row counts and values, in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return out


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v if v is None or isinstance(v, (str, bool, float)) else str(v)


def rows(names: list[str], got) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in got), key=repr)


def differences(frame, con, sql: str) -> str:
    mine = rows(frame.columns, frame.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows(names, cur.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows; {[r for r in mine if r not in theirs][:2]} {[r for r in theirs if r not in mine][:2]}"
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else ""
