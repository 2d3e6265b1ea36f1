"""Digests of results in their order: equal sequences of rows have equal digests, with order and repetition.

A sequence's digest is its length and four polynomials of its rows' hashes over primes below 2^31. Those of two sequences give that of one
after the other, so each sorted range is folded where it lies and only one row a range is put together; nothing is gathered or sorted anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.results import canonical, result_digest

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1000003, 998244353, 1010101039, 479001599)
LANES = len(PRIMES)
HASHES = 2  # of a row, each for as many lanes: columns cost more on their way to Python than folding does
FOLDED = "part long, n long, " + ", ".join(f"h{i} long, p{i} long" for i in range(LANES))
#: Rows that a LIMIT may keep for each task to hold the first so many in memory; for more, all rows are sorted by ranges.
MOST_FIRST = 50_000


def is_ordered(result: DataFrame) -> bool:
    """Whether the query says the order of its result: a sort of all rows under no more than projections and limits."""
    plan = result._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "GlobalLimit", "LocalLimit", "Offset", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "Sort" and bool(getattr(plan, "global")())


def _is_short(result: DataFrame) -> bool:
    """Whether the query itself says that its result has few rows."""
    most = result._jdf.queryExecution().optimizedPlan().maxRows()
    return most.isDefined() and most.get() <= MOST_FIRST


def _hashes(rows: DataFrame, whole: set[str]) -> list[Column]:
    """Hashes of canonical rows, of which the columns ``whole`` were no fractions. Each value follows a mark of its kind, so that nulls, numbers and
    texts stay apart and in their places; numbers, texts and dates are hashed as they are, other kinds as JSON."""
    said = []
    for name, kind in rows.dtypes:
        c = F.col(name)
        mark = F.when(c.isNull(), 0).otherwise(1 if kind == "double" else 2)
        if kind == "double" and name not in whole:
            mark = F.when((c == 0) & (F.pow(c, F.lit(-1.0)) < 0), 3).otherwise(mark)  # -0.0, which the hash takes for 0.0
        said += [mark, c if kind in ("double", "string") else c.cast("string") if kind == "date" else F.when(c.isNotNull(), F.to_json(F.struct(c), {"ignoreNullFields": "false"}))]
    return [F.xxhash64(F.lit(i), *said).alias(f"l{i}") for i in range(HASHES)]


def _powers(n: int, lane: int) -> np.ndarray:
    """Powers of a lane's base from 0 on, by doubling."""
    out = np.ones(1, np.uint64)
    p = np.uint64(PRIMES[lane])
    while len(out) < n:
        step = pow(BASES[lane], len(out), PRIMES[lane])
        out = np.concatenate([out, out * np.uint64(step) % p])
    return out[:n]


def _fold(batches: Iterator[pa.RecordBatch], hashes: int = LANES) -> Iterator[pa.RecordBatch]:
    """One row of a partition's rows in their order: its number, count, and each lane's polynomial and power. The lanes share the columns of hashes."""
    n, state, powers = 0, [(0, 1)] * LANES, [np.zeros(0, np.uint64)] * LANES
    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        for lane in range(LANES):
            if len(powers[lane]) < m + 1:
                powers[lane] = _powers(m + 1, lane)
            prime, (value, power) = PRIMES[lane], state[lane]
            own = batch.column(lane * hashes // LANES).to_numpy().view(np.uint64) % np.uint64(prime)
            part = int((own * powers[lane][m - 1 :: -1][:m] % np.uint64(prime)).sum()) % prime
            step = int(powers[lane][m])
            state[lane] = ((value * step + part) % prime, power * step % prime)
        n += m
    if n:
        row = [TaskContext.get().partitionId(), n, *(x for pair in state for x in pair)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], [c.split()[0] for c in FOLDED.split(", ")])


def sequence_digest(result: DataFrame) -> DataFrame:
    """One row: digest, n_rows, n_columns, of the rows in the order of the result, which should be that of ``is_ordered``. Rows that a query's
    keys leave tied come in the engine's order."""
    rows = canonical(result)
    # Spark moves hashes below a LIMIT, where they part it from its sort, and then sorts all rows; a column that depends on the task stays above.
    whole = {c for c, (_, kind) in zip(rows.columns, result.dtypes, strict=True) if kind not in ("float", "double")}
    hashed = rows.select(*_hashes(rows, whole), *([F.spark_partition_id().alias("task")] if _is_short(result) else []))
    folded = hashed.mapInArrow(lambda batches: _fold(batches, HASHES), FOLDED)
    parts = folded.agg(F.sort_array(F.collect_list(F.struct("part", *[c.split()[0] for c in FOLDED.split(", ")[1:]]))).alias("parts"))  # one a range
    lane = lambda i: F.aggregate("parts", F.lit(0).cast("long"), lambda acc, x: (acc * x[f"p{i}"] + x[f"h{i}"]) % F.lit(PRIMES[i]).cast("long"))
    n_rows = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    made = parts.select(n_rows.alias("n_rows"), *[lane(i).cast("string").alias(f"h{i}") for i in range(LANES)])
    digest = F.sha2(F.concat_ws("|", F.lit("sequence"), F.col("n_rows").cast("string"), F.lit(len(result.columns)).cast("string"), *[f"h{i}" for i in range(LANES)]), 256)
    return made.select(digest.alias("digest"), "n_rows", F.lit(len(result.columns)).alias("n_columns"))


def ordered_digest(result: DataFrame) -> DataFrame:
    """The digest of the sequence where the query says its order, else of the multiset of rows."""
    return sequence_digest(result) if is_ordered(result) else result_digest(result, multiset=True)


def same_sequence(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results hold the same rows, as often and in the same order where both say one."""
    digest = sequence_digest if is_ordered(a) and is_ordered(b) else lambda x: result_digest(x, multiset=True)
    return digest(a).first()["digest"] == digest(b).first()["digest"]
