"""Running, validating and comparing SQL text over registered tables, with limits in time."""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import InheritableThread, inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import results as R
from quarry.operators.sequences import ordered_digest
from quarry.plans.dialect import bridge, bridge_typed, clean  # noqa: F401  bridge is used by callers of this module


def known_columns(spark: SparkSession) -> set[str]:
    return {f.name.lower() for t in spark.catalog.listTables() if t.isTemporary for f in spark.table(t.name).schema.fields}


def frame(spark: SparkSession, sql: str, sqlite: bool = True) -> DataFrame:
    """The lazy result of a query, from the SQLite dialect by default."""
    if not sqlite:
        return spark.sql(sql)

    def analyzes(text: str) -> bool:
        try:  # EXPLAIN says in its text what is wrong, and runs nothing
            return not spark.sql(f"EXPLAIN {text}").first()[0].startswith("Error occurred")
        except AnalysisException:  # no SQL at all: running it will say so
            return False

    return spark.sql(bridge_typed(sql, known_columns(spark) if '"' in sql else None, analyzes))


def with_timeout(spark: SparkSession, work, timeout: float | None) -> Any:
    """Runs work() in a thread with a job tag of its own; its jobs are cancelled when time is up, which None never is."""
    tag, out = f"quarry-{uuid.uuid4().hex}", {}

    def run() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            out["value"] = work()
        except Exception as e:  # noqa: BLE001  handed to the caller's thread
            out["error"] = e

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(timeout)
    if thread.is_alive():
        spark.sparkContext.cancelJobsWithTag(tag)
        raise TimeoutError(f"no result after {timeout} s")
    if "error" in out:
        raise out["error"]
    return out["value"]


#: Rows that "all" takes to the driver unless more are asked for.
MOST_ROWS = 100_000


def run_sql(spark: SparkSession, sql: str, fetch: str | int = "all", timeout: float = 60, sqlite: bool = True, most: int | None = MOST_ROWS) -> Any:
    """Rows as tuples: "all", "one" (a tuple or None), "random" (one of the first ten) or at most n. "all" fails for results of over ``most`` rows, which
    belong in ``frame``; None lifts that."""
    if fetch not in ("all", "one", "random") and not isinstance(fetch, int):
        raise ValueError("fetch must be 'all', 'one', 'random' or a number")

    def work() -> Any:
        result = frame(spark, sql, sqlite)
        if fetch == "one":
            got = result.head(1)
            return tuple(got[0]) if got else None
        if fetch == "random":
            got = result.limit(10).orderBy(F.rand()).head(1)
            return tuple(got[0]) if got else None
        if isinstance(fetch, int):
            return [tuple(r) for r in result.head(fetch)]
        got = result.collect() if most is None else result.head(most + 1)
        if most is not None and len(got) > most:
            raise ValueError(f"the result has over {most} rows")
        return [tuple(r) for r in got]

    return with_timeout(spark, work, timeout)


def retried(spark: SparkSession, work, timeouts: tuple[float, ...] = (3, 5)) -> Any:
    """work() under growing limits; its own errors are raised at once."""
    for i, t in enumerate(timeouts):
        try:
            return with_timeout(spark, work, t)
        except TimeoutError:
            if i + 1 == len(timeouts):
                raise
    raise TimeoutError


@dataclass
class Verdict:
    exec_res: int
    exec_err: str


def compare_sql(spark: SparkSession, predicted: str, gold: str, timeout: float = 30) -> Verdict:
    """Whether two queries give the same set of rows: 1 and "--", or 0 and the reason."""
    try:
        same = with_timeout(spark, lambda: R.same_result(frame(spark, clean(predicted)), frame(spark, gold)), timeout)
    except TimeoutError:
        return Verdict(0, "timeout")
    except Exception as e:  # noqa: BLE001  any failure of a predicted query is an outcome
        return Verdict(0, str(e).splitlines()[0][:500])
    return Verdict(1, "--") if same else Verdict(0, "incorrect answer")


def validate_sql(spark: SparkSession, sql: str, rows: int = 30, timeout: float = 60) -> dict[str, Any]:
    try:
        return {"SQL": sql, "RESULT": run_sql(spark, sql, rows, timeout), "STATUS": "OK"}
    except Exception as e:  # noqa: BLE001
        return {"SQL": sql, "RESULT": str(e).splitlines()[0], "STATUS": "ERROR"}


def execution_status(spark: SparkSession, sql: str, timeout: float = 60, strict: bool = False) -> str:
    """The status of a query, from at most two rows and one aggregate."""
    try:
        result = frame(spark, sql)
        some = with_timeout(spark, lambda: [tuple(r) for r in result.head(2)], timeout)
        is_count = bool(re.match(r"(?is)\s*select\s+count\s*\(", sql))
        all_null = False
        if strict and some and all(v is None for r in some for v in r):
            set_ = [F.col(f"`{c}`").isNotNull() for c in result.toDF(*[f"c{i}" for i in range(len(result.columns))]).columns]
            named = result.toDF(*[f"c{i}" for i in range(len(result.columns))])
            any_set = set_[0]
            for s in set_[1:]:
                any_set = any_set | s
            all_null = with_timeout(spark, lambda: named.where(any_set).isEmpty(), timeout)
    except Exception:  # noqa: BLE001
        return R.WRONG
    return R.status(len(some), len(result.columns), some[0] if some else None, is_count, all_null, strict)


def execute_all(spark: SparkSession, candidates: list[tuple[int, int, str]], timeout: float | None = 60, known: dict[str, tuple] | None = None, ordered: bool = False, threads: int = 1) -> DataFrame:
    """question_id, ord, sql, digest, n_rows, status, error of candidate queries: (question_id, ord, sql). ``ordered``: results count as sequences
    where their query says an order and as multisets elsewhere, not as sets. ``threads`` texts run at a time, each under the limit of its own.

    ``known`` keeps outcomes by the query's text, so that a text runs once however many candidates and stages have it; what ran
    out of time is not kept.
    """
    known = {} if known is None else known

    def outcome(sql: str) -> tuple:
        try:
            result = frame(spark, sql)
            digest, n, _ = with_timeout(spark, lambda: (ordered_digest if ordered else R.result_digest)(result).first(), timeout)
            return digest, n, R.status(n), None
        except TimeoutError as e:
            return None, None, R.WRONG, str(e)[:500]
        except Exception as e:  # noqa: BLE001
            return None, None, R.WRONG, (str(e) or type(e).__name__).splitlines()[0][:500]

    def once(sql: str) -> tuple:
        got = known.get(sql) or outcome(sql)
        if not (got[3] or "").startswith("no result after"):
            known[sql] = got
        return got

    texts = list(dict.fromkeys(sql for _, _, sql in candidates))  # one Spark job a text: the queries are few, their results stay distributed
    if threads > 1 and len(texts) > 1:
        with ThreadPoolExecutor(min(threads, len(texts))) as pool:
            runs = [pool.submit(inheritable_thread_target(spark)(once), sql) for sql in texts]
        got = {sql: run.result() for sql, run in zip(texts, runs, strict=True)}
    else:
        got = {sql: once(sql) for sql in texts}
    rows = [(question_id, ord_, sql, *got[sql]) for question_id, ord_, sql in candidates]
    return spark.createDataFrame(rows, "question_id long, ord int, sql string, digest string, n_rows long, status string, error string")


def aggregate_sqls(spark: SparkSession, sqls: list[str], timeout: float = 60, ordered: bool = False) -> str:
    """The shortest query of those whose result most of them give; the first one if all fail."""
    if not sqls:
        raise ValueError("no queries")
    return R.majority_vote(execute_all(spark, [(0, i, s) for i, s in enumerate(sqls)], timeout, ordered=ordered)).first()["sql"]
