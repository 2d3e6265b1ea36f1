"""Operators on query results and candidates: equality, digests, clusters, votes, status, scores, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CORRECT, EMPTY, WRONG, NONE, ZERO, ALL_NONE = "SYNTACTICALLY_CORRECT", "EMPTY_RESULT", "SYNTACTICALLY_INCORRECT", "NONE_RESULT", "ZERO_COUNT_RESULT", "ALL_NONE_RESULT"
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def canonical(result: DataFrame) -> DataFrame:
    """A result with positional names and numbers widened, so that 1 equals 1.0 and names do not matter; '1' stays text."""
    made = []
    for i, (_, kind) in enumerate(result.dtypes):
        c = F.col(f"c{i}")
        made.append((c.cast("double") if kind in _NUMBERS or kind.startswith("decimal") or kind == "boolean" else c).alias(f"c{i}"))
    return result.toDF(*[f"c{i}" for i in range(len(result.columns))]).select(*made)


def same_result(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results hold the same set of rows, whatever their order, repetition and names; two empty ones are equal."""
    if len(a.columns) != len(b.columns):
        return a.isEmpty() and b.isEmpty()
    x, y = canonical(a), canonical(b)
    if [k for _, k in x.dtypes] != [k for _, k in y.dtypes]:
        return a.isEmpty() and b.isEmpty()
    return x.subtract(y).isEmpty() and y.subtract(x).isEmpty()


def result_digest(result: DataFrame, multiset: bool = False) -> DataFrame:
    """One row: digest, n_rows, n_columns. Equal sets (or multisets) of rows have equal digests.

    The rows' digests are summed, not gathered, so a large result costs one small aggregation.
    """
    rows = canonical(result)
    if not multiset:
        rows = rows.distinct()
    row = F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256) if rows.columns else F.lit("")
    part = lambda i: F.coalesce(F.sum(F.conv(F.substr("h", F.lit(1 + 15 * i), F.lit(15)), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    made = rows.select(row.alias("h")).agg(F.count("*").alias("n_rows"), *[part(i).alias(f"p{i}") for i in range(4)])
    return made.select(F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), "p0", "p1", "p2", "p3"), 256).alias("digest"), "n_rows", F.lit(len(result.columns)).alias("n_columns"))


def clusters(executed: DataFrame, errors_together: bool = True) -> DataFrame:
    """``executed``: question_id, ord, sql, digest, error. Adds cluster_size and cluster_first (the smallest ord of the cluster).

    Failed queries form one cluster, or none of their own if they are to be left out.
    """
    kept = executed if errors_together else executed.where("error is null")
    key = F.when(F.col("error").isNotNull(), "error").otherwise(F.col("digest"))
    by = Window.partitionBy("question_id", "_cluster")
    return kept.withColumn("_cluster", key).withColumn("cluster_size", F.count("*").over(by)).withColumn("cluster_first", F.min("ord").over(by)).withColumnRenamed("_cluster", "cluster")


def majority_vote(executed: DataFrame, shortest: bool = True) -> DataFrame:
    """question_id, sql, ord, cluster_size: from the largest cluster (the first met on ties) the shortest query, or its first.

    Where every query failed, the first one.
    """
    sized = clusters(executed).withColumn("_ok", F.col("error").isNull())
    order = [F.col("_ok").desc(), F.when(F.col("_ok"), F.col("cluster_size")).otherwise(0).desc(), F.when(F.col("_ok"), F.col("cluster_first")).otherwise(0)]
    order += [F.when(F.col("_ok"), F.length("sql")).otherwise(0)] if shortest else []
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(*order, "ord"))
    return sized.withColumn("_n", rank).where("_n = 1").select("question_id", "ord", "sql", "cluster_size")


def status(n_rows: int | None, n_columns: int = 0, first: tuple | None = None, is_count: bool = False, all_null: bool = False, strict: bool = False) -> str:
    """The status of an execution; n_rows is None if it failed. Unless strict, only the three of the live rule."""
    if n_rows is None:
        return WRONG
    if n_rows == 0:
        return EMPTY
    if strict:
        if n_rows == 1 and first is not None and first[0] is None:
            return NONE
        if n_rows == 1 and n_columns == 1 and first is not None and first[0] == 0 and is_count:
            return ZERO
        if all_null:
            return ALL_NONE
    return CORRECT


def need_fixing(executed: DataFrame) -> DataFrame:
    return executed.withColumn("need_fixing", (F.col("status") != CORRECT) | F.col("error").isNotNull())


def keep_valid_revisions(revised: DataFrame) -> DataFrame:
    """``revised``: sql, revision. The revision where it is a query, else what was there."""
    return revised.withColumn("sql", F.when(F.upper("revision").contains("SELECT"), F.col("revision")).otherwise(F.col("sql"))).drop("revision")


def final_by_ladder(executed: DataFrame) -> DataFrame:
    """``executed``: question_id, step, sql, status. The last correct query after the first, else the last with a zero count, else the first."""
    score = F.when(F.col("status") == CORRECT, 2).when(F.col("status") == ZERO, 1).otherwise(0)
    place = F.when(score > 0, F.col("step")).otherwise(-F.col("step"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(score.desc(), place.desc()))
    return executed.withColumn("_n", rank).where("_n = 1").select("question_id", "step", "sql", "status")


def final_by_stage(evaluated: DataFrame) -> DataFrame:
    """``evaluated``: question_id, stage_ord, stage, sql, exec_err. The last stage that did not fail, else the last."""
    failed = F.col("exec_err").isNotNull() & ~F.col("exec_err").isin("--", "incorrect answer")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(failed.cast("int"), F.col("stage_ord").desc()))
    return evaluated.withColumn("_n", rank).where("_n = 1").select("question_id", "stage", "sql", "exec_err")


def pick_by_scores(scores: DataFrame, executed: DataFrame) -> DataFrame:
    """``scores``: question_id, test, ord, passed. The candidate that passes most tests; of equal ones the first in the largest cluster."""
    summed = scores.groupBy("question_id", "ord").agg(F.sum("passed").alias("n_passed"))
    joined = summed.join(clusters(executed).select("question_id", "ord", "sql", "cluster_size", "cluster_first"), ["question_id", "ord"])
    best = F.max("n_passed").over(Window.partitionBy("question_id"))
    tied = joined.withColumn("_best", best).where("n_passed = _best")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("cluster_size").desc(), "cluster_first", "ord"))
    return tied.withColumn("_n", rank).where("_n = 1").select("question_id", "ord", "sql", "n_passed")


def telling_tests(scores: DataFrame, executed: DataFrame) -> DataFrame:
    """question_id, test of the tests on which all members of each cluster agree and clusters differ."""
    member = scores.join(clusters(executed).select("question_id", "ord", "cluster"), ["question_id", "ord"])
    within = member.groupBy("question_id", "test", "cluster").agg(F.min("passed").alias("lo"), F.max("passed").alias("hi"))
    agreed = within.groupBy("question_id", "test").agg(F.max(F.col("hi") - F.col("lo")).alias("spread"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return agreed.where("spread = 0 and lo < hi").select("question_id", "test")


def statistics(evaluated: DataFrame) -> DataFrame:
    """``evaluated``: stage, db_id, question_id, exec_res, exec_err. Counts and sorted ids of correct, incorrect and failed, by stage."""
    outcome = F.when(F.col("exec_res") == 1, "correct").when(F.col("exec_err") == "incorrect answer", "incorrect").otherwise("error")
    pair = F.concat_ws("/", "db_id", F.lpad(F.col("question_id").cast("string"), 12, "0"))
    made = evaluated.withColumn("outcome", outcome).withColumn("_id", pair)
    counted = made.groupBy("stage").agg(
        *[F.sum(F.when(F.col("outcome") == o, 1).otherwise(0)).alias(f"n_{o}") for o in ("correct", "incorrect", "error")], F.count("*").alias("total"),
        *[F.array_sort(F.collect_list(F.when(F.col("outcome") == o, F.col("_id")))).alias(f"{o}_ids") for o in ("correct", "incorrect", "error")],
    )
    return counted.withColumn("accuracy", F.round(F.col("n_correct") / F.col("total"), 6))


def outcomes(evaluated: DataFrame) -> DataFrame:
    """stage, outcome (correct, incorrect or error) and id (database/question) of every evaluation, as rows for runs of any size."""
    outcome = F.when(F.col("exec_res") == 1, "correct").when(F.col("exec_err") == "incorrect answer", "incorrect").otherwise("error")
    return evaluated.select("stage", outcome.alias("outcome"), F.concat_ws("/", "db_id", F.col("question_id").cast("string")).alias("id"))


def rendered(result: DataFrame, rows: int = 20) -> str:
    """Row and column counts and the first rows, as text for a prompt."""
    shown = [tuple(r) for r in result.limit(rows).collect()]
    return f"Rows: {result.count()}, Columns: {len(result.columns)}, Results: {shown}"


def consecutive_pairs(steps: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Each step's value with the next one's, for every step that has a next."""
    line = Window.partitionBy(*by).orderBy(order)
    return steps.withColumn("next_" + value, F.lead(value).over(line)).where(F.col("next_" + value).isNotNull())
