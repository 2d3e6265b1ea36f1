"""Joins by time: the last row before (as-of), and rows within intervals.

Neither ever puts the rows of one key into one task only because they share the key. An as-of join is a union of both sides in the order of
time with the last right row carried forward; keys with a large share of all rows are cut into ranges of time of about equal size, and what
the ranges before hold is carried into each. An interval join meets on bins of time as wide as the interval, in levels of widths, so that
each interval lies in two bins at most; bins with many rows are split.

Defined cases: a null key or a null time matches nothing; two right rows of one key and time are told apart by ``ties``; an interval that ends
before or when it starts holds nothing; empty sides give what the kind of join says; columns of both sides that share a name are refused.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key or bin with at least this share of all rows, and this many, is split; so there are at most SHARE of them, which bounds what is broadcast.
SHARE, LEAST_HOT = 256, 10_000
PIECES = 64
#: Widths of bins grow by this factor from level to level.
STEP = 8
LEVELS = 24


def _number(frame: DataFrame, column: str) -> Column:
    """A time as a number: microseconds, or the value of a numeric column."""
    kind = frame.schema[column].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)")
    if kind == "timestamp":
        return F.unix_micros(column)
    if kind == "date":
        return F.unix_date(F.col(column)).cast("long") * 86_400_000_000
    return F.col(column).cast("double" if kind in ("double", "float", "decimal") else "long")


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _refuse_clashes(left: DataFrame, right: DataFrame, on: list[str]) -> list[str]:
    added = [c for c in right.columns if c not in on]
    taken = {c.lower() for c in left.columns}
    if clash := [c for c in added if c.lower() in taken]:
        raise ValueError(f"both sides have {', '.join(clash)}; rename one")
    return added


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, ties: list[str] | None = None, how: str = "left", strict: bool = False, hot_rows: int | None = None) -> DataFrame:
    """Each left row with the last right row of its key at or before its time (``strict``: before it): the left columns, then the right ones
    other than the key, null where there is none. ``how="inner"`` leaves such rows out."""
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    added, ties = _refuse_clashes(left, right, on), ties or []
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(on)]
    names = [f"_k{i}" for i in range(len(on))]
    matchable = _all(F.col(c).isNotNull() for c in [*on, left_time])
    usable = _all(F.col(c).isNotNull() for c in [*on, right_time])
    # Of one moment, right rows come before left ones, or after them where only earlier ones count.
    l_side = left.where(matchable).select(*keys, F.col(left_time).alias("_t"), _number(left, left_time).cast("double").alias("_x"), F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_l"))
    r_side = right.where(usable).select(*keys, F.col(right_time).alias("_t"), _number(right, right_time).cast("double").alias("_x"), F.lit(1 if strict else 0).alias("_side"), F.struct(*added).alias("_r"), F.struct(*ties, F.lit(0).alias("_")).alias("_tie"))
    both = l_side.unionByName(r_side, allowMissingColumns=True)
    counted = both.groupBy(*names).agg(F.count("*").alias("_n"))
    total = counted.agg(F.sum("_n")).first()[0] or 0
    least = max(LEAST_HOT, total // SHARE) if hot_rows is None else hot_rows
    hot = counted.where(F.col("_n") >= least).select(*names)
    cuts = [i / PIECES for i in range(1, PIECES)]
    edges = both.join(F.broadcast(hot), names).groupBy(*names).agg(F.array_distinct(F.percentile_approx("_x", cuts, 10_000)).alias("_edges"))
    # At most SHARE rows of PIECES numbers, fixed here: the cuts are estimates, which another evaluation may give otherwise, and all steps must have the same.
    edges = left.sparkSession.createDataFrame(edges.collect(), edges.schema)
    # Every row of a moment falls into one range, so ties stay together.
    range_of = F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col("_x"))), F.lit(0)).alias("_range")
    dealt = both.join(F.broadcast(edges), names, "left").select("*", range_of)
    order = [F.col("_t"), F.col("_side"), F.col("_tie")]
    found = F.last("_r", ignorenulls=True).over(Window.partitionBy(*names, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # What the ranges before hold: one row a hot key and range.
    lasts = dealt.where("_edges is not null and _r is not null").groupBy(*names, "_range").agg(F.max_by("_r", F.struct("_t", "_tie")).alias("_last"))
    every = edges.select(*names, F.explode(F.sequence(F.lit(0), F.size("_edges"))).alias("_range"))
    before = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.join(lasts, [*names, "_range"], "left").select(*names, "_range", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    met = dealt.withColumn("_found", found).where("_l is not null").join(F.broadcast(carried), [*names, "_range"], "left")
    met = met.select("_l.*", F.coalesce("_found", "_carried").alias("_m"))
    out = met.select(*left.columns, *[F.col(f"_m.`{c}`").alias(c) for c in added])
    if how == "inner":
        return met.where("_m is not null").select(*left.columns, *[F.col(f"_m.`{c}`").alias(c) for c in added])
    rest = left.where(~F.coalesce(matchable, F.lit(False)))
    return out.unionByName(rest.select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in added]))


def interval_join(intervals: DataFrame, points: DataFrame, on: list[str], start: str, end: str, at: str, hot_rows: int | None = None) -> DataFrame:
    """Each interval with every point of its key in [start, end): the intervals' columns, then the points' other than the key.

    An interval belongs to the level whose bins are at least as wide as it is, and to the one or two bins there that it touches; a point is in
    one bin of each level that any interval has. Bins with many points deal them out, and their intervals visit each part.
    """
    added = _refuse_clashes(intervals, points, on)
    names = [f"_k{i}" for i in range(len(on))]
    keys = [F.col(c).alias(n) for c, n in zip(on, names, strict=True)]
    x, y, t = _number(intervals, start), _number(intervals, end), _number(points, at)
    held = intervals.where(_all(F.col(c).isNotNull() for c in on) & (y > x)).select(*keys, x.cast("double").alias("_x"), y.cast("double").alias("_y"), F.struct(*intervals.columns).alias("_i"))
    least = held.agg(F.percentile_approx(F.col("_y") - F.col("_x"), 0.25)).first()[0]
    unit = max(float(least or 1), 1e-9)  # the finest bins are as wide as a short interval
    width = lambda level: F.lit(unit) * F.pow(F.lit(float(STEP)), level)
    level = F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log(float(STEP), (F.col("_y") - F.col("_x")) / unit) - 1e-9))).cast("int")
    leveled = held.withColumn("_level", level)
    levels = sorted(r[0] for r in leveled.select("_level").distinct().collect())  # at most LEVELS + 1
    first, last = (F.floor(F.col(c) / width(F.col("_level"))).cast("long") for c in ("_x", "_y"))
    touched = leveled.withColumn("_bin", F.explode(F.sequence(first, last)))
    placed = points.where(_all(F.col(c).isNotNull() for c in [*on, at])).select(*keys, t.cast("double").alias("_t"), F.struct(*points.columns).alias("_p"))
    placed = placed.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>"))).withColumn("_bin", F.floor(F.col("_t") / width(F.col("_level"))).cast("long"))
    where = [*names, "_level", "_bin"]
    counted = placed.groupBy(*where).agg(F.count("*").alias("_n"))
    total = counted.agg(F.sum("_n")).first()[0] or 0
    most = max(LEAST_HOT, total // SHARE) if hot_rows is None else hot_rows
    hot = F.broadcast(counted.where(F.col("_n") > most).select(*where, F.ceil(F.col("_n") / most).cast("int").alias("_parts")))  # at most SHARE
    parts = F.coalesce("_parts", F.lit(1))
    dealt = placed.join(hot, where, "left").select(*where, "_t", "_p", F.pmod(F.xxhash64("_p"), parts).cast("int").alias("_part"))
    visits = touched.join(hot, where, "left").select(*where, "_x", "_y", "_i", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    met = visits.join(dealt, [*where, "_part"]).where("_t >= _x and _t < _y")
    return met.select("_i.*", *[F.col(f"_p.`{c}`").alias(c) for c in added])


def interval_counts(intervals: DataFrame, points: DataFrame, on: list[str], by: str, start: str, end: str, at: str, ident: str, width: int) -> DataFrame:
    """What ``interval_join`` grouped by ``by`` counts: by, n_rows, n_distinct (of ``ident``), first_at, last_at of the points in each group's intervals.

    A group of one interval of ``width`` (in the unit of the times, microseconds for timestamps) needs no pairs: the points before its end less those before its
    start are counted, and likewise distinct ones, less the pairs of following points of one ``ident`` that lie in it (no such pair spans it, where only
    pairs less than ``width`` apart are counted). So work grows with the rows. Groups of several intervals, or of other widths, are joined and counted.
    """
    _refuse_clashes(intervals, points, on)
    names = [f"_k{i}" for i in range(len(on))]
    keys = [F.col(c).alias(n) for c, n in zip(on, names, strict=True)]
    kept = intervals.select(*dict.fromkeys([by, *on, start, end]))
    kept = kept.withColumn("_wide", _number(kept, end) - _number(kept, start))
    groups = kept.groupBy(by).agg(F.count("*").alias("_n"), F.first(F.struct(*kept.columns)).alias("_i"))
    plain = (F.col("_n") == 1) & F.coalesce(F.col("_i._wide") == width, F.lit(False))
    single, rest = groups.where(plain).select("_i.*"), groups.where(~plain).select(F.col(by).alias("_by"))
    joined = interval_join(intervals.join(rest, F.col(by).eqNullSafe(F.col("_by")), "left_semi"), points, on, start, end, at)
    joined = joined.groupBy(by).agg(F.count("*").alias("n_rows"), F.countDistinct(ident).alias("n_distinct"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))

    held = single.where(_all(F.col(c).isNotNull() for c in on))
    probe = lambda column, sign: held.select(*keys, _number(held, column).alias("_x"), F.lit(0).alias("_side"), F.lit(sign).alias("_sign"), F.col(by).alias("_by"))
    placed = points.where(_all(F.col(c).isNotNull() for c in [*on, at])).select(*keys, _number(points, at).alias("_x"), F.lit(1).alias("_side"), F.col(at).alias("_at"), F.col(ident).alias("_id"))
    known = placed.where("_id is not null")
    follow = Window.partitionBy(*names, "_id").orderBy("_x")
    near = lambda gap: F.coalesce((gap < width).cast("long"), F.lit(0).cast("long"))
    known = known.withColumn("_ends", near(F.col("_x") - F.lag("_x").over(follow))).withColumn("_begins", near(F.lead("_x").over(follow) - F.col("_x")))
    placed = known.unionByName(placed.where("_id is null"), allowMissingColumns=True).select(*names, "_x", "_side", "_at", F.col("_id").isNotNull().cast("long").alias("_known"), "_ends", "_begins")
    both = probe(start, -1).unionByName(probe(end, 1)).unionByName(placed, allowMissingColumns=True)
    # Hot keys are cut into ranges of time, with the sums of the ranges before and the first point of those after.
    counted = both.groupBy(*names).agg(F.count("*").alias("_n"))
    total = counted.agg(F.sum("_n")).first()[0] or 0
    hot = counted.where(F.col("_n") >= max(LEAST_HOT, total // SHARE)).select(*names)
    cuts = [i / PIECES for i in range(1, PIECES)]
    edges = both.join(F.broadcast(hot), names).groupBy(*names).agg(F.array_distinct(F.percentile_approx("_x", cuts, 10_000)).alias("_edges"))
    edges = points.sparkSession.createDataFrame(edges.collect(), edges.schema)  # at most SHARE rows, fixed here as in asof_join
    range_of = F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col("_x"))), F.lit(0)).alias("_range")
    dealt = both.join(F.broadcast(edges), names, "left").select("*", range_of)
    sums = lambda: [F.count("_at").alias("_rows"), F.sum("_known").alias("_knowns"), F.sum("_ends").alias("_ended"), F.sum("_begins").alias("_begun"), F.max("_at").alias("_last")]
    parts = dealt.where("_edges is not null and _at is not null").groupBy(*names, "_range").agg(*sums(), F.min("_at").alias("_first"))
    every = edges.select(*names, F.explode(F.sequence(F.lit(0), F.size("_edges"))).alias("_range")).join(parts, [*names, "_range"], "left")
    whole = Window.partitionBy(*names)
    past, later = (whole.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("_range"), F.col("_range").desc()))
    numbers = ["_rows", "_knowns", "_ended", "_begun"]
    carried = every.select(*names, "_range", *[F.sum(c).over(past).alias(f"{c}_past") for c in numbers], F.max("_last").over(past).alias("_last_past"), F.min("_first").over(later).alias("_first_later"))
    own = Window.partitionBy(*names, "_range")
    upward = own.orderBy("_x", "_side").rowsBetween(Window.unboundedPreceding, 0)
    downward = own.orderBy(F.col("_x").desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = dealt.select(*names, "_range", "_sign", "_by", *[F.coalesce(c.over(upward), F.lit(0)).alias(n) for c, n in zip((F.count("_at"), F.sum("_known"), F.sum("_ends"), F.sum("_begins")), numbers, strict=True)], F.max("_at").over(upward).alias("_last"), F.min("_at").over(downward).alias("_first"))
    seen = seen.where("_sign is not null").join(F.broadcast(carried), [*names, "_range"], "left")
    upto = lambda c: F.col(c) + F.coalesce(f"{c}_past", F.lit(0))
    ends = F.col("_sign") == 1
    found = seen.groupBy(F.col("_by").alias(by)).agg(
        F.sum(F.col("_sign") * upto("_rows")).alias("n_rows"),
        F.sum(F.col("_sign") * upto("_knowns") + F.when(ends, -upto("_ended")).otherwise(upto("_begun"))).alias("n_distinct"),
        F.max(F.when(~ends, F.coalesce("_first", "_first_later"))).alias("first_at"), F.max(F.when(ends, F.coalesce("_last", "_last_past"))).alias("last_at"),
    )
    return found.where("n_rows > 0").unionByName(joined)
