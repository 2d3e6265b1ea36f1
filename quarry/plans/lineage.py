"""Tables, columns and filter literals of a query, read from Catalyst's analysed plan, subqueries included."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.bounds import blocks_joined

_COMPARISONS = ("EqualTo", "EqualNullSafe", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "Like", "ILike", "In", "StartsWith", "EndsWith", "Contains")


@dataclass
class Lineage:
    tables: list[str] = field(default_factory=list)
    columns: dict[str, list[str]] = field(default_factory=dict)
    literals: list[tuple[str, str, str, str]] = field(default_factory=list)


def _items(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _roots(plan):
    stack = [plan]
    while stack:
        p = stack.pop()
        yield p
        stack.extend(_items(p.subqueriesAll()))


def _walk(plan):
    stack = [plan]
    while stack:
        p = stack.pop()
        yield p
        stack.extend(reversed(list(_items(p.children()))))


def _attribute(expression):
    """The column below casts and case changes, if that is all there is."""
    while expression.nodeName() in ("Cast", "Lower", "Upper", "Trim", "StringTrim"):
        expression = expression.children().apply(0)
    return expression if expression.nodeName() == "AttributeReference" else None


def _literal(expression):
    while expression.nodeName() in ("Cast", "Lower", "Upper"):
        expression = expression.children().apply(0)
    return str(expression.value()) if expression.nodeName() == "Literal" and expression.value() is not None else None


def lineage(spark: SparkSession, sql: str) -> Lineage:
    """What a query over registered views reads: tables as often as they occur, columns by table, and (table, column, comparison, literal)."""
    analysed = spark.sql(sql)._jdf.queryExecution().analyzed()
    out, owner, inner = Lineage(), {}, set()
    for root in _roots(analysed):
        for node in _walk(root):
            if node.nodeName() == "View":
                table = node.desc().identifier().table()
                out.tables.append(table)
                for a in _items(node.output()):
                    owner[a.exprId().id()] = (table, a.name())
                for below in _items(node.children()):
                    inner.update(id_ for x in _walk(below) for id_ in [x.hashCode()])
    found: dict[str, dict[str, str]] = {}
    for root in _roots(analysed):
        for node in _walk(root):
            if node.nodeName() in ("View", "SubqueryAlias") or node.hashCode() in inner or node.nodeName().startswith(("LogicalRelation", "Relation")):
                continue
            for a in _items(node.references().toSeq()):
                if (at := owner.get(a.exprId().id())) is not None:
                    found.setdefault(at[0], {}).setdefault(at[1].lower(), at[1])
            for top in _items(node.expressions()):
                stack = [top]
                while stack:
                    e = stack.pop()
                    kids = list(_items(e.children()))
                    if e.nodeName() in _COMPARISONS and kids:
                        left = _attribute(kids[0])
                        at = owner.get(left.exprId().id()) if left is not None else None
                        for right in kids[1:]:
                            value = _literal(right)
                            if at is not None and value is not None:
                                out.literals.append((*at, e.nodeName(), value))
                    stack.extend(kids)
    out.columns = {t: sorted(c.values()) for t, c in found.items()}
    return out


def lineage_of(spark: SparkSession, queries: list[str]) -> dict[str, list[str]]:
    """The columns that any of the queries reads; queries that do not parse read none."""
    out: dict[str, set[str]] = {}
    for sql in queries:
        try:
            for t, own in lineage(spark, sql).columns.items():
                out.setdefault(t, set()).update(own)
        except Exception:  # noqa: BLE001  a failing query has no lineage
            continue
    return {t: sorted(c) for t, c in out.items()}


def literals_found(catalog, literals: DataFrame) -> DataFrame:
    """``literals``: table, column, literal of conditions. Adds found: whether any row of the column is the literal, and
    found_anyhow: whether one is but for case and outer spaces. Literals of unknown columns, and nulls, are not found.

    One scan a column, which keeps only the column; the literals are those of a few queries.
    """
    asked = literals.select("table", "column", "literal").distinct()
    places = {(t.lower(), c.lower()): (t, c) for t, c, *_ in catalog.types}
    met = None
    for t, c in sorted({(r[0], r[1]) for r in asked.select("table", "column").distinct().collect() if r[0] and r[1]}):  # names in queries
        if (at := places.get((t.lower(), c.lower()))) is None:
            continue
        own = asked.where((F.col("table") == t) & (F.col("column") == c) & F.col("literal").isNotNull())
        value = F.col(f"`{at[1]}`").cast("string")
        rows = catalog.table(at[0]).select(value.alias("_value")).where("_value is not null")
        one = blocks_joined(rows, own, F.lower(F.trim("_value")) == F.lower(F.trim("literal"))).groupBy("table", "column", "literal").agg(F.max(F.col("_value") == F.col("literal")).alias("found"))
        met = one if met is None else met.unionByName(one)
    if met is None:
        return literals.withColumn("found", F.lit(False)).withColumn("found_anyhow", F.lit(False))
    back = met.select(*[F.col(c).alias(f"_{c}") for c in ("table", "column", "literal")], F.col("found").alias("_found"))
    on = (F.col("table") == F.col("_table")) & (F.col("column") == F.col("_column")) & (F.col("literal") == F.col("_literal"))
    joined = literals.join(back, on, "left").withColumn("found", F.coalesce("_found", F.lit(False))).withColumn("found_anyhow", F.col("_found").isNotNull())
    return joined.drop("_table", "_column", "_literal", "_found")
