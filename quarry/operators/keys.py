"""Keys and references read from the data, for databases that declare none.

Unique column sets are searched level by level: a set with a unique subset is not minimal, one whose columns have too few values together
cannot be unique; of the rest a slice of the values, all sets of a level in one pass, refutes most, and the others are counted exactly. Inclusions of columns come from
one aggregation: the distinct values of all columns meet by digest, equal sets of columns are counted, and a column lies in another if as
many of its values are seen with the other as it has. Only digests move.

Defined cases: columns with nulls are no keys; an empty table has no keys; a column without values refers to nothing; arrays, maps, structs and
binaries are passed over; numbers are compared with numbers and texts with texts; repeated rows leave a table without keys.
"""

from __future__ import annotations

import itertools
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.catalog import Catalog, Constraints

#: Relative error of the sketches, and how far below the number of rows a sketch of a unique set may lie.
ERROR, SLACK = 0.02, 0.1
#: Tables of up to so many rows are counted exactly at once, all sets of a level in one pass.
FEW_ROWS = 200_000
#: Of so many slices of the values one is looked at first.
SLICES = 64
#: Columns that one number holds as bits.
MASK = 62
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _atomic(frame: DataFrame) -> list[str]:
    return [c for c, kind in frame.dtypes if not kind.startswith(("array", "map", "struct", "binary", "variant"))]


def _halves(columns: list[Column], kinds: list[str]) -> tuple[Column, Column]:
    """128 bits that tell the values of non-null columns apart: one or two whole numbers as they are, else two independent hashes."""
    if len(columns) < 3 and all(k in _WHOLE for k in kinds):
        return columns[0].cast("long"), (columns[1] if len(columns) == 2 else F.lit(0)).cast("long")
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)


def _repeated(frame: DataFrame, sets: list[tuple[str, ...]], slices: int) -> set[int]:
    """The places of the sets of full columns that repeat a value, of those values that fall into the first of so many slices by hash. One pass."""
    kinds = dict(frame.dtypes)
    made = []
    for i, own in enumerate(sets):
        h, g = _halves([F.col(f"`{c}`") for c in own], [kinds[c] for c in own])
        made.append(F.struct(F.lit(i).alias("i"), h.alias("h"), g.alias("g")))
    dealt = frame.select(F.explode(F.array(*made)).alias("v")).select("v.i", "v.h", "v.g")
    if slices > 1:
        dealt = dealt.where(F.pmod(F.xxhash64("h", "g"), F.lit(slices)) == 0)
    return {r["i"] for r in dealt.groupBy("i", "h", "g").count().where("count > 1").select("i").distinct().collect()}  # bounded by the schema


def unique_sets(frame: DataFrame, most: int = 2) -> list[tuple[str, ...]]:
    """The minimal sets of at most ``most`` columns whose values no two rows share, in the order of size and columns."""
    names = _atomic(frame)
    if not names:
        return []
    q = lambda c: F.col(f"`{c}`")
    first = frame.agg(F.count(F.lit(1)).alias("n"), *[F.count(q(c)).alias(f"f{i}") for i, c in enumerate(names)], *[F.approx_count_distinct(q(c), ERROR).alias(f"d{i}") for i, c in enumerate(names)]).first()
    n = first["n"]
    if not n:
        return []
    values = {c: first[f"d{i}"] for i, c in enumerate(names) if first[f"f{i}"] == n}
    found: list[tuple[str, ...]] = []
    near = n * (1 - SLACK)
    for size in range(1, most + 1):
        level = []
        for own in itertools.combinations(values, size):
            room = 1.0
            for c in own:
                room *= values[c] * (1 + SLACK)
            if room >= n and not any(set(k) <= set(own) for k in found):
                level.append(own)
        if level and n <= FEW_ROWS:
            exact = frame.agg(*[F.count_distinct(F.struct(*map(q, own))) for own in level]).first()
            found += [own for own, d in zip(level, exact, strict=True) if d == n]
            continue
        if size == 1:
            level = [own for own in level if values[own[0]] >= near]
        # A slice of the hashed values, every row of which is in it, refutes most sets; what is left is counted in whole.
        for slices in (SLICES, 1):
            if level:
                repeated = _repeated(frame, level, slices)
                level = [own for i, own in enumerate(level) if i not in repeated]
        found += level
    return found


def _all_sets(catalog: Catalog, most: int) -> dict[str, list[tuple[str, ...]]]:
    """The unique sets of every table, several tables at a time."""
    with ThreadPoolExecutor(4) as pool:
        return dict(zip(catalog.names, pool.map(lambda t: unique_sets(catalog.table(t), most), catalog.names), strict=True))


def discovered_keys(catalog: Catalog, most: int = 2) -> DataFrame:
    """table, columns (by commas, in the table's order), size of all minimal unique sets."""
    rows = [(t, ",".join(own), len(own)) for t, sets in _all_sets(catalog, most).items() for own in sets]
    return catalog.spark.createDataFrame(rows, "table string, columns string, size int")


def inclusions(catalog: Catalog) -> DataFrame:
    """src_table, src_column, dst_table, dst_column, n_values of all pairs of columns where each value of the first (n_values of them, one at
    least) is one of the second."""
    columns, seen = [], None
    chosen = [(t, c, kind) for t in catalog.names for c, kind in catalog.table(t).dtypes if kind in _WHOLE or kind == "string"]
    if not chosen:
        return catalog.spark.createDataFrame([], "src_table string, src_column string, dst_table string, dst_column string, n_values long")
    masks = -(-len(chosen) // MASK)
    for t in catalog.names:
        own = []
        for c, kind in [(c, kind) for s, c, kind in chosen if s == t]:
            h, g = _halves([F.col(f"`{c}`")], [kind])
            place = len(columns)
            bits = [F.lit(1 << place % MASK if place // MASK == m else 0).cast("long").alias(f"m{m}") for m in range(masks)]
            own.append(F.struct(F.lit(kind == "string").alias("text"), F.when(F.col(f"`{c}`").isNotNull(), h).alias("h"), g.alias("g"), *bits))
            columns.append((place, t, c))
        if own:
            one = catalog.table(t).select(F.explode(F.array(*own)).alias("v")).select("v.*").where("h is not null")
            seen = one if seen is None else seen.unionByName(one)
    names = catalog.spark.createDataFrame(columns, "col int, `table` string, `column` string")
    # The columns of a value are bits, so that values repeated in a column are merged before they move, and move once.
    together = seen.groupBy("text", "h", "g").agg(*[F.bit_or(f"m{m}").alias(f"m{m}") for m in range(masks)])
    counted = together.groupBy(*[f"m{m}" for m in range(masks)]).agg(F.count("*").alias("n"))  # values in the same columns, counted together
    held = [F.when(F.getbit(F.col(f"m{i // MASK}"), F.lit(i % MASK)) == 1, F.lit(i)) for i in range(len(columns))]
    counted = counted.select("n", F.array_compact(F.array(*held)).alias("cols"))
    pairs = counted.select("n", F.col("cols"), F.explode("cols").alias("src")).select("n", "src", F.explode("cols").alias("dst")).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    whole = pairs.where("src = dst").select(F.col("src").alias("_src"), F.col("n").alias("n_values"))
    kept = pairs.where("src <> dst").join(whole, F.col("src") == F.col("_src")).where("n = n_values")
    src, dst = names.toDF("src", "src_table", "src_column"), names.toDF("dst", "dst_table", "dst_column")
    return kept.join(F.broadcast(src), "src").join(F.broadcast(dst), "dst").select("src_table", "src_column", "dst_table", "dst_column", "n_values")


def discovered_references(catalog: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """The inclusions whose second column is a key by itself."""
    keys = discovered_keys(catalog, 1) if keys is None else keys
    single = keys.where("size = 1").select(F.col("table").alias("dst_table"), F.col("columns").alias("dst_column"))
    return inclusions(catalog).join(single, ["dst_table", "dst_column"]).select("src_table", "src_column", "dst_table", "dst_column", "n_values")


def _stem(name: str) -> str:
    """A column's name without the prefix of its table."""
    head, _, rest = name.lower().partition("_")
    return rest if rest and len(head) <= 2 else name.lower()


def constraints(catalog: Catalog, most: int = 2) -> Constraints:
    """Keys as a database would declare them: of each table the first smallest unique set as primary, the other sets as unique, and as foreign
    keys the references whose columns have the same name, but for prefixes of tables."""
    sets = _all_sets(catalog, most)
    rows = [(t, ",".join(k), len(k)) for t, own in sets.items() for k in own]
    keys = catalog.spark.createDataFrame(rows, "table string, columns string, size int")
    primary = {t: own[0] for t, own in sets.items() if own}
    # Bounded by the schema: pairs of columns.
    found = sorted(tuple(r)[:4] for r in discovered_references(catalog, keys).collect())
    foreign = tuple((s, c, d, k) for s, c, d, k in found if s != d and _stem(c) == _stem(k) and primary.get(d) == (k,))
    return Constraints(primary, foreign, tuple((t, k) for t, own in sets.items() for k in own[1:]))


def with_discovered_keys(catalog: Catalog, most: int = 2) -> Catalog:
    """The same tables with keys found in the data."""
    return Catalog(catalog.spark, catalog.path, catalog.names, constraints(catalog, most))
