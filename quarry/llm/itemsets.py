"""Closed frequent itemsets and their rules, by cumulative intersection of baskets in item-conditional shards.

Frequent items are put in the order of rising support. The shard of an item holds, of every basket with it, the items that come
after it; equal remainders are one row with a weight. So the shards of rare items are small, and those of common items have few
items left, which merge into few rows. Within a shard the baskets are intersected one after the other with a repository of all
intersections so far, a prefix tree whose nodes carry the weight of the baskets that hold them; items that can no longer become
frequent by the baskets to come are taken out of it. An itemset belongs to the shard of its first item in that order, so shards
are merged by owner: sets of equal support and equal baskets (told by digests, then compared item by item) are one closed set.

A shard of more than ``shard_rows`` rows, or whose repository would pass ``max_nodes``, is split by the next item into shards of
longer heads, as often as needed, so no task holds more than that; no basket is left out.

Defined cases: rows with a null basket or item count for nothing; repeated rows count once; an empty table has no itemsets; a
basket of any length (the longest holds each frequent item once) is read whole; other columns are left out.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, ranked

LEAST, PER = 8, 2000
SHARD_ROWS = 200_000
MAX_NODES = 1_000_000
#: Frequent items are at most PER times the mean size of a basket, whatever the number of baskets; beyond this many they are joined by shuffle.
BROADCAST_ITEMS = 50_000

MINED = "shard string, head array<int>, items array<int>, support long, h1 long, h2 long"


class Repository:
    """Intersections of the baskets so far. A node is [weight, digest, digest, round, children]; its set is its path, from high items to low."""

    def __init__(self, least: int, remaining: Counter):
        self.least, self.remaining = least, remaining
        self.root: list = [0, 0, 0, 0, {}]
        self.round, self.nodes, self.checked = 0, 0, 4096

    def add(self, items: list[int], weight: int, h1: int, h2: int) -> None:
        """Intersects one basket (items falling) with all that is held."""
        self.round += 1
        now, members, low, root = self.round, set(items), items[-1] if items else 0, self.root
        root[:3] = root[0] + weight, root[1] ^ h1, root[2] ^ h2
        at = root
        for item in items:
            if item not in at[4]:
                at[4][item] = [0, 0, 0, 0, {}]
                self.nodes += 1
            at = at[4][item]
            self.remaining[item] -= weight
        todo = [(root, root)] if items else []
        while todo:
            source, target = todo.pop()
            for item, node in list(source[4].items()):
                if item < low:
                    continue
                if item not in members:
                    if item > low and node[4]:
                        todo.append((node, target))
                    continue
                met = target[4].get(item)
                if met is None:
                    met = target[4][item] = [0, 0, 0, 0, {}]
                    self.nodes += 1
                held = (met[0] - weight, met[1] ^ h1, met[2] ^ h2) if met[3] == now else (met[0], met[1], met[2])
                if met is not node and node[0] > held[0]:  # a source that this basket has changed is a subset of it, hence its own target
                    held = (node[0], node[1], node[2])
                met[:4] = held[0] + weight, held[1] ^ h1, held[2] ^ h2, now
                if item > low and node[4]:
                    todo.append((node, met))
        if self.nodes > self.checked:
            self.prune()
            self.checked = max(4096, 2 * self.nodes)

    def prune(self) -> None:
        """Takes items out where the baskets to come cannot make their sets frequent; what then agrees is merged."""
        fresh: list = [*self.root[:4], {}]
        nodes, todo = 0, [(self.root, fresh)]
        while todo:
            old, new = todo.pop()
            for item, node in old[4].items():
                if node[0] + self.remaining[item] < self.least:
                    todo.append((node, new))
                    continue
                met = new[4].get(item)
                if met is None:
                    met = new[4][item] = [*node[:4], {}]
                    nodes += 1
                elif node[0] > met[0]:
                    met[:4] = node[:4]
                todo.append((node, met))
        self.root, self.nodes = fresh, nodes

    def found(self):
        """(items rising, weight, digests) of the frequent sets that no longer path in the tree has in the same baskets."""
        todo = [(self.root, ())]
        while todo:
            node, path = todo.pop()
            if node[0] >= self.least and all(child[0] != node[0] for child in node[4].values()):
                yield path, node[0], node[1], node[2]
            todo.extend((child, (item, *path)) for item, child in node[4].items() if child[0] >= self.least)


def _miner(least: int, max_nodes: int):
    """The sets of one shard; a single row of support -1 asks for the shard to be split."""

    def mine(rows: pd.DataFrame) -> pd.DataFrame:
        shard, head = rows["shard"].iloc[0], [int(x) for x in rows["head"].iloc[0]]
        counts: Counter = Counter()
        for rest, weight in zip(rows["rest"], rows["weight"], strict=True):
            for item in rest:
                counts[int(item)] += int(weight)
        merged: dict[tuple, list[int]] = {}
        for rest, weight, h1, h2 in zip(rows["rest"], rows["weight"], rows["h1"], rows["h2"], strict=True):
            kept = tuple(sorted((i for i in map(int, rest) if counts[i] >= least), reverse=True))
            one = merged.setdefault(kept, [0, 0, 0])
            one[:] = one[0] + int(weight), one[1] ^ int(h1), one[2] ^ int(h2)
        made = Repository(least, Counter({i: n for i, n in counts.items() if n >= least}))
        for items in sorted(merged, key=lambda x: (len(x), x)):
            made.add(list(items), *merged[items])
            if made.nodes > max_nodes:
                return pd.DataFrame([(shard, head, head, -1, 0, 0)], columns=["shard", "head", "items", "support", "h1", "h2"])
        return pd.DataFrame([(shard, head, [*head, *path], n, h1, h2) for path, n, h1, h2 in made.found()], columns=["shard", "head", "items", "support", "h1", "h2"])

    return mine


def _digested(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("weight").alias("weight"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))


def _split(pending: DataFrame, which: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(the heads of the shards as sets, their baskets dealt to shards of heads that are one item longer)."""
    own = pending.join(which, "shard", "left_semi")
    tops = _digested(own, "shard", "head").select("shard", "head", F.col("head").alias("items"), F.col("weight").alias("support"), "h1", "h2")
    longer = own.select("shard", "head", F.posexplode("rest").alias("at", "item"), "rest", "weight", "h1", "h2")
    counts = longer.groupBy("shard", "item").agg(F.sum("weight").alias("n")).where(F.col("n") >= least).select("shard", "item")
    head = F.concat("head", F.array("item"))
    dealt = longer.join(counts, ["shard", "item"]).select(F.array_join(head, ",").alias("shard"), head.alias("head"), F.expr("slice(rest, at + 2, size(rest))").alias("rest"), "weight", "h1", "h2")
    return tops, _digested(dealt, "shard", "head", "rest")


def frequent_items(rows: DataFrame, least: int) -> DataFrame:
    """item, support and place (from 0 on, in the order of rising support) of the items that are frequent by themselves."""
    counted = rows.distinct().groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= least)
    return materialize(ranked(counted, "place", F.col("support"), F.col("item")).withColumn("place", F.col("place").cast("int")), "items")


def mine(rows: DataFrame, items: DataFrame, least: int, shard_rows: int = SHARD_ROWS, max_nodes: int = MAX_NODES) -> DataFrame:
    """shard, head, items (places), support and digests of the sets found in all shards: every closed set, and of each set's baskets one at least."""
    known = items.select("item", "place")
    placed = rows.join(F.broadcast(known) if items.count() <= BROADCAST_ITEMS else known, "item")
    baskets = placed.groupBy("basket").agg(F.sort_array(F.collect_set("place")).alias("items"))  # at most all frequent items
    baskets = baskets.select("items", F.lit(1).cast("long").alias("weight"), F.xxhash64("basket").alias("h1"), F.xxhash64("basket", F.lit(1)).alias("h2"))
    starts = _digested(baskets, "items").select("*", F.explode(F.sequence(F.lit(1), F.size("items"))).alias("at"))
    head = F.slice("items", F.col("at"), 1)
    dealt = starts.select(F.array_join(head, ",").alias("shard"), head.alias("head"), F.expr("slice(items, at + 1, size(items))").alias("rest"), "weight", "h1", "h2")
    pending = materialize(_digested(dealt, "shard", "head", "rest"), "shards")
    parts = []
    while True:
        large = materialize(pending.groupBy("shard").count().where(F.col("count") > shard_rows).select("shard"), "large")
        mined = materialize(pending.join(large, "shard", "left_anti").groupBy("shard").applyInPandas(_miner(least, max_nodes), MINED), "mined")
        parts.append(mined.where("support > 0"))
        again = large.union(mined.where("support < 0").select("shard"))
        if again.isEmpty():
            break
        tops, dealt = _split(pending, again, least)
        parts.append(materialize(tops, "heads"))
        pending = materialize(dealt, "shards")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def closed(mined: DataFrame) -> DataFrame:
    """items and support of the closed sets. A set found in several shards has in each the items from that shard on; of sets of the same
    baskets, at most one a shard head, those within another go."""
    alike = mined.groupBy("support", "h1", "h2").agg(F.collect_set("items").alias("sets"))
    kept = F.expr("filter(sets, s -> not exists(sets, o -> size(o) > size(s) and size(array_except(s, o)) = 0))")
    return alike.select("support", F.explode(kept).alias("items"))


def supports(mined: DataFrame, wanted: DataFrame) -> DataFrame:
    """rest and its support a: the largest support of a found set that holds it, in the shards of its first item."""
    heads = mined.select(F.col("shard").alias("owner"), F.col("head").alias("head")).distinct().withColumn("first", F.col("head")[0])
    fits = F.expr("size(array_except(filter(rest, x -> x <= element_at(head, -1)), head)) = 0")
    asked = wanted.withColumn("first", F.col("rest")[0]).join(heads, "first").where(fits).select("owner", "rest")

    def answer(sets: pd.DataFrame, rests: pd.DataFrame) -> pd.DataFrame:
        order = sets.sort_values("support", ascending=False)
        held = [frozenset(map(int, x)) for x in order["items"]]
        weights = order["support"].tolist()
        places: dict[int, list[int]] = defaultdict(list)
        for k, own in enumerate(held):
            for item in own:
                places[item].append(k)
        out = []
        for rest in rests["rest"]:
            own = {int(x) for x in rest}
            k = next((k for k in min((places[i] for i in own), key=len) if own <= held[k]), None)
            if k is not None:
                out.append((sorted(own), weights[k]))
        return pd.DataFrame(out, columns=["rest", "a"])

    answers = mined.select("shard", "items", "support").groupBy("shard").cogroup(asked.groupBy("owner")).applyInPandas(answer, "rest array<int>, a long")
    return answers.groupBy("rest").agg(F.max("a").alias("a"))


def itemsets(sales: DataFrame, basket: str, item: str, least: int = LEAST, per: int = PER, confidence: int = 10, shard_rows: int = SHARD_ROWS, max_nodes: int = MAX_NODES) -> DataFrame:
    """Closed itemsets in at least ``least`` baskets and a share of 1/``per`` of all, with the rules that each gives: items (numerically
    rising, by commas), n_items, support, n_rules, best_item, rules_sha256, rules.

    Taking c from a set is a rule if the set is in at least ``confidence`` per cent of the baskets of the rest (a), and more often than
    chance (support * baskets > a * support of c). ``rules`` are structs of c, a and s.
    """
    rows = sales.select(F.col(basket).alias("basket"), F.col(item).cast("long").alias("item")).where("basket is not null and item is not null")
    n_baskets = rows.select("basket").distinct().count()
    least = max(least, -(-n_baskets // per))
    items = frequent_items(rows, least)
    mined = materialize(mine(rows, items, least, shard_rows, max_nodes), "sets")
    sets = materialize(closed(mined), "closed")
    taken = sets.select("items", "support", F.explode("items").alias("place"))
    taken = taken.withColumn("rest", F.array_remove("items", F.col("place")))
    answers = supports(mined, taken.where("size(rest) > 0").select("rest").distinct())
    full = taken.join(items.select("place", F.col("item").alias("c"), F.col("support").alias("s")), "place").join(answers, "rest", "left")
    wide = lambda name: F.col(name).cast("decimal(19,0)")  # noqa: E731  products of two longs
    is_rule = (F.col("support") * 100 >= F.col("a") * confidence) & (wide("support") * F.lit(n_baskets).cast("decimal(19,0)") > wide("a") * wide("s"))
    rule = F.when(is_rule, F.struct("c", "a", "s"))
    whole = full.groupBy(F.array_join("items", ",").alias("key"), "support").agg(
        F.sort_array(F.collect_list("c")).alias("own"), F.sort_array(F.collect_list(rule)).alias("rules"), F.min(F.when(is_rule, F.struct("a", "c")))["c"].alias("best_item")
    )
    said = F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["c"].cast("string"), r["a"].cast("string"), r["s"].cast("string"))), ";")
    return whole.select(
        F.array_join(F.transform("own", lambda x: x.cast("string")), ",").alias("items"), F.size("own").cast("long").alias("n_items"), "support", F.size("rules").cast("long").alias("n_rules"),
        "best_item", F.sha2(said, 256).alias("rules_sha256"), "rules",
    )


def of_sales(sale_lines: DataFrame) -> DataFrame:
    """The itemsets of the baskets of sales, without returned lines."""
    kept = sale_lines.where(~F.col("flag").eqNullSafe(F.lit("returned")))
    return itemsets(kept, "sale_id", "item_id").select("items", "n_items", "support", "n_rules", "best_item", "rules_sha256")


def oracle_sql() -> str:
    """All frequent itemsets, level by level, by lists of their baskets; then the closed ones and their rules."""
    return f"""
with recursive r as (select distinct sale_id, item_id from sale_lines where flag is distinct from 'returned' and sale_id is not null and item_id is not null),
t as (select count(distinct sale_id) as b, greatest({LEAST}, cast(ceil(count(distinct sale_id) / {PER}) as bigint)) as least from r),
one as (select item_id, count(*) as n from r group by 1 having count(*) >= (select least from t)),
f as (select sale_id, item_id from r join one using (item_id)),
pairs as (select x.item_id as i, y.item_id as j from f x join f y on x.sale_id = y.sale_id and x.item_id < y.item_id group by all having count(*) >= (select least from t)),
level(items, last, sales) as (
  select [item_id], item_id, list(sale_id) from f group by item_id
  union all
  select items || [j], j, list(f.sale_id) from (select items, last, unnest(sales) as sale_id from level) l join pairs on pairs.i = l.last join f on f.sale_id = l.sale_id and f.item_id = pairs.j
  group by items, j having count(*) >= (select least from t)),
s as (select items, len(sales) as support from level),
wider as (select list_filter(items, lambda x: x <> c) as rest, c, items, support from (select *, unnest(items) as c from s where len(items) > 1)),
closed as (select items, support from s where not exists (select 1 from wider w where w.rest = s.items and w.support = s.support)),
rules as (select w.items, w.c, a.support as a, one.n as s, w.support from wider w join s a on a.items = w.rest join one on one.item_id = w.c
          where 100 * w.support >= 10 * a.support and w.support * (select b from t) > a.support * one.n)
select array_to_string(c.items, ',') as items, len(c.items) as n_items, c.support, count(r.c) as n_rules, arg_min(r.c, (r.a, r.c)) as best_item,
       sha256(coalesce(string_agg(r.c || ':' || r.a || ':' || r.s, ';' order by r.c), '')) as rules_sha256
from closed c left join rules r on r.items = c.items group by c.items, c.support"""
