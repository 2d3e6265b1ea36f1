"""Suffix-array deduplication of byte strings that repeat across documents, by column-wise collection indexes.

A byte goes if a ``SPAN``-byte string that covers it also starts earlier in the collection. Matches are found exactly:

1. Every window of SPAN bytes is assigned to the leftmost of its ANCHOR-byte strings with the least hash, so equal windows get
   equal anchors at equal distances. Blocks of documents send each anchor hash once; hashes that occur once end there.
2. Blocks send the stretches of bytes whose windows share a repeated anchor, each distinct stretch once, with its first place.
   Equal stretches of all blocks are merged, and the different ones of an anchor are indexed together: one symbol of each is
   inserted per round, from the last to the first, into the collection's Burrows-Wheeler transform, and the common prefixes
   are updated with it. Runs of common prefixes of SPAN or more are the equal windows; the earliest stays.
3. Blocks get one bit per window back and cut their documents.

The text moves once (all three steps read the same shuffle). The sequential files of the column-wise construction are arrays
here, as each collection is bounded: a batch holds whole anchors up to BATCH stretches. Anchors with more than HOT stretches are
sent window by window instead, dealt out by both ends of the window, so that a passage in a large share of all documents does
not meet in one task.

Defined cases: a null text counts as empty; the order is by doc_id, then offset; rows that repeat a doc_id are ordered by text
and count as documents one after another; rows without doc_id come after all others, by a hash of the text; empty tables give
empty results; other columns are kept by ``remove_repeats`` and left out of ``repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import release
from quarry.llm.sketch import rolling

SPAN = 100
ANCHOR = 37
REACH = SPAN - ANCHOR + 1  # strings of a window that can be its anchor: 64, so that a stretch's windows fit a word
BLOCK_BYTES = 4_000_000
SHARD_BYTES = 8_000_000
BATCH = 1000
HOT = 20_000
_SLICE = 1 << 17
#: Columns that documents get on their way, by names that no table has.
KEY, BLOCK = "__quarry_key", "__quarry_block"
_KEY = ~np.uint64(3)  # the low bits of an anchor's hash carry flags


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor place, hash) of all runs of windows with one anchor; documents lie at starts, ends."""
    out = []
    n = len(data) - SPAN + 1
    for s in range(0, max(0, n), _SLICE):
        e = min(n, s + _SLICE)
        h = rolling(data[s : e + SPAN - 1], ANCHOR)
        least = h
        for shift in (1, 2, 4, 8, 16, 32):  # 64 = REACH
            least = np.minimum(least[:-shift], least[shift:])
        heads = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        tails = np.r_[heads[1:], e - s] - 1
        value = least[heads]
        place = np.empty(len(heads), np.int64)
        for i in range(0, len(heads), 8192):
            near = h[heads[i : i + 8192, None] + np.arange(REACH)]
            place[i : i + 8192] = heads[i : i + 8192] + (near == value[i : i + 8192, None]).argmax(1)
        good = tails <= place
        out.append(np.stack([heads[good] + s, tails[good] + s, place[good] + s, value[good].view(np.int64)]))
        for i in np.flatnonzero(~good):  # the anchor's string occurs again within reach: each occurrence serves the windows up to it
            at = np.flatnonzero(h[heads[i] : tails[i] + REACH] == value[i]) + heads[i]
            first = np.maximum(np.r_[heads[i], at[:-1] + 1], heads[i])
            last = np.minimum(at, tails[i])
            some = first <= last
            out.append(np.stack([first[some] + s, last[some] + s, at[some] + s, np.full(int(some.sum()), value[i]).view(np.int64)]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    first, last, place, value = np.concatenate(out, axis=1)
    order = np.argsort(first, kind="stable")
    first, last, place, value = first[order], last[order], place[order], value[order]
    # Only windows inside one document count, and a run reaches into one at most: windows across an end are more than its reach.
    doc = np.searchsorted(starts, place, side="right") - 1
    first, last = np.maximum(first, starts[doc]), np.minimum(last, ends[doc] - SPAN)
    some = first <= last
    return first[some], last[some], place[some], value[some].view(np.uint64)


def collection_index(strings: list[bytes]) -> tuple[np.ndarray, ...]:
    """(string, offset, common prefix with the one before, preceding symbol) of all suffixes in order, by rounds of one symbol a string.

    Round j inserts the suffixes of length j. Where a suffix goes follows from the transform of the shorter ones; its common
    prefixes are one more than the least between the places of its own tail and its neighbours' tails. Symbols are bytes
    plus 1; 0 ends a string, ends are ordered by string. Rounds carry two small arrays, the transform and the prefixes; whose
    suffix stands where is read off the finished transform, from each string's end to its start.
    """
    count = len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    longest = int(size.max(initial=0))
    codes = np.unique(np.frombuffer(b"".join(strings), np.uint8))  # in order, so codes sort as bytes do
    kind = np.uint8 if len(codes) < 255 and longest < 255 else np.uint16
    if longest >= 1 << 16:
        raise ValueError("strings of a collection are shorter than 65536 bytes")
    code = np.zeros(256, kind)
    code[codes] = np.arange(1, len(codes) + 1)
    symbols = np.zeros((longest + 1, count), kind)  # row j: the symbol j places from the end
    for i, s in enumerate(strings):
        symbols[: len(s), i] = code[np.frombuffer(s, np.uint8)[::-1]]
    own, prefix = symbols[0].copy(), np.zeros(count, kind)
    numbers = np.arange(int(size.sum()) + count, dtype=np.int32)
    at = np.arange(count)
    for j in range(1, longest + 1):
        active = np.flatnonzero(size >= j)
        p, n = at[active], len(own)
        order = np.argsort(own, kind="stable")
        rank = np.empty(n, np.int32)
        rank[order] = numbers[:n]
        r = rank[p].astype(np.int64)
        new = r + (count - np.count_nonzero(own == 0))
        before, after = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, n - 1)]
        mine = own[p]
        has_before = (r > 0) & (own[before] == mine)
        has_after = (r + 1 < n) & (own[after] == mine)
        common = np.zeros(len(p), kind)
        common[has_before] = _least(prefix, before[has_before] + 1, p[has_before] + 1) + kind(1)
        following = _least(prefix, p[has_after] + 1, after[has_after] + 1) + kind(1)
        old = np.ones(n + len(p), bool)
        old[new] = False
        merged_own, merged_prefix = np.empty(len(old), kind), np.empty(len(old), kind)
        merged_own[old], merged_prefix[old] = own, prefix
        merged_own[new], merged_prefix[new] = symbols[j, active], common
        merged_prefix[new[has_after] + 1] = following
        own, prefix = merged_own, merged_prefix
        at[active] = new
    order = np.argsort(own, kind="stable")
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(len(own))
    rank += count - np.count_nonzero(own == 0)  # where the suffix one symbol longer stands
    who, offset = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
    at = np.arange(count)
    for j in range(longest + 1):
        active = np.flatnonzero(size >= j)
        at[active] = rank[at[active]] if j else at[active]
        who[at[active]], offset[at[active]] = active, size[active] - j
    back = np.r_[0, codes.astype(np.int64) + 1]
    return who, offset, prefix.astype(np.int64), back[own]


def _least(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least common prefix of entries start to end (not empty) of each range."""
    if not len(start):
        return np.zeros(0, prefix.dtype)
    width = end - start
    heads = width.cumsum() - width
    at = np.repeat(start - heads, width) + np.arange(width.sum())
    return np.minimum.reduceat(prefix[at], heads)


def _ends(anchor: int, window: bytes) -> int:
    """A hash of a hot anchor's window by both ends: by it such windows are dealt out, and compared only with their like."""
    return int.from_bytes(hashlib.blake2b(window[:8] + window[-8:] + (anchor & ~3).to_bytes(8, "big"), digest_size=8).digest(), "big")


class _Block:
    """The documents of a block in order, and their runs of windows."""

    def __init__(self, table: pa.Table):
        keys, texts = table.column(KEY).to_pylist(), [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
        self.order = sorted(range(len(keys)), key=lambda i: (keys[i], texts[i]))
        self.texts = [texts[i] for i in self.order]
        key = np.array([keys[i] for i in self.order], np.int64)
        heads = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        turn = np.arange(len(key)) - np.maximum.accumulate(np.where(heads, np.arange(len(key)), 0))
        self.raw = b"".join(self.texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.ends = sizes.cumsum()
        self.starts = self.ends - sizes
        some = sizes > 0
        self.first, self.last, self.place, self.value = anchors(self.data, self.starts[some], self.ends[some])
        doc = np.flatnonzero(some)[np.searchsorted(self.starts[some], self.place, side="right") - 1] if some.any() else np.zeros(0, np.int64)
        self.doc_key = key[doc]
        self.offset = (turn[doc] << 40) + self.first - self.starts[doc]

    def stretches(self, repeated: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
        """For the runs with a repeated anchor: (first window, last window, distinct stretch, is its first, shard hash, run).

        Runs of hot anchors are taken apart into their windows.
        """
        key = self.value & _KEY
        runs = np.flatnonzero(np.isin(key, repeated))
        is_hot = np.isin(key[runs], hot)
        width = np.where(is_hot, self.last[runs] - self.first[runs] + 1, 1)
        run = np.repeat(runs, width)
        step = np.arange(len(run)) - np.repeat(width.cumsum() - width, width)
        hot_run = np.repeat(is_hot, width)
        first = self.first[run] + step
        last = np.where(hot_run, first, self.last[run])
        left = self.place[run] - first
        seen: dict[tuple[int, bytes], int] = {}
        raw, which, new = self.raw, np.empty(len(run), np.int64), np.zeros(len(run), bool)
        for i, (a, b, d, v) in enumerate(zip(first.tolist(), (last + SPAN).tolist(), left.tolist(), key[run].tolist(), strict=True)):
            content = (v, d, raw[a:b])
            at = seen.get(content)
            if at is None:
                at = seen[content] = len(seen)
                new[i] = True
            which[i] = at
        shard = key[run].copy()
        for i in np.flatnonzero(hot_run & new):
            a = int(first[i])
            shard[i] = _ends(int(key[run[i]]), raw[a : a + SPAN])
        return first, last, which, new, shard, run


def _docs_table(documents: DataFrame, blocks: int) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2))
    return documents.withColumn(KEY, key).withColumn(BLOCK, F.pmod(F.xxhash64(KEY), F.lit(blocks)).cast("int"))


def _numbers(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(b, kind) for b in column.to_pylist()]


def _survey(shards: int):
    def run(table: pa.Table) -> pa.Table:
        """Each anchor hash of a block once; the lowest bit says whether it occurs there more than once."""
        keys, n = np.unique(_Block(table).value & _KEY, return_counts=True)
        packed = keys | (n > 1).astype(np.uint64)
        shard = (keys >> np.uint64(20)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        found, heads = np.unique(shard[order], return_index=True)
        parts = np.split(packed[order], heads[1:])
        counts = np.split(np.minimum(n[order], 2**31 - 1).astype(np.int32), heads[1:])
        block = table.column(BLOCK)[0].as_py()
        return pa.table({"shard": pa.array(found.astype(np.int32)), "block": pa.array([block] * len(found), pa.int32()), "keys": pa.array([p.tobytes() for p in parts][: len(found)], pa.binary()), "counts": pa.array([c.tobytes() for c in counts][: len(found)], pa.binary())})

    return run


def _repeated(hot: int):
    def run(table: pa.Table) -> pa.Table:
        """Tells each block which of its anchors occur elsewhere or again; bit 1: so often that they are sent by window."""
        keys = _numbers(table.column("keys"), np.uint64)
        n = np.concatenate(_numbers(table.column("counts"), np.int32)).astype(np.int64)
        block = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        key = np.concatenate(keys) & _KEY
        order = np.argsort(key, kind="stable")
        key, block, n = key[order], block[order], n[order]
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        total = np.repeat(np.add.reduceat(n, heads), np.diff(np.r_[heads, len(key)]))
        twice = total > 1
        answer = key | np.where(total > hot, np.uint64(2), np.uint64(0))
        answer, block = answer[twice], block[twice]
        order = np.argsort(block, kind="stable")
        parts = np.split(answer[order], np.searchsorted(block[order], np.arange(1, len(keys))))
        return pa.table({"block": table.column("block").combine_chunks(), "keys": pa.array([p.tobytes() for p in parts], pa.binary())})

    return run


def _told(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    told = np.concatenate([np.zeros(0, np.uint64), *_numbers(table.column("keys"), np.uint64)])
    return np.unique(told & _KEY), np.unique(told[(told & np.uint64(2)) > 0] & _KEY)


STRETCHES = "shard int, block int, value binary, size binary, left_side binary, doc_key binary, place binary, data binary"


def _send(shards: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        """The distinct stretches of a block's repeated anchors, with their first places."""
        names = [c.split()[0] for c in STRETCHES.split(", ")]
        out: dict[str, list] = {n: [] for n in names}
        release()
        if docs.num_rows and told.num_rows:
            block = _Block(docs)
            repeated, hot = _told(told)
            first, last, _, new, shard, run_ = block.stretches(repeated, hot)
            at = np.flatnonzero(new)
            to = (shard[at] >> np.uint64(20)) % np.uint64(shards)
            for s in np.unique(to):
                i = at[to == s]
                r = run_[i]
                out["shard"].append(int(s))
                out["block"].append(docs.column(BLOCK)[0].as_py())
                key = block.value[r] & _KEY
                out["value"].append((key | np.isin(key, hot) * np.uint64(2)).tobytes())
                out["size"].append((last[i] - first[i] + SPAN).astype(np.uint8).tobytes())
                out["left_side"].append((block.place[r] - first[i]).astype(np.uint8).tobytes())
                out["doc_key"].append(block.doc_key[r].tobytes())
                out["place"].append((block.offset[r] + first[i] - block.first[r]).tobytes())
                out["data"].append(b"".join([block.raw[a:b] for a, b in zip(first[i].tolist(), (last[i] + SPAN).tolist(), strict=True)]))
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
        return pa.table({n: pa.array(out[n], k) for n, k in zip(names, kinds, strict=True)})

    return run


def _first_windows(contents: list[bytes], groups: np.ndarray, doc_key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For distinct stretches with their first places: a bit for each window that occurs nowhere earlier."""
    masks = np.zeros(len(contents), np.uint64)
    order = np.argsort(groups, kind="stable")
    heads = np.flatnonzero(np.r_[True, groups[order][1:] != groups[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    widths = np.diff(np.r_[heads, len(order)])
    # A collection of one string needs no rounds: windows of a stretch stand at different distances from its anchor, so no two
    # are equal, and what equals the stretch throughout was merged with it.
    masks[order[np.repeat(widths == 1, widths)]] = ~np.uint64(0)
    batch: list[np.ndarray] = []
    held = 0

    def settle() -> None:
        nonlocal held
        if batch:
            own = np.concatenate(batch)
            who, offset, prefix, _ = collection_index([contents[i] for i in own])
            run = (prefix >= SPAN).astype(np.int64)
            window = np.array([len(contents[i]) for i in own])[who] - offset >= SPAN
            who, offset, run = own[who[window]], offset[window], run[window]
            start = np.flatnonzero(run == 0)
            group = np.cumsum(run == 0) - 1
            at = np.lexsort((place[who] + offset, doc_key[who], group))
            earliest = at[start]  # groups are contiguous and as long, so the sorted order has the same heads
            np.bitwise_or.at(masks, who[earliest], np.uint64(1) << offset[earliest].astype(np.uint64))
        batch.clear()
        held = 0

    for h, n in zip(heads[widths > 1], widths[widths > 1], strict=True):
        if held and held + n > BATCH:
            settle()
        batch.append(order[h : h + n])
        held += int(n)
    settle()
    return masks


def _judge(table: pa.Table) -> pa.Table:
    """Masks for the stretches that blocks sent, in their order."""
    release()
    contents: dict[tuple[int, int, bytes], int] = {}
    distinct: list[bytes] = []
    values: list[int] = []
    which: list[np.ndarray] = []
    keys, places = _numbers(table.column("doc_key"), np.int64), _numbers(table.column("place"), np.int64)
    value = _numbers(table.column("value"), np.uint64)
    for v, size, left, data in zip(value, _numbers(table.column("size"), np.uint8), _numbers(table.column("left_side"), np.uint8), table.column("data").to_pylist(), strict=True):
        ends = size.astype(np.int64).cumsum().tolist()
        at, start = np.empty(len(v), np.int64), 0
        for i, (x, d, end) in enumerate(zip(v.tolist(), left.tolist(), ends, strict=True)):
            content = data[start:end]
            start = end
            got = contents.get((x, d, content))
            if got is None:
                got = contents[(x, d, content)] = len(distinct)
                distinct.append(content)
                values.append(_ends(x, content) if x & 2 else x)
            at[i] = got
        which.append(at)
    flat, key, place = np.concatenate(which), np.concatenate(keys), np.concatenate(places)
    order = np.lexsort((place, key, flat))
    heads = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
    first = order[heads]
    masks = _first_windows(distinct, np.array(values, np.uint64), key[first], place[first])
    answer = np.zeros(len(flat), np.uint64)
    answer[first] = masks
    parts = np.split(answer, np.cumsum([len(w) for w in which])[:-1])
    return pa.table({"block": table.column("block").combine_chunks(), "shard": table.column("shard").combine_chunks(), "value": table.column("value").combine_chunks(), "masks": pa.array([p.tobytes() for p in parts], pa.binary())})


def _removed(block: _Block, answers: pa.Table, shards: int) -> np.ndarray:
    """Which bytes of the block go."""
    gone = np.zeros(len(block.data) + 1, np.int32)
    if answers.num_rows:
        values = _numbers(answers.column("value"), np.uint64)
        told = np.concatenate(values)
        hot = np.unique(told[(told & np.uint64(2)) > 0] & _KEY)
        first, last, which, new, shard, _ = block.stretches(np.unique(told & _KEY), hot)
        at = np.flatnonzero(new)
        to = ((shard[at] >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
        masks = np.zeros(len(at), np.uint64)
        for s, got in zip(answers.column("shard").to_pylist(), _numbers(answers.column("masks"), np.uint64), strict=True):
            masks[to == s] = got
        mask = np.where(new, masks[which], np.uint64(0))  # a later occurrence in the block has none of its windows first
        whole = mask == 0
        np.add.at(gone, first[whole], 1)
        np.add.at(gone, last[whole] + SPAN, -1)
        part = np.flatnonzero(~whole)
        for i in range(0, len(part), 65536):
            own = part[i : i + 65536]
            bits = np.unpackbits(mask[own].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, offset = np.nonzero((bits == 0) & (np.arange(REACH) <= (last[own] - first[own])[:, None]))
            np.add.at(gone, first[own][row] + offset, 1)
            np.add.at(gone, first[own][row] + offset + SPAN, -1)
    return gone.cumsum()[:-1] > 0


def _spans(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    return edge[::2], edge[1::2]


def _report(shards: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        release()
        if docs.num_rows:
            block = _Block(docs)
            gone = _removed(block, answers, shards)
            ids = docs.column("doc_id").to_pylist()
            for i, text, a, b in zip(block.order, block.texts, block.starts.tolist(), block.ends.tolist(), strict=True):
                own = gone[a:b]
                starts, ends = _spans(own)
                rows.append((ids[i], b - a, int(own.sum()), len(starts), hashlib.sha256(block.data[a:b][~own].tobytes()).hexdigest(), starts.tolist(), ends.tolist()))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "span_starts", "span_ends"], columns, kinds, strict=True)})

    return run


def whole_characters(text: bytes, gone: np.ndarray) -> str:
    """What is left of a text; characters of which a byte stays, stay."""
    data = np.frombuffer(text, np.uint8)
    if not gone.any():
        return text.decode()
    heads = (data & 0xC0) != 0x80
    char = heads.cumsum() - 1
    kept = np.bincount(char, ~gone, minlength=int(heads.sum())) > 0
    return data[kept[char]].tobytes().decode()


def _cut(shards: int, columns: list[str], schema: pa.Schema):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        release()
        block = _Block(docs)
        gone = _removed(block, answers, shards)
        texts = [whole_characters(t, gone[a:b]) for t, a, b in zip(block.texts, block.starts, block.ends, strict=True)]
        table = docs.take(pa.array(block.order)).select(columns)
        made = {"text": pa.array(texts, schema.field("text").type)}
        if "n_chars" in columns:
            made["n_chars"] = pa.array([len(t) for t in texts]).cast(schema.field("n_chars").type)
        return pa.table({c: made.get(c, table.column(c)) for c in columns}).cast(schema)

    return run


def _answers(docs: DataFrame, shards: int, hot: int) -> DataFrame:
    survey = docs.groupBy(BLOCK).applyInArrow(_survey(shards), "shard int, block int, keys binary, counts binary")
    told = survey.groupBy("shard").applyInArrow(_repeated(hot), "block int, keys binary")
    sent = docs.groupBy(BLOCK).cogroup(told.groupBy("block")).applyInArrow(_send(shards), STRETCHES)
    return sent.groupBy("shard").applyInArrow(_judge, "block int, shard int, value binary, masks binary")


def _plan(documents: DataFrame, hot: int, block_bytes: int, shard_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shards = max(1, -(-total // block_bytes)), max(1, -(-total // shard_bytes))
    docs = _docs_table(documents, blocks)
    return docs, _answers(docs, shards, hot), shards


def repeats(documents: DataFrame, hot: int = HOT, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (byte offsets) of every row."""
    docs, answers, shards = _plan(documents.select("doc_id", "text"), hot, block_bytes, shard_bytes)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_starts array<long>, span_ends array<long>"
    return docs.groupBy(BLOCK).cogroup(answers.groupBy("block")).applyInArrow(_report(shards), out)


def remove_repeats(documents: DataFrame, hot: int = HOT, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents without the bytes that repeat earlier ones, in whole characters, and n_chars to match."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs, answers, shards = _plan(documents, hot, block_bytes, shard_bytes)
    return docs.groupBy(BLOCK).cogroup(answers.groupBy("block")).applyInArrow(_cut(shards, documents.columns, to_arrow_schema(documents.schema)), documents.schema)
