"""Alignment of the tokens of two tokenizers over the same bytes.

The ends of both token runs are merged with two pointers: where both end at one offset a group ends, and each step between ends is a link,
the one overlap of an A and a B token. Tokens never cross the spaces at which texts are cut into stretches (``words.cut``), so a stretch's
groups and links are merged once and remembered; a text's are those of its stretches in a row.

A batch of documents gives a row a document (with its stretches as numbers) and one row of its distinct linked id pairs with how often
each occurs. Spark adds the pairs up over the corpus, takes the highest count of each B id and joins both back to the batches' pairs;
there every document's links are looked up. A pair comes once a batch however common it is, so no key is hot.

Defined cases: texts that are null or empty, or whose joined tokens of either side are not the text's bytes after a space, have no tokens:
zeros and an empty digest; repeated rows are aligned each; very long stretches are aligned whole; other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, release
from quarry.llm.words import blocks, cut, independent, last_bytes, token_bytes, unknown

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: A batch ends at so many characters; so many short stretches are remembered between batches.
BATCH_CHARS = 4_000_000
REMEMBERED = 400_000
LONGEST = 64
SPACE = "▁"


def merge(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends of all links, ends of all groups) of two rising runs of ends with the same last: what a pass with a pointer in each of them
    meets. The stable sort of two rising runs is that pass."""
    both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    twice = both[1:] == both[:-1]
    return both[np.append(~twice, True)] if len(both) else both, both[1:][twice]


def _decimals(top: int) -> tuple[np.ndarray, np.ndarray]:
    """(digits of the numbers below ``top`` with room for one more letter, their lengths)."""
    said = [str(i).encode() for i in range(top)]
    width = max(map(len, said), default=0) + 1
    return np.frombuffer(b"".join(x.ljust(width) for x in said), np.uint8).reshape(-1, width).copy(), np.array([len(x) for x in said])


class Pair:
    """Both tokenizers, and the alignments of stretches by number."""

    def __init__(self, config: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(config)
        self.a.encode_special_tokens = True
        self.bytes_a = token_bytes(self.a.get_vocab(with_added_tokens=True))
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in own]) for own in (self.bytes_a, self.bytes_b))
        self.digits, self.n_digits = _decimals(max(len(self.bytes_a), len(self.bytes_b)))
        self.cuts = independent(config) and all(SPACE not in p.lstrip(SPACE) for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.said: list[bytes] = []
        #: By stretch: n_a, n_b, n_groups, n_links; and the links' id pairs (a << 32 | b) of all stretches in a row.
        self.shape, self.links = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)
        self.more_links: list[np.ndarray] = []
        self.more_shape: list[np.ndarray] = []

    def forget(self) -> None:
        """Keeps the half of the stretches that are named and were used most, so that common ones stay."""
        parts, numbers = list(self.numbers), np.fromiter(self.numbers.values(), np.int64, len(self.numbers))
        times = self.times[numbers]
        best = np.argsort(-times, kind="stable")[: REMEMBERED // 2]
        kept = numbers[best]
        lengths = self.shape[kept, 3]
        first, ends = (np.cumsum(self.shape[:, 3]) - self.shape[:, 3])[kept], np.cumsum(lengths)
        self.links = self.links[np.repeat(first - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        self.shape, self.times, self.said = self.shape[kept], times[best] // 2, [self.said[k] for k in kept]
        self.numbers = {parts[b]: k for k, b in enumerate(best.tolist())}

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Both sides' ids; None if their bytes are not the text's after a space."""
        whole = (" " + text).encode()
        a, b = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)
        same = b"".join(map(self.bytes_a.__getitem__, a)) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole
        return (np.array(a, np.int64), np.array(b, np.int64)) if same else None

    def align(self, parts: list[str]) -> bool:
        """Aligns stretches together and numbers them; False if the bytes differ, with nothing done."""
        got = self.tokens(" ".join(parts))
        if got is None:
            return False
        a, b = got
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        links, groups = merge(ends_a, ends_b)
        last = last_bytes(parts)
        if not np.isin(last, groups).all():
            return False
        self.more_links.append(a[np.searchsorted(ends_a, links)] << 32 | b[np.searchsorted(ends_b, links)])
        upto = np.stack([np.searchsorted(x, last, "right") for x in (ends_a, ends_b, groups, links)], 1)
        self.more_shape.append(np.diff(upto, axis=0, prepend=np.zeros((1, 4), np.int64)))
        # All ids in the order in which they are said: of each group those of A, then those of B.
        of_a, of_b = np.searchsorted(groups, ends_a), np.searchsorted(groups, ends_b)
        n_a, n_b = np.searchsorted(ends_a, groups, "right"), np.searchsorted(ends_b, groups, "right")
        place = np.concatenate([np.arange(len(a)) + np.append(0, n_b)[of_a], np.arange(len(b)) + n_a[of_b]])
        ids, mark = np.empty(len(place), np.int64), np.full(len(place), ord(","), np.uint8)
        ids[place] = np.concatenate([a, b])
        mark[place[n_a - 1]] = ord("|")
        mark[place[len(a) + n_b - 1]] = ord(";")
        rows, lengths = self.digits[ids], self.n_digits[ids]
        rows[np.arange(len(rows)), lengths] = mark
        said = rows[np.arange(rows.shape[1]) <= lengths[:, None]].tobytes()
        at = np.append(0, np.cumsum(lengths + 1))[upto[:, 0] + upto[:, 1]].tolist()
        for part, start, end in zip(parts, [0, *at[:-1]], at, strict=True):
            self.numbers[part] = len(self.said)
            self.said.append(said[start : end - 1])
        return True

    def stretches(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of the stretches of each text, none where it has no tokens."""
        if len(self.said) > REMEMBERED:
            self.forget()
        cuts = [(cut(t) if self.cuts else [t]) if t else [] for t in texts]
        new, odd = unknown(cuts, self.numbers), set()
        for block in blocks(new):
            if not self.align(block):
                odd.update(p for p in block if not self.align([p]))
        if odd:  # there the whole text decides
            for k, parts in enumerate(cuts):
                if not odd.isdisjoint(parts):
                    cuts[k] = [texts[k]] if texts[k] in self.numbers or self.align([texts[k]]) else []
        self.links, self.shape = np.concatenate([self.links, *self.more_links]), np.concatenate([self.shape, *self.more_shape])
        self.more_links, self.more_shape = [], []
        out = [np.array(list(map(self.numbers.__getitem__, parts)), np.int64) for parts in cuts]
        for part in [p for p in [*new, *(c[0] for c in cuts if len(c) == 1)] if len(p) > LONGEST]:
            self.numbers.pop(part, None)
        return out

    def batch(self, texts: list[str | None]) -> tuple[pd.DataFrame, dict[str, np.ndarray]]:
        """(a row a text with its stretches, the batch's id pairs and the pairs of each stretch)."""
        own = self.stretches(texts)
        lengths = np.array([len(o) for o in own])
        flat = np.concatenate([np.zeros(0, np.int64), *own])
        times = np.bincount(flat, minlength=len(self.shape))
        self.times = times + np.append(self.times, np.zeros(len(times) - len(self.times), np.int64))
        used = np.flatnonzero(times)
        place = np.zeros(len(self.shape), np.int32)
        place[used] = np.arange(len(used))
        n_links = self.shape[used, 3]
        first = (np.cumsum(self.shape[:, 3]) - self.shape[:, 3])[used]
        ends = np.cumsum(n_links)
        codes = self.links[np.repeat(first - (ends - n_links), n_links) + np.arange(ends[-1] if len(ends) else 0)]
        pairs, at = np.unique(codes, return_inverse=True)
        counts = np.bincount(at, np.repeat(times[used], n_links), len(pairs)).astype(np.int64)
        running = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.shape[flat], 0)])
        upto = np.append(0, np.cumsum(lengths)).astype(np.int64)
        sums = running[upto[1:]] - running[upto[:-1]]
        digests = [hashlib.sha256(b";".join(map(self.said.__getitem__, o.tolist()))).hexdigest() if len(o) else "" for o in own]
        rows = pd.DataFrame({"n_a": sums[:, 0], "n_b": sums[:, 1], "n_groups": sums[:, 2], "n_links": sums[:, 3], "groups_sha256": digests})
        rows["words"] = [place[o] for o in own]
        return rows, {"a": (pairs >> 32).astype(np.int32), "b": (pairs & 0xFFFFFFFF).astype(np.int32), "n": counts, "ends": ends.astype(np.int32), "links": at.astype(np.int32)}


_loaded: dict[str, Pair] = {}


def load(config: str, model: bytes) -> Pair:
    key = hashlib.sha256(config.encode() + model).hexdigest()
    if key not in _loaded:
        _loaded[key] = Pair(config, model)
    return _loaded[key]


COUNTED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
BATCH = "batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, words array<int>, a array<int>, b array<int>, n array<long>, ends array<int>, links array<int>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned_batches(documents: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """A row a document (words: its stretches in the batch), and a row a batch (a, b, n: its id pairs; ends, links: the pairs of each stretch)."""
    with open(a_path, encoding="utf-8") as file:  # on the driver; executors get the contents
        config = file.read()
    with open(b_path, "rb") as file:
        model = file.read()
    if json.loads(config)["normalizer"] is not None:
        raise ValueError("a tokenizer that rewrites texts has no tokens of their bytes")

    names = [c.split()[0] for c in BATCH.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, number = load(config, model), TaskContext.get().partitionId() << 32
        for frame in frames:
            cuts = (frame["text"].str.len().fillna(0).cumsum() // batch_chars).astype(int)
            for _, part in frame.groupby(cuts, sort=True):
                rows, made = pair.batch([t if isinstance(t, str) else None for t in part["text"].tolist()])
                rows.insert(0, "doc_id", part["doc_id"].astype("Int64").array)
                rows.insert(0, "batch", number)
                yield rows.assign(a=None, b=None, n=None, ends=None, links=None)
                yield pd.DataFrame([dict.fromkeys(names) | {"batch": number} | made])
                number += 1
        release()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, BATCH)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, count (links of the corpus that hold the pair) and best (whether no pair with that b has more), of a, b and n."""
    counts = materialize(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(documents: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its B id), count_sum (of the links' pairs) and
    groups_sha256 of every document."""
    batches = materialize(aligned_batches(documents, a_path, b_path, batch_chars), "aligned")
    pairs = batches.where("a is not null").select("batch", F.posexplode(F.arrays_zip("a", "b", "n")).alias("at", "p")).select("batch", "at", "p.a", "p.b", "p.n")
    known = pairs.join(pair_counts(pairs), ["a", "b"]).select(F.col("batch").alias("own"), "at", "count", "best")

    def look_up(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        table = rows[rows["ends"].notna()].iloc[0]
        docs = rows[rows["ends"].isna()]
        count, best = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        count[counts["at"]] = counts["count"]
        best[counts["at"]] = counts["best"]
        ends, links = np.append(0, table["ends"]).astype(np.int64), np.asarray(table["links"], np.int64)
        each = [np.diff(np.append(0, np.cumsum(x[links]))[ends]) for x in (best, count)]
        out = docs[COUNTED].copy()
        for name, own in zip(("n_best", "count_sum"), each, strict=True):
            out[name] = [int(own[np.asarray(w, np.int64)].sum()) for w in docs["words"]]
        return out[[c.split()[0] for c in RESULT.split(", ")]]

    return batches.groupBy("batch").cogroup(known.groupBy("own")).applyInPandas(look_up, RESULT)
