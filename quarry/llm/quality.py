"""Quality classifier: a generalised additive model with pairwise interactions.

Training boosts shallow trees in turn over binned features, each tree only adding to one feature's lookup table (or to the
table of one pair of features), so the model is a base, a table per feature and a few tables per pair. Scoring looks the bins
of a text up and adds. Inputs are computed from the whole text alone.

Defined cases: a null text counts as empty; empty texts get the score of the empty feature row; repeated rows are scored each;
rows without a doc_id are never learnt from, and of rows that share one
only that of least features is; labels that are null are ignored, of several labels of one document the largest
counts; without labels of both kinds the score is the share of label 1 (0.5 with none). Other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, utf8

#: Labelled rows that the fit uses at most, those of smallest hash of doc_id.
MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.3
FOLDS = 5

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "newline", "non_ascii", "pipe", "bang", "marks", "other_marks",
    "entropy", "distinct_words", "top_word", "marked_words", "upper_words", "line_words", "repeated_lines", "short_lines", "ended_lines", "longest_word",
]

_MARKS = np.zeros(256, bool)
_MARKS[list(b"#$%&*@^~<>{}[]=_+\\/`")] = True
_OTHER = np.zeros(256, bool)
_OTHER[list(b".,;:?\"'()-")] = True
_MARK_BYTES = bytes(np.flatnonzero(_MARKS)) + b"!|"
_DROP_MARKS = {b: None for b in _MARK_BYTES}


def features(text: bytes) -> list[float]:
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts[counts > 0] / n
    words = text.split()
    m = max(1, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    short = sum(len(x) < 40 for x in lines)
    ended = sum(x.rstrip()[-1:] in b".!?:\"'" for x in lines)
    marked = sum(c for w, c in seen.items() if w[-1] in _DROP_MARKS or w[0] in _DROP_MARKS)
    upper = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper())
    return [
        np.log1p(n), np.log1p(len(words)), (n - counts[32] - counts[10]) / m, counts[65:91].sum() / n, counts[48:58].sum() / n, counts[32] / n, counts[10] / n,
        counts[128:].sum() / n, counts[124] / n, counts[33] / n, counts[_MARKS].sum() / n, counts[_OTHER].sum() / n, float(-(share * np.log2(share)).sum()),
        len(seen) / m, max(seen.values(), default=0) / m, marked / m, upper / m, np.log1p(len(words) / k), 1 - len(set(lines)) / k, short / k, ended / k,
        np.log1p(max(map(len, seen), default=0)),
    ]


@dataclass
class Model:
    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        bins = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)]
        for table, b in zip(self.tables, bins, strict=True):
            total += table[b]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g * g / (h + l2)


def _best_cut(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[int, float]:
    """The cut of ordered bins that gains most, and its gain; 0 if none."""
    if len(g) < 2:
        return 0, 0.0
    left_g, left_h = g.cumsum()[:-1], h.cumsum()[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = _gain(left_g, left_h, l2) + _gain(all_g - left_g, all_h - left_h, l2) - _gain(all_g, all_h, l2)
    gain[(left_h < least) | (all_h - left_h < least)] = 0
    at = int(gain.argmax())
    return (at + 1, float(gain[at])) if gain[at] > 0 else (0, 0.0)


def _tree(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> np.ndarray:
    """A tree of at most four leaves over ordered bins, as each bin's step."""
    out = np.zeros(len(g))
    first, _ = _best_cut(g, h, l2, least)
    edges = {0, len(g), first}
    for a, b in ((0, first), (first, len(g))):
        if b > a:
            cut, _ = _best_cut(g[a:b], h[a:b], l2, least)
            edges.add(a + cut)
    ordered = sorted(edges)
    for a, b in zip(ordered, ordered[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The cross-shaped tree over a pair's grid that gains most: its gain and each cell's step."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a = np.s_[:-1, :-1]
    parts = lambda c: (c[a], c[:-1, -1:] - c[a], c[-1:, :-1] - c[a], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[a])
    sums_g, sums_h = parts(cg), parts(ch)
    gain = sum(_gain(x, np.maximum(y, 0), l2) for x, y in zip(sums_g, sums_h, strict=True)) - _gain(cg[-1, -1], ch[-1, -1], l2)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    step = np.zeros_like(g)
    for k, at in enumerate((np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :])):
        step[at] = sums_g[k][i, j] / (max(sums_h[k][i, j], 0) + l2)
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 40, rate: float = 0.08, l2: float = 1.0, least: float = 1.0) -> Model:
    """Cyclic boosting on the logistic loss: each round visits every feature once with a small step, then the chosen pairs likewise."""
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4))
    model = Model(float(np.log(mean / (1 - mean))))
    if len(y) == 0 or y.min() == y.max():
        return model
    for i in range(x.shape[1]):
        model.cuts.append(np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])))
        model.tables.append(np.zeros(len(model.cuts[-1]) + 1))
    binned = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(model.cuts)]
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        for b, table in zip(binned, model.tables, strict=True):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)), l2, least)
            table += step
            total += step[b]
    for table in model.tables:
        model.coarse.append((np.arange(len(table)) * pair_bins // len(table)).astype(np.int64))
    coarse = [c[b] for c, b in zip(model.coarse, binned, strict=True)]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p, at = 1 / (1 + np.exp(-total)), coarse[i] * pair_bins + coarse[j]
        return tuple(np.bincount(at, v, pair_bins**2).reshape(pair_bins, pair_bins) for v in (y - p, p * (1 - p)))

    ranked = sorted(((-_quadrants(*grid(i, j), l2)[0], i, j) for i in range(len(coarse)) for j in range(i)))
    for _, i, j in ranked[:pairs]:
        model.pairs.append((i, j))
        model.pair_tables.append(np.zeros((pair_bins, pair_bins)))
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            step = rate * _quadrants(*grid(i, j), l2)[1]
            table += step
            total += step[coarse[i], coarse[j]]
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fits on at most ``max_rows`` labelled documents outside the held-out fold."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # the documented bound of the sample
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(batch.column(1)), pa.array([features(t) for t in utf8(batch.column(2))], pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    made = map_batches(rows.select("doc_id", F.col("quality").cast("double"), "text"), compute, "doc_id long, quality double, x array<double>")
    one = made.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("r")).select("doc_id", "r.quality", "r.x")  # of repeated rows one
    got = sorted(one.collect(), key=lambda r: r[0])  # at most max_rows small rows, in an order that reruns share
    return fit(np.array([r[2] for r in got]).reshape(len(got), len(FEATURES)), np.array([r[1] for r in got]))


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(np.array([features(t) for t in utf8(batch.column(2))]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_batches(documents.select("doc_id", held_out().alias("held_out"), "text"), compute, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model accepts, with all their columns."""
    columns = documents.columns
    schema = documents.schema

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(np.array([features(t) for t in utf8(batch.column(batch.schema.get_field_index("text")))]))
        return batch.filter(pa.array(s >= threshold))

    return map_batches(documents.select(*columns), compute, schema)
