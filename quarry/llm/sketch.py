"""Document fingerprints by a threshold-scaled sketch.

Every shingle of ``WIDTH`` bytes is hashed; a sketch keeps all hashes below a fixed fraction of the hash range. So the sketch
of a union is the union of sketches, and shares of kept hashes estimate containment however unequal the texts are. The
fingerprint is a hash of the whole text and the kept hashes in ascending order, as text.

The likeness of two fingerprints is the estimated containment of the smaller in the larger: kept hashes in both over those of
the smaller sketch. Where one of them has kept no hash, it is 1 for equal texts and else 0.

Defined cases: a null text counts as empty; equal texts have equal fingerprints; texts shorter than a shingle keep none; the
next document is by descending doc_id (nulls last, ties by descending text), the last one's next is the first, a single one is its
own next; repeated rows are documents of their own; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 8
#: One hash in so many is kept.
SCALE = 4
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SLICE = 1 << 18


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _SLICE + 256), _powers(_INVERSE, _SLICE + 256)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a polynomial hash over all bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def rolling(text: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` bytes (at most _SLICE bytes of text)."""
    n = len(text) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _UP[: len(text)], out=sums[1:])
    return mixed((sums[width:] - sums[:n]) * _DOWN[:n])


def sketch(text: bytes, width: int = WIDTH, scale: int = SCALE) -> np.ndarray:
    """The kept hashes, distinct and ascending, as their high 32 bits below the threshold."""
    data = np.frombuffer(text, np.uint8)
    most = np.uint64((1 << 64) // scale)
    kept = []
    for i in range(0, max(1, len(data) - width + 1), _SLICE - width):
        h = rolling(data[i : i + _SLICE], width)
        kept.append(h[h < most])
    return np.unique((np.concatenate(kept) >> np.uint64(24)).astype(np.uint64))


def fingerprint(text: bytes, kept: np.ndarray) -> str:
    """The text's hash and its kept hashes (five bytes each), printable."""
    packed = kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    return f"{xxhash.xxh3_128_hexdigest(text)}:{base64.b64encode(packed).decode()}"


def read_fingerprint(text: str) -> np.ndarray:
    packed = np.frombuffer(base64.b64decode(text.split(":", 1)[1]), np.uint8).reshape(-1, 5)
    return np.concatenate([np.zeros((len(packed), 3), np.uint8), packed], axis=1).reshape(-1).view(">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray, equal: bool) -> float:
    if equal:
        return 1.0
    small = min(len(a), len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / small if small else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the start of another."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class _Rows:
    """Gathers result rows and gives them out in batches."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str, own: tuple, following: str, following_own: tuple) -> None:
        new = edited(text, following)
        raw = new.encode()
        kept = sketch(raw)
        self.rows.append((doc_id, len(text), hashlib.sha256(raw).hexdigest(), own[1], made := fingerprint(raw, kept), likeness(own[0], kept, own[1] == made), likeness(own[0], following_own[0], own[1] == following_own[1])))
        self.size += len(own[1]) + len(made)

    def give(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in OUT.split(", ")])


def _print(text: str) -> tuple[np.ndarray, str]:
    raw = text.encode()
    kept = sketch(raw)
    return kept, fingerprint(raw, kept)


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows but the last of each part, whose next row lies in another part. Rows come sorted by part."""
    held, out = None, _Rows()
    for batch in batches:
        for part, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            now = (part, doc_id, text, _print(text))
            if held is not None and held[0] == part:
                out.add(*held[1:], text, now[3])
            held = now
            if out.size > 4_000_000:
                yield out.give()
    if out.rows:
        yield out.give()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's last row and first text."""
    part = first = last = None

    def give() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), last.column(1), last.column(2), pa.array([first], pa.string())], ["part", "doc_id", "text", "first"])

    for batch in batches:
        parts = batch.column(0).to_pylist()
        for i, p in enumerate(parts):
            if p != part:
                if part is not None:
                    yield give()
                part, first = p, batch.column(2)[i].as_py()
            if i + 1 == len(parts) or parts[i + 1] != p:
                last = batch.slice(i, 1)
    if part is not None:
        yield give()


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = _Rows()
        for doc_id, text, following in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            out.add(doc_id, text, _print(text), following, _print(following))
        if out.rows:
            yield out.give()


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """The columns of OUT for every document, its edited text and its next document.

    Parts are ranges of doc_id between a bounded number of quantiles, found once; where many quantiles fall on one doc_id, or
    many rows have none, quantiles of the text's first bytes divide its rows. One range shuffle of the parts puts neighbours together; the
    last row of each part meets the first text of the next in a small join over one row a part, which reads the same shuffle again.
    """
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    at = F.percentile_approx("doc_id", [i / (4 * n) for i in range(1, 4 * n)], 10 * n)
    every, named, cuts = rows.agg(F.count("*"), F.count("doc_id"), at).first()
    cuts = sorted(cuts or [], reverse=True)
    above, same = F.array(*[F.lit(c) for c in cuts]).cast("array<long>"), F.col("doc_id")
    # how many cuts lie above the row: cuts descend, so parts ascend as doc_id descends
    part = F.coalesce(F.size(F.filter(above, lambda c: c > same)), F.lit(0)) + F.when(same.isNull(), len(cuts) + 1).otherwise(0)
    shares = {c: k for c, k in Counter(cuts).items() if k > 1} | ({None: 4 * n * (every - named) // every + 1} if every > named else {})
    if shares:  # at most 4 n cuts in all, of documents without an id and of ids with more than one part's rows
        start = F.conv(F.rpad(F.hex(F.substring(F.encode("text", "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
        of_many = rows.where(same.isNull() | same.isin([c for c in shares if c is not None]))
        found = of_many.groupBy("doc_id").agg(F.percentile_approx(start, [i / (4 * n) for i in range(1, 4 * n)], 10 * n)).collect()
        inner = F.lit(0)
        for c, at in found:
            own = F.array(*[F.lit(at[i * (4 * n - 1) // shares[c]]) for i in range(1, shares[c])]).cast("array<long>")
            inner = F.when(same.eqNullSafe(F.lit(c).cast("long")), F.size(F.filter(own, lambda x: x > start))).otherwise(inner)
        part = part + inner
    rows = rows.withColumn("part", part.cast("int"))
    order = ["part", F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    ordered = rows.repartitionByRange(n, "part").sortWithinPartitions(*order).select("part", "doc_id", "text")
    inside = ordered.mapInArrow(_inside, OUT)
    ends = ordered.mapInArrow(_ends, "part int, doc_id long, text string, first string")
    parts = sorted(r[0] for r in rows.select("part").distinct().collect())  # at most 4 n + 1 and as many numbers for nulls
    if not parts:
        return inside
    following = F.element_at(F.create_map(*[F.lit(x) for kv in zip(parts, [*parts[1:], parts[0]], strict=True) for x in kv]), F.col("part"))
    firsts = ends.select(F.col("part").alias("following"), "first")
    paired = ends.select(following.alias("following"), "doc_id", "text").join(firsts, "following").select("doc_id", "text", "first")
    return inside.unionByName(paired.mapInArrow(_edges, OUT))
