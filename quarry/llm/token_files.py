"""Token ids in binary files with Elias-Fano coded document boundaries.

A file holds a run of documents in the order of doc_id: a header, the ids of the documents and the ends of their token runs as two
Elias-Fano sequences, and all ids in one array of 16 or 32 bits. An Elias-Fano sequence keeps the low bits of its rising numbers packed
and the high parts as a unary bit vector, about 2 + log2(range / count) bits a number; places of every 256th set bit let ``select`` find
a document's offsets without decoding the others, so no table of 64-bit offsets is kept.

Documents are sorted by ranges, encoded and packed in batches; a file ends at about ``file_bytes``, whatever the size of a partition, and
goes out through Spark's text sink (one row a file, followed by one line feed), so any file system that Spark writes to will do. A file
knows how many ids its partition has before it; only one number a partition goes to the driver, for the start over all files.

Defined cases: null and empty texts have the end id only; null ids come first; rows that repeat a doc_id are documents of their own, in the
order of their texts' hashes; no rows give no documents; other columns are left out.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import delete_path, fresh_path, materialize, release
from quarry.llm.words import Cuts, independent, token_bytes

TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.json"
END_ID = 2
FILE_BYTES = 16_000_000
#: Texts are encoded so many bytes at a time, new stretches in texts of so many; so many stretches of at most LONGEST bytes are remembered.
BATCH_BYTES, BLOCK_BYTES = 4_000_000, 20_000
REMEMBERED, LONGEST = 600_000, 64
# Fixed values of the format: magic and version; the header's fields (width of an id, partition, file in it, documents, of them with null ids, ids, ids of the partition before it, least doc_id).
MAGIC = b"QTOK\x01"
HEADER = struct.Struct("<BIIQQQQq")
SEQUENCE = struct.Struct("<QQB")
SAMPLE = 256


class EliasFano:
    """A rising sequence of numbers from 0 on."""

    def __init__(self, n: int, top: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.width, self.low, self.high, self.samples = n, top, width, low, high, samples

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros((top >> width) + n + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return EliasFano(n, top, width, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.uint64))

    def select(self, i: int) -> int:
        """The i-th number: from the sampled set bit before it on, until as many set bits have passed as lie between."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        skip = at % 8
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 64], bitorder="little")[skip:])
            if len(ones) > left:
                place = byte * 8 + skip + int(ones[left])
                break
            left, byte, skip = left - len(ones), byte + 64, 0
        first, last = i * self.width, (i + 1) * self.width
        held = int.from_bytes(self.low[first // 8 : (last + 7) // 8].tobytes(), "little") >> (first % 8)
        return (place - i) << self.width | held & ((1 << self.width) - 1)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width).astype(np.uint64)
            out |= (bits << np.arange(self.width, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out.astype(np.int64)

    def to_bytes(self) -> bytes:
        return SEQUENCE.pack(self.n, self.top, self.width) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u8" if self.top >> 31 else "<u4").tobytes()

    @staticmethod
    def read(data: memoryview, at: int) -> tuple[EliasFano, int]:
        """(sequence, where it ends)."""
        n, top, width = SEQUENCE.unpack_from(data, at)
        at += SEQUENCE.size
        sizes = (n * width + 7) // 8, ((top >> width) + n + 1 + 7) // 8 if n else 0, -(-n // SAMPLE)
        wide = np.dtype("<u8" if top >> 31 else "<u4")
        low = np.frombuffer(data, np.uint8, sizes[0], at)
        high = np.frombuffer(data, np.uint8, sizes[1], at + sizes[0])
        samples = np.frombuffer(data, wide, sizes[2], at + sizes[0] + sizes[1])
        return EliasFano(n, top, width, low, high, samples), at + sizes[0] + sizes[1] + sizes[2] * wide.itemsize


def pack(doc_ids: list[int | None], runs: list[bytes], width: int, part: int, number: int, before: int) -> bytes:
    """A file of documents (null ids first, then rising) and their ids as bytes of ``width`` an id."""
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    ends = np.cumsum([len(r) // width for r in runs], dtype=np.int64)
    header = HEADER.pack(width, part, number, len(runs), len(doc_ids) - len(known), int(ends[-1]) if len(ends) else 0, before, least)
    return b"".join([MAGIC, header, EliasFano.of(np.array([d - least for d in known], np.uint64)).to_bytes(), EliasFano.of(ends).to_bytes(), *runs])


class TokenFile:
    """A file's documents by their place in it."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of token ids")
        view = memoryview(data)
        self.width, self.part, self.number, self.n_docs, self.n_null, self.n_ids, self.before, self.least = HEADER.unpack_from(view, len(MAGIC))
        self.docs, at = EliasFano.read(view, len(MAGIC) + HEADER.size)
        self.ends, at = EliasFano.read(view, at)
        self.ids = np.frombuffer(view, np.dtype(f"<u{self.width}"), self.n_ids, at)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.least + self.docs.select(i - self.n_null)

    def offsets(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        first, last = self.offsets(i)
        return self.ids[first:last]


class Encoder:
    """Texts to the bytes of their ids with the tokenizers library. A batch is cut into stretches by its bytes, of which each distinct one is looked
    up once; ids of stretches are remembered, up to REMEMBERED of them: then the half that was seen last stays."""

    def __init__(self, config: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_str(config), np.dtype(f"<u{width}")
        self.cuts = Cuts(config) if independent(config) else None
        self.sizes = np.array([len(b) for b in token_bytes(self.tokenizer.get_vocab(with_added_tokens=True))]) if self.cuts else None
        self.known = self.ids = pa.array([], pa.large_binary())
        self.seen, self.batch = np.zeros(0, np.int64), 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def together(self, parts: pa.Array) -> pa.Array:
        """The ids of stretches that each begin with a space or a line end between other characters, many in one text."""
        data, offsets = _buffers(parts)
        places = np.searchsorted(offsets, np.arange(0, len(data) + BLOCK_BYTES, BLOCK_BYTES))  # each block begins with a stretch
        runs, ends, n = [], [np.zeros(1, np.int64)], 0
        for start, end in itertools.pairwise(np.unique(np.minimum(places, len(parts))).tolist()):
            text = data[offsets[start] : offsets[end]].tobytes().decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            after, last = np.cumsum(self.sizes[ids]), offsets[start + 1 : end + 1] - offsets[start]
            at = np.searchsorted(after, last)
            if after[-1] != last[-1] or (after[at] != last).any():
                raise ValueError("stretches are not independent under this tokenizer")
            ends.append(n + at + 1)
            runs.append(ids)
            n += len(ids)
        return _binary(np.concatenate([np.zeros(0, self.kind), *runs]).view(np.uint8), np.concatenate(ends) * self.kind.itemsize)

    def learn(self, parts: pa.Array) -> np.ndarray:
        """Makes distinct stretches known that were not; where they stand among the known ones."""
        data, offsets = _buffers(parts)
        lead = data[offsets[:-1]]
        plain = np.flatnonzero((lead == 0x20) | (lead == 0x0A))
        data, offsets = _buffers(parts.take(pa.array(plain)))
        begins = np.zeros(len(data) + 3, bool)  # all in one text between others: both ends of a stretch must be cuts there
        begins[self.cuts.starts(np.concatenate([[0x78], data, [0x20, 0x78]]).astype(np.uint8), np.array([0, len(data) + 3]))] = True
        plain = plain[begins[offsets[:-1] + 1] & begins[offsets[1:] + 1]]
        rest = np.delete(np.arange(len(parts)), plain)
        alone = [self.whole(p.decode()) for p in parts.take(pa.array(rest)).to_pylist()]
        order, n = np.concatenate([plain, rest]), len(self.known)
        self.known = pa.concat_arrays([self.known, parts.take(pa.array(order))])
        self.ids = pa.concat_arrays([self.ids, self.together(parts.take(pa.array(plain))), pa.array(alone, pa.large_binary())])
        self.seen = np.append(self.seen, np.zeros(len(parts), np.int64))
        at = np.empty(len(parts), np.int64)
        at[order] = np.arange(n, n + len(parts))
        return at

    def places(self, parts: pa.Array) -> np.ndarray:
        """Where distinct stretches stand among the known ones, of which all are then."""
        at = pc.index_in(parts, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        at[new] = self.learn(parts.take(pa.array(new)))
        self.seen[at] = self.batch
        return at

    def forget(self) -> None:
        """Long stretches go, and of too many those that were not seen for longest."""
        kept = pc.binary_length(self.known).to_numpy() <= LONGEST
        if kept.sum() > REMEMBERED:
            kept[np.argsort(self.seen, kind="stable")[: len(kept) - REMEMBERED // 2]] = False
        if not kept.all():
            self.known, self.ids, self.seen = self.known.filter(pa.array(kept)), self.ids.filter(pa.array(kept)), self.seen[kept]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        if not self.cuts:
            return [self.whole(t) for t in (texts if isinstance(texts, list) else texts.to_pylist())]
        data, offsets = _buffers(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts)
        first = self.cuts.starts(data, offsets)
        parts = _binary(data, np.append(first, len(data))).dictionary_encode()
        self.batch += 1
        places = self.places(parts.dictionary)[parts.indices.to_numpy()]
        raw, ends = _buffers(self.ids.take(pa.array(places)))
        at = ends[np.searchsorted(first, offsets)].tolist()
        raw = raw.tobytes()
        self.forget()
        return [raw[start:end] for start, end in itertools.pairwise(at)]


def _buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a large column without nulls, and where each begins and the last one ends."""
    _, offsets, data = values.buffers()
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8), offsets - offsets[0]


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


_loaded: dict[str, Encoder] = {}


def load(config: str, width: int) -> Encoder:
    key = hashlib.sha256(config.encode()).hexdigest() + str(width)
    if key not in _loaded:
        _loaded[key] = Encoder(config, width)
    return _loaded[key]


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """doc_ids and texts of about BATCH_BYTES at a time."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        ends = _buffers(texts)[1][1:]
        start = 0
        while start < len(texts):
            end = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BATCH_BYTES)) + 1
            yield batch.column(0)[start:end].to_pylist(), texts[start:end]
            start = end


def write(documents: DataFrame, path: str, tokenizer_path: str = TOKENIZER_PATH, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Writes the ids of all documents, each with the end id after it, as files under a path, in the order of doc_id."""
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as file:  # on the driver; executors get the text
        config = file.read()
    width = 2 if max(Tokenizer.from_str(config).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
    end = end_id.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = load(config, width), TaskContext.get().partitionId()
        ids: list[int | None] = []
        runs: list[bytes] = []
        size = number = before = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack(ids, runs, width, part, number, before)], pa.binary())], ["file"])

        for doc_ids, texts in _bounded(batches):
            for doc_id, one in zip(doc_ids, encoder.encode(texts), strict=True):
                runs.append(one + end)
                ids.append(doc_id)
                size += len(runs[-1])
                if size >= file_bytes:
                    yield made()
                    before, number, size = before + size // width, number + 1, 0
                    ids, runs = [], []
        if runs:
            yield made()
        ids, runs = [], []
        release()

    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(n, *order, F.monotonically_increasing_id()).sortWithinPartitions(*order)  # copies of one row need not share a partition
    dealt.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of all files under a path: part, doc_id, before (ids of the partition before it), n_tokens, ids_crc32 (of the ids as
    little-endian 32-bit numbers) and, if asked for, ids."""
    names = ["part", "doc_id", "before", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                file = TokenFile(data.as_py())
                ends = file.ends.all()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                docs = [None] * file.n_null + (file.docs.all() + file.least).tolist()
                wide = file.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(np.full(len(ends), file.part)), pa.array(docs, pa.int64()), pa.array(starts + file.before), pa.array(ends - starts), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(wide.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)
        release()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "part long, doc_id long, before long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def with_starts(found: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of rows as ``read`` gives them, which should be written."""
    totals = sorted((r[0], r[1]) for r in found.groupBy("part").agg(F.sum("n_tokens")).collect())  # one a partition of the writer
    before = itertools.accumulate([n for _, n in totals], initial=0)
    parts = found.sparkSession.createDataFrame([(k, b) for (k, _), b in zip(totals, before, strict=False)], "part long, first long")
    return found.join(F.broadcast(parts), "part").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(documents: DataFrame, **how) -> DataFrame:
    """What the files of all documents say once read back; they are deleted then."""
    spark = documents.sparkSession
    path = fresh_path(spark, "tokens")
    write(documents, path, **how)
    found = materialize(read(spark, path), "read")
    delete_path(spark, path)
    return with_starts(found)
