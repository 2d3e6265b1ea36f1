"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once; at each position its output links give every piece that ends
there, and a Viterbi pass relaxes the best score with them, the longest piece first. Characters that no piece reaches become
unknown and, with byte fallback, their bytes. No piece of common models runs across the start of a word, so the best path of a
text is that of its words in a row; words are cached per worker. Decoding puts the pieces' bytes together again.

The vocabulary file is a parameter; its bytes travel with the task, so executors need no local file. A model of type BPE is read
by its pieces and scores as well: the result is then the segmentation of highest total score, not that of greedy merges.

Defined cases: null and empty texts have no tokens and decode to an empty text; repeated rows are encoded each; lone
surrogates cannot occur in Parquet text; other columns are kept by ``encode_column`` and left out of ``encode``.
"""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import map_batches

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Fixed values of the model format: piece types, and how far below the least score an unknown character counts.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
CACHE = 150_000


def _fields(data: bytes):
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {kind} in a model file")
        yield key >> 3, value


@dataclass
class Vocabulary:
    pieces: list[tuple[str, float, int]]
    dummy_prefix: bool = True
    trim_spaces: bool = True
    byte_fallback: bool = False

    @staticmethod
    def parse(data: bytes) -> Vocabulary:
        out = Vocabulary([])
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                out.pieces.append((got.get(1, b"").decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
            elif number == 2:
                out.byte_fallback = bool(dict(_fields(value)).get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported: only the identity normaliser is")
                out.dummy_prefix, out.trim_spaces = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        return out


class Tokenizer:
    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        scores = [s for _, s, kind in v.pieces if kind == NORMAL]
        most, least = max(scores, default=0.0), min(scores, default=0.0)
        self.unknown_score = least - UNKNOWN_PENALTY
        self.unknown_id = next((i for i, p in enumerate(v.pieces) if p[2] == UNKNOWN), 0)
        self.automaton = ahocorasick.Automaton()
        self.byte_ids: dict[int, int] = {}
        self.raw: list[bytes] = []
        self.cut_words = True
        letters: set[str] = set()
        for i, (piece, score, kind) in enumerate(v.pieces):
            if kind in (NORMAL, USER_DEFINED) and piece:
                self.automaton.add_word(piece, (len(piece), len(piece) * most - 0.1 if kind == USER_DEFINED else score, i))
                letters.update(piece)
                self.cut_words &= SPACE not in piece.lstrip(SPACE)
            if kind == BYTE:
                self.byte_ids[int(piece[1:-1], 16)] = i
            self.raw.append(bytes([int(piece[1:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else piece.replace(SPACE, " ").encode())
        self.automaton.make_automaton()
        # A character that no piece has is a boundary by itself; line ends are the common one.
        line = "" if "\n" in letters else "\n"
        self.words = re.compile(rf"{SPACE}*[^{SPACE}{line}]+|{SPACE}+|\n") if self.cut_words else re.compile(r".+", re.S)
        self.cache: dict[str, tuple[int, ...]] = {}

    def normalize(self, text: str) -> str:
        if self.vocabulary.trim_spaces:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.vocabulary.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE)

    def viterbi(self, text: str) -> tuple[int, ...]:
        """The ids of the best-scoring segmentation; of equal ones, that whose last piece is longest."""
        n = len(text)
        best = [float("-inf")] * (n + 1)
        best[0] = 0.0
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        unknown, at, single = self.unknown_score, 0, False
        for last, (length, score, piece) in self.automaton.iter(text):
            end = last + 1
            while at + 1 < end:  # the characters passed end here: settle them before later ones build on them
                if not single and best[at] + unknown > best[at + 1]:
                    best[at + 1], back[at + 1] = best[at] + unknown, (at, -1)
                at, single = at + 1, False
            start = end - length
            if length == 1:
                single = True
            if best[start] + score > best[end]:
                best[end], back[end] = best[start] + score, (start, piece)
        while at < n:
            if not single and best[at] + unknown > best[at + 1]:
                best[at + 1], back[at + 1] = best[at] + unknown, (at, -1)
            at, single = at + 1, False
        out: list[int] = []
        end = n
        while end:
            start, piece = back[end]
            if piece >= 0:
                out.append(piece)
            elif self.vocabulary.byte_fallback and self.byte_ids:
                out.extend(self.byte_ids[b] for b in reversed(text[start:end].encode()))
            else:
                out.append(self.unknown_id)
            end = start
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        cache, add = self.cache, out.extend
        for word in self.words.findall(self.normalize(text)):
            ids = cache.get(word)
            if ids is None:
                ids = self.viterbi(word)
                if len(word) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[word] = ids
            add(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; invalid bytes become replacement characters."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.vocabulary.dummy_prefix and text.startswith(" ") else text


_loaded: dict[str, Tokenizer] = {}


def load(data: bytes) -> Tokenizer:
    key = hashlib.sha256(data).hexdigest()
    if key not in _loaded:
        _loaded[key] = Tokenizer(Vocabulary.parse(data))
    return _loaded[key]


def encode_column(frame: DataFrame, keep: list[str], text: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """The kept columns with n_tokens, token_ids and round_trip (whether decoding gives the normalised text back)."""
    with open(model_path, "rb") as file:  # on the driver; executors get the bytes
        model = file.read()
    chosen = frame.select(*keep, text) if text not in keep else frame.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keep).schema.fields), "n_tokens int, token_ids array<int>, round_trip boolean"])
    names = [*keep, "n_tokens", "token_ids", "round_trip"]

    def compute(batch: pa.RecordBatch) -> list:
        tokenizer = load(model)
        offsets, parts, same = [0], [], []
        for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
            ids = tokenizer.encode(t) if t else []
            back = tokenizer.decode(ids)
            wanted = tokenizer.normalize(t or "").replace(SPACE, " ")
            same.append(back == (wanted[1:] if tokenizer.vocabulary.dummy_prefix else wanted) or back == (t or ""))
            parts.append(np.array(ids, np.int32))
            offsets.append(offsets[-1] + len(ids))
        ids = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.concatenate(parts)))
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(np.diff(np.array(offsets)).astype(np.int32)), ids, pa.array(same)], names)

    return map_batches(chosen, compute, schema)


def encode(documents: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    return encode_column(documents, ["doc_id"], "text", model_path)


def decode(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id and text of encoded rows."""
    with open(model_path, "rb") as file:
        model = file.read()

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer = load(model)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([tokenizer.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "token_ids"), compute, "doc_id long, text string")
