"""Stretches that token files cut and remember by the bytes of a whole batch."""

import cProfile
import json
import pstats
import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import token_files
from quarry.llm.words import Cuts

CONFIG = open(token_files.TOKENIZER_PATH, encoding="utf-8").read()
LETTERS = ["a", "Z", "é", "×", "ſ", "ƀ", "日", "1", "'s", "'", " ", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u2028", "\u3000", "\u200b", "🙂"]
MARKS = [".", ",", "-", "$", "_", "|", "<|endoftext|>", "<|", "|>", "endoftext"]


def odd(seed, n=400):
    r = random.Random(seed)
    return ["".join(r.choices(LETTERS + MARKS, k=r.choice((0, 1, 2, 3, 8, 40)))) for _ in range(n)]


def same(encoder, own):
    assert encoder.encode(own) == [encoder.whole(t) for t in own]


@pytest.mark.parametrize("width", [2, 4])
def test_batches_of_odd_texts(width):
    encoder = token_files.Encoder(CONFIG, width)
    for seed in range(6):
        same(encoder, odd(seed))
    same(encoder, [])
    same(encoder, ["", ""])


def test_stretches_begin_where_characters_say():
    cuts = Cuts(CONFIG)
    own = odd(9)
    data, ends = "".join(own).encode(), np.cumsum([0, *(len(t.encode()) for t in own)])
    want = set()
    for text, at in zip(own, ends.tolist(), strict=False):
        for k, c in enumerate(text):
            white = lambda x: x.isspace() or x == "\u180e"
            between = c in " \n" and 0 < k < len(text) - 1 and not white(text[k - 1]) and not white(text[k + 1])
            mark = c in ".,-$_" and k and (text[k - 1].isascii() and text[k - 1].isalpha() or text[k - 1] in "éſ")
            if k == 0 or between or mark:
                want.add(at + len(text[:k].encode()))
    assert set(cuts.starts(np.frombuffer(data, np.uint8), ends).tolist()) == want


def test_added_tokens_are_not_cut():
    config = json.loads(CONFIG)
    config["added_tokens"].append(config["added_tokens"][0] | {"id": 50257, "content": "a-b\nc"})
    encoder = token_files.Encoder(json.dumps(config), 2)
    own = ["xa-b\ncd", "a-b", "b\nc", "a-b\nc a-b\nc", "no-thing, here", *odd(3)]
    assert 50257 in np.frombuffer(encoder.encode(own)[0], "<u2")
    same(encoder, own)


def test_slices_nulls_and_small_batches(monkeypatch):
    monkeypatch.setattr(token_files, "BATCH_BYTES", 50)
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 7)
    encoder = token_files.Encoder(CONFIG, 2)
    own = [None, *odd(4), None, "x" * 500, ""]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.record_batch([pa.array(range(len(own) + 1)), pa.array(["before", *own], kind)], ["doc_id", "text"]).slice(1)
        got = [(i, ids) for doc_ids, texts in token_files._bounded([batch, batch.slice(0, 0)]) for i, ids in zip(doc_ids, encoder.encode(texts), strict=True)]
        assert got == [(i + 1, encoder.whole(t or "")) for i, t in enumerate(own)]


def test_python_calls_do_not_grow_with_stretches():
    """Work a stretch is the arrays' and the library's (round 3: too many CPU seconds a GB)."""
    encoder, r = token_files.Encoder(CONFIG, 2), random.Random(1)
    words = ["".join(r.choices("abcdefgh", k=6)) + r.choice(["", ".", ",", "$$"]) for _ in range(20_000)]
    text = "\n".join(" ".join(words[k : k + 5]) for k in range(0, len(words), 5))
    profile = cProfile.Profile()
    got = profile.runcall(encoder.encode, [text])
    assert pstats.Stats(profile).total_calls < 2_000
    assert got == [encoder.whole(text)]
    assert len(encoder.known) <= len({w.strip(".,$") for w in words}) * 2 + 4  # words after a space or a line end, whatever marks follow, and marks
