"""Texts cut into stretches that tokenizers treat independently of each other, so that a stretch's tokens can be remembered.

A byte-level BPE with the usual pattern begins a new pre-token at a space that stands between two characters other than white space, and no
piece of common SentencePiece models has such a space inside. So the tokens of a text are those of its stretches in a row.
"""

from __future__ import annotations

import itertools
import json
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np

# U+180E was white space in older versions of Unicode; all else that any library calls white space Python does too.
_CUT = re.compile("(?<=[^\\s\u180e]) (?=[^\\s\u180e])")
_LINE = re.compile("(?<=[^\\s\u180e])\n(?=[^\\s\u180e])")


# White space by its number of bytes in UTF-8, as numbers; which bytes are letters; the kinds of bytes that may begin a stretch.
_WIDE = {n: [int.from_bytes(b) for c in range(0x3001) if (chr(c).isspace() or c == 0x180E) and len(b := chr(c).encode()) == n] for n in (1, 2, 3)}
_WHITE = np.isin(np.arange(256), _WIDE[1])
_LETTER = np.isin(np.arange(256), list(string.ascii_letters.encode()))
_BETWEEN, _MARK = 1, 2


# Members of tokenizer files that say that stretches are independent.
_PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def cut(text: str) -> list[str]:
    """The stretches; joined by single spaces they are the text."""
    parts = text.split()
    return parts if len(parts) == text.count(" ") + 1 and " ".join(parts) == text and "\u180e" not in text else _CUT.split(text)


def lines(text: str) -> list[str]:
    """The text cut at single line ends between two characters other than white space; a byte-level BPE makes them tokens of their own."""
    return _LINE.split(text) if "\n" in text else [text]


def independent(config: str) -> bool:
    """Whether a tokenizer file (JSON) makes stretches independent."""
    c = json.loads(config)
    plain = all(" " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in c["added_tokens"])
    model = c["model"]
    return plain and c["normalizer"] is None and c["post_processor"] is None and c["pre_tokenizer"] == _PRE_TOKENIZER and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")


class Cuts:
    """Where a byte-level BPE's stretches begin, told from the bytes of many texts at once: at a single space or line end between two characters
    other than white space, and at a mark after a Latin letter. What begins a stretch belongs to it. Characters of added tokens begin none."""

    def __init__(self, config: str):
        added = "".join(t["content"] for t in json.loads(config)["added_tokens"])
        self.kind = np.zeros(256, np.uint8)
        for kind, characters in ((_BETWEEN, " \n"), (_MARK, string.punctuation.replace("'", ""))):  # an apostrophe may begin a contraction
            self.kind[[ord(c) for c in characters if c not in added]] = kind

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First bytes of the stretches of texts in UTF-8 that lie between offsets."""
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        kinds = self.kind[data]
        at = np.flatnonzero(kinds)
        at = at[~first[at]]
        mark = kinds[at] == _MARK
        between, mark = at[~mark], at[mark]
        between = between[~first[between + 1]]
        before, after = data[between - 1], data[between + 1]
        kept = ~(_WHITE[before] | _WHITE[after])
        wide = np.flatnonzero(kept & ((before >= 0x80) | (after >= 0x80)))
        for n in (2, 3):
            kept[wide] &= ~(np.isin(_number(data, between[wide] - n, n), _WIDE[n]) | np.isin(_number(data, between[wide] + 1, n), _WIDE[n]))
        last, lead = data[mark - 1], data[mark - 2]
        latin = (last >= 0x80) & ((lead == 0xC3) & (last != 0x97) & (last != 0xB7) | (lead == 0xC4) | (lead == 0xC5))  # U+00C0 to U+017F but two signs
        first[between[kept]] = True
        first[mark[_LETTER[last] | latin]] = True
        return np.flatnonzero(first[:-1])


def _number(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """So many bytes from each place on as one number; beyond an end those of the other end, which complete no character."""
    return sum(data.take(at + k, mode="wrap").astype(np.int64) << 8 * (n - 1 - k) for k in range(n))


def unknown(stretches: Iterable[list[str]], known: dict) -> list[str]:
    """The distinct stretches that are not known yet."""
    return list(set(itertools.chain.from_iterable(stretches)).difference(known))


def blocks(parts: list[str], chars: int = 20_000) -> Iterator[list[str]]:
    """The stretches in runs of about so many characters, to be tokenized together."""
    run, size = [], 0
    for part in parts:
        run.append(part)
        size += len(part) + 1
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def last_bytes(parts: list[str]) -> np.ndarray:
    """Where each stretch ends in the bytes of all, each with a space before it."""
    return np.cumsum([len(p.encode()) + 1 for p in parts])


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 characters are themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def token_bytes(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; a special token's are its text."""
    letters = byte_of_letter()
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return out
