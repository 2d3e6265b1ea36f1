"""Column functions on text: n-grams, signatures, similarity, keyword forms, vectors."""

from __future__ import annotations

import difflib
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType

NGRAM = 3
PERMUTATIONS = 100
DIMENSIONS = 64
#: Modulus of the slots' permutations; products with 28-bit hashes stay within 63 bits.
PRIME = 2**31 - 1


def ngrams(c: Column, n: int = NGRAM) -> Column:
    """The distinct character n-grams; a shorter text is one gram whole, an empty one none."""
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substr(c, i, F.lit(n))))
    return F.when(F.length(c) >= n, many).when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Exact similarity of two sets of grams; 0 where both are empty."""
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def slot_parameters(slots: int = PERMUTATIONS) -> list[tuple[int, int]]:
    """Multiplier and addend of each slot's permutation of the gram hashes, modulo ``PRIME``: powers of two generators."""
    return [(pow(48271, k + 1, PRIME), pow(69621, k + 1, PRIME)) for k in range(slots)]


def gram_hash(gram: Column) -> Column:
    """28 bits of the gram's MD5: a hash that any SQL engine has."""
    return F.conv(F.substr(F.md5(gram), F.lit(1), F.lit(7)), 16, 10).cast("long")


def signature(grams: Column, slots: int = PERMUTATIONS) -> Column:
    """The MinHash signature: in each slot the least permuted hash of the grams; empty for no grams.

    Each gram is hashed once, in the JVM; a batch then derives one slot of all its rows at a time, so its memory is a few
    numbers a gram, however long the texts are.
    """
    parameters = slot_parameters(slots)

    @F.pandas_udf(ArrayType(LongType()))
    def minima(hashes: pd.Series) -> pd.Series:
        sizes = hashes.map(lambda h: 0 if h is None else len(h)).to_numpy()
        full = np.flatnonzero(sizes)
        out = np.empty((len(full), slots), dtype=np.int64)
        if len(full):
            flat = np.concatenate([np.asarray(hashes.iloc[i], dtype=np.int64) for i in full])
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            for k, (a, b) in enumerate(parameters):
                out[:, k] = np.minimum.reduceat((flat * a + b) % PRIME, starts)
        made = [np.empty(0, dtype=np.int64)] * len(hashes)
        for row, i in enumerate(full):
            made[i] = out[row]
        return pd.Series(made, index=hashes.index, dtype=object)

    return minima.asNondeterministic()(F.transform(grams, gram_hash))  # so that no filter over the column runs it again


def estimated_jaccard(a: Column, b: Column) -> Column:
    """The share of equal slots; 0 where a signature is empty."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), same / F.size(a)).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def normalized_name(c: Column) -> Column:
    """Lower-case, without spaces and underscores, without a plural's last letters."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[ _]", ""), "s+$", "")


def column_part(c: Column) -> Column:
    """What stands before the first "=", trimmed; null without one."""
    return F.when(F.instr(c, "=") > 0, F.trim(F.substring_index(c, "=", 1)))


def value_part(c: Column) -> Column:
    """What stands after the first "=", trimmed; null without one."""
    return F.when(F.instr(c, "=") > 0, F.trim(F.substr(c, F.instr(c, F.lit("=")) + 1)))


def space_splits(c: Column) -> Column:
    """Both sides of every space of the text, trimmed, those that are not empty."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substr(c, i, F.lit(1)) == " ")
    sides = F.flatten(F.transform(at, lambda i: F.array(F.trim(F.substr(c, F.lit(1), i - 1)), F.trim(F.substr(c, i + 1)))))
    return F.filter(sides, lambda s: s != "")


def search_texts(c: Column) -> Column:
    """What a keyword is searched as: itself, the value of "column = value", and both sides of every space, each once."""
    value = F.filter(F.array(value_part(c)), lambda v: v.isNotNull() & (v != ""))
    return F.array_distinct(F.filter(F.concat(F.array(F.trim(c)), value, space_splits(F.trim(c))), lambda s: s != ""))


def one_line(c: Column) -> Column:
    return F.regexp_replace(c, r"[\r\n]+", "")


def fenced_block(c: Column, language: str = "sql") -> Column:
    """The inside of the first fenced block of a language; null without one."""
    return F.nullif(F.trim(F.regexp_extract(c, rf"(?is)```\s*{re.escape(language)}\s*(.*?)```", 1)), F.lit(""))


def nested_parentheses(text: str | None) -> list[str]:
    """The insides of all balanced parentheses, inner ones too, by where they open; then those of no pair are left out."""
    opened: list[int] = []
    found: list[tuple[int, str]] = []
    for i, c in enumerate(text or ""):
        if c == "(":
            opened.append(i)
        elif c == ")" and opened:
            start = opened.pop()
            found.append((start, text[start + 1 : i]))
    return [s for _, s in sorted(found)]


@F.pandas_udf(ArrayType(StringType()))
def parenthesized(texts: pd.Series) -> pd.Series:
    return texts.map(nested_parentheses)


def similarity_ratio(a: str | None, b: str | None) -> float:
    """Twice the matched characters over all; the order of the two counts."""
    return difflib.SequenceMatcher(None, a or "", b or "").ratio()


#: Second texts from this length on have frequent characters that count for less, which is left to the library; cells of one search.
LONG_TEXT, CELLS = 200, 2_000_000


def _matched(a: list[str], b: list[str]) -> np.ndarray:
    """How many characters of each pair of texts match: of all stretches at once the longest equal block, the first of equal ones, then what lies
    before and after it, as long as there are stretches left."""
    out = np.zeros(len(a), np.int64)
    widths = max(map(len, a), default=0), max(map(len, b), default=0)
    if not len(a) or not min(widths):
        return out
    x, y = (np.array([[ord(c) for c in t.ljust(w, "\0")] for t in own], np.int32) for own, w in ((a, widths[0]), (b, widths[1])))
    open_ = np.array([(k, 0, len(p), 0, len(q)) for k, (p, q) in enumerate(zip(a, b, strict=True)) if p and q], np.int64).reshape(-1, 5)
    while len(open_):
        pair, a_lo, a_hi, b_lo, b_hi = open_.T
        n, m = int((a_hi - a_lo).max()), int((b_hi - b_lo).max())
        places = np.arange(m)
        there = y[pair[:, None], np.minimum(b_lo[:, None] + places, y.shape[1] - 1)]
        inside = b_lo[:, None] + places < b_hi[:, None]
        run = np.zeros((len(open_), m), np.int32)
        size, at_a, at_b = (np.zeros(len(open_), np.int64) for _ in range(3))
        for i in range(n):
            own = x[pair, np.minimum(a_lo + i, x.shape[1] - 1)]
            same = (there == own[:, None]) & inside & (a_lo + i < a_hi)[:, None]
            shifted = np.zeros_like(run)
            shifted[:, 1:] = run[:, :-1]
            run = np.where(same, shifted + 1, 0)
            j = run.argmax(1)
            best = run[np.arange(len(run)), j]
            longer = best > size
            size, at_a, at_b = np.where(longer, best, size), np.where(longer, a_lo + i + 1 - best, at_a), np.where(longer, b_lo + j + 1 - best, at_b)
        np.add.at(out, pair, size)
        met = size > 0
        before = np.stack([pair, a_lo, at_a, b_lo, at_b], 1)[met]
        after = np.stack([pair, at_a + size, a_hi, at_b + size, b_hi], 1)[met]
        open_ = np.concatenate([before, after])
        open_ = open_[(open_[:, 1] < open_[:, 2]) & (open_[:, 3] < open_[:, 4])]
    return out


def similarity_ratios(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """``similarity_ratio`` of many pairs: equal pairs once, pairs of like lengths together."""
    pairs = list(zip(("" if p is None else p for p in a), ("" if q is None else q for q in b), strict=True))
    distinct = list(dict.fromkeys(pairs))
    made = {p: similarity_ratio(*p) for p in distinct if len(p[1]) >= LONG_TEXT or "\0" in p[0] + p[1]}
    short = sorted((p for p in distinct if p not in made), key=lambda p: (len(p[0]), len(p[1])))
    while short:
        widest = max(1, len(short[-1][0])) * max(1, max(len(p[1]) for p in short))
        run, short = short[: max(1, CELLS // widest)], short[max(1, CELLS // widest) :]
        matched = _matched([p for p, _ in run], [q for _, q in run])
        made |= {p: 2.0 * int(n) / (len(p[0]) + len(p[1])) if p[0] or p[1] else 1.0 for p, n in zip(run, matched, strict=True)}
    return np.array([made[p] for p in pairs])


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(similarity_ratios(a.tolist(), b.tolist()), dtype=float)


def edit_similarity(a: Column, b: Column) -> Column:
    """The native alternative to ``ratio``: one less the edit distance over the longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, 1 - F.levenshtein(a, b) / longer).otherwise(1.0)


def embed_text(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A unit vector of hashed character n-grams of the padded lower-case words: the offline embedder. Hashes are the first sixty bits of MD5, which
    SQL engines have too."""
    out = np.zeros(dimensions)
    for word in re.findall(r"\w+", (text or "").lower()):
        padded = f"<{word}>"
        for n in (3, 4):
            for i in range(max(1, len(padded) - n + 1)):
                h = int(hashlib.md5(f"{n}{padded[i : i + n]}".encode()).hexdigest()[:15], 16)
                out[h % dimensions] += 1.0 if h >> 59 else -1.0
    norm = np.linalg.norm(out)
    return out / norm if norm else out


@F.pandas_udf(ArrayType(DoubleType()))
def embedding(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The offline embedder; each distinct text of a batch is embedded once."""
    for texts in batches:
        made = {t: embed_text(t).tolist() for t in texts.unique()}
        yield texts.map(made)


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def template_variables(template: str) -> list[str]:
    """The {NAMES} of a template, in order, each once."""
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{([A-Za-z_][A-Za-z0-9_]*)\}(?!\})", template)))


def fill(template: str, **values: object) -> str:
    missing = [v for v in template_variables(template) if v not in values]
    if missing:
        raise KeyError(f"template variables without a value: {missing}")
    return re.sub(r"(?<!\{)\{([A-Za-z_][A-Za-z0-9_]*)\}(?!\})", lambda m: str(values[m[1]]), template)
