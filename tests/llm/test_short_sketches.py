"""Likeness of short texts against the true containment of their shingles."""

import hashlib
import random

import numpy as np

from quarry.llm import sketch
from tests.llm.test_operators import words


def test_short_texts_keep_their_likeness():
    r, near, far, off = random.Random(3), [], [], []
    for n in range(30, 201):
        text, other = words(r, 60)[:n], words(r, 60)[:n]
        a, b, c = (t.encode() for t in (text, sketch.edited(text, other), other))
        grams = [{t[i : i + sketch.WIDTH] for i in range(len(t) - sketch.WIDTH + 1)} for t in (a, b)]
        true = len(grams[0] & grams[1]) / min(map(len, grams))
        got = sketch.likeness(sketch.sketch(a), sketch.sketch(b), a == b)
        near.append(got > 0)
        off.append(got - true)
        far.append(sketch.likeness(sketch.sketch(a), sketch.sketch(c), False))
    assert np.mean(near) > 0.97 and abs(np.mean(off)) < 0.1 and np.std(off) < 0.25 and np.mean(far) < 0.05
    assert np.mean([len(sketch.sketch(words(r, 9)[:15].encode())) > 0 for _ in range(200)]) > 0.8


def test_ids_of_many_rows_are_divided(spark):
    """A third of the rows without an id, a third with one id: the order of next documents holds across the parts."""
    r = random.Random(3)
    text = lambda: "".join(r.choice("abcdé ") for _ in range(r.randint(0, 40)))
    rows = [(None, text()) for _ in range(150)] + [(7, text()) for _ in range(150)] + [(i, text()) for i in range(100)]
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()), reverse=True)
    want = []
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        n = len(t) // 3
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()))
    got = sketch.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(x["doc_id"]), x["n_chars"], x["edited_sha256"]) for x in got) == sorted(want)
