"""Token files and alignments against the libraries on whole texts."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarry.llm import alignment, token_files
from quarry.llm.words import byte_of_letter, cut, lines

ODD = [
    None, "", " ", "a", "a  b", " a", "a ", "a\n b", "x <s> y", "<|endoftext|> b", "say<|endoftext|>", "a▁b x", "é ́x", "\t\ta b", "a᠎ b", "a  b", "\x00 a", "a\x1c b", "日本語 テキスト",
    "a   b  c", "1 2  3\n\n 4", "​ a", "ﬁ x", "x" * 3000 + " y", "end.\nNext, word; it's x", "a\r\nb", "the the the " * 400, "\n", "\nword\nword\n", "don't-stop (now)!", "Straße, naïve. ĀŽſ",
]


def texts(seed=1):
    r = random.Random(seed)
    letters = "abcdeé ,.\n日 "
    return [*ODD, *("".join(r.choices(letters, k=r.randint(1, 80))) for _ in range(150))]


def frame(spark, own, ids=None):
    rows = [(i if ids is None else ids[i], t, "x", 5) for i, t in enumerate(own)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, n_tokens int").repartition(3)


def test_cut_and_lines_give_the_text_back():
    for t in texts():
        if t:
            assert " ".join(cut(t)) == t
            assert "\n".join(lines(t)) == t


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 5, 5, 9, 2**40], list(range(0, 100_000, 7)), [3] * 1000 + [10**9]])
def test_elias_fano(values):
    made = token_files.EliasFano.of(np.array(values, np.uint64))
    back, end = token_files.EliasFano.read(memoryview(made.to_bytes() + b"rest"), 0)
    assert end == len(made.to_bytes())
    assert back.all().tolist() == values
    assert [back.select(i) for i in range(len(values))][:2000] == values[:2000]
    if len(values) > 1000:
        assert len(made.to_bytes()) < len(values) * (2.6 + np.log2(max(values[-1] / len(values), 1))) / 8 + 64  # bits a number, with the samples
    with pytest.raises(IndexError):
        back.select(len(values))


def want_files(own):
    tokenizer = Tokenizer.from_file(token_files.TOKENIZER_PATH)
    at, out = 0, []
    for doc_id, text in own:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


@pytest.mark.parametrize("file_bytes", [token_files.FILE_BYTES, 300])
def test_round_trip(spark, file_bytes):
    own = texts()
    got = token_files.round_trip(frame(spark, own), file_bytes=file_bytes)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want_files(list(enumerate(own)))


def test_ids_that_are_null_negative_or_repeated(spark):
    own = ["a b", "c", "a b", None, "d e f", "g"]
    ids = [None, -5, 7, None, 7, 2**40]
    got = sorted(map(tuple, token_files.round_trip(frame(spark, own, ids)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, -5, 7, 7, 2**40]
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    assert sorted(r[3] for r in got) == sorted(r[3] for r in want_files(list(zip(ids, own, strict=True))))
    assert token_files.round_trip(frame(spark, own).limit(0)).count() == 0


def test_offsets_of_single_documents(spark, tmp_path):
    own = [t for t in texts() if t]
    path = f"file://{tmp_path}/files"
    token_files.write(frame(spark, own), path)
    tokenizer = Tokenizer.from_file(token_files.TOKENIZER_PATH)
    seen = 0
    for data in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect():
        file = token_files.TokenFile(bytes(data["content"]))
        for i in range(file.n_docs):
            assert file.document(i).tolist() == [*tokenizer.encode(own[file.doc_id(i)], add_special_tokens=False).ids, 2]
            seen += 1
    assert seen == len(own)
    with_ids = {r["doc_id"]: r["ids"] for r in token_files.read(spark, path, with_ids=True).collect()}
    assert with_ids[0] == [*tokenizer.encode(own[0], add_special_tokens=False).ids, 2]
    with pytest.raises(ValueError, match="token ids"):
        token_files.TokenFile(b"something else")


def brute_alignment(own):
    """Both libraries on the whole text, and a walk along the bytes."""
    a_side = Tokenizer.from_file(alignment.A_PATH)
    a_side.encode_special_tokens = True
    b_side, letters = sentencepiece.SentencePieceProcessor(model_file=alignment.B_PATH), byte_of_letter()
    b_bytes = lambda i: bytes([int(b_side.id_to_piece(i)[3:-1], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    counts, out = Counter(), {}
    for k, text in enumerate(own):
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        raw_a, raw_b = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in a], [b_bytes(i) for i in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            out[k] = (0, 0, [], [])
            continue
        at_a, at_b = [i for i, x in enumerate(raw_a) for _ in x], [j for j, x in enumerate(raw_b) for _ in x]
        links = sorted(set(zip(at_a, at_b, strict=True)))
        groups, i, j = [], 0, 0
        for at in range(1, len(whole) + 1):
            if at == len(whole) or (at_a[at] != at_a[at - 1] and at_b[at] != at_b[at - 1]):
                to_i, to_j = (len(a), len(b)) if at == len(whole) else (at_a[at], at_b[at])
                groups.append(",".join(map(str, a[i:to_i])) + "|" + ",".join(map(str, b[j:to_j])))
                i, j = to_i, to_j
        pairs = [(a[x], b[y]) for x, y in links]
        counts.update(pairs)
        out[k] = (len(a), len(b), groups, pairs)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return {
        k: (n_a, n_b, len(groups), len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for k, (n_a, n_b, groups, pairs) in out.items()
    }


@pytest.mark.parametrize("batch_chars", [alignment.BATCH_CHARS, 500])
def test_alignment(spark, batch_chars):
    own = texts(2) + texts(3)
    want = brute_alignment(own)
    assert sum(w[0] == 0 for w in want.values()) >= 6
    got = alignment.align(frame(spark, own), batch_chars=batch_chars).collect()
    assert {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in got} == want
    assert len(got) == len(own)


def test_forgetting_keeps_results(spark, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 30)
    monkeypatch.setattr(token_files, "REMEMBERED", 30)
    config, model = open(alignment.A_PATH, encoding="utf-8").read(), open(alignment.B_PATH, "rb").read()
    pair, fresh = alignment.Pair(config, model), alignment.Pair(config, model)
    encoder = token_files.Encoder(config, 2)
    for seed in range(5):
        own = texts(seed)
        rows, made = pair.batch(own)
        fresh.clear()
        again, anew = fresh.batch(own)
        assert rows["groups_sha256"].tolist() == again["groups_sha256"].tolist()
        assert all(made[k].tolist() == anew[k].tolist() for k in ("a", "b", "n"))
        assert [encoder.encode([t or ""])[0] for t in own] == [encoder.whole(t or "") for t in own]


def test_empty_alignment(spark):
    assert alignment.align(frame(spark, ["a"]).limit(0)).count() == 0
    got = alignment.align(frame(spark, [None, ""])).collect()
    assert [(r["n_a"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in got] == [(0, 0, 0, 0, "")] * 2
