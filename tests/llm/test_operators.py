"""The operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import base64
import hashlib
import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import ann, components, html_text, licenses, mixing, quality, sentencepiece, simhash, sketch, suffix, warc
from tests.oracle import connect, differences

WORD = "abcdeéß"


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(WORD) for _ in range(r.randint(2, 8))) for _ in range(n))


def documents(spark, rows, extra=False):
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return made.withColumn("fp", F.lit(1)).withColumn("block", F.lit("x")).withColumn("score", F.lit(0.5)) if extra else made


def corpus(seed=1, n=120):
    r = random.Random(seed)
    passages = [words(r, 60) for _ in range(4)]
    out = []
    for i in range(n):
        parts = [words(r, r.randint(0, 80))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, 100)
            parts += [p[a : a + r.randint(50, 400)] if r.random() < 0.6 else p, words(r, r.randint(0, 30))]
        out.append((i * 3, " ".join(parts), r.choice(["en", None]), r.choice(["s1", "s2", "s3", "é", None]), 0))
    out += [(1000, "a" * 5000, "en", "s1", 0), (1001, "ab" * 3000 + "x" + "ab" * 60, None, None, 0), (1002, "", "en", "s1", 0), (1003, None, None, "s2", 0), (1004, out[5][1], "en", "s1", 0), (None, out[6][1], "en", "s3", 0), (None, None, None, None, None)]
    out += [out[7], out[7], (1005, " ".join(["long"] * 30_000), "en", "s2", 0)]
    return out


# --- HTML ------------------------------------------------------------------------------------------------------------------
ARTICLE = "<p>First paragraph, with &lt;some&gt; text, long enough to count, and commas, really.</p><p>Second &amp; <b>bold</b> one,\n spread   over lines, for the score.</p>"
WANTED = "First paragraph, with <some> text, long enough to count, and commas, really.\nSecond & bold one, spread over lines, for the score."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("plain words", "plain words"),
        (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Menu</a></nav><article>{ARTICLE}</article><footer>&copy; foot</footer></body></html>", WANTED),
        (f"<body><header><h1>Site</h1></header><div id='content'>{ARTICLE}</div><div class='sidebar'><p>Other things, many, of them, here, and there, all around the page.</p></div><script>var t='</p>';</script></body>", WANTED),
        (f"<div class=main-content>{ARTICLE}<div class='ad'>Buy, buy, now, this is an advert, with commas.</div><form><p>Name, address, and so on, fill it in please.</p></form></div>", WANTED),
        (f"<article>{ARTICLE}<section id='comments'><p>I say, as a reader, that this, well, is long enough, too.</p></section></article>", WANTED),
        (f"<article>{ARTICLE}<div class='cookie-notice'>We use cookies, as everyone, does, so agree.</div></article>", WANTED),
        (f"<body class='has-sidebar'><div class='layout with-sidebar'><h1>Head</h1><div>{ARTICLE}</div><div class='widget'>w, w</div></div></body>", "Head\n" + WANTED),
        (f"<div role=main>{ARTICLE}<figure><img src=x><figcaption>A caption</figcaption></figure></div><div class='alert'>Down, soon.</div>", WANTED + "\nA caption"),
        ("<article><h1>Title &eacute;</h1><p><b>One<br><p>Two</p><p>Three", "Title é\nOne\nTwo\nThree"),
        (f"<body><div><div><div>{ARTICLE}</div></div></div><ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul></body>", WANTED),
        ("<!-- <p>no</p> --><p>yes &#8364; &#x41;</p>", "yes € A"),
        ("<table><tr><td>a cell of text, with commas, long enough to count<td>another cell, also long, with commas in it</table>", "a cell of text, with commas, long enough to count\nanother cell, also long, with commas in it"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


P = "A paragraph of prose, with commas, and long enough to count for its container."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<nav><a href=x>Home</a></nav><div class='ad'>Buy this.</div><footer>Copyright notice of the site</footer>", ""),
        (f"<article><p>{P}</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></article>", f"{P}\nOne\nTwo"),
        (f"<article><p>{P}</p><section id='related-work'><p>{P} Again.</p></section><div class='notice-period'><p>{P} Then.</p></div></article>", f"{P}\n{P} Again.\n{P} Then."),
        (f"<article><p>{P}</p></article><article><p>A second, short.</p></article>", f"{P}\nA second, short."),
        (f"<main><section><article><p>{P}</p><p>{P}</p></article></section><section><article><p>{P} Two.</p></article></section></main>", f"{P}\n{P}\n{P} Two."),
        (f"<article><div><p>{P}</p></div><div><p>{P} Two.</p></div><article class='comment'><p>{P} I say.</p></article></article>", f"{P}\n{P} Two."),
        (f"<div class='page-sidebar'><p>{P}</p></div><div id=c><div><p>{P}</p></div><div><p>{P} Two.</p></div></div><p class=notice>{P} Soon.</p>", f"{P}\n{P} Two."),
        (f"<ul><li><a>Home</a><li><a>News</a><li><a>About</a></ul><div><p>{P}</p><p>{P}</p></div>", f"{P}\n{P}"),
    ],
)
def test_only_furniture_is_left_out(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize(("up", "down"), [("<div>", "</span>"), ("<b>", "</i>"), ("<i><td>", "</div>")])
def test_time_is_linear_in_depth(up, down):
    took = []
    for n in (50_000, 100_000):
        began = time.process_time()
        assert html_text.main_text(up * n + P + down * n) == P
        took.append(time.process_time() - began)
    assert took[1] < 3.2 * took[0] + 0.3


def test_main_text_of_all_pages_matches_sql(spark):
    assert differences(html_text.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")), connect("/root/testdata/sf0.01"), html_text.oracle_sql()) == ""


def test_deep_and_broken_pages():
    deep = "<div>" * 20_000 + "<p>the text, deep down, in the page</p>"
    assert html_text.main_text(deep) == "the text, deep down, in the page"
    assert isinstance(html_text.main_text("<a href='" * 2000), str)
    assert html_text.main_text("<p>x <y z='1\">t</p>") is not None


def test_extract(spark):
    rows = spark.createDataFrame([(1, "u", f"<article>{ARTICLE}</article>"), (2, None, None), (2, None, None), (None, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(rows).collect()
    assert len(got) == 4 and {(r["page_id"], r["text"], r["n_chars"]) for r in got} == {(1, WANTED, len(WANTED)), (2, "", 0), (None, "", 0)}
    assert html_text.extract(rows.limit(0)).count() == 0


# --- quality ---------------------------------------------------------------------------------------------------------------
def test_quality_learns_and_generalises(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 40 and sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.93
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() < docs.count()


def test_quality_edge_cases(spark):
    docs = documents(spark, corpus(), True)
    labels = spark.createDataFrame([(0, 1, 0), (3, None, 0), (6, 0, 0), (6, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert quality.score(docs, model).count() == docs.count()
    none = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.train(docs, labels, max_rows=1) is not None


def test_model_is_additive():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only the pair tells
    model = quality.fit(x, y, pair_rounds=120)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9 and (1, 0) in model.pairs


# --- licences --------------------------------------------------------------------------------------------------------------
def test_license_query(spark):
    con = connect("/root/testdata/sf0.01")
    assert differences(licenses.of_documents(spark, "/root/testdata/sf0.01"), con, licenses.oracle_sql()) == ""


def test_license_inheritance(spark):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0"]
    files = [("a/LICENSE", mit), ("a/x.py", "code"), ("a/b/c/y.py", "code"), ("a/b/LICENSE", apache), ("a/b/z.py", f"code\n# {mit}\n" + " ".join(f"name{k}" for k in range(60))), ("q/r.py", None), ("ab/x.py", ""), (None, "text"), ("top.py", "t"), ("a/x.py", "code")]
    frame = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "id long, path string, text string").withColumn("license", F.lit("clash")).drop("license")
    got = {r["id"]: (r["license"], r["origin"]) for r in licenses.scan(frame).collect()}
    assert got[0] == ("MIT", "file") and got[1] == ("MIT", "inherited") == got[9] and got[2] == ("Apache-2.0", "inherited") and got[4] == ("MIT", "header")
    assert all(got[i] == (None, None) for i in (5, 6, 7, 8))
    assert licenses.scan(frame.limit(0)).count() == 0


LEAD = "Some code comes first, " + " ".join(f"name{k}" for k in range(40)) + ".\n\n"


@pytest.mark.parametrize(
    ("text", "license_", "origin"),
    [
        (lambda: "MIT License\n\nCopyright (c) 2021 Jane Doe\n\n" + licenses._MIT_GRANT + "\n\n" + licenses._MIT_NOTICE + "\n\n" + licenses._AS_IS[:60], "MIT", "file"),
        (lambda: "\n".join("# " + x for x in ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]) + "\n#\nimport os\n" + "value = compute(value)\n" * 30, "GPL-3.0", "header"),
        (lambda: LEAD + "// SPDX-License-Identifier: MIT\n\nint main;", "MIT", "header"),
        (lambda: LEAD + "# SPDX-License-Identifier: GPL-3.0-or-later\n", "GPL-3.0", "header"),
        (lambda: LEAD + "Copyright (c) 2021 Jane Doe. Released under the MIT License.\nx", "MIT", "header"),
        (lambda: LEAD + "The MIT License (MIT)\nx", "MIT", "header"),
        (lambda: LEAD + licenses._APACHE + licenses._APACHE_END + "\n\n" + "code here " * 40, "Apache-2.0", "header"),
        (lambda: "Copyright 2020, A. Writer\nAll rights reserved.\n\n" + " ".join([licenses._BSD_HEAD, licenses._BSD_TWO, licenses._BSD_THREE, licenses._BSD_END]), "BSD-3-Clause", "file"),
        (lambda: LEAD + "The licence of poets is to say what they like.", None, None),
        (lambda: "prose " * 60_000 + "\n\nReleased under the MIT License.", "MIT", "header"),
    ],
)
def test_real_notices_are_found(spark, text, license_, origin):
    rows = [(1, "p/x.txt", text())] + [(i, f"o{i}/x", f"plain words of file {i}, the code and the rest of it, to be the corpus") for i in range(2, 60)]
    got = {r["id"]: r for r in licenses.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert (got[1]["license"], got[1]["origin"]) == (license_, origin) and all(got[i]["license"] is None for i in range(2, 60))


def test_license_files_by_name_and_clashing_columns(spark):
    gpl = "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n" + "Everyone is permitted to do many other things that this long text says. " * 50
    rows = [(0, "a/COPYING", gpl), (1, "a/b/x.c", "int x;"), (2, "z/x.c", gpl), (3, "z/y.c", ""), (3, "z/y.c", "")]
    frame = spark.createDataFrame(rows, "id long, path string, text string")
    for c in ("license", "_file", "_dir", "_row", "dir", "own", "held", "rest", "word"):
        frame = frame.withColumn(c, F.lit("mine"))
    out = licenses.scan(frame)
    assert out.columns[-3:] == ["license_1", "origin", "score"] and set(frame.columns) - {"text"} <= set(out.columns)
    got = {r["id"]: (r["license_1"], r["origin"], r["license"], r["own"]) for r in out.collect()}
    assert got == {0: ("GPL-3.0", "file", "mine", "mine"), 1: ("GPL-3.0", "inherited", "mine", "mine"), 2: ("GPL-3.0", "header", "mine", "mine"), 3: (None, None, "mine", "mine")} and out.count() == 5


# --- WARC ------------------------------------------------------------------------------------------------------------------
def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i} y", "same <p>ü" if i % 7 == 0 else None if i % 11 == 0 else f"<p>{i}</p>" * 50) for i in range(300)] + [(None, None, "same <p>ü"), (5, "again", "<p>5</p>" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    warc.write_archives(pages, f"{tmp_path}/w", archive_bytes=2000)
    got = warc.read_archives(spark, f"{tmp_path}/w").collect()
    first = {}
    for i, _, h in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        first.setdefault((h or "").encode(), i)
    assert len(got) == len(rows) and all(r["gap_start"] is None for r in got)
    for r in got:
        if r["page_id"] is None:
            assert (r["record_type"], r["refers_to"]) == ("revisit", 0)
            continue
        payload = next((h or "").encode() for i, _, h in rows if i == r["page_id"])
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r["refers_to"] == (None if first[payload] == r["page_id"] else first[payload]) and (r["record_type"] == "response") == (r["refers_to"] is None)
        assert r["record_type"] == "revisit" or r["payload"] == payload
    assert len({r["archive"] for r in got}) > 3
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_salvage_logs_gaps_and_goes_on():
    records = [warc.record(i, f"http://x/{i}", b"pay%d" % i * 50, None, warc.digest(b"pay%d" % i * 50), False) for i in range(10)]
    members = [warc.member(x) for x in records]
    starts = np.cumsum([0, *map(len, members)])
    good = b"".join(members)
    bad = bytearray(good)
    bad[starts[4] + 40] ^= 255
    got = list(warc.salvage(bytes(bad)))
    assert [x.page_id for x in got if isinstance(x, warc.Record)] == [0, 1, 2, 3, 5, 6, 7, 8, 9]
    assert [x for x in got if not isinstance(x, warc.Record)] == [(starts[4], starts[5])]
    plain = b"".join(records[:3]) + b"WARC/1.1\r\ngarbage\r\n" + records[3] + records[4][:-30]
    got = list(warc.salvage(plain))
    assert [x.page_id for x in got if isinstance(x, warc.Record)] == [0, 1, 2, 3] and len([x for x in got if not isinstance(x, warc.Record)]) == 2
    cut = good[: starts[7] + 30]
    assert len([x for x in warc.salvage(cut) if isinstance(x, warc.Record)]) == 7
    assert list(warc.salvage(b"")) == [] and [x for x in warc.salvage(b"nothing here") if isinstance(x, warc.Record)] == []
    mixed = records[0] + members[1] + b"\x00" * 100 + records[2]
    assert [x.page_id for x in warc.salvage(mixed) if isinstance(x, warc.Record)] == [0, 1, 2]


# --- SimHash ---------------------------------------------------------------------------------------------------------------
def brute_fingerprint(text: str | None) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    own = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 4]) for i in range(max(1, len(own) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(nodes, near):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("limit", [simhash.BUCKET_LIMIT, 20])
def test_simhash(spark, limit):
    r = random.Random(3)
    rows = corpus(2, 60)
    base = [w for w in words(r, 400).split()]
    for i in range(40):  # a family of near copies
        own = list(base)
        own[r.randrange(len(own))] = "CHANGED"
        rows.append((2000 + i, "\t".join(own), "en", "s1", 0))
    rows += [(3000, "A\x0bb C", "en", "s1", 0), (3001, "a b c", "en", "s1", 0), (3002, " \n ", "en", "s1", 0)]
    got = simhash.near_duplicates(documents(spark, rows, True), limit=limit).collect()
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    assert sorted((str(x["doc_id"]), x["fingerprint"]) for x in got) == sorted((str(i), f"{p:016x}") for i, p in prints)
    label = brute_components(sorted({p for _, p in prints}), lambda a, b: (a ^ b).bit_count() <= 4)
    least: dict[int, int] = {}
    for i, p in prints:
        if i is not None:
            least[label[p]] = min(least.get(label[p], i), i)
    for x in got:
        assert x["component_id"] == least.get(label[int(x["fingerprint"], 16)])


def test_simhash_index_finds_all_links():
    rng = np.random.default_rng(5)
    centers = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([centers] + [centers ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(20)]))
    index = simhash.GrayIndex(np.zeros(len(fps), np.int64), fps)
    label = index.link(4, batch=64)
    want = brute_components(range(len(fps)), lambda a, b: (int(index.fp[a]) ^ int(index.fp[b])).bit_count() <= 4)
    assert [int(x) for x in label] == [want[i] for i in range(len(fps))]


def test_keep_one(spark):
    rows = corpus(4, 30)
    kept = simhash.keep_one(documents(spark, rows))
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1004 not in ids and ids.count(None) == 2 and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert simhash.near_duplicates(documents(spark, rows).limit(0)).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(7, 7)] + [(i, i + 1) for i in range(400, 460)]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    pairs = {frozenset(e) for e in edges}
    want = brute_components(sorted({n for e in edges for n in e}), lambda a, b: frozenset((a, b)) in pairs)
    assert all(want[n] == root for n, root in got.items()) and {n for e in edges for n in e if e[0] != e[1]} == set(got)


# --- mixing ----------------------------------------------------------------------------------------------------------------
def brute_targets(size_of: dict) -> dict:
    order = sorted((s for s in size_of if s is not None), key=lambda s: s.encode()) + ([None] if None in size_of else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(size_of.values()), set()
    while True:
        rest = total - sum(3 * size_of[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        share = rest / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * share >= 3 * size_of[s]}
        if not over:
            return {s: 3.0 * size_of[s] if s in capped else weight[s] * share for s in order}
        capped |= over


def test_mixing(spark):
    r = random.Random(9)
    rows = [(i, words(r, r.randint(0, 60)), "en", r.choice(["big"] * 30 + ["a", "b", "Ä", None]), 0) for i in range(1500)] + corpus(1, 10)
    docs = documents(spark, rows, True)
    got = mixing.plan(docs, block_words=700).collect()
    again = mixing.plan(docs.repartition(7), block_words=700).collect()
    key = lambda x: (str(x["doc_id"]), x["text_hash"], x["passes"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    size_of: dict = {}
    for _, t, _, s, _ in rows:
        size_of[s] = size_of.get(s, 0) + len((t or "").encode().split())
    want = brute_targets(size_of)
    taken: dict = {}
    for x in got:
        assert x["source_size"] == size_of[x["source"]] and abs(x["target"] - want[x["source"]]) < 1e-6 * max(1, want[x["source"]]) and 0 <= x["passes"] <= 3
        taken[x["source"]] = taken.get(x["source"], 0) + x["size"] * x["passes"]
    for s in size_of:
        own = [x["size"] for x in got if x["source"] == s]
        assert abs(taken[s] - want[s]) <= max(own) + 1
    mixed = mixing.mix(docs, shard_words=3000, block_words=700)
    assert mixed.columns == [*docs.columns, "shard", "position"]
    out = mixed.select("doc_id", "shard").collect()
    expect = [x["doc_id"] for x in got if x["size"] for _ in range(x["passes"])]
    assert sorted(map(str, (x["doc_id"] for x in out))) == sorted(map(str, expect))
    assert len({x["shard"] for x in out}) > 3
    assert mixing.plan(docs.limit(0)).count() == 0


def test_splitting_tree():
    counts = np.array([50, 3, 0, 20])
    leaves = [mixing.split_counts(counts, 7, i, 1) for i in range(7)]
    assert (sum(q for _, q in leaves) == counts).all()
    assert all((f == sum((q for _, q in leaves[:i]), np.zeros(4, int))).all() for i, (f, _) in enumerate(leaves))
    assert max(int(q.sum()) for _, q in leaves) - min(int(q.sum()) for _, q in leaves) <= 3


# --- sketches --------------------------------------------------------------------------------------------------------------
def test_fingerprints(spark):
    rows = corpus(6, 50)
    got = sketch.fingerprint_documents(documents(spark, rows, True)).collect()
    ordered = sorted(((i, t or "") for i, t, *_ in rows), key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1]), reverse=True)
    want = []
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        n = len(t) // 3
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()))
    assert sorted((str(x["doc_id"]), x["n_chars"], x["edited_sha256"]) for x in got) == sorted(want)
    by_text: dict = {}
    for x in got:
        t = next(t or "" for i, t, *_ in rows if i == x["doc_id"])
        if x["doc_id"] is not None:
            assert by_text.setdefault(t, x["fingerprint"]) == x["fingerprint"]
        assert 0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1
    long = [x for x in got if x["n_chars"] > 400]
    assert np.mean([x["near_edited"] for x in long]) > 0.5 > np.mean([x["near_next"] for x in long])
    assert sketch.fingerprint_documents(documents(spark, rows).limit(0)).count() == 0
    single = sketch.fingerprint_documents(documents(spark, [(1, "x" * 90, "en", "s", 0)])).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1.0


def test_sketch_estimates_containment():
    r = random.Random(8)
    big = words(r, 6000).encode()
    part = big[: len(big) // 4]
    a, b = sketch.sketch(big), sketch.sketch(part)
    assert sketch.likeness(a, b, False) > 0.95
    assert len(np.setdiff1d(sketch.sketch(big[:20_000]), a)) <= 1
    assert (sketch.read_fingerprint(sketch.fingerprint(big, a)) == a).all()
    grams = {big[i : i + sketch.WIDTH] for i in range(len(big) - sketch.WIDTH + 1)}
    assert abs(len(a) - len(grams) / sketch.SCALE) < 5 * (len(grams) / sketch.SCALE) ** 0.5
    sliced = big * 12  # longer than a slice: the same strings give the same hashes wherever they stand
    assert set(a) <= set(sketch.sketch(sliced))


# --- suffix arrays ---------------------------------------------------------------------------------------------------------
def test_collection_index():
    r = random.Random(1)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(40)] + [b"", b"\x00\xff\x00"]
    who, offset, prefix, before = suffix.collection_index(strings)
    want = sorted(((w, o) for w in range(len(strings)) for o in range(len(strings[w]) + 1)), key=lambda t: [c + 1 for c in strings[t[0]][t[1] :]] + [0, t[0]])
    assert list(zip(who.tolist(), offset.tolist(), strict=True)) == want

    def common(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    assert prefix.tolist() == [0] + [common(strings[a][b:], strings[c][d:]) for (a, b), (c, d) in zip(want, want[1:], strict=False)]
    assert before.tolist() == [strings[w][o - 1] + 1 if o else 0 for w, o in want]
    assert [len(x) for x in suffix.collection_index([])] == [0] * 4


def brute_repeats(rows):
    seen, out = set(), []
    for i, t in sorted(((i, (t or "").encode()) for i, t, *_ in rows if i is not None)):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - suffix.SPAN + 1):
            w = t[p : p + suffix.SPAN]
            if w in seen:
                gone[p : p + suffix.SPAN] = True
            else:
                seen.add(w)
        out.append((i, t, gone))
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 4000, "shard_bytes": 10_000}, {"block_bytes": 3000, "shard_bytes": 5000, "hot": 5}])
def test_repeats(spark, options):
    rows = [x for x in corpus() if x[0] is not None]
    got = suffix.repeats(documents(spark, rows, True), **options).collect()
    report = lambda i, t, gone: (i, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())
    assert sorted((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got) == sorted(report(*x) for x in brute_repeats(rows))


def test_repeats_edge_cases(spark):
    rows = corpus(3, 20)
    docs = documents(spark, rows)
    assert suffix.repeats(docs).count() == len(rows) and suffix.repeats(docs.limit(0)).count() == 0
    cut = suffix.remove_repeats(docs.withColumn("block", F.lit("own")).withColumn("raw", F.lit(1)))
    assert {(x["block"], x["raw"]) for x in cut.collect()} == {("own", 1)}
    cut = suffix.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.schema == docs.schema and cut.count() == len(rows)
    for x in cut.collect():
        assert x["n_chars"] == len(x["text"])
    text = "aé€b".encode()
    assert suffix.whole_characters(text, np.array([1, 1, 0, 1, 1, 1, 0], bool)) == "éb"


# --- SentencePiece ---------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer():
    with open(sentencepiece.MODEL_PATH, "rb") as f:
        return sentencepiece.load(f.read())


def brute_score(tokenizer, text: str) -> float:
    pieces = {p: s for p, s, kind in tokenizer.vocabulary.pieces if kind == sentencepiece.NORMAL}
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 20), end):
            if text[start:end] in pieces:
                best[end] = max(best[end], best[start] + pieces[text[start:end]])
        if text[end - 1] not in pieces:
            best[end] = max(best[end], best[end - 1] + tokenizer.unknown_score)
    return best[-1]


def test_viterbi_is_best(tokenizer):
    r = random.Random(1)
    for _ in range(60):
        text = tokenizer.normalize(" ".join("".join(r.choice("theandstinger") for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 6))))
        ids = tokenizer.viterbi(text)
        assert sum(tokenizer.vocabulary.pieces[i][1] for i in ids) == pytest.approx(brute_score(tokenizer, text))
        assert "".join(tokenizer.vocabulary.pieces[i][0] for i in ids) == text


def test_words_encode_as_the_whole(tokenizer):
    for text in ("the  words of a   text, one by one", "línea über 漢字\nnext\n\n line", "a", " ", "\n", "x" * 3000):
        whole = tokenizer.viterbi(tokenizer.normalize(text))
        assert tuple(tokenizer.encode(text)) == whole and tokenizer.decode(list(whole)) == text


@pytest.mark.parametrize("text", ["", " ", "plain", "  two  spaces ", "tabs\tand\nlines\r\n", "emoji 🎈 漢字 é́ ​", "▁ mark", "\x00\x01", "<s> </s> <unk>", "﻿bom"])
def test_round_trip(tokenizer, text):
    back = tokenizer.decode(tokenizer.encode(text))
    assert back == (text.replace("▁", " "))


def test_against_the_library_as_unigram(tokenizer):
    library = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    with open(sentencepiece.MODEL_PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    other = library.SentencePieceProcessor()
    other.LoadFromSerializedProto(model.SerializeToString())
    r, same, n = random.Random(4), 0, 0
    for _ in range(200):
        text = " ".join("".join(r.choice("theandstinger") for _ in range(r.randint(1, 9))) for _ in range(4))
        mine, theirs = tokenizer.encode(text), other.encode(text)
        score = lambda ids: sum(tokenizer.vocabulary.pieces[i][1] for i in ids)
        assert score(mine) >= score(theirs)
        n += 1
        same += mine == theirs
    assert same / n > 0.95


def test_encode_and_decode(spark):
    docs = documents(spark, corpus(5, 20), True)
    encoded = sentencepiece.encode(docs)
    got = encoded.collect()
    assert len(got) == docs.count() and all(x["round_trip"] and x["n_tokens"] == len(x["token_ids"]) for x in got)
    back = {(x["doc_id"], x["text"]) for x in sentencepiece.decode(encoded).collect()}
    assert back == {(i, t or "") for i, t, *_ in corpus(5, 20)}
    assert sentencepiece.encode(docs.limit(0)).count() == 0


# --- nearest neighbours ----------------------------------------------------------------------------------------------------
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_nearest_neighbours(spark):
    got = ann.search(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).collect()
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], float)
    found: dict = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    queries = ids[ids % 20 == 0]
    for q in queries:
        s = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        own = sorted(found[q])
        assert [k for k, _, _ in own] == list(range(1, 21)) and [s_ for _, _, s_ in own] == sorted((s_ for _, _, s_ in own), reverse=True)
        assert all(abs(s[ids == v][0] - s_) < 1e-9 for _, v, s_ in own)
        hits += len({v for _, v, _ in own} & set(ids[order]))
    assert hits / (20 * len(queries)) >= 0.9


def test_neighbours_edge_cases(spark):
    r = np.random.default_rng(2)
    good = [(i, [float(v) for v in r.normal(size=6)], 0) for i in range(30)]
    bad = [(40, None, 0), (60, [0.0] * 6, 0), (80, [float("nan")] * 6, 0), (100, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (120, [float("inf")] * 6, 0), (140, [1.0] * 5, 0), (160, [], 0), (None, [1.0] * 6, 0)]
    ties = [(200 + i, [1.0] * 6, 0) for i in range(30)] + [(20, good[20][1], 0)]
    got = ann.search(vectors(spark, good + bad + ties).withColumn("cell", F.lit(1)).withColumn("score", F.lit(1))).collect()
    assert {x["query_id"] for x in got} == {0, 20, 200, 220}
    tied = [x["vec_id"] for x in sorted((x for x in got if x["query_id"] == 220), key=lambda x: x["rank"])]
    assert all(a < b for a, b in zip([v for v in tied if v >= 200], [v for v in tied if v >= 200][1:], strict=False))
    assert ann.search(vectors(spark, bad[:3])).count() == 0 and ann.search(vectors(spark, good).limit(0)).count() == 0
    few = ann.search(vectors(spark, good[:3])).collect()
    assert len(few) == 2 and {x["vec_id"] for x in few} == {1, 2}


def exact_neighbours(rows, every=20, k=20):
    """query_id -> sorted lists of (rank, vec_id, score), one for each row of the id."""
    good = [(i, np.array(v, float)) for i, v, _ in rows]
    out: dict = {}
    for a, (i, q) in enumerate(good):
        if i % every == 0:
            near = sorted((-float(q @ x), j) for b, (j, x) in enumerate(good) if b != a)[:k]
            out.setdefault(i, []).append([(n + 1, j, round(-s, 9)) for n, (s, j) in enumerate(near)])
    return out


@pytest.mark.parametrize("n", [6, 20, 21, 24, 60])
def test_small_tables_are_searched_in_whole(spark, n):
    r = np.random.default_rng(n)
    rows = [(i, [float(v) for v in r.normal(size=64)], 0) for i in range(n)]
    got = ann.search(vectors(spark, rows)).collect()
    exact = exact_neighbours([(i, np.float32(v), 0) for i, v, _ in rows])
    for i, lists in exact.items():
        own = sorted((x["rank"], x["vec_id"]) for x in got if x["query_id"] == i)
        assert len(own) == min(20, n - 1)
        if n <= 21:
            assert own == [x[:2] for x in lists[0]]


def test_neighbours_of_repeated_ids_and_hot_vectors(spark):
    r = np.random.default_rng(5)
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, [float(v) for v in r.integers(-3, 4, 4)], 0) for i in range(1, 12)]
    rows = [x for x in rows if any(x[1])] + [(300 + i, same, 0) for i in range(90)]  # one vector of most rows
    rows += [(40, [1.0, 1.0, 1.0, 1.0], 0), (40, [2.0, 0.0, 0.0, 1.0], 0), (300, same, 0)]  # repeats: unequal and equal
    broken = [(40, [1.0, None, 1.0, 1.0], 0)]  # an invalid repeat takes no valid one with it
    got = ann.search(vectors(spark, rows + broken)).collect()
    exact = exact_neighbours(rows)
    assert {x["query_id"] for x in got} == set(exact) == {40, 300, 320, 340, 360, 380}
    for i, lists in exact.items():
        own = sorted((x["rank"], x["vec_id"], round(x["score"], 9)) for x in got if x["query_id"] == i)
        assert own == sorted(x for one in lists for x in one)


def test_hot_lists_are_split():
    counts = np.array([5, 200_000, 10, 0, 3])
    deal = ann.Deal.of(counts, 10_000, 0.5, 21)
    assert deal.parts[1] > 1 and deal.base[1] + deal.parts[1] - 1 < deal.base[2] and deal.base[2] == deal.base[3] == deal.base[4]


# --- queries and pipeline --------------------------------------------------------------------------------------------------
def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "suffix_dedup", "mixing", "tokenize"]
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "/root/testdata/sf0.001").collect(), docs.schema)
        assert docs.columns == columns, name
        own = {r[0] for r in docs.select("doc_id").collect()}
        assert own and own <= ids
        ids = own
    out = cp.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    assert len(out) == docs.count() and all(r["round_trip"] for r in out)
    whole = cp.run(spark, "/root/testdata/sf0.001").select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, whole)) == sorted((r["doc_id"], r["n_tokens"]) for r in out)
