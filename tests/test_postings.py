"""The versioned table, and the inverted index that lies on it."""

import threading

import pytest
from pyspark.sql import functions as F

from quarry.operators import postings, values
from quarry.sources.versioned import Conflict, VersionedTable

WORDS = ["AUTOMOBILE", "BUILDING", "MACHINERY", "blue ring", "blue rings", "blur ring", "red ring", "Customer#000000042", "ab", "x", "", "blue ring two"]


def word_values(spark, words=WORDS, column="c"):
    return spark.createDataFrame([("t", column, w) for w in words], "table string, column string, value string")


def keywords(spark, *own):
    return spark.createDataFrame([(w,) for w in own], "keyword string")


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_versions_and_readers(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(ValueError, match="no rows"):
        t.read()
    assert t.append(spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")) == 1
    early = t.read()
    assert t.upsert(spark.createDataFrame([(2, "c"), (None, "n")], "id int, s string"), ["id"]) == 2
    t.upsert(spark.createDataFrame([(None, "m")], "id int, s string"), ["id"])
    assert rows(t.read()) == rows(spark.createDataFrame([(1, "a"), (2, "c"), (None, "m")], "id int, s string"))
    assert rows(early) == [(1, "a"), (2, "b")]
    assert rows(t.read(1)) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="does not fit"):
        t.append(spark.createDataFrame([(1,)], "id int"))
    with pytest.raises(ValueError, match="no version"):
        t.read(9)
    t.compact()
    assert len(t.manifest()["parts"]) == 1
    assert t.vacuum() > 0
    assert t.read().count() == 3
    assert t.versions() == [4]
    t.overwrite(spark.createDataFrame([(7, "z")], "id int, s string"))
    assert rows(t.read()) == [(7, "z")]


def test_two_writers_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    VersionedTable(spark, path).append(spark.createDataFrame([(-1, "start")], "id int, s string"))
    failed = []

    def work(k):
        try:
            t = VersionedTable(spark, path)
            for i in range(3):
                frame = spark.createDataFrame([(k * 10 + i, "x"), (99, f"{k}")], "id int, s string")
                t.upsert(frame, ["id"]) if i % 2 else t.append(frame.where("id <> 99"))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    got = [r["id"] for r in VersionedTable(spark, path).read().collect()]
    assert sorted(got) == sorted([-1, 99, *(k * 10 + i for k in range(4) for i in range(3))])
    assert len(VersionedTable(spark, path).versions()) == 13


def test_the_second_to_name_a_version_is_told(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/p")
    assert t._publish(1, {"version": 1, "parts": [], "schema": None, "facts": {}})
    assert not t._publish(1, {"version": 1, "parts": ["lost"], "schema": None, "facts": {}})
    assert t.manifest()["parts"] == []
    with pytest.raises(Conflict):
        t.replace(["gone"], [])


def test_lookup_equals_the_scan(spark, tmp_path):
    index = postings.PostingIndex(spark, f"file://{tmp_path}/i", buckets=3, homes=4)
    index.append(word_values(spark, WORDS[:5]))
    index.append(word_values(spark, WORDS))  # five are there already
    index.append(word_values(spark, WORDS[3:4], "other"))
    every = word_values(spark).union(word_values(spark, WORDS[3:4], "other"))
    asked = keywords(spark, "blue ring", "automobile", "ab", "nothing like it", None)
    want = rows(values.signature_top(values.signatures(every), asked.where("keyword is not null")))
    assert rows(index.top(asked)) == want
    assert rows(index.top(asked, top=2)) == [r for r in want if r[5] <= 2]
    assert index.values().count() == len(WORDS) + 1
    before = index.table.manifest()["version"]
    index.compact()
    assert len(index.table.manifest()["parts"]) == 2
    assert rows(index.top(asked)) == want
    assert rows(index.top(asked, version=before)) == want
    assert rows(postings.PostingIndex(spark, f"file://{tmp_path}/i").top(asked)) == want  # opened again: its facts are in the table


def test_lookup_reads_a_share_of_the_files(spark, tmp_path):
    index = postings.PostingIndex(spark, f"file://{tmp_path}/s", slots=20, buckets=8)
    words = spark.range(3000).select(F.lit("t").alias("table"), F.lit("c").alias("column"), F.concat(F.lit("w"), F.md5(F.col("id").cast("string"))).alias("value"))
    index.append(words)
    wanted = words.first()["value"]
    read, there = postings.files_read(index.candidates(keywords(spark, wanted)))
    assert there >= 20 * 8
    assert read <= there / 4  # one range of keys in eight a slot, and those that share it
    assert index.top(keywords(spark, wanted)).first()["value"] == wanted
    scan, _ = postings.files_read(values.signature_top(values.signatures(index.values(), 20), keywords(spark, wanted), slots=20))
    assert scan == 32
