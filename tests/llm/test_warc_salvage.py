"""Salvage inside gzip members, and records that state no digest or length."""

import time

import pytest

from quarry.llm import warc
from tests.oracle import connect, differences


def made(i):
    return warc.record(i, f"http://x/{i}", b"pay%d" % i * 50, None, warc.digest(b"pay%d" % i * 50), False)


def ids(data):
    return [x.page_id for x in warc.salvage(data) if isinstance(x, warc.Record)]


def gaps(data):
    return [x for x in warc.salvage(data) if not isinstance(x, warc.Record)]


def test_one_member_with_a_bad_record():
    records = [made(i) for i in range(10)]
    records[4] = records[4].replace(b"pay4pay4", b"pay4PAY4", 1)
    one = warc.member(b"".join(records))
    assert ids(one) == [0, 1, 2, 3, 5, 6, 7, 8, 9] and gaps(one) == [(0, len(one))]
    assert ids(one + warc.member(made(11))) == [0, 1, 2, 3, 5, 6, 7, 8, 9, 11]


def test_broken_member_gives_its_prefix():
    import random

    r = random.Random(1)
    pays = [bytes(r.randrange(256) for _ in range(3000)) for _ in range(10)]
    one = warc.member(b"".join(warc.record(i, "u", p, None, warc.digest(p), False) for i, p in enumerate(pays)))
    cut = one[: len(one) // 2]
    assert ids(cut) == list(range(len(ids(cut)))) and 3 <= len(ids(cut)) <= 5 and gaps(cut)
    crc = one[:-8] + bytes(4) + one[-4:]
    assert ids(crc) == list(range(10)) and gaps(crc) == [(0, len(crc))]


def plain(kind, block, *more):
    return "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", *more, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_without_digest_or_length():
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n6\r\n world\r\n0\r\n\r\n"
    data = plain("warcinfo", b"software: x\r\n") + plain("response", chunked, f"WARC-Payload-Digest: sha1:{warc.digest(b'hello world')}") + plain("metadata", b"a: b")
    data += plain("response", b"HTTP/1.1 200 OK\r\n\r\nbody") + plain("response", b"HTTP/1.1 200 OK\r\ncontent-length: 9\r\n\r\nbody") + made(3)
    for whole in (data, warc.member(data)):
        got = [x for x in warc.salvage(whole) if isinstance(x, warc.Record)]
        assert [(x.record_type, x.payload) for x in got[:4]] == [("warcinfo", b"software: x\r\n"), ("response", b"hello world"), ("metadata", b"a: b"), ("response", b"body")]
        assert len(got) == 5 and got[4].page_id == 3 and len(gaps(whole)) == 1


@pytest.mark.parametrize("false", [b"\x1f\x8b\x08\x00", b"WARC/1.1\r\n", b"WARC/1.0\r\nA: b\r\n"])
def test_false_starts_take_linear_time(false):
    took = []
    for n in (20_000, 40_000):
        began = time.process_time()
        assert ids(made(1) + false * n + warc.member(made(2))) == [1, 2]
        took.append(time.process_time() - began)
    assert took[1] < 3.2 * took[0] + 0.5


def test_long_payloads_and_many_members():
    pay = b"0123456789" * 2_000_000
    data = b"".join(warc.member(made(i)) for i in range(300)) + warc.member(warc.record(7, "u" * 70_000, pay, None, warc.digest(pay), False))
    got = [x for x in warc.salvage(data) if isinstance(x, warc.Record)]
    assert len(got) == 301 and got[-1].payload == pay and not gaps(data)


def test_gaps_are_returned(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "page %d" % i * 20) for i in range(40)], "page_id long, url string, html string")
    member = warc.member
    monkeypatch.setattr(warc, "member", lambda data, level=1: bytes(40) + member(data, level))  # bytes of no member before each
    path = warc.fresh_path(spark, "broken")
    held = [warc.member(made(i)) for i in range(5)]
    spark.createDataFrame([(b"".join(held),)], "value binary").selectExpr("cast(value as string) as value").write.text(path)
    found = warc.read_archives(spark, path).collect()
    assert sorted(x["page_id"] for x in found if x["record_type"]) == list(range(5)) and sum(x["gap_start"] is not None for x in found) == 5
    monkeypatch.undo()
    records, log = warc.archive(pages)
    assert records.count() == 40 and log.columns == ["archive", "gap_start", "gap_end"] and log.count() == 0


def test_pages_match_sql(spark):
    assert differences(warc.round_trip(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")), connect("/root/testdata/sf0.01"), warc.oracle_sql()) == ""
