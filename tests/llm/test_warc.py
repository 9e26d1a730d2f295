import gzip
import hashlib

import pytest

from repeatlens.llm import warc
from tests.llm.helpers import table, with_clashes

PAGES = "page_id long, url string, html string"


def expected(rows):
    out = []
    last = {}
    for i, _, h in rows:
        h = h or ""
        last[h] = max((x for x in (last.get(h), i) if x is not None), default=None)
    for i, _, h in rows:
        b = (h or "").encode()
        to = last[h or ""]
        revisit = len(b) >= warc.REVISIT_BYTES and i != to
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response",
                    to if revisit else None))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_driver_table(spark):
    p = table(spark, "pages")
    rows = [tuple(r) for r in p.select("page_id", "url", "html").collect()]
    assert order(warc.archive_pages(p).collect()) == order(expected(rows))


def test_copies_framing_and_odd_rows(spark):
    big, mean = "é" * 700, "WARC/1.1\r\n\r\nfiledesc://x 1 2\r\n\r\n" * 60
    rows = [(1, "http://a/ b", big), (2, "http://a", big), (3, None, big), (4, "http://b", "s"),
            (5, "http://b", "s"), (6, "u", None), (7, "u", ""), (8, "v", mean), (9, "w", mean),
            (None, "x", big), (None, None, None), (3, "again", big), (10, "z", "line\n" * 50_000),
            (-4, "neg", "\x00\x01" * 600), (-5, "neg", "\x00\x01" * 600)]
    df = with_clashes(spark.createDataFrame(rows, PAGES), "digest", "payload", "type", "date")
    assert order(warc.archive_pages(df).collect()) == order(expected(rows))
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).collect() == []


def test_small_files_and_no_broadcast(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", -1)
    rows = [(i, f"http://h/{i}", f"page {i % 7} " * 200) for i in range(90)]
    df = spark.createDataFrame(rows, PAGES).coalesce(2)
    legacy = df.selectExpr("concat(url, '#page-', page_id) url", "html", "'20010203040506' date")
    warc.write_arc(legacy, str(tmp_path / "arc"), records=8)
    got = warc.read_arc(spark, str(tmp_path / "arc"))
    assert {r.arc_version for r in got.collect()} == {1, 2}
    assert sorted(r.payload.decode() for r in got.collect()) == sorted(h for *_, h in rows)
    assert len(list((tmp_path / "arc").glob("part-*"))) >= 12
    records = warc.to_warc(got, warc._page_id(got.url))
    warc.write_warc(records, str(tmp_path / "warc"), per_file=20)
    back = warc.read_warc(spark, str(tmp_path / "warc")).collect()
    assert len(back) == 90 and sum(r.type == "response" for r in back) == 7
    assert {r.date for r in back} == {"2001-02-03T04:05:06Z"}
    assert len({r.id for r in back}) == 90


def test_large_payloads_make_files_of_fewer_records(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 30_000)
    sizes = []
    monkeypatch.setattr(warc, "_files", lambda spark, path, read=warc._files: (
        sizes.extend(r.n for r in read(spark, path).selectExpr("*").toDF("content").selectExpr(
            "octet_length(content) n").collect()), read(spark, path))[1])
    rows = [(i, f"http://h/{i}", f"{i} " * 5000) for i in range(1, 10)]
    df = spark.createDataFrame(rows, PAGES).coalesce(1)
    assert order(warc.archive_pages(df).collect()) == order(expected(rows))
    assert warc._records_per_file(df) == 3 and len(sizes) >= 8


def test_header_lines_by_version():
    data = b""
    for v, line in ((1, "http://a 1.2.3.4 20000101000000 text/html 5"),
                    (2, "http://b 1.2.3.4 20000101000000 text/html 200 sum loc 9 f.arc 3")):
        body = {1: "he\nlo", 2: "x\n\n"}[v]
        data += gzip.compress((warc.version_block(v) + "\n" + line + "\n" + body + "\n").encode())
    got = list(warc.parse_arc(data))  # two members: each with its version block
    assert [(v, h["URL"], b) for v, h, b in got] == [(1, "http://a", b"he\nlo"),
                                                     (2, "http://b", b"x\n\n")]
    assert got[1][1]["Result-code"] == "200" and "Result-code" not in got[0][1]


def test_broken_archives_are_refused():
    block = warc.version_block(1) + "\n"
    with pytest.raises(ValueError):
        list(warc.parse_arc(gzip.compress((block + "http://a 1 2 text/html 50\nshort\n").encode())))
    with pytest.raises(ValueError):
        list(warc.parse_arc(gzip.compress((block + "http://a 1 text/html 5\nhello\n").encode())))
    with pytest.raises(ValueError):
        list(warc.parse_warc(gzip.compress(b"HTTP/1.1 200\r\n\r\nx")))
    assert list(warc.parse_arc(gzip.compress(b""))) == []
