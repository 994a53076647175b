import base64
import gzip
import hashlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

from rollcall.llm import web_archives as W
from rollcall.llm.common import table
from rollcall.llm.queries import op12_warc

P = "page_id long, url string, html string, record_type string, path string"
LONG = "<p>ünï 你好</p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 20_000


def brute(rows):
    """Sorted (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    groups = defaultdict(list)
    for i, html in rows:
        groups[(html or "").encode()].append(i)
    out = []
    for payload, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        name = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out += [(i, len(payload), name, "revisit", ids[-1]) for i in ids[:-1]] + [(ids[-1], len(payload), name, "response", None)]
    return sorted(out, key=str)


def told(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=str)


def test_whole_table(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = told(op12_warc(spark, "/root/testdata/sf0.01"))
    assert got == brute([(r.page_id, r.html) for r in pages.collect()])
    with duckdb.connect() as db:
        db.sql("CREATE VIEW pages AS FROM '/root/testdata/sf0.01/pages.parquet'")
        assert sorted(db.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({W.PAGES_SQL})").fetchall(), key=str) == got


def odd_pages(spark):
    rows = [(1, "http://a.example/x y\nz", "same", "x", "p"), (9, None, "same", None, None), (2, "http://b.example/", "same", None, None), (2, "http://b.example/", "same", None, None), (None, "no scheme", "same", None, None)]
    rows += [(3, "http://c.example", None, None, None), (4, "http://c.example", "", None, None), (5, "filedesc://x", LONG, None, None), (6, "ftp://d", "HTTP/1.1 200 OK\r\n\r\nnot a head", None, None)]
    rows += [(7, "http://e", "http://f.example/ 0.0.0.0 20000101000000 text/html 5\nabcde\n", None, None), (8, "http://e", "\n\nlone\rcr\x00nul", None, None), (-10, "", "a", None, None), (None, None, None, None, None), (None, None, "alone", None, None)]
    rows += [((1 << 63) - 1, "http://g", "far", None, None), (-(1 << 63), "http://g", "far", None, None), (10**18, "http://g", "far", None, None)]
    return spark.createDataFrame(rows, P).repartition(3)


def test_odd_pages(spark, tmp_path, monkeypatch):
    df = odd_pages(spark)
    want = brute([(r.page_id, r.html) for r in df.collect()])
    assert told(W.through_archives(df, f"{tmp_path}/a")) == want
    monkeypatch.setattr(W, "FILE_RECORDS", 2)  # files without a version block
    monkeypatch.setattr(W, "SLICE_BYTES", 10)
    assert told(W.through_archives(df, f"{tmp_path}/b")) == want


def test_no_pages(spark, tmp_path):
    assert told(W.through_archives(spark.createDataFrame([], P), f"{tmp_path}/none")) == []


def test_archives_say_what_they_should(spark, tmp_path):
    W.through_archives(odd_pages(spark), f"{tmp_path}/x")
    arc = [W.unpacked(f.read_bytes()) for f in sorted(Path(f"{tmp_path}/x/arc").glob("part-*"))]
    assert {a.split(b"\n")[1][:1] for a in arc if a} == {b"1", b"2"}
    blocks = {}
    for f in Path(f"{tmp_path}/x/warc").glob("part-*"):
        for r in W.warc_records(W.unpacked(f.read_bytes())):
            assert r.fields["warc-block-digest"] == f"sha1:{W.digest(r.block)}" and not r.short
            assert r.fields["warc-date"] == "2000-01-01T00:00:00Z" and r.fields["warc-record-id"] not in blocks
            blocks[r.fields["warc-record-id"]] = r
    kinds = [r.fields["warc-type"] for r in blocks.values()]
    assert kinds.count("warcinfo") == sum(1 for a in arc if a) and len(kinds) == 17 + kinds.count("warcinfo")
    for r in blocks.values():
        if r.fields["warc-type"] == "revisit":
            first = blocks[r.fields["warc-refers-to"]]
            assert first.fields["warc-payload-digest"] == r.fields["warc-payload-digest"] and first.fields["warc-target-uri"] == r.fields["warc-refers-to-target-uri"]
            assert r.body() == b"" and r.head() == len(r.block)


ONE = b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n"
TWO = b"filedesc://new.arc 0.0.0.0 199709231421 text/plain 120 - - 0 new.arc 13\n2 0 somebody\n\n"


def test_versions_dates_and_damage():
    records = list(W.arc_records(ONE + b"http://a.example/with space 10.0.0.1 19961104142103 text/html 24\nHTTP/1.0 200 OK\n\nbody\n\n\nnoise\ndns:a 10.0.0.1 19961104142104 text/dns 3\nabc\nhttp://cut 1.1.1.1 19961104142105 text/html 99\nrest"))
    assert [r.fields["URL"] for r in records] == ["filedesc://old.arc", "http://a.example/with space", "dns:a", "http://cut"]
    assert records[1].body() == b"body\n\n\n" and records[2].block == b"abc" and records[3].short
    assert b"WARC-Type: resource" in W.converted(records[2], "old.arc", None) and b"WARC-Truncated: length" in W.converted(records[3], "old.arc", None)
    assert b"WARC-Date: 1996-11-04T14:21:03Z" in W.converted(records[1], "old.arc", None)
    later = list(W.arc_records(TWO + b"http://b.example/ 10.0.0.2 19970923142103 text/html 302 abc http://b.example/to 99 new.arc 2\nhi\n"))
    assert later[1].fields["Result-code"] == "302" and later[1].fields["Location"] == "http://b.example/to" and later[1].block == b"hi"
    assert b"WARC-Date: 1997-09-23T14:21:00Z" in W.converted(later[0], "new.arc", None)


@pytest.mark.parametrize("cut", [0, 4])
def test_gzip_of_many_members(cut):
    parts = [gzip.compress(p) for p in (ONE, b"http://a 1.1.1.1 19961104142103 text/html 2\nhi\n", b"http://b 1.1.1.1 19961104142103 text/html 2\nho\n")]
    data = b"".join(parts)[: len(b"".join(parts)) - cut]
    assert [r.fields["URL"] for r in W.arc_records(W.unpacked(data))] == ["filedesc://old.arc", "http://a", "http://b"]
