"""Operator 8: exact round trips, whatever the byte ranges."""

import gzip
import hashlib
import io

import pytest
from ordolith.llm import warc

BIG = "<p>" + "same page " * 150 + "</p>"
PAGES = [
    (1, "http://a/1", BIG),
    (2, "http://a/2", BIG),
    (9, None, BIG),
    (4, "http://a/4 with space\r\nX: y", "small"),
    (5, "http://a/5", "small"),
    (6, "http://a/6", None),
    (7, "http://a/7", ""),
    (8, "http://a/8", "ü" * 600 + "\r\n\r\nWARC/1.1\r\n\x1f\x8b\x08"),
    (10, "http://a/10", "é" * 499 + "x"),
    (11, "http://a/11", "é" * 500),
    (12, "http://a/12", "é" * 500),
]


def want(pages):
    owner = {}
    for i, _, html in pages:
        body = (html or "").encode()
        if len(body) >= 1000:
            owner[body] = max(owner.get(body, i), i)
    out = []
    for i, _, html in pages:
        body = (html or "").encode()
        to = owner.get(body, i)
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "response" if to == i else "revisit", None if to == i else to))
    return sorted(out)


@pytest.mark.parametrize("split", [17, 1000, 1 << 24])
def test_round_trip_over_byte_ranges(spark, tmp_path, split):
    pages = PAGES + [(100 + i, f"http://b/{i}", f"page {i} " * (i * 7)) for i in range(60)]
    df = spark.createDataFrame([(*p, "x", 0) for p in pages], "page_id bigint, url string, html string, digest string, owner int").repartition(2)
    folder = "file://" + str(tmp_path / "w")
    manifest = warc.write_warc(df, folder, roll=4000)
    got = warc.read_warc(manifest, folder, split=split, payloads=True).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want(pages)
    html = {p[0]: (p[2] or "").encode() for p in pages}
    assert all(bytes(r.payload) == (html[r.page_id] if r.record_type == "response" else b"") for r in got)


def test_files_are_ordinary_gzip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").coalesce(1)
    warc.write_warc(df, "file://" + str(tmp_path / "w"))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.warc.gz"))
    assert raw.count(b"\r\nWARC-Type: ") == len(PAGES)


def test_ranges_own_the_records_that_begin_in_them():
    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    parts = [warc.record(i, f"u{i}", "x\x1f\x8b\x08" * i * 40, None, False) for i in range(30)]
    data = b"junk\x1f\x8b\x08" + b"".join(parts)
    for split in (1, 5, 333, len(data)):
        found = [at for lo in range(0, len(data), split) for at, *_ in warc.RangeReader(File(data), lo, min(lo + split, len(data)), chunk=64)]
        starts = [7 + sum(map(len, parts[:i])) for i in range(30)]
        assert found == starts


def test_odd_tables(spark, tmp_path):
    df = spark.createDataFrame([(None, "u", BIG), (3, "u", BIG), (3, "u", BIG)], "page_id bigint, url string, html string")
    folder = "file://" + str(tmp_path / "w")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read_warc(warc.write_warc(df, folder), folder).collect()), key=str)
    assert got == [(3, "response", None), (3, "response", None), (None, "revisit", 3)]
    folder += "0"
    assert warc.read_warc(warc.write_warc(df.limit(0), folder), folder).count() == 0
