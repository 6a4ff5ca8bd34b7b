from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from plumbline.llm import warc as W


def _pages(spark, rows):
    schema = "page_id bigint, url string, html string, path string, position int, archive string, record_type string, version int"
    return spark.createDataFrame([(i, u, h, "p", 1, "a", "r", 9) for i, u, h in rows], schema)


def _read(pages, min_bytes=0):
    return W.read(W.convert(W.write_arc(pages), min_bytes), payloads=True).collect()


def brute_force(rows, min_bytes=0):
    out, seen = [], {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = len(payload) >= min_bytes and payload in seen
        out.append((i, len(payload), sha1, "revisit" if first else "response", seen[payload] if first else None))
        seen.setdefault(payload, i)
    return sorted(out, key=str)


ROWS = [
    (5, "http://a.example/x y\t", "<p>same</p>"), (2, "http://b.example/ü", "<p>same</p>"), (9, None, None), (1, "", ""),
    (3, "u", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n\r\n\r\nfiledesc://x\n1 0 y\n"), (4, "u", "\n\n\r\n"), (6, "u", "\n\n\r\n"),
    (2, "http://b.example/ü", "<p>same</p>"), (None, "n", "<p>same</p>"), (None, "n", "alone"), (None, "m", "alone"),
    (7, "long", "0123456789ab漢字" * 200_000), (8, "v", "x"), (10, "v", "x"),
]


@pytest.mark.parametrize("min_bytes", [0, 2])
def test_agrees_with_brute_force(spark, monkeypatch, min_bytes):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 600)
    found = _read(_pages(spark, ROWS).repartition(3), min_bytes)
    assert sorted((tuple(r)[:5] for r in found), key=str) == brute_force(ROWS, min_bytes)
    payloads = {(i, (h or "").encode()) for i, _, h in ROWS}
    assert all((r.page_id, bytes(r.payload)) in payloads for r in found if r.record_type == "response")


def test_every_revisit_names_a_record_of_the_page(spark):
    found = _read(_pages(spark, ROWS))
    ids = {r.record_id: r for r in found}
    assert len(ids) == len(ROWS)
    for r in found:
        if r.record_type == "revisit":
            first = ids[r.refers_to_record]
            assert first.record_type == "response" and first.payload_digest == r.payload_digest
            assert first.page_id == r.refers_to and r.payload is None


def test_hot_groups_joined_apart_give_the_same(spark):
    rows = [(i, "u", "hot" if i % 3 == 0 else f"page {i // 4}") for i in range(400)]
    records = W.written(W.listed(W.write_arc(_pages(spark, rows).repartition(4))), "records")
    def pairs(df):  # noqa: E306
        each = df.select("archive", F.explode("revisits").alias("r")).select("archive", "r.position", "r.first.page_id")
        return sorted(tuple(r) for r in each.collect())
    small, large = pairs(W.revisits(records, 0)), pairs(W.revisits(records, 0, broadcast_bytes=0))
    assert small == large and sum(1 for _, _, first in small if first == 0) == 133


def test_empty_tables(spark):
    manifest = W.convert(W.write_arc(_pages(spark, [])))
    assert manifest.count() == 0 and W.read(manifest).count() == 0


def _arc(records, version, fields=None, block=None):
    fields = fields or W.ARC_FIELDS[version]
    block = block or f"{version} 0 Org\n{' '.join(fields)}\n".encode()
    more = " 200 - - 0 old.arc" if version == 2 else ""
    out = f"filedesc://old.arc 0.0.0.0 19970101120000 text/plain{more} {len(block)}\n".encode() + block
    return out + b"".join(b"\n" + line.encode() + b" %d\n" % len(content) + content for line, content in records)


HTTP = b"HTTP/1.0 200 OK\nServer: x\n\nbody\n\nmore"


def test_archives_of_both_versions_made_elsewhere(spark, tmp_path):
    one = _arc([("http://h/a b 1.2.3.4 19970102030405 text/html", HTTP), ("dns:h 1.2.3.4 199701 text/dns", b"h IN A 1.2.3.4")], 1)
    two = _arc([("http://h/c 1.2.3.4 19980102030405 text/html 200 SUM - 77 old.arc", HTTP)], 2)
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.arc").write_bytes(one)
    (tmp_path / "sub" / "two.arc.gz").write_bytes(gzip.compress(two))
    (tmp_path / "notes.txt").write_text("x")
    manifest = W.archives_in(spark, str(tmp_path))
    done = W.convert(manifest)
    rows = {r.record_id: r for r in W.read(done, payloads=True).collect()}
    assert sorted(r.record_type for r in rows.values()) == ["resource", "response", "revisit"]
    assert sorted(bytes(r.payload) for r in rows.values() if r.payload) == [b"body\n\nmore", b"h IN A 1.2.3.4"]
    fields = {}
    for r in done.collect():
        with W._opened(r.path) as file:
            for found, block in W.warc_records(file, r.archive):
                fields[r.archive, found["WARC-Type"]] = found, block
    assert set(fields) == {("one.warc.gz", k) for k in ("warcinfo", "response", "resource")} | {("two.warc.gz", k) for k in ("warcinfo", "revisit")}
    response, block = fields["one.warc.gz", "response"]
    assert (response["WARC-Target-URI"], response["WARC-Date"], block) == ("http://h/a b", "1997-01-02T03:04:05Z", HTTP)
    assert response["WARC-IP-Address"] == "1.2.3.4" and response["WARC-Warcinfo-ID"] == fields["one.warc.gz", "warcinfo"][0]["WARC-Record-ID"]
    assert fields["one.warc.gz", "resource"][0]["WARC-Date"] == "1997-01-01T00:00:00Z"
    revisit, block = fields["two.warc.gz", "revisit"]
    assert revisit["WARC-Refers-To-Target-URI"] == "http://h/a b" and revisit["WARC-Refers-To-Date"] == "1997-01-02T03:04:05Z"
    assert block == b"HTTP/1.0 200 OK\nServer: x\n\n" and revisit["WARC-Refers-To"] == response["WARC-Record-ID"]


def test_what_does_not_keep_to_the_format_is_refused(spark, tmp_path):
    whole = _arc([("http://h/a 1.2.3.4 19970102030405 text/html", HTTP)], 1)
    for broken, what in [(whole[:-3], "declares 37 bytes and has 34"), (whole.replace(b" 37\n", b" x\n"), "ends in a length"),
                         (whole.replace(b"1 0 Org", b"7 0 Org"), "version '7'")]:
        with pytest.raises(ValueError, match=what):
            list(W.arc_records(io.BufferedReader(io.BytesIO(broken)), "x.arc"))
    for k in ("a", "b"):
        (tmp_path / k).mkdir()
        (tmp_path / k / "x.arc").write_bytes(whole)
    with pytest.raises(ValueError, match=r"x\.arc"):
        W.archives_in(spark, str(tmp_path))


def test_dates():
    assert [W.warc_date(d) for d in ("19970102030405", "1997", "199702", "19991301", "x", "")] == [
        "1997-01-02T03:04:05Z", "1997-01-01T00:00:00Z", "1997-02-01T00:00:00Z", *["1970-01-01T00:00:00Z"] * 3
    ]


def test_files_are_the_same_when_written_again(spark):
    pages = _pages(spark, ROWS)
    def unpacked():  # noqa: E306
        return [gzip.decompress(open(r.path, "rb").read()) for r in W.convert(W.write_arc(pages)).orderBy("archive").collect()]
    assert unpacked() == unpacked()
