"""WARC writer and reader: round trips, real files, damage."""

import base64
import gzip
import hashlib

import pytest

from strayfinder.llm import warc

SCHEMA = "page_id bigint, url string, html string, path string, first bigint"


def pages():
    rows = [
        (7, "http://a", "<p>same é</p>", "x", 1), (3, "http://b\r\nX: y", "<p>same é</p>", "x", 1), (9, None, "", "x", 1),
        (8, "u", None, "x", 1), (1, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "x", 1), (2, "u", "z" * 300_000, "x", 1),
        (4, "u", "\x00\r\n\r\n", "x", 1), (3, "http://b", "<p>same é</p>", "x", 1), (None, "u", "<p>same é</p>", "x", 1),
    ]
    return rows + [(100 + k, f"u{k}", "hot", "x", 1) for k in range(40)]


@pytest.mark.parametrize("size", [warc.ARCHIVE_BYTES, 500])
def test_roundtrip(spark, monkeypatch, size):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
    rows = pages()
    got = sorted((tuple(r) for r in warc.roundtrip(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    least = {}
    for page, _, html, *_ in rows:
        if page is not None:
            least[html or ""] = min(least.get(html or "", page), page)
    want = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = page != least[html or ""]
        want.append((page, len(data), sha, "revisit" if again else "response", least[html or ""] if again else None))
    assert got == sorted(want, key=str)


def test_small_payloads_are_never_revisits(spark):
    rows = warc.roundtrip(spark.createDataFrame(pages(), SCHEMA), revisit_from=4).collect()
    assert {r.record_type for r in rows if r.payload_bytes < 4} == {"response"}
    assert sum(r.record_type == "revisit" for r in rows) == 2
    assert warc.roundtrip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_files_and_payloads(spark, tmp_path):
    """Archives as files, read by Spark's own source; foreign records with other headers too."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    body = gzip.compress(info) + warc.record(5, "http://x", b"<b>\xc3\xa9</b>", None) + warc.record(6, "http://y", b"<b>\xc3\xa9</b>", 5)
    (tmp_path / "a.warc.gz").write_bytes(body)
    rows = warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("position").collect()
    assert [r.record_type for r in rows] == ["warcinfo", "response", "revisit"]
    assert rows[0].payload == b"hello" and rows[1].payload == b"<b>\xc3\xa9</b>" and rows[2].payload is None
    assert rows[2].refers_to == "urn:page:5" and rows[1].payload_digest == rows[2].payload_digest


@pytest.mark.parametrize("damage", ["cut", "flip", "length", "digest"])
def test_damage_is_found(spark, damage):
    good = warc.record(1, "u", b"first payload", None)
    bad = warc.record(2, "u", b"second payload" * 50, None)
    plain = gzip.decompress(bad)
    bad = {
        "cut": bad[:-9], "flip": bad[:60] + bytes([bad[60] ^ 1]) + bad[61:],
        "length": gzip.compress(plain.replace(b"application/http;msgtype=response\r\nContent-Length: 7", b"application/http;msgtype=response\r\nContent-Length: 6")),
        "digest": gzip.compress(plain.replace(b"second", b"Second", 1)),
    }[damage]
    archives = spark.createDataFrame([("p", bytearray(good + bad))], "path string, content binary")
    rows = warc.read_archives(archives, strict=False).collect()
    assert [(r.record_type, r.valid) for r in rows] == [("response", True), ("damaged", False)]
    with pytest.raises(Exception, match="p: "):
        warc.read_archives(archives).collect()
