"""WARC archives: a writer with revisit records and a sequential reader.

An archive is a row (path, content) as Spark's ``binaryFile`` source gives it, so the reader takes
real ``.warc.gz`` files as well as the archives written here. Every record is a gzip member of its
own. The reader inflates member by member in small steps, frames records by Content-Length and checks
both digests.

Defined results: a null html is an empty payload; rows with the smallest page_id of equal payloads are
all responses (also when that row is repeated), others revisit it; a null page_id is larger than any
and is kept; null urls are written as an empty target; empty tables give no archive; one very long
page fills an archive of its own; other columns are not read. A damaged archive raises unless
``strict`` is off; then the records before the damage are returned and one invalid row marks it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from strayfinder.llm import text as tx
from strayfinder.session import durable

ARCHIVE_BYTES = 1 << 23
STEP_BYTES = 1 << 16
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2000-01-01T00:00:00Z"
ID_PREFIX = b"urn:page:"
REVISIT_ROWS = 500_000

ARCHIVE_SCHEMA = "path string, content binary"
RECORD_SCHEMA = (
    "path string, position long, record_type string, record_id string, refers_to string, "
    "target_uri string, payload_digest string, payload_bytes long, payload binary, valid boolean"
)


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str | None) -> bytes:
    return (value or "").replace("\r", " ").replace("\n", " ").encode()


def _name(page_id: int | None) -> bytes:
    return b"<" + ID_PREFIX + (b"" if page_id is None else b"%d" % page_id) + b">"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response, or a revisit that keeps only the head of the response."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if refers_to is None else b"")
    fields = [
        (b"WARC-Type", b"response" if refers_to is None else b"revisit"),
        (b"WARC-Record-ID", _name(page_id)),
        (b"WARC-Date", DATE),
        (b"WARC-Target-URI", _clean(url)),
        (b"WARC-Payload-Digest", b"sha1:" + digest(payload).encode()),
        (b"WARC-Block-Digest", b"sha1:" + digest(block).encode()),
        (b"Content-Type", b"application/http;msgtype=response"),
        (b"Content-Length", b"%d" % len(block)),
    ]
    if refers_to is not None:
        fields[3:3] = [(b"WARC-Refers-To", _name(refers_to)), (b"WARC-Profile", PROFILE)]
    body = VERSION + b"\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in fields) + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(body + block + b"\r\n\r\n") + packer.flush()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    held: list[bytes] = []
    size = number = 0

    def archive() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([f"part-{part:06d}-{number:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())],
            names=["path", "content"],
        )

    for batch in batches:
        for rows in tx.slices(batch, "html"):
            for page_id, url, html, first in zip(*(c.to_pylist() for c in rows.columns)):
                member = record(page_id, url, (html or "").encode(), first)
                if held and size + len(member) > ARCHIVE_BYTES:
                    yield archive()
                    held, size, number = [], 0, number + 1
                held.append(member)
                size += len(member)
    if held:
        yield archive()


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    revisit_from: int = 0,
) -> DataFrame:
    """Archives (path, content) of all pages; equal payloads of ``revisit_from`` bytes are stored once."""
    html = F.coalesce(pages[html_col], F.lit(""))
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), html.alias("html"))
    keyed = rows.withColumn("sha", F.sha1("html"))
    ids = durable(keyed.where(F.octet_length("html") >= revisit_from).select("page_id", "sha"))
    firsts = ids.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    revisits = durable(
        ids.join(firsts, "sha")
        .where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
        .select(F.col("page_id").alias("again"), F.col("sha").alias("again_sha"), "first")
        .distinct()
    )
    if revisits.limit(REVISIT_ROWS + 1).count() <= REVISIT_ROWS:
        revisits = F.broadcast(revisits)
    joined = keyed.join(
        revisits, keyed["page_id"].eqNullSafe(revisits["again"]) & (keyed["sha"] == revisits["again_sha"]), "left"
    )
    return joined.select("page_id", "url", "html", "first").mapInArrow(_pack, ARCHIVE_SCHEMA)


class Damaged(ValueError):
    """An archive that breaks its framing or a digest."""


def members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Position and inflated bytes of every gzip member, read in steps."""
    view = memoryview(content)
    at = 0
    while at < len(view):
        begin, packer, out = at, zlib.decompressobj(31), []
        while not packer.eof:
            step = view[at : at + STEP_BYTES]
            if not len(step):
                raise Damaged(f"member at {begin} is cut off")
            try:
                out.append(packer.decompress(step))
            except zlib.error as error:
                raise Damaged(f"member at {begin}: {error}") from error
            at += len(step) - len(packer.unused_data)
        yield begin, b"".join(out)


def _fields(head: bytes) -> dict[bytes, bytes]:
    lines = (line.partition(b":") for line in head.split(b"\r\n") if line)
    return {key.strip().lower(): value.strip() for key, _, value in lines}


def parse(member: bytes, position: int) -> dict:
    """The record in an inflated member: framed by Content-Length, digests checked."""
    head, mark, rest = member.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not mark or not version.startswith(b"WARC/"):
        raise Damaged(f"no record at {position}")
    fields = _fields(lines)
    try:
        length = int(fields[b"content-length"])
    except (KeyError, ValueError) as error:
        raise Damaged(f"no Content-Length at {position}") from error
    block = rest[:length]
    if len(block) != length or rest[length : length + 4] != b"\r\n\r\n":
        raise Damaged(f"record at {position} doesn't end where its Content-Length says")
    kind = fields.get(b"warc-type", b"").decode()
    inner, payload = {}, block
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        top, mark, payload = block.partition(b"\r\n\r\n")
        inner = _fields(top.partition(b"\r\n")[2])
    stated = fields.get(b"warc-payload-digest", b"").decode()
    checks = [(fields.get(b"warc-block-digest", b"").decode(), block)]
    if kind != "revisit":
        checks.append((stated, payload))
    for claim, data in checks:
        if claim and claim != f"sha1:{digest(data)}":
            raise Damaged(f"digest of the record at {position} is {claim}, not sha1:{digest(data)}")

    def link(key: bytes) -> str | None:
        return fields[key].strip(b"<>").decode() if key in fields else None

    return {
        "position": position,
        "record_type": kind,
        "record_id": link(b"warc-record-id"),
        "refers_to": link(b"warc-refers-to"),
        "target_uri": link(b"warc-target-uri"),
        "payload_digest": stated.rpartition(":")[2],
        "payload_bytes": len(payload) if kind != "revisit" else int(inner.get(b"content-length", b"0")),
        "payload": payload if kind != "revisit" else None,
        "valid": True,
    }


def _read(strict: bool, keep_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("path", pa.string()), ("position", pa.int64()), ("record_type", pa.string()),
            ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
            ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
            ("valid", pa.bool_()),
        ])
        for batch in batches:
            for k in range(batch.num_rows):
                path, content = batch.column("path")[k].as_py(), batch.column("content")[k].as_py()
                held, size = [], 0
                try:
                    for position, member in members(content or b""):
                        row = {"path": path} | parse(member, position)
                        size += len(member)
                        held.append(row if keep_payload else row | {"payload": None})
                        if size > tx.SLICE_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                except Damaged as error:
                    if strict:
                        raise ValueError(f"{path}: {error}") from error
                    held.append({"path": path, "record_type": "damaged", "valid": False})
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return read


def read_archives(archives: DataFrame, strict: bool = True, payload: bool = True) -> DataFrame:
    """All records of archives (path, content); a revisit has the digest and length it stands for."""
    return archives.select("path", "content").mapInArrow(_read(strict, payload), RECORD_SCHEMA)


def page_of(column: str):
    """The page id in a record id written here."""
    return F.nullif(F.substring(F.col(column), len(ID_PREFIX) + 1, 40), F.lit("")).cast("long")


def roundtrip(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write all pages, read the archives back, one row per page."""
    records = read_archives(durable(write_archives(pages, revisit_from=revisit_from)), payload=False)
    return records.select(
        page_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of("refers_to").alias("refers_to"),
    )
