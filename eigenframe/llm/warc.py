"""WARC archives: one gzip member per record, written and read in parallel.

Each task writes its rows to archives of bounded size in the shared folder, through
Arrow's file systems, so any store with a URI serves. An archive gets its final name
only when it is closed, and the list of archives is a table: what a lost or doubled
attempt leaves behind is never on it. A reader takes whole archives and goes through
them front to back in chunks, one zlib stream per member, framing each record by its
Content-Length and checking both digests; it holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenframe.llm.common import shared_uri
from eigenframe.plans.durable import stored

CHUNK = 1 << 16
NO_ID = "none"
DATE = "1970-01-01T00:00:00Z"  # the pages carry no date


class Damaged(ValueError):
    """A record that is cut short, badly framed, or fails its digest."""


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{NO_ID if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header, with the length of the payload it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_uri(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[^!-~]', lambda m: ''.join(f'%{b:02X}' for b in m[0].encode()), url or 'urn:none')}",
        f"WARC-Payload-Digest: {digest}",
        f"WARC-Block-Digest: {_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n") + deflate.compress(block) + deflate.compress(b"\r\n\r\n") + deflate.flush()


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one at a time."""
    data = b""
    while True:
        data = data or stream.read(CHUNK)
        if not data:
            return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not data:
                data = stream.read(CHUNK)
                if not data:
                    raise Damaged("a member is cut short")
            try:
                parts.append(inflate.decompress(data))
            except zlib.error as e:
                raise Damaged(f"a member does not inflate: {e}") from e
            data = inflate.unused_data
        yield b"".join(parts)


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (x.split(":", 1) for x in lines.decode().split("\r\n") if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def parse(member: bytes) -> dict:
    """The record of a member, framed and verified."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/1."):
        raise Damaged("not a WARC record")
    fields = _headers(head)
    length = int(fields.get("content-length", -1))
    block, end = rest[:length], rest[length:]
    if length < 0 or len(block) != length or end != b"\r\n\r\n":
        raise Damaged(f"{fields.get('warc-record-id')}: the block is not Content-Length bytes long")
    if fields.get("warc-block-digest") != _sha1(block):
        raise Damaged(f"{fields.get('warc-record-id')}: block digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    size, digest, kind = int(_headers(http)["content-length"]), fields["warc-payload-digest"], fields["warc-type"]
    if kind == "response" and (len(payload) != size or _sha1(payload) != digest):
        raise Damaged(f"{fields.get('warc-record-id')}: payload digest")
    return {
        "record_id": fields["warc-record-id"], "record_type": kind, "url": fields["warc-target-uri"],
        "payload_bytes": size, "payload_digest": base64.b32decode(digest.removeprefix("sha1:")).hex(),
        "refers_to": fields.get("warc-refers-to"), "payload": payload if kind == "response" else None,
    }


def with_originals(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, original): the page whose record holds an equal payload of ``least`` bytes or more.

    The original is the largest page_id among equal payloads; NULL if there is no other row.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.select("page_id", "url", F.encode("html", "UTF-8").alias("payload"))
    digest, size = F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")
    rows = rows.select("page_id", "url", "payload", digest, size)
    heads = rows.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("original"))
    heads = stored(heads.filter("n > 1").select(F.col("digest").alias("_d"), F.col("size").alias("_s"), "original"), "originals")
    same = (F.col("digest") == F.col("_d")) & (F.col("size") == F.col("_s"))
    return rows.join(heads, same, "left").select("page_id", "url", "payload", "digest", "original")


def write(pages: DataFrame, folder: str, least: int = 1000, archive_bytes: int = 256 << 20) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder``; the table of archives, already made.

    Of equal payloads of at least ``least`` bytes the largest page_id is a response and
    the others revisit it; if rows repeat that page_id, each of them is a response. A
    NULL html is an empty payload, a NULL url is ``urn:none``, a NULL page_id is kept
    and is never the original of others. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, size, rows = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            store.move(f"{root}/.{name}", f"{root}/{name}")
            return pa.record_batch([pa.array([f"{root}/{name}"]), pa.array([rows], pa.int64())], names=["archive", "records"])

        for batch in batches:
            for k in range(batch.num_rows):
                page, url, payload, digest, original = (batch.column(i)[k].as_py() for i in range(5))
                revisit = original is not None and original != page
                named = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
                data = record(page, url, payload, named, original, revisit)
                if out is not None and size + len(data) > archive_bytes:
                    yield close()
                    out = None
                if out is None:
                    name, size, rows = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/.{name}", compression=None)
                out.write(data)
                size, rows = size + len(data), rows + 1
        if out is not None:
            yield close()

    return stored(with_originals(pages, least).mapInArrow(run, "archive string, records long"), "archives")


SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Every record of the archives in ``archives``, verified; with ``payloads`` their bytes too (NULL for revisits).

    Each archive is one task's work, from front to back. Damage is an error that names the record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        page = lambda x: None if x is None or x == f"<urn:page:{NO_ID}>" else int(x[len("<urn:page:") : -1])
        for batch in batches:
            for archive, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held, seen = [], 0, 0
                with store.open_input_stream(archive, compression=None) as stream:
                    for member in members(stream):
                        r = parse(member)
                        row = (page(r["record_id"]), r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], page(r["refers_to"]))
                        rows.append((*row, r["payload"]) if payloads else row)
                        held, seen = held + (len(r["payload"] or b"") if payloads else 200), seen + 1
                        if held > 4 << 20:
                            yield _batch(rows, payloads)
                            rows, held = [], 0
                if seen != records:
                    raise Damaged(f"{archive}: {seen} records instead of {records}")
                if rows:
                    yield _batch(rows, payloads)

    spread = archives.repartition(max(1, archives.count()), "archive")
    return spread.mapInArrow(run, SCHEMA + (", payload binary" if payloads else ""))


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if payloads else [])]
    names = [*(x.split()[0] for x in SCHEMA.split(", ")), *(["payload"] if payloads else [])]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write archives of ``pages`` to the shared folder and read them back."""
    folder = shared_uri(pages.sparkSession, "warc")
    return read(write(pages, folder, least), folder)


