"""Web archives: a writer of WARC files with revisit records, and a sequential reader (operator 10)."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, written

#: A task begins another archive beyond so many compressed bytes.
ARCHIVE_BYTES = 64 << 20
#: Bytes read from a file at once.
READ_BYTES = 1 << 20
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def _safe(url: str) -> str:
    """A URL for a header line: what would end or blur the line is percent-encoded."""
    return re.sub(r"[^\x21-\x7e]|%", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def _unsafe(url: str) -> str:
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), url.encode()).decode()


def member(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One record as a gzip member of its own; first: the page that it revisits, or None for a response."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += payload if first is None else b""
    head = {
        "WARC-Type": "response" if first is None else "revisit", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE, "WARC-Target-URI": None if url is None else _safe(url),
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}", "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "WARC-Page-ID": page_id,
        "WARC-Refers-To": None if first is None else record_id(first), "WARC-Refers-To-Page-ID": first, "WARC-Profile": None if first is None else PROFILE,
        "Content-Type": "application/http;msgtype=response", "Content-Length": len(block),
    }
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(lines.encode() + block + b"\r\n\r\n") + pack.flush()


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes
    payload_bytes: int

    @property
    def digest(self) -> str:
        return self.headers["WARC-Payload-Digest"].removeprefix("sha1:")


def members(file: BinaryIO) -> Iterator[bytes]:
    """The content of each gzip member of a file, which is read once from front to back."""
    raw = file.read(READ_BYTES)
    while raw:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not raw:
                raise ValueError("the archive ends within a record")
            parts.append(unpack.decompress(raw))
            raw = unpack.unused_data if unpack.eof else file.read(READ_BYTES)
        yield b"".join(parts)
        raw = raw or file.read(READ_BYTES)


def records(file: BinaryIO) -> Iterator[Record]:
    """The records of an archive. Raises ValueError where framing or a digest is wrong."""
    for data in members(file):
        head, mark, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not mark or not version.startswith("WARC/"):
            raise ValueError("a record doesn't begin with a WARC header")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        block = rest[:size]
        if len(block) != size or rest[size:] != b"\r\n\r\n":
            raise ValueError("a record's length isn't its Content-Length")
        if "sha1:" + base32_sha1(block) != headers["WARC-Block-Digest"]:
            raise ValueError("a block's digest is wrong")
        http, _, payload = block.partition(b"\r\n\r\n")
        told = re.search(rb"(?im)^content-length: *(\d+)", http)
        full = int(told[1]) if told else len(payload)
        if headers["WARC-Type"] == "response" and (len(payload) != full or "sha1:" + base32_sha1(payload) != headers["WARC-Payload-Digest"]):
            raise ValueError("a payload's length or digest is wrong")
        yield Record(headers, payload, full)


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes `pages` (page_id, url, html) as archives under the URI `folder`; returns path, n_records and n_bytes of each file.

    Of pages whose payloads (html in UTF-8; null: empty) are equal and at least `min_bytes` long, those with the smallest
    page_id are responses and the others revisit them; smaller ones are all responses. Equality is that of SHA-256, whose
    minima are pre-aggregated; the join back is one whose hot digests AQE splits. A null page_id comes after all others; with
    no other of its payload it is a response. Rows that repeat the smallest page_id are responses as well. Each task
    writes files of its own, under another name until they are whole, so a task that runs again replaces its files.
    Null url: no target header. No rows: no files. Other columns are ignored.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("same", F.sha2("html", 256))
    firsts = slim.groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("same", "first")
    revisits = (F.octet_length("html") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    told = slim.join(firsts, "same", "left").select("page_id", "url", "html", F.when(revisits, F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        done, out, path, n = [], None, "", 0

        def close() -> None:
            size = out.tell()
            out.close()
            fs.move(f"{path}.{attempt}", path)
            done.append((f"{folder}/{path.rsplit('/', 1)[1]}", n, size))

        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                if out is None:
                    path, n = f"{base}/pages-{task:06d}-{len(done):04d}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}.{attempt}", compression=None)
                out.write(member(page_id, url, html.encode(), first))
                n += 1
                if out.tell() >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        columns = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["path", "n_records", "n_bytes"])

    return written(told.mapInArrow(run, "path string, n_records long, n_bytes long"))


def read(archives: DataFrame) -> DataFrame:
    """The records of `archives` (path), read front to back: RECORDS, and html (null for a revisit). A wrong digest fails the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = FileSystem.from_uri(uri)
                with fs.open_input_stream(path, compression=None) as file:
                    rows: list[tuple] = []
                    held = 0
                    for r in records(file):
                        h, response = r.headers, r.headers["WARC-Type"] == "response"
                        number = lambda k, h=h: int(h[k]) if k in h else None
                        url = h.get("WARC-Target-URI")
                        rows.append((number("WARC-Page-ID"), None if url is None else _unsafe(url), r.payload_bytes, r.digest, h["WARC-Type"], number("WARC-Refers-To-Page-ID"), r.payload.decode() if response else None))
                        held += len(r.payload)
                        if held > READ_BYTES * 8 or len(rows) >= 5000:
                            yield _rows(rows)
                            rows, held = [], 0
                    yield _rows(rows)

    paths = archives.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(run, RECORDS + ", html string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*(c.split()[0] for c in RECORDS.split(", ")), "html"])


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes `pages` as archives into a new folder beside the checkpoints, and returns what the reader finds there."""
    return read(write(pages, f"{scratch(pages.sparkSession)}/warc-{uuid.uuid4().hex}", min_bytes))
