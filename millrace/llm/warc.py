"""WARC archives: one gzip member a record, with revisit records for equal payloads.

The reader is sequential: it inflates a file in chunks, member by member, frames each block by its
content length and verifies the digests of block and payload.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .files import new_file, open_input

CHUNK = 1 << 20
#: A task starts a new archive beyond this many bytes.
ARCHIVE_BYTES = 256 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: Headers
    block: bytes


def _header_text(v: str | None) -> str:
    return " ".join((v or "").split())


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member: version line, headers, block."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    raw = b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def read_records(chunks: Iterable[bytes]) -> Iterator[Record]:
    """Records of a WARC file from its bytes in order; digests that the headers give are verified."""
    inflate, member = None, bytearray()
    for chunk in chunks:
        while chunk:
            if inflate is None:
                inflate = zlib.decompressobj(31)
            member += inflate.decompress(chunk)
            chunk = inflate.unused_data
            if inflate.eof:
                yield _parse(bytes(member))
                inflate, member = None, bytearray()
    if inflate is not None:
        raise ValueError("the last member is cut off")


class Headers(dict):
    """Header values by name, whatever its case."""

    def __init__(self, pairs: Iterable[tuple[str, str]]):
        super().__init__((k.lower(), v) for k, v in pairs)

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def get(self, name: str, default=None):
        return super().get(name.lower(), default)


def _check(want: str | None, data: bytes, what: str) -> None:
    """Hold data against a digest of an algorithm that is known here; others pass unverified."""
    kind, _, value = (want or "").partition(":")
    if not value or kind.lower() not in ("sha1", "sha256", "md5"):
        return
    found = hashlib.new(kind.lower(), data).digest()
    if value.lower() != found.hex() and value.upper().rstrip("=") != base64.b32encode(found).decode().rstrip("="):
        raise ValueError(f"the {what} doesn't match its digest")


def _parse(raw: bytes) -> Record:
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    pairs: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and pairs:  # a folded line goes on
            pairs[-1] = (pairs[-1][0], f"{pairs[-1][1]} {line.strip()}")
        else:
            name, _, value = line.partition(":")
            pairs.append((name.strip(), value.strip()))
    headers = Headers(pairs)
    n = int(headers["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the content length doesn't frame the record")
    block = rest[:n]
    _check(headers.get("WARC-Block-Digest"), block, "block")
    if headers["WARC-Type"] == "response" and not headers.get("WARC-Truncated"):
        _check(headers.get("WARC-Payload-Digest"), _payload(headers, block), "payload")
    return Record(headers, block)


def _payload(headers: Headers, block: bytes) -> bytes:
    """What follows the protocol's own headers in a response, else the whole block."""
    http = headers.get("Content-Type", "application/http").lower().startswith("application/http")
    return block.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] in ("response", "request") and http else block


def _urn(i: int | None) -> str:
    return f"<urn:page:{'' if i is None else i}>"


def _page(urn: str | None) -> int | None:
    """The page number of a record id made here; other ids have none."""
    v = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(v) if (urn or "").startswith("<urn:page:") and v else None


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, name, size, records = TaskContext.get().partitionId(), None, "", 0, 0

        def report():
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [records], "bytes": [size]})

        for batch in batches:
            for page, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                revisit = refers_to is not None
                block = _HTTP if revisit else _HTTP + payload
                headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", _header_text(url)), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("WARC-Block-Digest", "sha1:" + digest(block)), ("X-Payload-Length", str(len(payload)))]
                if revisit:
                    headers += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", _PROFILE)]
                if out is None:
                    (out, name), size, records = new_file(folder, f"pages-{task:06d}", ".warc.gz"), 0, 0
                member = record_bytes(headers, block)
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    yield report()
                    out = None
        if out is not None:
            out.close()
            yield report()

    return run


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = 0) -> DataFrame:
    """Write one WARC record for each page; returns the stored manifest of archives (``archive``, ``records``, ``bytes``).

    Of pages with equal payloads of at least ``least_revisit`` bytes that with the smallest id is the response, the
    others are revisits that refer to it. A null html is an empty payload. A row with a null id is always a
    response that nothing refers to; rows that repeat the smallest id are all responses.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").alias("html"))
    keys = rows.where("id is not null").select("id", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("k"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).where(F.col("n") >= least_revisit)
    firsts = keys.groupBy("k").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    revisits = keys.join(firsts, "k").where("id > first").select("id", "k", F.col("first").alias("refers_to")).distinct()
    hashed = rows.withColumn("k", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    placed = hashed.join(revisits, ["id", "k"], "left").select("id", "url", "html", "refers_to")
    return common.stored(placed.mapInArrow(_write(folder), "archive string, records long, bytes long"), "warc-manifest")


_FIELDS = [("page_id", T.LongType()), ("url", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("payload", T.BinaryType()), ("record_id", T.StringType()), ("refers_to_id", T.StringType())]
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string()]


def _rows(records: Iterator[Record]) -> Iterator[pa.RecordBatch]:
    out, held = [], 0

    def flush():
        columns = list(zip(*out, strict=True)) or [()] * len(_FIELDS)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], [n for n, _ in _FIELDS])

    for r in records:
        h = r.headers
        payload = None if h["WARC-Type"] == "revisit" else _payload(h, r.block)
        n = len(payload) if payload is not None else int(h.get("X-Payload-Length", 0))
        told = (h.get("WARC-Payload-Digest") or "").partition(":")[2] or (digest(payload) if payload is not None else None)
        refers = h.get("WARC-Refers-To")
        out.append((_page(h.get("WARC-Record-ID")), h.get("WARC-Target-URI"), n, told, h["WARC-Type"], _page(refers), payload, h.get("WARC-Record-ID"), refers))
        held += n
        if held > 8 << 20 or len(out) >= 2000:
            yield flush()
            out, held = [], 0
    if out:
        yield flush()


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Read archives sequentially, one task for each: page id, url, payload with its size and digest, record type and what it refers to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open_input(folder, name) as f:
                    yield from _rows(read_records(iter(lambda: f.read(CHUNK), b"")))  # noqa: B023  read at once

    spread = manifest.select("archive").repartition(common.shuffle_partitions(manifest.sparkSession), "archive")
    return spread.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in _FIELDS]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Read WARC files, of whatever origin, by a path that only Spark's readers need to reach; each file lies in memory once.

    Records of all types are rows: ``record_id`` and ``refers_to_id`` are the headers' own, ``page_id`` and ``refers_to`` numbers where
    they were written here. A missing payload digest is computed; one of an unknown algorithm isn't verified.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                yield from _rows(read_records(content[i : i + CHUNK] for i in range(0, len(content), CHUNK)))  # noqa: B023

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in _FIELDS]))


def warc_round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page to archives in the shared folder and read them back."""
    folder = common.scratch(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, id_col=id_col, url_col=url_col, html_col=html_col)
    return read_archives(manifest, folder)
