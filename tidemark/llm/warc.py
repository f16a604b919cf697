"""WARC archives: a writer of one gzip member per record, and a sequential reader.

The reader decompresses in steps, frames records by their Content-Length, and checks digests while bytes
pass, so its memory doesn't grow with records or archives.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import scratch, stored
from .common import quoted, text_bytes
from .files import open_folder

#: Compressed bytes after which a task begins another archive; one task reads one archive.
ROLL_BYTES = 256 << 20
#: Payloads from this size on are kept once.
MIN_REVISIT_BYTES = 1000
#: Rows of (digest, id), some 80 bytes each, that may be broadcast.
BROADCAST_ROWS = 300_000
STEP = 1 << 16
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ------------------------------------------------------------------------------------- records

def digest_header(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record_bytes(
    record_id: str, url: str | None, payload: bytes, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z"
) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP header of the payload alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: {digest_header(hashlib.sha1(payload).digest())}",
        f"WARC-Block-Digest: {digest_header(hashlib.sha1(block).digest())}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {url}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class BadRecord(ValueError):
    pass


class _Member:
    """The decompressed bytes of one gzip member, a step at a time."""

    def __init__(self, source: BinaryIO, ahead: bytes):
        self.source, self.ahead, self.buffer = source, ahead, b""
        self.unpacker = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.unpacker.eof:
            return False
        data = self.unpacker.unconsumed_tail or self.ahead or self.source.read(STEP)
        if not self.unpacker.unconsumed_tail:
            self.ahead = b""
        if not data:
            raise BadRecord("the archive ends inside a record")
        try:
            self.buffer += self.unpacker.decompress(data, STEP)
        except zlib.error as e:
            raise BadRecord(f"not a gzip member: {e}") from None
        return True

    def header(self) -> dict[str, str]:
        """Lines up to the empty one; the first is kept under an empty name."""
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if len(self.buffer) > 1 << 20 or not self._more():
                raise BadRecord("a header doesn't end")
        lines, self.buffer = self.buffer[:end].decode("utf-8", "replace").split("\r\n"), self.buffer[end + 4 :]
        fields = {"": lines[0]}
        for line in lines[1:]:
            name, colon, value = line.partition(":")
            if not colon:
                raise BadRecord("a header line has no name")
            fields[name.strip().lower()] = value.strip()
        return fields

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self._more():
                raise BadRecord("a record is shorter than its Content-Length")
            part, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(part)
            yield part

    def close(self) -> bytes:
        """Checks the end of the record and gives compressed bytes that belong to the next one."""
        if b"".join(self.take(4)) != b"\r\n\r\n":
            raise BadRecord("a record is longer than its Content-Length")
        while not self.buffer and self._more():
            pass
        if self.buffer:
            raise BadRecord("a gzip member holds more than one record")
        return self.unpacker.unused_data + self.ahead


def _length(fields: dict[str, str]) -> int:
    value = fields.get("content-length", "")
    if not value.isdigit():
        raise BadRecord("no Content-Length")
    return int(value)


def read_records(source: BinaryIO, with_payload: bool = False) -> Iterator[dict]:
    """Records of an archive in order; a damaged one ends it with a row whose ``error`` says why."""
    ahead = b""
    while True:
        ahead = ahead or source.read(STEP)
        if not ahead:
            return
        member, row = _Member(source, ahead), {}
        try:
            fields = member.header()
            if not fields[""].startswith("WARC/"):
                raise BadRecord("not a WARC record")
            row = {
                "record_id": fields.get("warc-record-id", "").strip("<>") or None,
                "url": fields.get("warc-target-uri"),
                "record_type": fields.get("warc-type"),
                "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
                "payload_digest": None, "payload_bytes": None, "payload": None, "error": None,
            }
            left = _length(fields)
            block, body, kept, size = hashlib.sha1(), hashlib.sha1(), [], 0
            http, inner = b"", None
            for part in member.take(left):
                block.update(part)
                if inner is None:
                    http += part
                    if (end := http.find(b"\r\n\r\n")) < 0:
                        continue
                    inner, part = http[:end].decode("latin-1"), http[end + 4 :]
                body.update(part)
                size += len(part)
                if with_payload:
                    kept.append(part)
            ahead = member.close()
            named = fields.get("warc-payload-digest", "").removeprefix("sha1:")
            if fields.get("warc-block-digest") not in (None, digest_header(block.digest())):
                raise BadRecord("the block has another digest")
            if row["record_type"] == "revisit":
                lengths = [x.partition(":")[2].strip() for x in (inner or "").split("\r\n") if x.lower().startswith("content-length:")]
                row["payload_bytes"] = int(lengths[0]) if lengths and lengths[0].isdigit() else None
                row["payload_digest"] = base64.b32decode(named).hex() if named else None
            else:
                if named and named != base64.b32encode(body.digest()).decode():
                    raise BadRecord("the payload has another digest")
                row |= {"payload_bytes": size, "payload_digest": body.hexdigest(), "payload": b"".join(kept) if with_payload else None}
        except ValueError as e:  # BadRecord, or a value that can't be decoded
            yield dict.fromkeys(("record_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")) | row | {"error": str(e)}
            return
        yield row


# -------------------------------------------------------------------------------------- Spark

def with_originals(pages: DataFrame, page_id: str, payload: Column, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds ``_refers_to``: the largest id with the same payload, for the other rows with it.

    Only digests and ids are shuffled. Repeated payloads are few rows and are broadcast after a count; more
    than ``BROADCAST_ROWS`` of them are joined by a shuffle on the digest, whose hot keys Spark splits.
    """
    digest = F.when(F.octet_length(payload) >= min_bytes, F.unhex(F.sha1(payload)))
    repeated = stored(
        pages.select(digest.alias("_digest"), F.col(page_id).alias("_id")).where("_digest IS NOT NULL")
        .groupBy("_digest").agg(F.max("_id").alias("_original"), F.count("*").alias("n")).where("n > 1").drop("n"),
        "repeated-payloads",
    )
    small = repeated.count() <= BROADCAST_ROWS
    joined = pages.withColumn("_digest", digest).join(F.broadcast(repeated) if small else repeated, "_digest", "left")
    refers = F.when(~F.col(page_id).eqNullSafe(F.col("_original")), F.col("_original"))
    return joined.withColumn("_refers_to", refers).drop("_digest", "_original")


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    min_bytes: int = MIN_REVISIT_BYTES, roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Writes a record per row and returns the archives (path, records, bytes) as a stored table.

    NULL payloads are empty and a NULL url leaves its header out. Of rows with equal payloads of at least
    ``min_bytes``, those with the largest id are responses and the others revisit it. Every attempt of a
    task writes files of its own names; those of a lost attempt are in no manifest and are never read.
    """
    rows = pages.select(F.col(quoted(page_id)).cast("long").alias("id"), F.col(quoted(url)).alias("url"), F.coalesce(F.col(quoted(html)), F.lit("")).cast("binary").alias("body"))
    rows = with_originals(rows, "id", F.col("body"), min_bytes).select("id", "url", "body", "_refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        fs.create_dir(path, recursive=True)
        done, out, name, records, size = [], None, "", 0, 0
        for batch in batches:
            for doc, address, body, refers in zip(*[batch.column(0).to_pylist(), text_bytes(batch.column(1)), text_bytes(batch.column(2)), batch.column(3).to_pylist()]):
                if out is None:
                    name, records, size = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(name, compression=None)
                address = None if address is None else quote(address, safe="!#$%&'()*+,/:;=?@[]~")
                data = gzip_member(record_bytes(f"urn:page:{doc}", address, body, None if refers is None else f"urn:page:{refers}"))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= roll_bytes:
                    out.close()
                    done.append((name, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records, size))
        base = folder.rstrip("/")
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{base}/{n.rpartition('/')[2]}" for n, *_ in done], pa.string())]
            + [pa.array([x[i] for x in done], pa.int64()) for i in (1, 2)],
            names=["path", "records", "bytes"],
        )

    return stored(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


RECORDS = "record_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string"


def read_archives(archives: DataFrame, with_payload: bool = False, batch_rows: int = 500, whole: bool = False) -> DataFrame:
    """The records of all archives in ``path``, one archive a task, each read once from start to end.

    With ``whole`` the job fails on a damaged record, and on an archive with other than the ``records`` that
    its row counts. Otherwise a damaged record is the last row of its archive and has an ``error``.
    """
    paths = archives.select("path", *["records"] * whole).repartition(max(1, archives.count()))
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

        rows: list[dict] = []
        for b in batches:
            for uri, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist() if whole else itertools.repeat(None)):
                fs, path = open_folder(uri)
                read = 0
                with fs.open_input_stream(path, compression=None) as source:
                    for row in read_records(source, with_payload):
                        if whole and row["error"]:
                            raise BadRecord(f"record {read} of {uri}: {row['error']}")
                        read += 1
                        rows.append(row)
                        if len(rows) >= batch_rows:
                            yield batch(rows)
                            rows = []
                if whole and read != records:
                    raise BadRecord(f"{uri} has {read} records, its manifest counts {records}")
        yield batch(rows)

    return paths.mapInArrow(run, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back; the job fails where a record is lost or damaged."""
    return read_archives(write_archives(pages, scratch(spark, "warc")), whole=True)
