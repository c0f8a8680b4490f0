"""WARC archives: write with revisit records, read back sequentially (operator 5).

Archives hold one gzip member per record.  The reader takes the file front to back: it inflates
each member as its bytes arrive, cuts the record by its Content-Length, and checks the block and
payload digests.  A damaged archive raises; nothing is skipped.

Cases: a null payload is an empty one; a null url leaves the target field out; control characters
of a url are percent-encoded in its field; a null id gives a null id back and is never another
row's original; rows that repeat an id are records of their own (copies of the largest id are all
responses); an empty table gives no archive.  Columns beyond the three are not read.  A record is
held in memory whole, an archive never is.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import open_in, open_out, scratch, written

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A revisit is written for payloads of at least so many bytes.
MIN_REVISIT = 1000


@dataclass
class Record:
    """A record as read: header fields, HTTP header of the block, payload, and the verdict on its digests."""

    fields: dict[str, str]
    http: bytes
    payload: bytes
    verified: bool


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, original: int | None, level: int = 5) -> bytes:
    """One record as a gzip member; a revisit of ``original`` when that is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if original is not None else http + payload
    fields = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}",
              f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    if original is not None:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{original}>"]
    fields += [f"WARC-Payload-Digest: {_digest(payload)}", f"WARC-Block-Digest: {_digest(block)}",
               "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    raw = "\r\n".join(fields).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return press.compress(raw) + press.flush()


def members(stream, piece: int = 1 << 16) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one after the other."""
    data = b""
    while data or (data := stream.read(piece)):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if not data and not (data := stream.read(piece)):
                raise ValueError("archive ends inside a record")
            out.append(inflate.decompress(data))
            data = inflate.unused_data if inflate.eof else b""
        yield b"".join(out)


def read_records(stream) -> Iterator[Record]:
    """The records of an archive, in order, digests checked."""
    for raw in members(stream):
        end = raw.find(b"\r\n\r\n")
        lines = raw[:end].decode("utf-8", "surrogatepass").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/1."):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        block = raw[end + 4:end + 4 + int(fields["Content-Length"])]
        if len(block) != int(fields["Content-Length"]) or raw[end + 4 + len(block):] != b"\r\n\r\n":
            raise ValueError("record length does not fit its Content-Length")
        cut = block.find(b"\r\n\r\n") + 4
        payload = block[cut:]
        whole = fields["WARC-Type"] == "revisit" or _digest(payload) == fields["WARC-Payload-Digest"]
        yield Record(fields, block[:cut], payload, whole and _digest(block) == fields["WARC-Block-Digest"])


def write_archives(pages: DataFrame, out_dir: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", archive_bytes: int = 64 << 20) -> DataFrame:
    """Write a record per row; return the manifest (``path, n_records, n_bytes``).

    Repeated payloads are found by digest on narrow rows: a partial maximum of the id per digest,
    kept only where a digest repeats.  The rows then join it on the digest; a digest with a third
    of the rows is split by the skew join.
    """
    out_dir = out_dir or scratch(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"),
                        F.sha1(payload).alias("digest"))
    first = (rows.where((F.octet_length("payload") >= MIN_REVISIT) & F.col("id").isNotNull())
             .groupBy("digest").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("copies"))
             .where("copies > 1").select("digest", "top"))
    todo = rows.join(first, "digest", "left").select(
        "id", "url", "payload", F.when(F.col("top") != F.coalesce("id", F.col("top") - 1), F.col("top")).alias("original"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stamp, seq = TaskContext.get().partitionId(), uuid.uuid4().hex[:8], 0
        out = path = None
        n = size = 0
        for b in batches:
            for i, u, p, o in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "original"))):
                if out is None:
                    path, n, size = f"{out_dir}/{part:06d}-{seq:06d}-{stamp}.warc.gz", 0, 0
                    out = open_out(path)
                data = record_bytes(i, u, p, o)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    yield pa.record_batch({"path": [path], "n_records": [n], "n_bytes": [size]})
                    out, seq = None, seq + 1
        if out is not None:
            out.close()
            yield pa.record_batch({"path": [path], "n_records": [n], "n_bytes": [size]})

    return written(todo.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row per record of the archives in ``manifest``.

    ``payload_bytes`` and ``payload_digest`` are of the full payload, for revisits too (from the
    kept HTTP header and the digest field).  ``with_payload`` adds the stored ``payload``.
    """
    schema = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
              "refers_to long, verified boolean" + (", payload binary" if with_payload else ""))

    def number(x: str | None) -> int | None:
        found = re.fullmatch(r"<urn:x-page:(-?\d+)>", x or "")
        return int(found[1]) if found else None

    def row(r: Record) -> tuple:
        length = re.search(rb"Content-Length: (\d+)", r.http)
        url = r.fields.get("WARC-Target-URI")
        digest = base64.b32decode(r.fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        out = (number(r.fields["WARC-Record-ID"]), None if url is None else unquote(url, errors="surrogatepass"),
               int(length[1]), digest, r.fields["WARC-Type"], number(r.fields.get("WARC-Refers-To")), r.verified)
        return out + (r.payload,) if with_payload else out

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for b in batches:
            for path in b.column("path").to_pylist():
                rows: list[tuple] = []
                held = 0
                with open_in(path) as stream:
                    for r in read_records(stream):
                        if not r.verified:
                            raise ValueError(f"digest mismatch in {path}: {r.fields['WARC-Record-ID']}")
                        rows.append(row(r))
                        held += len(r.payload) * with_payload + 200
                        if held >= 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    n = manifest.count()
    return manifest.select("path").repartition(max(1, min(n, 20_000))).mapInArrow(read, schema)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages``, read the archives back, one row per page."""
    return read_archives(write_archives(pages)).drop("url", "verified")
