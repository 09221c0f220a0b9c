"""WARC archives with resolved revisits.

Headers (payload digest, id, URL) are shuffled by digest, aggregated in each task first: the smallest id of a digest
is its response, the others become revisit records that refer to it. Only digests that stand more than once travel
back to the payloads: to every task while there are at most ``SENT`` of them, so that no payload is shuffled; beyond
that the payloads are joined to them. The records are written as gzip members, one a record, with fresh headers, into
archives of bounded size; a table in the shared folder holds the archives as binary values, so that Spark's committer
keeps one copy of each however often a task runs, and ``export_archives`` writes them as files. Reading parses each
archive once and joins revisits to the responses they name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import durable, new_folder, python_path
from .hot import hot_join, repeated

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 4 << 20
READ_BYTES = 64 << 10
SENT = 200_000  # most repeated digests to send to every task, some 150 bytes each
_UNSAFE = re.compile("[\\x00-\\x20\\x7f-\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _record(kind: str, rid: str, date: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {date}"]
    lines += [f"{k}: {v}" for k, v in fields] + [f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _safe(url: str | None) -> str:
    """A URL for a header line: spaces and control characters percent-encoded."""
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "urn:x-unknown"


def page_record(page: int, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, date: str, first_url: str | None = None) -> bytes:
    """A response, or a revisit of page ``refers_to``. The record's name holds the page and the digest, so that pages
    that repeat an id with other payloads have names of their own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = base64.b32encode(digest).decode()
    fields = [("WARC-Target-URI", _safe(url)), ("WARC-Payload-Digest", f"sha1:{name}")]
    kind, block = "response", http + payload
    if refers_to is not None:
        kind, block = "revisit", http
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}:{name}>"), ("WARC-Refers-To-Target-URI", _safe(first_url)), ("WARC-Refers-To-Date", date)]
    return _record(kind, f"urn:x-page:{page}:{name}", date, [*fields, ("Content-Type", "application/http; msgtype=response")], block)


def _members(archive: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, or the whole of a plain one; each byte is read once."""
    at = 0
    while at < len(archive):
        if archive[at : at + 2] != b"\x1f\x8b":
            yield archive[at:]
            return
        member, parts = zlib.decompressobj(31), []
        while at < len(archive) and not member.eof:
            piece = archive[at : at + READ_BYTES]
            parts.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        if not member.eof:
            raise ValueError("an archive ends within a record")
        yield b"".join(parts)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive whose members are gzip'd or plain."""
    for data in _members(archive):
        at = 0
        while True:
            while data[at : at + 1] in (b"\r", b"\n"):
                at += 1
            if at >= len(data):
                break
            end = data.find(b"\r\n\r\n", at)
            lines = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/") or end < 0:
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            at = end + 4 + int(fields["content-length"])
            yield fields, data[end + 4 : at]


def _payload(column: str):
    return F.coalesce(F.col(column), F.lit(""))


def resolve(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(digest binary, first, url, n) of the digests that more than one row with a payload of at least ``least_bytes``
    bytes has: the response's id and URL, and the number of rows."""
    rows = pages.where(F.col(id_col).isNotNull() & (F.octet_length(_payload(payload_col)) >= least_bytes))
    heads = rows.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.unhex(F.sha1(_payload(payload_col))).alias("digest"))
    return repeated(heads, "digest", "id", "url")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", sent: int = SENT) -> None:
    """Write a record for each row to a table (archive string, records int, warc binary) at ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one with the smallest id is a response and the
    others are revisits of it. A null payload counts as empty, a null URL as unknown; rows with a null id are left
    out; rows that repeat an id with the same payload get the same kind of record each, of the same name. No rows, no
    archives."""
    python_path(pages.sparkSession)
    schema = pa.schema([("archive", pa.string()), ("records", pa.int32()), ("warc", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = hashlib.sha1(b"".join(parts)).hexdigest() + ".warc.gz"
            info = _record("warcinfo", f"urn:x-archive:{name}", date, [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(parts)], pa.int32()), pa.array([info + b"".join(parts)], pa.binary())], schema=schema)

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page, url, html, digest, refers_to, first_url = (x.as_py() for x in row)
                parts.append(page_record(page, url, html.encode("utf-8", "surrogatepass"), digest, refers_to, date, first_url))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    parts, size = [], 0
        if parts:
            yield close()

    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), _payload(payload_col).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html")))
    again = resolve(pages, least_bytes, id_col, url_col, payload_col).withColumnRenamed("url", "first_url")
    few = again.count() <= sent
    # Beyond ``sent`` only headers meet the digests, hot ones apart; what is found is joined by id and digest.
    marks = again if few else hot_join(rows.select("id", "digest").distinct(), again, "digest")
    full = rows.join(F.broadcast(again.drop("n")), "digest", "left") if few else rows.join(marks, ["id", "digest"], "left")
    refers_to = F.when((F.col("first") != F.col("id")) & (F.octet_length("html") >= least_bytes), F.col("first"))
    full.select("id", "url", "html", "digest", refers_to.alias("refers_to"), "first_url").mapInArrow(run, "archive string, records int, warc binary").write.mode("overwrite").parquet(path)


def export_archives(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Write the archives of the table at ``path`` as .warc.gz files into ``folder`` (a path or a URI of a store that
    pyarrow knows) and return their names. A name is a hash of the content and a file appears by renaming, so a task that
    runs again writes the same file."""
    python_path(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        for batch in batches:
            for name, warc in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = f"{at}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(warc.as_py())
                store.move(part, f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["archive"])

    return spark.read.parquet(path).select("archive", "warc").mapInArrow(run, "archive string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, url, payload_bytes, payload_digest, refers_to) of the page records at ``path``; payloads
    of responses are checked against their digest, revisits take the payload length of the response they refer to."""
    python_path(spark)
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("own_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def page(uri: str) -> int:
        return int(uri.strip("<>").split(":")[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                out = []
                for fields, block in records(archive.as_py()):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"payload digest of {fields['warc-record-id']} doesn't match")
                    own = len(payload) if kind == "response" else None
                    out.append((page(fields["warc-record-id"]), kind, fields["warc-target-uri"], own, digest, page(fields["warc-refers-to"]) if kind == "revisit" else None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    found = spark.read.parquet(path).select("warc").mapInArrow(run, "page_id long, record_type string, url string, own_bytes long, payload_digest string, refers_to long")
    return found


def resolved_records(spark: SparkSession, path: str) -> DataFrame:
    """The records at ``path`` with payload_bytes: a revisit is joined to the response that it refers to. The archives
    are read once; what is kept of a record has no payload."""
    found = durable(read_archives(spark, path))
    whole = found.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.min("own_bytes").alias("first_bytes"))
    again = found.where("record_type = 'revisit'")
    asked = durable(whole.join(again.groupBy("refers_to", "payload_digest").agg(F.count("*").alias("n")), ["refers_to", "payload_digest"]))
    names = ["page_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to"]
    revisits = hot_join(again, asked, ["refers_to", "payload_digest"]).withColumnRenamed("first_bytes", "payload_bytes")
    return found.where("record_type = 'response'").withColumnRenamed("own_bytes", "payload_bytes").select(*names).unionByName(revisits.select(*names))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to fresh archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archives(pages, path, **options)
    return resolved_records(spark, path)
