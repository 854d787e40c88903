"""Operator 2, WARC: archives written and read as streams of chunk rows.

A payload travels as rows of a record identifier and a chunk number, never as a whole: the writer
appends each chunk to the open gzip member and feeds the record's digest, the reader yields chunks
with the digest so far.  Every record is a gzip member of its own.  A task writes files under new
names and returns them; only files that the table of finished tasks lists are ever read, so a task
that runs again leaves nothing wrong behind.

Defined results: a null payload is empty; of equal payloads of at least ``revisit_from`` bytes the one
with the smallest ``page_id`` is a response and the others revisit it, rows that repeat that very
``page_id`` being responses too; a null ``page_id`` comes after all others, and where all ids are null
every row is a response; payloads of any length are taken whole, chunk by chunk; an empty table gives no
archives; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, written

CHUNK = 16 << 10
#: A task begins another file beyond this many bytes.
FILE_BYTES = 256 << 20
LEVEL = 3
DATE = "2020-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNKS = (
    "page_id long, record_id string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "chunk_no int, last boolean, chunk binary, bytes_so_far long, digest_so_far string"
)
COLUMNS = [c.split()[0] for c in CHUNKS.split(", ")]


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def opened(uri: str):
    """A file system that tasks reach without Spark, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def record_id(page_id: int | None, where: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, where if page_id is None else f'page:{page_id}')}>"


def header_value(text: str) -> str:
    """Control characters and what is not ASCII, percent-encoded."""
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), text)


def records(pages: DataFrame, payload: str = "html", revisit_from: int = 0) -> DataFrame:
    """(page_id, url, payload, length, sha1, record_type, refers_to) of each row."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("length", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    same = rows.where(F.col("length") >= revisit_from).groupBy("length", "sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # written, so that a join may deal out the many rows of one payload, or send the few that repeat
    repeated = written(same.where("n > 1").drop("n"), "repeated")
    met = rows.join(repeated, ["length", "sha1"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return met.select(
        "page_id", "url", "payload", "length", "sha1",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Records as rows of (…, chunk_no, last, chunk), in order and one after the other; a revisit has one, empty."""
    stored = F.when(F.col("record_type") == "response", F.col("length")).otherwise(F.lit(0))
    last = F.expr(f"CAST(greatest(stored - 1, 0L) div {chunk} AS INT)")
    numbered = rows.withColumn("stored", stored).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    part = F.when(F.col("stored") > 0, F.expr(f"substring(payload, chunk_no * {chunk} + 1, {chunk})")).otherwise(F.lit(b""))
    return numbered.select(
        "page_id", "url", "length", "sha1", "record_type", "refers_to", "chunk_no", (F.col("chunk_no") == last).alias("last"), part.alias("chunk")
    )


class ArchiveWriter:
    """Appends records to files of one task, chunk by chunk."""

    def __init__(self, folder: str, file_bytes: int = FILE_BYTES):
        self.system, self.folder = opened(folder)
        self.system.create_dir(self.folder, recursive=True)
        self.file_bytes, self.file, self.done = file_bytes, None, []

    def begin(self, page_id, url, length: int, sha1: str, record_type: str, refers_to) -> None:
        if self.file is None:
            self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.gz"
            self.file, self.written, self.records = self.system.open_output_stream(self.path, compression=None), 0, 0
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
        fields = {
            "WARC-Type": record_type,
            "WARC-Record-ID": record_id(page_id, f"{self.path}:{self.records}"),
            "WARC-Date": DATE,
            "WARC-Target-URI": header_value(url) if url else None,
            "Content-Type": "application/http; msgtype=response",
            "WARC-Payload-Digest": "sha1:" + base32(bytes.fromhex(sha1)),
            "Content-Length": len(http) + (length if record_type == "response" else 0),
            "Page-ID": page_id,
        }
        if record_type == "revisit":
            fields |= {"WARC-Profile": REVISIT, "WARC-Refers-To": record_id(refers_to, ""), "Refers-To-Page-ID": refers_to}
        head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
        self.member, self.sha1, self.digest = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), sha1, hashlib.sha1()
        self.put(VERSION + head.encode() + b"\r\n" + http)

    def put(self, data: bytes, end: bool = False) -> None:
        out = self.member.compress(data) + (self.member.flush() if end else b"")
        self.file.write(out)
        self.written += len(out)

    def chunk(self, data: bytes, last: bool, stored: bool) -> None:
        self.digest.update(data)
        self.put(data + b"\r\n\r\n" * last, last)
        if last:
            if stored and self.digest.hexdigest() != self.sha1:
                raise ValueError(f"the chunks of a record of {self.path} don't make up its payload")
            self.records += 1
            if self.written >= self.file_bytes:
                self.close()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.done.append((self.path, self.written, self.records))
            self.file = None


def write(chunks: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives; the table of their files: (path, bytes, records)."""
    scheme = folder.partition("://")[0] + "://" if "://" in folder else ""

    def run(batches):
        import pandas as pd

        out = ArchiveWriter(folder, file_bytes)
        for batch in batches:
            names = {n: batch.column(n) for n in batch.schema.names}
            small = {n: names[n].to_pylist() for n in names if n != "chunk"}
            for i, data in enumerate(names["chunk"]):
                if small["chunk_no"][i] == 0:
                    out.begin(*(small[n][i] for n in ("page_id", "url", "length", "sha1", "record_type", "refers_to")))
                out.chunk(data.as_py(), small["last"][i], small["record_type"][i] == "response")
        out.close()
        import pyarrow as pa

        frame = pd.DataFrame(out.done, columns=["path", "bytes", "records"]).astype({"path": "str", "bytes": "int64", "records": "int64"})
        yield pa.RecordBatch.from_pandas(frame, schema=pa.schema({"path": pa.string(), "bytes": pa.int64(), "records": pa.int64()}), preserve_index=False)

    files = written(chunks.mapInArrow(run, "path string, bytes long, records long"), "archives")
    return files.withColumn("path", F.concat(F.lit(scheme), "path")) if scheme else files


def fields_of(stream) -> dict[str, str]:
    out = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def read_archive(path: str, chunk: int = CHUNK, with_payload: bool = True):
    """Rows of ``COLUMNS`` from one file, which is read as a stream."""
    system, place = opened(path)
    with system.open_input_stream(place, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 17) as stream:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                if line.strip():
                    raise ValueError(f"no record begins where one should, in {path}")
                continue
            head = fields_of(stream)
            left = int(head["content-length"])
            status = stream.readline()
            http, size = {}, len(status)
            while (line := stream.readline()) not in (b"\r\n", b""):
                size += len(line)
                name, _, value = line.decode().partition(":")
                http[name.strip().lower()] = value.strip()
            left -= size + 2
            digest, number, so_far = hashlib.sha1(), 0, 0
            same = (
                int(head["page-id"]) if "page-id" in head else None,
                head["warc-record-id"],
                head["warc-type"],
                int(head["refers-to-page-id"]) if "refers-to-page-id" in head else None,
                int(http["content-length"]),
                head["warc-payload-digest"].removeprefix("sha1:"),
            )
            while True:
                data = stream.read(min(chunk, left))
                left -= len(data)
                so_far += len(data)
                digest.update(data)
                last = not left or not data
                yield (*same, number, last, data if with_payload else None, so_far, base32(digest.digest()) if last or with_payload else None)
                number += 1
                if last:
                    break


def read(files: DataFrame, chunk: int = CHUNK, with_payload: bool = True) -> DataFrame:
    """Chunk rows of the archives that ``files`` lists: see ``CHUNKS``.

    Without payloads only the last row of each record is given, with the digest of all its bytes.
    """

    def run(frames):
        import pandas as pd

        def frame(rows):
            out = pd.DataFrame(rows, columns=COLUMNS)
            return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64", "chunk_no": "int32", "bytes_so_far": "int64"})

        for part in frames:
            for path in part["path"]:
                rows = []
                for row in read_archive(path, chunk, with_payload):
                    if with_payload or row[7]:
                        rows.append(row)
                    if len(rows) >= 1000:
                        yield frame(rows)
                        rows = []
                yield frame(rows)

    count = max(1, files.count())
    return files.select("path").repartition(count).mapInPandas(run, CHUNKS)


def archive(pages: DataFrame, payload: str = "html", revisit_from: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder; the table of files."""
    folder = fresh_path(pages.sparkSession, "warc")
    return write(chunked(records(pages, payload, revisit_from)), folder)


def survey(files: DataFrame) -> DataFrame:
    """What the archives say: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's numbers come from the bytes read; a revisit's from its headers, as it has no payload.
    """
    ends = read(files, with_payload=False)
    response = F.col("record_type") == "response"
    return ends.select(
        "page_id",
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
