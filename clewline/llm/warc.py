"""WARC archives of pages: every record a Zstandard frame of its own, compressed with a dictionary that leads its file.

The file starts with a skippable frame that holds the dictionary, so an archive is read without anything beside it. Files
are written by tasks under names of their own attempt; a file counts only if the written manifest names it, so attempts
that failed or ran twice leave nothing that is read.
"""
from __future__ import annotations

import base64
import datetime as dt
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialise, scratch_path
from .registry import query, table

DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_SIZE = 48 << 10
#: Payloads that a file's dictionary is built from: those of its first records, at most so many and so many bytes.
SAMPLE_RECORDS, SAMPLE_BYTES = 256, 1 << 20
FILE_BYTES = 256 << 20
LEVEL = 3
DATE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _line(value) -> str:
    """A header value on one line."""
    return " ".join(str(value).split("\r\n")).replace("\r", " ").replace("\n", " ")


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {_line(v)}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool, date: str = DATE) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date), ("WARC-Target-URI", url),
               ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http; msgtype=response"),
               ("X-Page-Id", page_id), ("X-Payload-Length", len(payload))]
    if revisit:
        headers += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", refers_to)]
    return record(headers, http if revisit else http + payload)


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_SIZE) -> bytes:
    """A trained dictionary; of too few or too short samples, their own last bytes serve as one."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 4)), samples, k=512, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class ArchiveWriter:
    """One archive file; records are held back until there are enough to build the dictionary from."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str):
        self.path, self.records, self.size = path, 0, 0
        self.out = fs.open_output_stream(path)
        self.held: list[bytes] = []
        self.held_bytes = 0
        self.coder: zstandard.ZstdCompressor | None = None

    def _start(self):
        words = build_dictionary(self.held)
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(words)) + words)
        self.coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        name = self.path.rsplit("/", 1)[-1]
        info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE),
                       ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        for r in [info, *self.held]:
            self._put(self.coder.compress(r))
        self.held = []

    def _put(self, data: bytes):
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes):
        self.records += 1
        if self.coder is not None:
            self._put(self.coder.compress(data))
            return
        self.held.append(data)
        self.held_bytes += len(data)
        if len(self.held) >= SAMPLE_RECORDS or self.held_bytes >= SAMPLE_BYTES:
            self._start()

    def close(self):
        if self.coder is None:
            self._start()
        self.out.close()


def open_uri(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record per page into files below ``folder`` (a place all executors reach) and returns the manifest (path, records, bytes).

    Of pages with equal payloads that with the smallest id is a response, the others are revisits of it; rows that repeat
    an id and its payload are the same page and share a type. Null html is an empty payload. Null ids come after all others.
    """
    text = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    given = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), text.alias("html")).withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    heads = given.groupBy("sha").agg(F.min("page_id").alias("head"))
    ready = given.join(heads, "sha").select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("head").cast("string").alias("head"), (~F.col("page_id").eqNullSafe(F.col("head"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]):
        fs, root = open_uri(folder)
        part, made = TaskContext.get().partitionId(), []
        writer = None
        for batch in batches:
            for i in range(len(batch)):
                if writer is None:
                    writer = ArchiveWriter(fs, f"{root}/part-{part:05d}-{uuid.uuid4().hex}.warc.zst")
                page, link, body, head, revisit = (batch.column(k)[i].as_py() for k in range(5))
                writer.add(page_record(page, link, body.encode("utf-8", "replace"), head, revisit))
                if writer.size >= file_bytes:
                    writer.close()
                    made.append(writer)
                    writer = None
        if writer is not None:
            writer.close()
            made.append(writer)
        if made:
            base = folder.rstrip("/")
            yield pa.RecordBatch.from_arrays([pa.array([f"{base}/{w.path.rsplit('/', 1)[-1]}" for w in made]), pa.array([w.records for w in made], pa.int64()), pa.array([w.size for w in made], pa.int64())], names=["path", "records", "bytes"])

    root_fs, root_path = open_uri(folder)
    root_fs.create_dir(root_path, recursive=True)
    return materialise(ready.mapInArrow(run, "path string, records bigint, bytes bigint"), "manifest")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, one at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame leads the archive")
    words = stream.read(size)
    coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    plain = io.BufferedReader(coder.stream_reader(stream, read_across_frames=True, closefd=False), 1 << 20)
    while True:
        line = plain.readline()
        if not line:
            return
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := plain.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            headers[name] = value
        block = plain.read(int(headers["Content-Length"]))
        plain.read(4)
        yield headers, block


def read_archives(manifest: DataFrame) -> DataFrame:
    """Page records of the archives that a manifest names: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (NULL for revisits).

    A response whose payload does not have the digest it claims fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = open_uri(path)
                rows: list[tuple] = []
                held = 0
                with fs.open_input_stream(name) as stream:
                    for headers, block in read_records(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        revisit = headers["WARC-Type"] == "revisit"
                        payload = None if revisit else block[block.index(b"\r\n\r\n") + 4 :]
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if payload is not None and base32_sha1(payload) != digest:
                            raise ValueError(f"{path}: payload of {headers['WARC-Record-ID']} is damaged")
                        rows.append((headers.get("X-Page-Id"), headers.get("WARC-Target-URI"), int(headers["X-Payload-Length"]) if revisit else len(payload), digest, headers["WARC-Type"], headers.get("X-Refers-To-Page-Id"), payload))
                        held += len(block)
                        if held >= 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = manifest.select("path").repartition(max(1, manifest.count()))
    return files.mapInArrow(run, "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex,
    min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS head FROM pages
), bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ((strpos('0123456789abcdef', hex[i]) - 1)::BIT::VARCHAR)[-4:]), '') AS b FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    16 * b[5 * i + 1]::INT + 8 * b[5 * i + 2]::INT + 4 * b[5 * i + 3]::INT + 2 * b[5 * i + 4]::INT + b[5 * i + 5]::INT + 1]), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to
FROM bits
"""


@query("op5_warc_dictionary", ORACLE)
def op5(spark, folder):
    pages = table(spark, folder, "pages")
    kind = dict(pages.dtypes)["page_id"]
    found = read_archives(write_archives(pages, scratch_path(spark, "archives")))
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
