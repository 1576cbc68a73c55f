"""WARC archives as seekable Zstandard bundles.

Each task writes bundles: records are grouped into independent Zstandard frames of a bounded size, and a
seek table in a skippable frame closes the file, so any Zstandard reader can read a bundle whole and a
seeking reader can open one frame. The index maps a record to (file, frame place and size, offset in the
frame's content, length). Records with equal payloads of at least ``min_revisit`` bytes are stored
once; the one with the smallest id is the response and the others are revisit records.

A file name carries the task attempt: if an attempt is lost or repeated, its file is never named in the
index, so nothing is read twice. Files go through pyarrow's file systems by URI.

Defined results: a null payload is empty; payloads below the limit are always responses; rows repeated
with the same id and payload are all responses (each holds the smallest id); a null id sorts after all
others; an empty table writes no file.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, utf8, work_dir

#: Fixed values of the seekable format: skippable frame magic, seek table magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 256 << 20
MIN_REVISIT = 100
RECORD_URN = "urn:page:"

INDEX_SCHEMA = "page_id long, file string, frame_at long, frame_size int, frame_no int, rec_at int, rec_len int"
RECORD_SCHEMA = "page_id long, record_type string, target_uri string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def record(page_id, url, payload: bytes, digest: str, n_bytes: int, refers_to) -> bytes:
    """The bytes of one WARC record; a revisit carries the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD_URN}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{RECORD_URN}{refers_to}>",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one WARC record, its payload checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    own = fields["WARC-Record-ID"][1:-1].removeprefix(RECORD_URN)
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": int(own) if own else None, "record_type": kind, "target_uri": fields["WARC-Target-URI"],
        "payload": payload if kind == "response" else None, "payload_bytes": int(said["Content-Length"]), "payload_digest": digest,
        "refers_to": int(refers[1:-1].removeprefix(RECORD_URN)) if refers else None,
    }


class Bundle:
    """One open archive file: frames, then the seek table."""

    def __init__(self, uri: str, frame_bytes: int):
        fs, path = pa.fs.FileSystem.from_uri(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.out, self.frame_bytes = uri, fs.open_output_stream(path, compression=None), frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.at, self.frames, self.open, self.size = 0, [], [], 0

    def add(self, page_id, data: bytes) -> list[tuple]:
        """Take a record; returns the index rows of a frame when it is full."""
        self.open.append((page_id, data))
        self.size += len(data)
        return self.flush() if self.size >= self.frame_bytes else []

    def flush(self) -> list[tuple]:
        if not self.open:
            return []
        packed = self.zstd.compress(b"".join(data for _, data in self.open))
        self.out.write(packed)
        rows, at = [], 0
        for page_id, data in self.open:
            rows.append((page_id, self.uri, self.at, len(packed), len(self.frames), at, len(data)))
            at += len(data)
        self.frames.append((len(packed), self.size))
        self.at += len(packed)
        self.open, self.size = [], 0
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        table = b"".join(struct.pack("<II", *frame) for frame in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.out.close()
        return rows


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed size, content size) of each frame, read from the end of a bundle."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the file")
    rows, at = [], 0
    for packed, size in struct.iter_unpack("<II", data[-9 - 8 * n : -9]):
        rows.append((at, packed, size))
        at += packed
    return rows


def _batch(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(columns, names, strict=True)], schema=schema)


_INDEX = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("frame_at", pa.int64()), ("frame_size", pa.int32()), ("frame_no", pa.int32()), ("rec_at", pa.int32()), ("rec_len", pa.int32())])
_RECORD = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def write_archive(pages: DataFrame, path: str | None = None, min_revisit: int = MIN_REVISIT, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write all pages (page_id, url, html) below ``path`` and return the index of their records."""
    path = path or work_dir(pages.sparkSession)
    payload = utf8(F.col("html"))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n"))
    # Only ids and digests are grouped; payloads move once, by (id, digest), which no group of copies heats up.
    ids = rows.where(F.col("n") >= min_revisit).select("page_id", "digest", "n")
    firsts = ids.groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where(F.col("c") > 1).drop("c")
    revisits = (
        ids.join(firsts, ["digest", "n"])
        .where(F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))))
        .select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("first").alias("refers_to"))
        .distinct()
    )
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    records = joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "n", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, n, bundle, found = f"part-{task.partitionId():05d}-{task.taskAttemptId()}", 0, None, []
        for batch in batches:
            for page_id, url, data, digest, size, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    bundle = Bundle(f"{path}/{name}-{n:04d}.warc.zst", frame_bytes)
                    n += 1
                found += bundle.add(page_id, record(page_id, url, data or b"", digest, size, refers))
                if bundle.at >= bundle_bytes:
                    found += bundle.close()
                    bundle = None
            if found:
                yield _batch(found, _INDEX.names, _INDEX)
                found = []
        if bundle is not None:
            yield _batch(bundle.close(), _INDEX.names, _INDEX)

    return cut(records.mapInArrow(write, INDEX_SCHEMA))


def read_records(index: DataFrame, n_parts: int | None = None) -> DataFrame:
    """Read and parse the records that ``index`` names, opening only the frames that hold them.

    Filter the index first to fetch single records. Frames are dealt out evenly; one is in memory at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, at, content, files = None, None, b"", {}
        unpack = zstandard.ZstdDecompressor()
        rows, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != opened:
                    fs, path = pa.fs.FileSystem.from_uri(row["file"])
                    if files:
                        files.popitem()[1].close()
                    files[row["file"]] = fs.open_input_file(path)
                    opened, at = row["file"], None
                if row["frame_at"] != at:
                    files[opened].seek(row["frame_at"])
                    content, at = unpack.decompress(files[opened].read(row["frame_size"])), row["frame_at"]
                found = parse(content[row["rec_at"] : row["rec_at"] + row["rec_len"]])
                rows.append(tuple(found.values()))
                held += row["rec_len"]
                if held > 8 << 20:
                    yield _batch(rows, _RECORD.names, _RECORD)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, _RECORD.names, _RECORD)

    cols = ["file", "frame_at"]
    dealt = index.repartition(n_parts, *cols) if n_parts else index.repartition(*cols)
    return dealt.sortWithinPartitions("file", "frame_at", "rec_at").mapInArrow(read, RECORD_SCHEMA)


def op9_seekable_warc(spark, sf_dir: str) -> DataFrame:
    """Archive every page, then read the archives back."""
    index = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("payload").isNotNull().alias("has_payload"))


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, n, min(page_id) AS first FROM p GROUP BY d, n)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to,
       NOT (n >= 100 AND page_id > first) AS has_payload
FROM p JOIN f USING (d, n)
"""
