"""WARC archives with a dictionary in front, and their reader.

Each task writes one archive (``.warc.zst``): a Zstandard dictionary is built from the
records it archives, embedded in a leading skippable frame, and every record is its own
frame compressed with the dictionary, so records can be read one at a time. The
dictionary's sample is bounded: the task's first SAMPLE_BYTES of records.

A payload that occurs on several rows is stored once: of rows with equal payloads of
MIN_REVISIT bytes or more, the one with the largest id is the response, the others are
revisits that refer to it. Shorter payloads are always responses.

Archives go to the shared folder through ``pyarrow.fs``, so any store with a URI that it
knows will do. A task writes under a name of its own attempt; the names of committed
attempts are staged as a table, and only these are read back, so a task that was lost and
ran again leaves nothing behind that is read.

Edge cases: null and empty pages have an empty payload and are responses; a null url is an
empty target; a null id cannot be a revisit's target unless all ids of the payload are
null, and is read back as null; rows that repeat the largest id are all responses and share a record id; an empty
table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_REVISIT = 1000
DICT_BYTES = 64 * 1024
SAMPLE_BYTES = 4_000_000
#: Fixed value of the public format: a skippable frame that holds a dictionary.
MAGIC = 0x184D2A5D
LEVEL = 3
READ = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
)


def record_id(page_id: int | None, digest: str, url: str) -> str:
    """A page's record id: the same for a reader of any archive; a page without id goes by its content."""
    name = f"page:{page_id}" if page_id is not None else f"content:{digest}|{url}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def http_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries its payload's length and digest, not the payload."""
    block = http_block(payload) if kind == "response" else b""
    clean = (url or "").replace("\r", " ").replace("\n", " ")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, digest, clean)}",
        f"WARC-Target-URI: {clean}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Refers-To-Page: {'' if refers_to is None else refers_to}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines[3:3] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest, clean)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(path: str) -> bytes:
    """An archive's first record."""
    block = b"format: WARC File Format 1.1\r\nsoftware: folioframe\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> zstd.ZstdCompressionDict:
    """A trained dictionary; from few or odd samples, which can't be trained on, a raw one."""
    if len(samples) >= 16:
        try:
            return zstd.train_dictionary(DICT_BYTES, samples)
        except zstd.ZstdError:
            pass
    raw = b"".join(s[:2048] for s in samples)[:DICT_BYTES]
    return zstd.ZstdCompressionDict(raw.ljust(8, b" "), dict_type=zstd.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Buffers the sample, then writes the dictionary's frame and a frame for each record."""

    def __init__(self, out) -> None:
        self.out, self.held, self.size, self.codec, self.n = out, [], 0, None, 0

    def _start(self) -> None:
        d = build_dictionary(self.held)
        body = d.as_bytes()
        self.out.write(struct.pack("<II", MAGIC, len(body)) + body)
        self.codec = zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True)
        for r in self.held:
            self.out.write(self.codec.compress(r))
        self.held = []

    def add(self, rec: bytes) -> None:
        self.n += 1
        if self.codec:
            self.out.write(self.codec.compress(rec))
            return
        self.held.append(rec)
        self.size += len(rec)
        if self.size >= SAMPLE_BYTES:
            self._start()

    def close(self) -> None:
        if self.codec is None:
            self._start()


def read_records(stream):
    """Records of an archive, one frame at a time."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != MAGIC:
        raise ValueError("the archive has no dictionary frame")
    body = stream.read(size)
    kind = zstd.DICT_TYPE_FULLDICT if body[:4] == b"\x37\xa4\x30\xec" else zstd.DICT_TYPE_RAWCONTENT
    codec = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(body, dict_type=kind))
    buf, ended = b"", False
    frame, parts = codec.decompressobj(), []
    while True:
        if not buf:
            buf = stream.read(1 << 20)
            if not buf:
                ended = True
        if ended:
            if parts:
                raise ValueError("the archive ends inside a record")
            return
        parts.append(frame.decompress(buf))
        buf = b""
        if frame.eof:
            buf = frame.unused_data
            yield b"".join(parts)
            frame, parts = codec.decompressobj(), []


def parse_record(rec: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = rec.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _filesystem(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, and for each row its record's type and target."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("rows"))
    several = large.where("rows > 1 and last is not null").select(F.col("digest").alias("_digest"), "last")
    # Short payloads have no part in it: they are dealt by their row, however many are equal.
    rows = rows.withColumn("_key", F.when(F.octet_length("html") >= MIN_REVISIT, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url", "digest").cast("string"))))
    out = rows.join(several, rows["_key"] == several["_digest"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return out.select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record for each row; returns the staged table (path, n_records) of archives."""
    folder = folder or f"{common.shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches):
        fs, root = _filesystem(folder)
        path, out, writer = f"{root}/{uuid.uuid4().hex}.warc.zst", None, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(path)
                    writer = ArchiveWriter(out)
                    writer.add(info_record(path))
                page_id, url, html, digest, kind, refers_to = row
                writer.add(record(page_id, url, html.encode(), digest, kind, refers_to))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([writer.n - 1], pa.int64())], names=["path", "n_records"])

    return common.staged(decided(pages).mapInArrow(run, "path string, n_records long"), "warc-names")


def read_archives(archives: DataFrame, folder_uri: str) -> DataFrame:
    """A row for each record of the archives; stored payloads are checked against their digests."""

    def run(batches):
        fs, _ = _filesystem(folder_uri)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(path) as stream:
                    rows: list[tuple] = []
                    for rec in read_records(stream):
                        f, block = parse_record(rec)
                        if f["WARC-Type"] == "warcinfo":
                            continue
                        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                        block = block.partition(b"\r\n\r\n")[2]  # without the HTTP headers
                        if f["WARC-Type"] == "response" and (hashlib.sha1(block).hexdigest() != digest or len(block) != int(f["X-Payload-Length"])):
                            raise ValueError(f"a payload of {path} doesn't match its digest")
                        rows.append((int(f["X-Page-ID"]) if f["X-Page-ID"] else None, int(f["X-Payload-Length"]), digest, f["WARC-Type"], int(f["X-Refers-To-Page"]) if f["X-Refers-To-Page"] else None))
                        if len(rows) >= 4096:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    def _batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=READ.names)

    return archives.select("path").mapInArrow(run, READ)


def archive_and_read(pages: DataFrame) -> DataFrame:
    folder = f"{common.shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    names = write_archives(pages, folder)
    spread = max(1, pages.sparkSession.sparkContext.defaultParallelism)
    return read_archives(names.repartition(spread), folder)
