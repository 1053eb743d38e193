"""WARC archives as seekable Zstandard bundles, and their way back.

Each task of the plan writes archives of its own: a warcinfo record, then a record for each page.
Records are gathered into frames of about ``FRAME_BYTES`` that are compressed independently; a seek table
(the compressed and the full size of each frame, in a skippable frame that ends the file) lets a reader
open one frame alone, and any Zstandard tool still reads the file from end to end. The index maps record
identifiers to (archive, frame, offset in the frame).

Equal payloads are stored once: the record of the largest page_id is the response, the others are
revisit records that refer to it and carry no payload. Payloads count as equal when SHA-1, length and a
second hash agree. Only payloads met more than once take part in a join, against one row for each.

Executors may go at any time: an archive has a name of its own for each attempt of a task, and exists
for readers only once the index that names it is committed. What a lost attempt wrote is never read.
Paths are opened by Arrow's file systems (file, hdfs, s3, gs), as the shared folder's scheme says.

Cases: null html is an empty payload (equal to all empty ones); null page_ids sort below all others and
are null when read back; rows equal in page_id and payload are told apart, one of them is the response;
null urls leave out the target; control characters and spaces of urls are percent-encoded; a record
larger than a frame has a frame to itself; an empty table gives no archives and no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import keep, partitions, prepare, shared_dir

FRAME_BYTES = 256 << 10
#: An archive is closed once its compressed bytes reach this.
ARCHIVE_BYTES = 1 << 30
#: Frames that a task reads at a time: about 16 MB of records.
BLOCK_FRAMES = 64
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tideframe:pages")

# The seekable format's magic numbers, the revisit profile.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, record_id string, record_type string, archive string, frame int, offset long, length long"
RECORDS = "page_id long, record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, frame int, offset long, payload binary"


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of a hexadecimal text of 40 digits, ten digits (eight of base 32) at a time."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def typed(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, is_revisit, refers_to of each page."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.select("*", base32(F.sha1("payload")).alias("digest"))
    key = [F.col("digest").alias("_d"), F.octet_length("payload").alias("_b"), F.xxhash64("payload").alias("_x")]
    held = rows.where(F.octet_length("payload") >= min_bytes).groupBy(*key, "page_id").agg(F.count(F.lit(1)).alias("n"))
    classes = held.groupBy("_d", "_b", "_x").agg(F.max(F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "n")).alias("top"), F.sum("n").alias("n"))
    classes = keep(classes.where("n > 1").select("_d", "_b", "_x", F.col("top.page_id").alias("_top"), (F.col("top.n") > 1).alias("_tied")), "payload-classes")
    on = (F.col("digest") == F.col("_d")) & (F.octet_length("payload") == F.col("_b")) & (F.xxhash64("payload") == F.col("_x"))
    joined = rows.join(classes, on, "left")
    is_top = F.col("page_id").eqNullSafe(F.col("_top"))
    columns = ["page_id", "url", "payload", "digest", "is_revisit", "refers_to"]
    joined = joined.withColumn("is_revisit", F.col("_d").isNotNull() & ~is_top).withColumn("refers_to", F.when(F.col("is_revisit"), F.col("_top")))
    if classes.where("_tied").isEmpty():
        return joined.select(columns)
    # Rows of one page_id and payload at the top of their class: numbered once and for all, the first stays the response.
    tied = F.coalesce("_tied", F.lit(False)) & is_top
    rows = keep(joined.where(tied).select(*columns, "_d", "_b", "_x").withColumn("_row", F.monotonically_increasing_id()), "tied-pages")
    first = keep(rows.groupBy("_d", "_b", "_x").agg(F.min("_row").alias("_first")), "first-pages")
    rows = rows.join(first, ["_d", "_b", "_x"]).withColumn("is_revisit", F.col("_row") > F.col("_first"))
    rows = rows.withColumn("refers_to", F.when(F.col("is_revisit"), F.col("page_id")))
    return joined.where(~tied).select(columns).unionByName(rows.select(columns))


def _header(fields: list[tuple[str, object]]) -> bytes:
    return "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None)]).encode() + b"\r\n\r\n"


def _target(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, is_revisit: bool, refers_to: int | None, place: str, date: str) -> tuple[str, bytes]:
    """The identifier and the bytes of one WARC record. A revisit's holds ``place``: several may have one page_id."""
    name = lambda kind, page: f"<{uuid.uuid5(_SPACE, f'{kind} {page} {digest}').urn}>"
    own = name(f"revisit {place}", page_id) if is_revisit else name("response", page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    fields = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", _target(url))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id)]
    if is_revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", name("response", refers_to)), ("X-Refers-To-Page-ID", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return own, _header(fields) + block + b"\r\n\r\n"


class Bundle:
    """Writes one archive; ``add`` gives a record's place: (frame, offset in the frame)."""

    def __init__(self, sink, date: str = DATE, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.held = self.written = 0
        about = b"software: tideframe\r\nformat: WARC File Format 1.1\r\n"
        own = f"<{uuid.uuid4().urn}>"
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", own), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", len(about))]
        self.add(_header(fields) + about + b"\r\n\r\n")

    def add(self, data: bytes) -> tuple[int, int]:
        if self.held and self.held + len(data) > self.frame_bytes:
            self._flush()
        at = len(self.frames), self.held
        self.parts.append(data)
        self.held += len(data)
        return at

    def _flush(self) -> None:
        if self.parts:
            packed = self.compressor.compress(b"".join(self.parts))
            self.sink.write(packed)
            self.frames.append((len(packed), self.held))
            self.written += len(packed)
            self.parts, self.held = [], 0

    def close(self) -> None:
        self._flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.sink.write(struct.pack("<II", _SKIPPABLE, len(entries)) + entries)
        self.sink.close()


class Opened:
    """Reads single frames of an archive by its seek table."""

    def __init__(self, path: str):
        fs, name = pyarrow.fs.FileSystem.from_uri(path)
        self.path, self.source = path, fs.open_input_file(name)
        size = self.source.size()
        frames, flags, magic = struct.unpack("<IBI", self.source.read_at(9, size - 9))
        if magic != _SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        width = 12 if flags & 0x80 else 8
        table = self.source.read_at(frames * width, size - 9 - frames * width)
        self.sizes = np.frombuffer(table, "<u4").reshape(frames, width // 4)[:, :2].astype(np.int64)
        self.begins = np.cumsum(self.sizes[:, 0]) - self.sizes[:, 0]
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        packed = self.source.read_at(int(self.sizes[k, 0]), int(self.begins[k]))
        return self.decompressor.decompress(packed, max_output_size=int(self.sizes[k, 1]))


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields (names in lower case) and block of the record at ``at``, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    begin = end + 4
    stop = begin + int(fields["content-length"])
    return fields, data[begin:stop], stop + 4


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple | None:
    """What a record says of its page; None for other kinds. A response's digest is computed and compared."""
    if fields["warc-type"] not in ("response", "revisit"):
        return None
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
    number = lambda name: int(fields[name]) if name in fields else None
    body = payload if with_payload and fields["warc-type"] == "response" else None
    return number("x-page-id"), fields["warc-record-id"], fields.get("warc-target-uri"), fields["warc-type"], size, digest, number("x-refers-to-page-id"), body


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


_INDEX_ARROW = [("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("archive", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]
_RECORDS_ARROW = [
    ("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("refers_to", pa.int64()), ("archive", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("payload", pa.binary()),
]


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = DATE, frame_bytes: int = FRAME_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages to archives in ``folder`` (one in the shared folder if None) and returns their stored index."""
    spark = prepare(pages.sparkSession)
    own = folder is None
    folder = (folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}").rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = pyarrow.fs.FileSystem.from_uri(folder)
        bundle = name = None
        for batch in batches:
            rows = []
            for page, url, payload, digest, is_revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    fs.create_dir(where, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(fs.open_output_stream(f"{where}/{name}", compression=None), date, frame_bytes)
                place = f"{name} {len(bundle.frames)} {bundle.held}" if is_revisit else ""
                identifier, data = record(page, url, payload, digest, is_revisit, refers_to, place, date)
                frame, offset = bundle.add(data)
                rows.append((page, identifier, "revisit" if is_revisit else "response", f"{folder}/{name}", frame, offset, len(data)))
                if bundle.written >= archive_bytes:
                    bundle.close()
                    bundle = None
            yield _batch(rows, _INDEX_ARROW)
        if bundle is not None:
            bundle.close()

    index = keep(typed(pages, min_bytes).mapInArrow(write, INDEX), "warc-index")
    if own:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return index


def read_archives(index: DataFrame, with_payload: bool = False, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """The records of all archives that the index names, read from the files block of frames by block of frames."""
    spark = prepare(index.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = None
        for batch in batches:
            for path, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if opened is None or opened.path != path:
                    opened = Opened(path)
                for k in range(first, min(last, len(opened.sizes))):
                    data, at, rows = opened.frame(k), 0, []
                    while at < len(data):
                        fields, block, stop = parse(data, at)
                        if (row := _row(fields, block, with_payload)) is not None:
                            rows.append((*row[:-1], path, k, at, row[-1]))
                        at = stop
                    yield _batch(rows, _RECORDS_ARROW)

    archives = index.groupBy("archive").agg((F.max("frame") + 1).alias("frames"))
    blocks = archives.select("archive", F.explode(F.sequence(F.lit(0), F.col("frames") - 1, F.lit(block_frames))).alias("first"))
    blocks = blocks.select("archive", "first", (F.col("first") + block_frames).alias("last"))
    return blocks.repartition(partitions(spark), "archive", "first").mapInArrow(read, RECORDS)


def fetch(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of the page_ids in ``wanted``, payloads included; only the frames that hold one are opened, each once."""
    spark = prepare(index.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, at, data = None, None, b""
        for batch in batches:
            rows = []
            for path, frame, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if opened is None or opened.path != path:
                    opened, at = Opened(path), None
                if at != frame:
                    at, data = frame, opened.frame(frame)
                fields, block, _ = parse(data, offset)
                row = _row(fields, block, True)
                rows.append((*row[:-1], path, frame, offset, row[-1]))
            yield _batch(rows, _RECORDS_ARROW)

    places = index.join(wanted.select("page_id").distinct(), "page_id", "left_semi").select("archive", "frame", "offset")
    return places.repartition(partitions(spark), "archive", "frame").sortWithinPartitions("archive", "frame", "offset").mapInArrow(read, RECORDS)


ORACLE = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + ((('0x' || substr(x, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31), 1)), '') AS payload_digest,
           CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> top THEN top END AS refers_to
    FROM d"""
