"""WARC archives as seekable Zstandard bundles, written and read by Spark tasks.

Each task groups its records into independent Zstandard frames of a bounded
number of bytes, appends them to a bundle, and ends the bundle with the footer
seek table of the seekable format (a skippable frame: compressed size,
decompressed size and checksum of every frame). An index table maps the
identifier of each record to bundle, frame, offset inside the frame and length,
so one record is read by decoding one frame. Any Zstandard decoder reads a
bundle from front to back as a plain WARC file.

Records with equal payloads of at least ``least`` bytes are stored once: the one
with the largest id is a ``response``, the others are ``revisit`` records that
name it. Groups are counted by SHA-1 and size with partial aggregation, so a
payload with any number of copies is one row; the few groups that hold a large
share of the copies are joined by broadcast (at most ``HOT_GROUPS`` rows), the
rest by key, and rows without a group get keys of their own.

A task that is run again writes bundles under new names; only bundles named in
the index, which Spark commits, are ever read, so lost executors leave nothing
but files nobody names.

Defined cases: a null payload is empty; payloads below ``least`` bytes are always
``response``; repeated rows of the largest id are ``response`` each; rows without
id revisit the largest id of their group, and are ``response`` where no row of
the group has an id; a null address leaves out its header, blanks and control
characters in it are percent-encoded; a payload larger than a frame gets a frame of its own; an empty
table gives an empty index; extra columns are dropped before the work.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder
from .flat import in_arrow, shuffle_tasks, text_slices

# Fixed values of the seekable format and of WARC 1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
ENTRY = struct.Struct("<III")
FOOTER = struct.Struct("<IBI")
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Groups of equal payloads that are joined by broadcast, at most.
HOT_GROUPS = 500
#: Copies a group needs to be one of them.
HOT_COPIES = 1000
#: Frames that a reading task takes at a time.
SPAN = 16

INDEX = "record_id string, target string, archive string, frame int, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


@dataclass(frozen=True)
class WarcConfig:
    """Production parameters."""

    least: int = 1000  # payload bytes from which copies become revisits
    frame: int = 1 << 20  # record bytes of a frame
    bundle: int = 256 << 20  # compressed bytes after which a new bundle is begun
    level: int = 3
    date: str = "2000-01-01T00:00:00Z"  # pages carry no time of their own


# --- identifiers and records ----------------------------------------------

def record_uri(page_id: int | None, digest: str) -> str:
    """Identifier of a page's record; the id can be read back from it."""
    low = int(digest[:16], 16) if page_id is None else page_id & (1 << 64) - 1
    top = (page_id is None) << 80 | 8 << 76 | low >> 62 << 64
    return f"urn:uuid:{uuid.UUID(int=top | 2 << 62 | low & (1 << 62) - 1)}"


def page_of(uri: str) -> int | None:
    """Page id that a record identifier holds."""
    value = uuid.UUID(uri.removeprefix("urn:uuid:")).int
    if value >> 80:
        return None
    low = (value >> 64 & 3) << 62 | value & (1 << 62) - 1
    return low - (1 << 64) if low >> 63 else low


def _address(url: str) -> str:
    return "".join(f"%{b:02X}" if b <= 0x20 or b == 0x7F else chr(b) for b in url.encode()).encode("latin-1").decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record; a revisit holds the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_uri(page_id, digest)}>",
        f"WARC-Date: {date}", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_address(url)}")
    if refers_to:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode().split("\r\n")
    return first, {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header fields and block of each record of decoded WARC bytes."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, fields = _fields(data[at:stop])
        begin = stop + 4
        end = begin + int(fields["content-length"])
        if not version.startswith("WARC/") or data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"no WARC record at byte {at}")
        yield at, end + 4 - at, fields, data[begin:end]
        at = end + 4


def read_block(fields: dict[str, str], block: bytes) -> tuple[int, str, bytes | None]:
    """Payload size, digest (hex) and, of a response, the payload itself, which must have that digest."""
    head, _, body = block.partition(b"\r\n\r\n")
    size = int(_fields(head)[1]["content-length"])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "revisit":
        return size, digest, None
    if len(body) != size or hashlib.sha1(body).hexdigest() != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    return size, digest, body


# --- bundles --------------------------------------------------------------

class Bundle:
    """Writes records into frames and ends with the seek table."""

    def __init__(self, out: BinaryIO, frame: int, level: int):
        self.out, self.frame = out, frame
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held: list[bytes] = []
        self.size = self.written = 0
        self.entries: list[tuple[int, int, int]] = []

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset inside it at which the record will stand."""
        if self.held and self.size + len(record) > self.frame:
            self.flush()
        place = len(self.entries), self.size
        self.held.append(record)
        self.size += len(record)
        return place

    def flush(self) -> None:
        if not self.held:
            return
        data = b"".join(self.held)
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.written += len(packed)
        self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(ENTRY.pack(*e) for e in self.entries) + FOOTER.pack(len(self.entries), CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to the frames of a bundle through its seek table."""

    def __init__(self, source: BinaryIO, size: int):
        self.source = source
        source.seek(size - FOOTER.size)
        n, flags, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table")
        source.seek(size - FOOTER.size - n * ENTRY.size)
        self.entries = list(ENTRY.iter_unpack(source.read(n * ENTRY.size)))
        self.starts = [0]
        for packed, _, _ in self.entries:
            self.starts.append(self.starts[-1] + packed)

    def read(self, frame: int) -> bytes:
        packed, size, check = self.entries[frame]
        self.source.seek(self.starts[frame])
        data = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {frame} is damaged")
        return data


def _open(folder: str, archive: str) -> BundleReader:
    store, path = stores.FileSystem.from_uri(f"{folder}/{archive}")
    source = store.open_input_file(path)
    return BundleReader(source, source.size())


# --- Spark jobs -----------------------------------------------------------

def decide(pages: DataFrame, config: WarcConfig = WarcConfig(), id_column: str = "page_id", url_column: str = "url", text_column: str = "html") -> DataFrame:
    """id, url, text, digest and keeper (the id to be revisited, null for responses) of each page."""
    spark = pages.sparkSession
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{url_column}`").cast("string").alias("url"), text.alias("text"))
    rows = rows.withColumn("digest", F.sha1("text")).withColumn("size", F.octet_length("text"))
    folder = shared_folder(spark, "warc-groups")
    equal = rows.where(F.col("size") >= config.least).groupBy("digest", "size").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
    equal.where("n > 1 and keeper is not null").write.parquet(folder)
    groups = spark.read.parquet(folder)
    copies = groups.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = F.col("n") > max(HOT_COPIES, copies // HOT_GROUPS)  # true for HOT_GROUPS groups at most
    few = groups.where(hot).select(F.col("digest").alias("d"), F.col("size").alias("s"), F.col("keeper").alias("hot_keeper"))
    many = groups.where(~hot).select(F.concat_ws(":", "digest", "size").alias("key"), F.col("keeper").alias("cold_keeper"))
    rows = rows.join(F.broadcast(few), (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    own = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    grouped = F.col("hot_keeper").isNull() & (F.col("size") >= config.least)
    rows = rows.withColumn("key", F.when(grouped, F.concat_ws(":", "digest", "size")).otherwise(own)).join(many, "key", "left")
    keeper = F.coalesce("hot_keeper", "cold_keeper")
    return rows.select("id", "url", "text", "digest", F.when(~F.col("id").eqNullSafe(keeper), keeper).alias("keeper"))


def write(pages: DataFrame, folder: str, config: WarcConfig = WarcConfig(), id_column: str = "page_id", url_column: str = "url", text_column: str = "html") -> DataFrame:
    """Bundles of all pages in ``folder``; returns the index (one row per record), kept there too.

    ``target`` is the record that holds the payload: the record itself or the
    one it revisits.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = stores.FileSystem.from_uri(folder)
        bundle, name, rows = None, None, []
        names = [part.strip().split()[0] for part in INDEX.split(",")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            for part in text_slices(batch, "text"):
                for row in zip(*(part.column(c).to_pylist() for c in ("id", "url", "text", "digest", "keeper"))):
                    page_id, url, text, digest, keeper = row
                    if bundle is None:
                        store.create_dir(path, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.zst"
                        bundle = Bundle(store.open_output_stream(f"{path}/{name}", compression=None), config.frame, config.level)
                    refers_to = None if keeper is None else record_uri(keeper, digest)
                    record = build_record(page_id, url, text.encode(), digest, refers_to, config.date)
                    own = record_uri(page_id, digest)
                    rows.append((own, refers_to or own, name, *bundle.add(record), len(record)))
                    if bundle.written >= config.bundle:
                        bundle.close()
                        bundle = None
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
        if bundle is not None:
            bundle.close()

    spark = pages.sparkSession
    in_arrow(decide(pages, config, id_column, url_column, text_column), pack, INDEX).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the bundles that the index of ``folder`` names, read back from their frames."""
    last = spark.read.parquet(f"{folder}/index").groupBy("archive").agg(F.max("frame").alias("last"))
    spans = last.select("archive", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(SPAN))).alias("first"))
    spans = spans.repartition(shuffle_tasks(spans), "archive", "first")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [part.strip().split()[0] for part in RECORDS.split(",")]
        for batch in batches:
            for archive, first, last in zip(*(batch.column(c).to_pylist() for c in ("archive", "first", "last"))):
                bundle = _open(folder, archive)
                for frame in range(first, min(first + SPAN, last + 1)):
                    rows = []
                    for _, _, fields, block in parse_records(bundle.read(frame)):
                        size, digest, _ = read_block(fields, block)
                        refers = fields.get("warc-refers-to")
                        rows.append((page_of(fields["warc-record-id"][1:-1]), size, digest, fields["warc-type"], page_of(refers[1:-1]) if refers else None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                bundle.source.close()

    return in_arrow(spans, unpack, RECORDS)


def fetch(wanted: DataFrame, folder: str) -> DataFrame:
    """record_id, payload of each ``record_id`` of ``wanted``: one frame is decoded per record, revisits are followed."""
    index = wanted.sparkSession.read.parquet(f"{folder}/index")
    place = index.groupBy("record_id").agg(F.min(F.struct("archive", "frame", "offset", "length")).alias("at"))
    asked = wanted.select("record_id").distinct().join(index.select("record_id", "target").distinct(), "record_id")
    asked = asked.join(place.withColumnRenamed("record_id", "target"), "target").select("record_id", "at.*")
    asked = asked.repartition(shuffle_tasks(asked), "archive", "frame").sortWithinPartitions("archive", "frame", "offset")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bundle, data = (None, None), None, b""
        for batch in batches:
            for record_id, archive, frame, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != held[0]:
                    bundle = _open(folder, archive)
                if (archive, frame) != held:
                    data, held = bundle.read(frame), (archive, frame)
                _, _, fields, block = next(parse_records(data[offset:offset + length]))
                payload = read_block(fields, block)[2]
                yield pa.RecordBatch.from_arrays([pa.array([record_id]), pa.array([payload], pa.binary())], ["record_id", "payload"])

    return in_arrow(asked, look, "record_id string, payload binary")


def round_trip(pages: DataFrame, config: WarcConfig = WarcConfig()) -> DataFrame:
    """Pages written into bundles of a fresh shared folder and read back: one row per page."""
    folder = shared_folder(pages.sparkSession, "warc")
    write(pages, folder, config)
    return read(pages.sparkSession, folder)
