"""WARC records in seekable Zstandard bundles.

Writing: each task packs its records into bundles. A bundle is a row of independent Zstandard
frames of a few records each, followed by the seek table of the seekable format (a skippable
frame with the sizes of all frames), so one record is read with one ranged read. The index
maps a record to (bundle, frame, offset inside the frame, length) and is written last: a bundle
that a lost or repeated task left behind is in no index and is never read.

Equal payloads are stored once: the row with the smallest id is a response, the others are
revisits that refer to it. Payloads below `min_bytes` are always responses. Null payloads are
empty ones. Rows that share the smallest id of a payload are all responses; a row without an
id is a revisit if any row of its payload has one. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.sources.staging import stage, stage_path

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
#: Compressed bytes that a task reads back.
TASK_BYTES = 16 << 20
#: Places in which rows of one payload meet.
SALTS = 64
LEVEL = 3
#: Pages carry no fetch time; a caller who knows one passes it.
DATE = "1970-01-01T00:00:00Z"

#: Fixed values of the seekable format and of the WARC revisit profile.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"

INDEX = (
    "page_id long, bundle string, frame long, frame_start long, frame_bytes long, "
    "record_offset long, record_bytes long"
)


class Record(NamedTuple):
    page_id: int | None
    url: str | None
    record_type: str
    payload_bytes: int
    payload_digest: str
    refers_to: int | None
    payload: bytes


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _line(name: str, value: str) -> bytes:
    safe = value.replace("\r", "%0D").replace("\n", "%0A")
    return f"{name}: {safe}\r\n".encode("utf-8", "surrogatepass")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE
) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header but not the payload."""
    revisit = refers_to is not None
    http = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    )
    block = http if revisit else http + payload
    head = b"WARC/1.1\r\n" + _line("WARC-Type", "revisit" if revisit else "response")
    head += _line("WARC-Record-ID", f"<{_ID}{'' if page_id is None else page_id}>")
    head += _line("WARC-Date", date)
    if url is not None:
        head += _line("WARC-Target-URI", url)
    head += _line("WARC-Payload-Digest", f"sha1:{digest_of(payload)}")
    if revisit:
        head += _line("WARC-Profile", PROFILE) + _line("WARC-Refers-To", f"<{_ID}{refers_to}>")
    head += _line("Content-Type", "application/http; msgtype=response")
    head += _line("Content-Length", str(len(block)))
    return head + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines if line)}


def _page(value: str | None) -> int | None:
    number = (value or "")[len(_ID) + 1 : -1]
    return int(number) if number else None


def parse_record(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record that starts at `at`, and where the next one starts."""
    head_end = data.index(b"\r\n\r\n", at)
    fields = _fields(data[at:head_end])
    start = head_end + 4
    end = start + int(fields["content-length"])
    http_end = data.index(b"\r\n\r\n", start, end) + 4
    size = int(_fields(data[start : http_end - 4])["content-length"])
    payload = data[http_end:end]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"record {fields['warc-record-id']} does not match its digest")
    refers = _page(fields["warc-refers-to"]) if kind == "revisit" else None
    found = Record(
        _page(fields["warc-record-id"]),
        fields.get("warc-target-uri"),
        kind,
        size,
        digest,
        refers,
        payload,
    )
    return found, end + 4


class _Bundle:
    """One open bundle file."""

    def __init__(self, folder: str, level: int, frame_bytes: int) -> None:
        import zstandard

        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        system, inner = _filesystem(self.path)
        self.out = system.open_output_stream(inner, compression=None)
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frame_bytes = frame_bytes
        self.sizes: list[tuple[int, int]] = []
        self.written = 0
        self.held: list[bytes] = []
        self.places: list[tuple] = []
        self.index: list[tuple] = []
        self.offset = 0

    def add(self, page_id, record: bytes) -> None:
        self.places.append((page_id, self.offset, len(record)))
        self.held.append(record)
        self.offset += len(record)
        if self.offset >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        frame = self.compressor.compress(b"".join(self.held))
        self.out.write(frame)
        for page_id, offset, size in self.places:
            self.index.append(
                (page_id, self.path, len(self.sizes), self.written, len(frame), offset, size)
            )
        self.sizes.append((len(frame), self.offset))
        self.written += len(frame)
        self.held, self.places, self.offset = [], [], 0

    def close(self) -> list[tuple]:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        head = struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer))
        self.out.write(head + table + footer)
        self.out.close()
        return self.index


def with_first(pages: DataFrame, page_id: str, url: str, html: str, min_bytes: int) -> DataFrame:
    """(page_id, url, payload, refers_to); only payloads that repeat take part in a join."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    # A payload that very many pages share (the empty one) meets in SALTS places, not in one.
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
    rows = rows.withColumn("salt", salt)
    seen = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy("digest", "salt")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    )
    repeated = (
        seen.groupBy("digest")
        .agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"))
        .where((F.col("n") > 1) & F.col("first_id").isNotNull())
        .drop("n")
    )
    places = stage(seen.select("digest", "salt").join(repeated, "digest"), "payloads")
    return rows.join(places, ["digest", "salt"], "left").select(
        "page_id",
        "url",
        "payload",
        F.when(
            F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")),
            F.col("first_id"),
        ).alias("refers_to"),
    )


def write_archive(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = 0,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
    level: int = LEVEL,
    date: str = DATE,
) -> DataFrame:
    """Write bundles below folder (shared by all executors) and return the stored index."""
    rows = with_first(pages, page_id, url, html, min_bytes)
    system, inner = _filesystem(f"{folder}/bundles")
    system.create_dir(inner, recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in INDEX.split(", ")]
        bundle = None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if bundle is None:
                    bundle = _Bundle(f"{folder}/bundles", level, frame_bytes)
                page = None if pd.isna(row.page_id) else int(row.page_id)
                refers = None if pd.isna(row.refers_to) else int(row.refers_to)
                bundle.add(page, make_record(page, row.url, bytes(row.payload), refers, date))
                if bundle.written >= bundle_bytes:
                    yield pd.DataFrame(bundle.close(), columns=columns).astype({"page_id": "Int64"})
                    bundle = None
        if bundle is not None:
            yield pd.DataFrame(bundle.close(), columns=columns).astype({"page_id": "Int64"})

    spark = pages.sparkSession
    rows.mapInPandas(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed bytes, bytes) of each frame, from the end of a bundle."""
    frames, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    table, at = [], 0
    for packed, plain in struct.iter_unpack("<II", data[-9 - 8 * frames : -9]):
        table.append((at, packed, plain))
        at += packed
    return table


def read_frame(entry) -> bytes:
    """The plain bytes of the frame that an index row names, by one ranged read."""
    import zstandard

    system, inner = _filesystem(entry["bundle"])
    with system.open_input_file(inner) as source:
        frame = source.read_at(entry["frame_bytes"], entry["frame_start"])
    return zstandard.ZstdDecompressor().decompress(frame)


def read_record(entry) -> Record:
    """One record through its index row."""
    return parse_record(read_frame(entry), entry["record_offset"])[0]


def read_archive(
    index: DataFrame, with_payload: bool = False, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """All records that the index names, through their frames' ranges.

    Index rows are dealt by frame to a number of tasks that follows from the frames' bytes, so
    that adaptive execution does not gather the short index in one task. A task opens each frame
    once, by a ranged read, and finds its records at their offsets.
    """
    schema = (
        "page_id long, url string, record_type string, payload_bytes long, "
        "payload_digest string, refers_to long"
    ) + (", payload binary" if with_payload else "")
    columns = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def framed(rows):
            frame = pd.DataFrame(rows, columns=Record._fields)
            return frame.astype({"page_id": "Int64", "refers_to": "Int64"})[columns]

        frame, plain = None, b""
        for batch in batches:
            held, total = [], 0
            for entry in batch.to_dict("records"):
                if (entry["bundle"], entry["frame_start"]) != frame:
                    frame, plain = (entry["bundle"], entry["frame_start"]), read_frame(entry)
                record = parse_record(plain, entry["record_offset"])[0]
                held.append(record if with_payload else record._replace(payload=b""))
                total += len(held[-1].payload) + 200
                if total > 8 << 20:
                    yield framed(held)
                    held, total = [], 0
            if held:
                yield framed(held)

    frames = index.groupBy("bundle", "frame_start").agg(F.max("frame_bytes").alias("bytes"))
    count, size = frames.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    workers = index.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(count, workers), -(-size // task_bytes))
    return (
        index.repartition(tasks, "bundle", "frame_start")
        .sortWithinPartitions("bundle", "frame_start", "record_offset")
        .mapInPandas(read, schema)
    )


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages to a fresh archive in the shared folder and read it back."""
    return read_archive(write_archive(pages, stage_path(spark, "warc"), min_bytes=min_bytes))
