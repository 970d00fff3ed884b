"""WARC files in Zstandard with a dictionary of their own.

Each file holds the records of one partition of the pages, or of about FILE_BYTES of them. A dictionary is built from all
of the file's records, each counted whole, and stands in front in a skippable frame (magic 0x184D2A5D), then every record
follows as a frame of its own, a warcinfo record first. So a record is read with two seeks, the dictionary's and its own, and small records compress as if they were
together. Files of too few records for a dictionary have none.

Records, their order and the dictionary depend on the partition alone: a task that is run again writes the same bytes.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import lean, table

MAGIC = 0x184D2A5D
FILE_BYTES = 32 << 20
DICTIONARY_BYTES = 112_640
LEVEL = 6
LEAST_RECORDS = 16
DATE = "2024-01-01T00:00:00Z"
SOFTWARE = "lexaquarry"
FRAMES = "file string, seq int, page_id bigint, record_id string, offset bigint, length bigint, frame binary"


def record(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> tuple[str, bytes]:
    """(record id, bytes) of a WARC 1.1 resource record; the id follows from the content."""
    body = (html or "").encode()
    digest = hashlib.sha256(body).hexdigest()
    name = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}"
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def info_record(file: str, date: str = DATE) -> tuple[str, bytes]:
    """(record id, bytes) of the warcinfo record that stands first in a file."""
    body = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode()
    name = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'warcinfo|{file}|{date}')}"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Filename: {file}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary_of(records: list[bytes], size: int) -> bytes:
    """A dictionary built from all records; empty where they don't suffice for one."""
    if len(records) < LEAST_RECORDS:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, records)) // 8)), records, k=1024, d=8, f=18, accel=1).as_bytes()
    except zstandard.ZstdError:  # too little or too uniform content
        return b""


def _archive(batches: Iterator[pa.RecordBatch], file_bytes: int, dictionary_bytes: int, level: int, date: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: list[tuple] = []
    size, files = 0, 0

    def close() -> Iterator[pa.RecordBatch]:
        name = f"part-{part:05d}-{files:03d}.warc.zst"
        raw = dictionary_of([x[2] for x in held], dictionary_bytes)
        rows, at = [], 0
        if raw:
            packed = zstandard.ZstdCompressor(level=19).compress(raw)
            frame = struct.pack("<II", MAGIC, len(packed)) + packed
            rows.append((name, 0, None, None, 0, len(frame), frame))
            at = len(frame)
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdCompressor(level=level)
        for i, (page, record_id, data) in enumerate([(None, *info_record(name, date)), *held]):
            frame = press.compress(data)
            rows.append((name, i + 1, page, record_id, at, len(frame), frame))
            at += len(frame)
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for i in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 1000]), kinds)], names=[x.split()[0] for x in FRAMES.split(", ")])

    for batch in batches:
        for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
            name, data = record(page, url, html, date)
            held.append((page, name, data))
            size += len(data)
            if size >= file_bytes:
                yield from close()
                held, size, files = [], 0, files + 1
    if held:
        yield from close()


def archive_frames(pages: DataFrame, file_bytes: int = FILE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL, date: str = DATE) -> DataFrame:
    """(file, seq, page_id, record_id, offset, length, frame): the frames of every file in order; seq 0 is the dictionary,
    seq 1 the warcinfo record. ``date`` is the WARC-Date of all records: the pages don't tell when they were fetched, and a
    clock would make a task that is run again write other bytes.

    A null html is an empty body, a null URL leaves the target out, a null page_id stays null; repeated pages, and pages of
    the same id, are records each, those equal in all with the same record id. A body of any length is one record and one
    frame; it closes its file. Other columns, of whatever name, are ignored; an empty table gives no rows.
    """
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(lean(_archive, file_bytes=file_bytes, dictionary_bytes=dictionary_bytes, level=level, date=date), FRAMES)


def _store(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs
    from pyspark import TaskContext

    where, base = fs.FileSystem.from_uri(folder)
    where.create_dir(base, recursive=True)
    attempt = TaskContext.get().taskAttemptId()
    open_: tuple | None = None

    def finish() -> None:
        open_[1].close()
        where.move(f"{base}/.{open_[0]}.{attempt}", f"{base}/{open_[0]}")

    for batch in batches:
        for name, frame in zip(batch.column("file").to_pylist(), batch.column("frame").to_pylist()):
            if open_ is None or open_[0] != name:
                if open_ is not None:
                    finish()
                open_ = name, where.open_output_stream(f"{base}/.{name}.{attempt}")
            open_[1].write(frame)
        yield batch.select(["file", "seq", "page_id", "record_id", "offset", "length"])
    if open_ is not None:
        finish()


def write_warc(pages: DataFrame, folder: str, **options) -> DataFrame:
    """Write the files into ``folder`` (a URI) and return their index (file, seq, page_id, record_id, offset, length). A file
    appears under its name when it is complete; a task that is run again replaces it by the same bytes. The index must be
    read (written, counted) once for the files to be there."""
    return archive_frames(pages, **options).mapInArrow(lean(_store, folder=folder), FRAMES.rsplit(", ", 1)[0])


def read_records(data: bytes) -> list[bytes]:
    """The records of a file's bytes."""
    dictionary, at, out = None, 0, []
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == MAGIC:
        n = struct.unpack_from("<I", data, 4)[0]
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + n]))
        at = 8 + n
    unpress = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        one = unpress.decompressobj()
        out.append(one.decompress(data[at:]))
        at = len(data) - len(one.unused_data)
    return out


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_frames(table(spark, sf_dir, "pages"))
