"""Operator 8, media columns in archives read by a custom data source.

Each text becomes an image of 8-bit samples, 192 to a row, stored losslessly
as PNG. Tasks write the images into archives in the shared folder. An archive
is a row of blocks, each with its own directory of members (id, offset,
length, checksum), and ends with the list of its blocks. The tasks report byte ranges of
whole blocks, which the manifest of the folder lists, so that the data source plans
its partitions without opening an archive. A partition goes from block to block of its range: it reads the
directory of a block, then streams the members in Arrow batches. A member whose bytes do
not fit its checksum is read again by its offset, with a fresh handle, without
its neighbours.

Archives are opened by URI (pyarrow.fs), so the shared folder can be in any
store that Arrow knows. Every task attempt writes its own file; only files of tasks
that succeeded are in the manifest, so lost executors leave nothing that is read.

Defined cases: a missing or empty text is 192 spaces with n_bytes 0; rows are
stored each for itself, equal texts give equal values; a missing doc_id comes
back missing; an empty table gives an archive set without members.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import new_path

WIDTH = 192
BLOCK = 4 << 20
RANGE = 32 << 20
TRIES = 4
#: Directory entry: has an id, id, bytes of the text, offset from the start of the archive, length, crc32.
ENTRY = struct.Struct("<?qqqqI")
#: Block header: members, bytes of the directory. Footer entry: offset and length of a block. Tail: blocks, bytes of the footer.
HEAD, SPAN, TAIL = struct.Struct("<qq"), struct.Struct("<qq"), struct.Struct("<qq4s")
MAGIC = b"CTMA"
PNG = b"\x89PNG\r\n\x1a\n"
SCHEMA = "doc_id bigint, n_bytes bigint, media binary"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the text padded with spaces to rows of WIDTH bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def to_image(payload: bytes) -> bytes:
    """A greyscale PNG with a sample for each byte."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)  # each row with filter 0
    data = zlib.compress(lines.tobytes(), 4)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    parts = [_chunk(b"IDAT", data[i : i + (1 << 30)]) for i in range(0, len(data), 1 << 30)]
    return PNG + _chunk(b"IHDR", header) + b"".join(parts) + _chunk(b"IEND", b"")


def from_image(media: bytes) -> bytes:
    """The samples of a PNG that ``to_image`` made, with the checksums of its chunks proved."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, data, size = 8, [], (0, 0)
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)[:, 1:].tobytes()


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class _Archive:
    """Writes members into blocks of about BLOCK bytes."""

    def __init__(self, uri: str):
        store, path = _opened(uri)
        self.out, self.at, self.spans, self.entries, self.body, self.held = store.open_output_stream(path), 0, [], [], [], 0

    def add(self, doc_id: int | None, n_bytes: int, media: bytes) -> None:
        self.entries.append((doc_id is not None, doc_id or 0, n_bytes, len(media), zlib.crc32(media)))
        self.body.append(media)
        self.held += len(media)
        if self.held >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if not self.entries:
            return
        directory = len(self.entries) * ENTRY.size
        offset, rows = self.at + HEAD.size + directory, []
        for known, doc_id, n_bytes, length, crc in self.entries:
            rows.append(ENTRY.pack(known, doc_id, n_bytes, offset, length, crc))
            offset += length
        self.out.write(HEAD.pack(len(self.entries), directory) + b"".join(rows) + b"".join(self.body))
        self.spans.append((self.at, offset - self.at))
        self.at, self.entries, self.body, self.held = offset, [], [], 0

    def ranges(self, least: int) -> list[tuple[int, int]]:
        """(start, end) of stretches of whole blocks, each of ``least`` bytes or more but for the last."""
        out, start = [], 0
        for at, length in self.spans:
            if at + length - start >= least:
                out.append((start, at + length))
                start = at + length
        return out + ([(start, self.at)] if start < self.at else [])

    def close(self) -> None:
        self.flush()
        footer = b"".join(SPAN.pack(*s) for s in self.spans)
        self.out.write(footer + TAIL.pack(len(self.spans), len(footer), MAGIC))
        self.out.close()


def write_archives(documents: DataFrame, folder: str, least: int = RANGE) -> None:
    """Writes the texts as images, an archive a task, and then the manifest: the archives and their ranges of ``least`` bytes or more."""
    store, path = _opened(folder)
    store.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        uri, archive, n = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.arc", None, 0
        for b in batches:
            for text, doc_id in zip(b.column(0), b.column(1), strict=True):
                archive = archive or _Archive(uri)
                size, payload = payload_of(text.as_py())
                archive.add(doc_id.as_py(), size, to_image(payload))
                n += 1
        if archive:
            archive.close()
            ranges = np.array(archive.ranges(least), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64()), pa.array([ranges.tobytes()])], names=["archive", "members", "ranges"])

    texts = documents.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"))
    done = texts.mapInArrow(run, "archive string, members bigint, ranges binary").collect()  # a row a task, 16 bytes a range
    rows = sorted((r.archive, np.frombuffer(r.ranges, "<i8").reshape(-1, 2).tolist()) for r in done)
    with store.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps(rows).encode())


class ByteRange(InputPartition):
    """Whole blocks of one archive."""

    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def partitions(self) -> list[ByteRange]:
        store, path = _opened(self.folder)
        with store.open_input_file(f"{path}/manifest.json") as f:
            archives = json.loads(f.read())
        return [ByteRange(archive, *own) for archive, ranges in archives for own in ranges] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        at = partition.start
        while at < partition.end:
            store, path = _opened(partition.archive)
            with store.open_input_file(path) as f:
                n, directory = HEAD.unpack(f.read_at(HEAD.size, at))
                entries = list(ENTRY.iter_unpack(f.read_at(directory, at + HEAD.size)))
                media = []
                for known, doc_id, n_bytes, offset, length, crc in entries:
                    media.append((doc_id if known else None, n_bytes, self.member(partition.archive, f, offset, length, crc)))
            at += HEAD.size + directory + sum(length for *_, length, _ in entries)
            for i in range(0, n, 256):
                some = media[i : i + 256]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.int64()), pa.array([x[2] for x in some], pa.binary())], names=["doc_id", "n_bytes", "media"])

    @staticmethod
    def member(archive: str, f: pa.NativeFile, offset: int, length: int, crc: int) -> bytes:
        """The member at an offset; read again with a handle of its own if it fails or is damaged."""
        problem: Exception | None = None
        for attempt in range(TRIES):
            try:
                if attempt:
                    store, path = _opened(archive)
                    with store.open_input_file(path) as own:
                        media = own.read_at(length, offset)
                else:
                    media = f.read_at(length, offset)
                if zlib.crc32(media) == crc:
                    return media
            except OSError as e:
                problem = e
        raise OSError(f"{archive}: the member at {offset} can't be read in {TRIES} tries") from problem


class ArchiveSource(DataSource):
    """``spark.read.format("calltide_archive").load(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "calltide_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("calltide_archive").load(folder)


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and an 8-bit mean hash of eight stretches."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    mean = counts @ values / len(x)
    share = counts[counts > 0] / len(x)
    parts = [p.mean() for p in np.array_split(x, 8)]
    bits = "".join("1" if p >= mean else "0" for p in parts)
    return f"mean={mean:.4f};std={np.sqrt(max(0.0, counts @ (values - mean) ** 2 / len(x))):.4f};entropy={-(share * np.log2(share)).sum() + 0.0:.4f};hash={bits}"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for media in b.column(2):
            stored = media.as_py()
            payload = from_image(stored)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)))
        cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def features(media: DataFrame) -> DataFrame:
    """Decodes the images and computes their digests and features."""
    return media.mapInArrow(_features, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def media_columns(documents: DataFrame) -> DataFrame:
    """Stores the texts as archives in the shared folder and returns the features of what is read back."""
    folder = new_path(documents.sparkSession, "media")
    write_archives(documents, folder)
    return features(read_archives(documents.sparkSession, folder))
