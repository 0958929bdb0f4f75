"""Media columns: lossless 8-bit samples in archives, read by a Spark data source.

A payload is stored as the samples of a greyscale PNG (deflate, so text shrinks),
each PNG as one uncompressed member of a ZIP archive; one archive is written by
each task.  The reader plans byte ranges over a folder of archives from the file
sizes alone.  A task opens its archive's directory, takes the members that begin
in its range and reads them one by one at their offsets; a member whose read
fails or whose checksum is wrong is read again on its own, without the others.
Rows leave in Arrow batches of bounded size.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from corpusmill.llm.common import batches_of, fresh_folder, require

#: Samples of a row; payloads are padded with PAD to a positive multiple of it.
WIDTH, PAD = 576, 255
FORMAT = "media_archive"
_PNG = b"\x89PNG\r\n\x1a\n"
_MANIFEST = re.compile(r"_committed-[0-9a-f]{32}\.json")  # one a write job
#: The member name of a null id; other ids carry a mark in front, so that none reads like it.
_NULL, _MARK = "null", "="
STORED = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
])


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """Greyscale PNG of WIDTH samples a row; the unpadded length rides along as text."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)  # filter 0 in front of every row
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> tuple[bytes, int]:
    """The samples and the unpadded length; ValueError if a checksum is wrong."""
    if png[:8] != _PNG:
        raise ValueError("not a PNG")
    at, parts, n_bytes, width = 8, [], -1, 0
    while at < len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"tEXt":
            n_bytes = int(body.partition(b"\0")[2])
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, width + 1)
    return rows[:, 1:].tobytes(), n_bytes


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    path: str
    size: int
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    name: str
    members: int


def manifests(store: fs.FileSystem, folder: str) -> list[str]:
    return sorted(i.path for i in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if _MANIFEST.fullmatch(i.base_name))


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", 16 << 20)))
        self.batch_bytes = int(options.get("batchbytes", options.get("batchBytes", 8 << 20)))
        self.tries = int(options.get("tries", 4))

    def partitions(self) -> list[Range]:
        """Byte ranges of the archives that were committed; only names and sizes pass here."""
        store, folder = filesystem(self.path)
        names = []
        for manifest in manifests(store, folder):
            with store.open_input_stream(manifest) as f:
                names += json.loads(f.read())
        infos = store.get_file_info([f"{folder}/{n}" for n in names]) if names else []
        found = []
        for info in infos:
            if info.type != fs.FileType.File:
                raise FileNotFoundError(info.path)
            found += [Range(info.path, info.size, at, min(at + self.range_bytes, info.size)) for at in range(0, info.size, self.range_bytes)]
        return found or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = filesystem(self.path)
        with store.open_input_file(partition.path) as file:
            with zipfile.ZipFile(file) as archive:
                members = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.end]
            rows: list[tuple] = []
            held = 0
            for member in members:
                row = self._member(store, partition.path, file, member)
                rows.append(row)
                held += len(row[2])
                if held >= self.batch_bytes or len(rows) >= 512:
                    yield _as_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _as_batch(rows)

    def _member(self, store, path: str, file, member: zipfile.ZipInfo) -> tuple:
        """One member, read at its own offset and, if need be, again through a fresh handle."""
        for attempt in range(self.tries):
            try:
                source = file if not attempt else store.open_input_file(path)
                try:
                    header = source.read_at(30, member.header_offset)
                    if header[:4] != b"PK\3\4":
                        raise ValueError("no member at this offset")
                    begin = member.header_offset + 30 + sum(struct.unpack("<HH", header[26:30]))
                    png = source.read_at(member.file_size, begin)
                finally:
                    if attempt:
                        source.close()
                if zlib.crc32(png) != member.CRC:
                    raise ValueError("checksum of the member")
                payload, n_bytes = from_png(png)
                name = member.filename.rpartition(".")[0]
                return (None if name == _NULL else name.removeprefix(_MARK), n_bytes, payload, len(png), hashlib.sha256(png).hexdigest())
            except (OSError, ValueError, zlib.error) as error:
                if attempt + 1 == self.tries:
                    raise RuntimeError(f"{path}, member {member.filename} at {member.header_offset}: {error}") from error
                time.sleep(0.2 * 2**attempt)
        raise AssertionError


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=STORED.names)


class ArchiveWriter(DataSourceArrowWriter):
    """One archive a task; only those of successful attempts enter the manifest of the job.

    A job that appends adds a manifest of its own; one that overwrites removes the
    manifests before it, and then their archives.
    """

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, folder = filesystem(self.path)
        store.create_dir(folder, recursive=True)
        name, members = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip", 0
        with store.open_output_stream(f"{folder}/{name}") as out, zipfile.ZipFile(_Forward(out), "w", zipfile.ZIP_STORED) as archive:
            for batch in batches_of(batches):
                for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    data = data or b""
                    entry = zipfile.ZipInfo(f"{_NULL if key is None else _MARK + key}.png", (1980, 1, 1, 0, 0, 0))
                    archive.writestr(entry, to_png(padded(data), len(data)))
                    members += 1
        if not members:
            store.delete_file(f"{folder}/{name}")
        return Written(name, members)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = filesystem(self.path)
        store.create_dir(folder, recursive=True)
        before = manifests(store, folder) if self.overwrite else []
        with store.open_output_stream(f"{folder}/_committed-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(sorted(m.name for m in messages if m is not None and m.members)).encode())
        for manifest in before:
            with store.open_input_stream(manifest) as f:
                names = json.loads(f.read())
            store.delete_file(manifest)
            for name in names:
                store.delete_file(f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = filesystem(self.path)
        for m in messages:
            if m is not None and m.members:
                store.delete_file(f"{folder}/{m.name}")


class _Forward(io.RawIOBase):
    """A stream that only goes forward, as object stores give; zipfile counts offsets itself."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)


class MediaArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return STORED

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, overwrite)


def store_texts(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", mode: str = "append") -> None:
    """Write every text's UTF-8 bytes as a member of an archive under ``path``.

    A null text counts as empty; a null id is kept as null; rows with the same id
    are members of the same name at different offsets.  ``mode`` is append, which
    keeps what other jobs have stored there, or overwrite.  Nothing is shuffled.
    """
    require(docs, id_col, text_col)
    docs.sparkSession.dataSource.register(MediaArchive)
    docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("data")).write.format(FORMAT).mode(mode).save(path)


def read_media(spark, path: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format(FORMAT).options(**options).load(path)


def features(payload: bytes) -> str:
    """Size, mean, deviation, entropy and a 64-bit mean hash of the samples."""
    data = np.frombuffer(payload, np.uint8)
    share = np.bincount(data, minlength=256) / len(data)
    levels = np.arange(256)
    mean = float(share @ levels)
    deviation = float(max(0.0, share @ levels**2 - mean**2)) ** 0.5
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    cells = np.array([c.mean() for c in np.array_split(data, 64)])
    bits = sum(1 << i for i, c in enumerate(cells) if c >= mean)
    return f"{WIDTH}x{len(data) // WIDTH};mean={mean:.4f};sd={deviation:.4f};entropy={entropy:.4f};hash={bits:016x}"


def describe_media(media: DataFrame, id_type: T.DataType) -> DataFrame:
    """Digests and features of members as read back; one row a member, repeated members included.

    Ids are cast to ``id_type``, null ids stay null; no member has an empty payload.
    """
    schema = T.StructType([
        T.StructField("id", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            payloads = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                    pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()),
                    batch.column(3),
                    batch.column(4),
                    pa.array([features(p) for p in payloads], pa.string()),
                ],
                names=schema.names,
            )

    return media.mapInArrow(run, schema).select(F.col("id").cast(id_type).alias("doc_id"), *schema.names[1:])


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text, read the archives back and describe what came back.

    One row per row of ``docs``: a null text counts as empty, repeated rows give
    repeated results, an empty table an empty one; columns other than doc_id and text
    are left out.  The archives stay in the shared folder.
    """
    path = fresh_folder(docs.sparkSession, "media")
    store_texts(docs, path)
    return describe_media(read_media(docs.sparkSession, path), docs.schema["doc_id"].dataType)
