"""Packed token-id matrices as binary files, written and read by a Spark data source.

A task writes two files.  ``.ids`` has the rows of its matrix, little-endian 16-bit
ids one after the other, as a trainer maps them to memory.  ``.rows.arrow`` has the
rest of each row: group, number, cumulative segment lengths, documents, starts and
where positions begin anew, in record batches of ``BATCH`` rows.  Between two resets
positions count up by one, and behind the last segment they are 0, so the resets
and the row's filled length say all of them in a few bytes a segment; a row whose
positions are otherwise is refused.

Files of failed attempts never enter a job's manifest.  The reader plans ranges of
rows from file sizes and reads each at its offset.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from corpusmill.llm.common import fresh_folder
from corpusmill.llm.media import filesystem, manifests
from corpusmill.llm.packing import PACKED

FORMAT = "packed_matrix"
#: Rows of a record batch, and record batches that one task reads.
BATCH, RANGE = 256, 32
_INDEX = ["group", "row", "cu_seqlens", "doc_ids", "starts"]
_RESETS = pa.list_(pa.uint16())


def resets_of(positions: np.ndarray, filled: int) -> np.ndarray:
    """Where the positions of a row begin anew, within its first ``filled``; ValueError if that does not say all of them."""
    found = np.flatnonzero(positions[:filled] == 0)
    if not np.array_equal(positions_of(found, filled, len(positions)), positions):
        raise ValueError("positions must count up by one from 0 in every segment and be 0 behind the last")
    return found


def positions_of(resets: np.ndarray, filled: int, width: int) -> np.ndarray:
    """Positions of a row: from 0 on at every reset, 0 from ``filled`` on."""
    found = np.zeros(width, np.int64)
    if filled:
        if not len(resets) or resets[0]:
            raise ValueError("the first position of a row must be 0")
        found[:filled] = np.arange(filled) - np.repeat(resets, np.diff(np.append(resets, filled)))
    return found.astype("<u2")


@dataclass
class Rows(InputPartition):
    path: str
    width: int
    start: int
    end: int


@dataclass
class Part(WriterCommitMessage):
    name: str
    width: int


class MatrixReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self) -> list[Rows]:
        """Ranges of rows of the committed parts; names and sizes only."""
        store, folder = filesystem(self.path)
        found = []
        for manifest in manifests(store, folder):
            with store.open_input_stream(manifest) as f:
                parts = json.loads(f.read())
            for info, (_, width) in zip(store.get_file_info([f"{folder}/{name}.ids" for name, _ in parts]) if parts else [], parts, strict=True):
                if info.type != fs.FileType.File:
                    raise FileNotFoundError(info.path)
                rows = info.size // (2 * width)
                found += [Rows(info.path.removesuffix(".ids"), width, at, min(at + BATCH * RANGE, rows)) for at in range(0, rows, BATCH * RANGE)]
        return found or [Rows("", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = filesystem(self.path)
        width = partition.width
        with store.open_input_file(f"{partition.path}.ids") as ids, store.open_input_file(f"{partition.path}.rows.arrow") as index:
            rest = pa.ipc.open_file(index)
            for at in range(partition.start, partition.end, BATCH):
                rows = rest.get_batch(at // BATCH)
                data = ids.read_at(2 * width * rows.num_rows, 2 * width * at)
                if len(data) != 2 * width * rows.num_rows:
                    raise ValueError(f"{partition.path}.ids ends within row {at + len(data) // (2 * width)}")
                matrix = [data[k : k + 2 * width] for k in range(0, len(data), 2 * width)]
                placed = [positions_of(np.array(x, np.int64), n, width).tobytes() for x, n in zip(rows.column("resets").to_pylist(), rows.column("filled").to_pylist(), strict=True)]
                made = {**{c: rows.column(c) for c in _INDEX}, "ids": pa.array(matrix, pa.binary()), "positions": pa.array(placed, pa.binary())}
                yield pa.RecordBatch.from_arrays([made[c] for c in PACKED.names], names=PACKED.names)


class MatrixWriter(DataSourceArrowWriter):
    """Two files a task; a job that appends adds a manifest, one that overwrites removes those before it."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        store, folder = filesystem(self.path)
        name, width = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0
        filled = (b for b in _of_size(batches) if b.num_rows)
        first = next(filled, None)
        if first is None:
            return Part("", 0)
        store.create_dir(folder, recursive=True)
        width = len(first.column("ids")[0].as_py()) // 2
        with store.open_output_stream(f"{folder}/{name}.ids") as ids, store.open_output_stream(f"{folder}/{name}.rows.arrow") as index:
            with pa.ipc.new_file(index, _with_resets(first).schema) as rest:
                batch = first
                while batch is not None:
                    for row in batch.column("ids").to_pylist():
                        if len(row) != 2 * width:
                            raise ValueError("all rows of a matrix must have one width")
                        ids.write(row)
                    rest.write_batch(_with_resets(batch))
                    batch = next(filled, None)
        return Part(name, width)

    def commit(self, messages: list[Part | None]) -> None:
        store, folder = filesystem(self.path)
        store.create_dir(folder, recursive=True)
        before = manifests(store, folder) if self.overwrite else []
        with store.open_output_stream(f"{folder}/_committed-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(sorted([m.name, m.width] for m in messages if m is not None and m.name)).encode())
        for manifest in before:
            with store.open_input_stream(manifest) as f:
                parts = json.loads(f.read())
            store.delete_file(manifest)
            for name, _ in parts:
                _remove(store, folder, name)

    def abort(self, messages: list[Part | None]) -> None:
        store, folder = filesystem(self.path)
        for m in messages:
            if m is not None and m.name:
                _remove(store, folder, m.name)


def _with_resets(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What the index keeps of some rows: resets and filled length in place of positions."""
    filled = [x[-1] for x in batch.column("cu_seqlens").to_pylist()]
    resets = [resets_of(np.frombuffer(p, "<u2"), n) for p, n in zip(batch.column("positions").to_pylist(), filled, strict=True)]
    kept = batch.select(_INDEX)
    return pa.RecordBatch.from_arrays([*kept.columns, pa.array(resets, _RESETS), pa.array(filled, pa.int32())], names=[*_INDEX, "resets", "filled"])


def _remove(store: fs.FileSystem, folder: str, name: str) -> None:
    for kind in ("ids", "rows.arrow"):
        store.delete_file(f"{folder}/{name}.{kind}")


def _of_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``BATCH``, the last one apart."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            some = batch.slice(at, BATCH - rows)
            held.append(some)
            at, rows = at + some.num_rows, rows + some.num_rows
            if rows == BATCH:
                yield pa.concat_batches(held)
                held, rows = [], 0
    if held:
        yield pa.concat_batches(held)


class PackedMatrix(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return PACKED

    def reader(self, schema: T.StructType) -> MatrixReader:
        return MatrixReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options, overwrite)


def write_matrices(packed: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows of schema PACKED under ``path``; no rows leave an empty manifest.

    ``mode`` is append, which keeps what other jobs wrote there, or overwrite.  All
    rows of a table need one width, repeated rows are written each, and columns that
    are not in PACKED are left out.  Nothing is shuffled.
    """
    packed.sparkSession.dataSource.register(PackedMatrix)
    packed.select(*PACKED.names).write.format(FORMAT).mode(mode).save(path)


def read_matrices(spark, path: str) -> DataFrame:
    """The rows written under ``path``, with their positions; a folder without any gives none."""
    spark.dataSource.register(PackedMatrix)
    return spark.read.format(FORMAT).load(path)


def stored(packed: DataFrame) -> DataFrame:
    """``packed`` written to the shared folder, where it stays, and read back."""
    path = fresh_folder(packed.sparkSession, "packed")
    write_matrices(packed, path)
    return read_matrices(packed.sparkSession, path)
