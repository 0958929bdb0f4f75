"""Token-id matrices packed by best-fit decreasing.

Texts are encoded; ids longer than a row are cut into full rows and a rest, which
loses nothing.  Full rows need no packing and leave as they are.  The rests of a
group of documents are packed into rows of the matrix: longest first, each into
the row with the least room that still takes it, which a segment tree over room
finds in logarithmic time.  A packed row comes with its ids, padded, the
cumulative lengths of its segments, and positions that begin anew in each.

Groups are formed by a hash, so each fits one task's memory whatever the table's
size; only the last row or two of a group are less full than they might be.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.bpe import ranks_of
from corpusmill.llm.common import batches_of, require

#: Documents whose rests are packed together, about.
GROUP = 1000
#: Groups that one task takes at most, on average, whatever the session's partitions.
GROUPS_A_TASK = 32
#: Rests of one group that a task holds before it packs them.
MOST_HELD = 4 * GROUP


class RoomTree:
    """Rows by the room they have left; finds the least room of at least so much.

    A segment tree over the rooms 0 to ``most``: each node counts the rows below.
    """

    def __init__(self, most: int):
        self.size = 1 << max(1, most).bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """A row with the least room of at least ``least``, and its room; it leaves the tree."""
        at = least + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # climb to a left child whose sibling has rows
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        row = self.rows[room].pop()
        self._add(room, -1)
        return row, room


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of item numbers; every item of 1 to ``width`` is in one row, no row exceeds ``width``."""
    tree, rows = RoomTree(width), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[item])
        row, room = found if found is not None else (len(rows), width)
        if found is None:
            rows.append([])
        rows[row].append(item)
        if room > lengths[item]:
            tree.put(row, room - lengths[item])
    return rows


#: A packed row: its segments in order, each part of a document that begins at a token.
PACKED = T.StructType([
    T.StructField("group", T.LongType()), T.StructField("row", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
    T.StructField("positions", T.BinaryType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("starts", T.ArrayType(T.LongType())),
])


def _packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=PACKED.names)


def _row(group: int, number: int, parts: list[tuple[int | None, int, np.ndarray]], width: int, pad: int) -> tuple:
    ids = np.full(width, pad, "<u2")
    positions = np.zeros(width, "<u2")
    ends = [0]
    for _, _, found in parts:
        ids[ends[-1] : ends[-1] + len(found)] = found
        positions[ends[-1] : ends[-1] + len(found)] = np.arange(len(found))
        ends.append(ends[-1] + len(found))
    return group, number, ids.tobytes(), ends, positions.tobytes(), [p[0] for p in parts], [p[1] for p in parts]


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    """The public tokenizer; packing takes ids from anywhere, and this is the fastest way to them."""
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})


def encode_chunks(docs: DataFrame, path: str, pattern: str, width: int, end_id: int, text_col: str, id_col: str, groups: int) -> DataFrame:
    """group, doc_id, start, ids: the documents' ids with an end mark, cut to ``width``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(path, pattern).encode_ordinary
        for batch in batches_of(batches):
            rows = []
            for key, group, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = array("H", encode(text or ""))
                ids.append(end_id)
                rows += [(group, key, at, ids[at : at + width].tobytes()) for at in range(0, len(ids), width)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["group", "doc_id", "start", "ids"])

    group = F.pmod(F.xxhash64(F.col(id_col), F.xxhash64(text_col)), F.lit(groups)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), group.alias("group"), F.col(text_col).alias("text")).mapInArrow(run, "group long, doc_id long, start long, ids binary")


def pack_documents(docs: DataFrame, path: str, pattern: str, width: int = 2048, end_id: int = 50256, pad_id: int = 50256, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows of packed matrices (schema PACKED), every token of every document once.

    Each document's ids are followed by ``end_id``; a null or empty text is its end
    mark alone.  ``ids`` and ``positions`` are little-endian 16-bit rows of ``width``;
    ``cu_seqlens`` has the borders of the segments, ``doc_ids`` and ``starts`` say
    which document each is from and at which of its tokens it begins.  Full rows
    have the number -1 of their group, packed ones count from 0.  Repeated rows are
    packed each; an empty table gives no rows; other columns are left out.  Ids
    below 65,536 and whole-number ids only.  Documents are grouped by a hash of id and
    text; equal rows share a group.  A task packs at most ``MOST_HELD`` rests together,
    so a group that equal rows make larger is packed in several goes: nothing is lost,
    but each go may leave a row or two less full than one go over all would.
    """
    require(docs, id_col, text_col)
    if not 2 <= width <= 65535 or max(end_id, pad_id) > 65535:
        raise ValueError("width and ids must fit 16 bits")
    groups = max(1, -(-docs.count() // GROUP))
    chunks = encode_chunks(docs, path, pattern, width, end_id, text_col, id_col, groups)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups // GROUPS_A_TASK))
    dealt = chunks.repartition(tasks, "group").sortWithinPartitions("group", "doc_id", "start", "ids")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number = None, 0
        rests: list[tuple[int | None, int, np.ndarray]] = []
        for batch in batches_of(batches, rows=4096):
            out = []
            for group, key, start, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if group != now or len(rests) >= MOST_HELD:
                    if rests:
                        yield from packed(now, number, rests)
                    number = number + len(rests) if group == now else 0  # no two rows of a group share a number
                    now, rests = group, []
                ids = np.frombuffer(data, "<u2")
                if len(ids) == width:
                    out.append(_row(group, -1, [(key, start, ids)], width, pad_id))
                else:
                    rests.append((key, start, ids))
                if len(out) >= 256:
                    yield _packed_batch(out)
                    out = []
            if out:
                yield _packed_batch(out)
        if rests:
            yield from packed(now, number, rests)

    def packed(group: int, number: int, rests: list) -> Iterator[pa.RecordBatch]:
        rows = best_fit_decreasing([len(r[2]) for r in rests], width)
        for at in range(0, len(rows), 256):
            yield _packed_batch([_row(group, number + at + k, [rests[i] for i in items], width, pad_id) for k, items in enumerate(rows[at : at + 256])])

    return dealt.mapInArrow(pack, PACKED)


def digest(packed: DataFrame) -> DataFrame:
    """Packed rows with the digests of their matrices' rows in place of these."""
    return packed.select(
        "group", "row", F.size("doc_ids").cast("long").alias("n_segments"), F.element_at("cu_seqlens", -1).cast("long").alias("n_tokens"), "doc_ids", "starts", "cu_seqlens",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"),
    )
