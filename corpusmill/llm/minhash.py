"""MinHash near-dedup on fast similarity sketches.

1. Every text becomes its set of hashed word shingles, a digest of the set and a
   fast similarity sketch, banded.  Equal digests are one class; what follows
   works on one row per class.
2. In every bucket (a band's key that several classes have) each class is paired
   with the bucket's centre only.  Pairs are confirmed on full sets, and connected
   components are formed.
3. What is left are pairs of one bucket whose members are still in different
   components.  A bucket's members are dealt to bounded blocks, those of its largest
   component apart; pairs of blocks are compared by sketches, and the members that
   have a partner are confirmed on full sets in the block's own task.  A block
   hands on fewer links than it has members, and no pairs.

Bands follow the threshold: a pair at it shares no bucket with probability 1e-6
(36 bands of 7 coordinates at 0.85, 46 of 6 at 0.8); the sketch comparison of step
3 loses one with 1e-5.  Nothing else is left out: no bucket is capped.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import batches_of, cut, fresh_folder, hot_keys, lookup, make_room, require
from corpusmill.llm.components import connected
from corpusmill.llm.shingles import WordHashes, band_keys, fast_similarity_sketch, overlap, set_digest, shingle_set

#: Coordinates a sketch has at most, and the chance that a pair at the threshold shares no band.
MOST_COORDINATES, MISSED = 280, 1e-6
#: Members of a bucket that one task compares with as many others at a time, and shingles that they have together.
BLOCK, BLOCK_ELEMENTS = 500, 2_000_000
#: Pairs of sketches that are compared at once.
PAIRS = 1 << 14


class Layout(NamedTuple):
    bands: int
    rows: int

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


def layout(percent: int) -> Layout:
    """The longest bands that miss a pair at the threshold no more often than ``MISSED``."""
    p = min(percent, 99) / 100
    ways = [Layout(math.ceil(math.log(MISSED) / math.log1p(-(p**rows))), rows) for rows in range(1, MOST_COORDINATES // 2)]
    fitting = [x for x in ways if x.coordinates <= MOST_COORDINATES]
    if not fitting:
        raise ValueError(f"a threshold of {percent} percent needs more than {MOST_COORDINATES} coordinates")
    return fitting[-1]


def _row_key(id_col: str, text_col: str):
    """A digest of id and text: rows that share it are equal in both."""
    known = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("null"))
    return F.unhex(F.md5(F.concat_ws("\0", known, F.coalesce(F.concat(F.lit("="), F.col(text_col)), F.lit("null")))))


def _sketch_rows(docs: DataFrame, size: int, cut_as: Layout) -> DataFrame:
    """id, row_key, n, set_id and bands of every row; no bands without words."""
    schema = T.StructType([
        T.StructField("id", docs.schema["id"].dataType), T.StructField("row_key", T.BinaryType()), T.StructField("n", T.LongType()),
        T.StructField("set_id", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        hashes = WordHashes()
        for batch in batches_of(batches):
            n, ids, bands = [], [], []
            for text in batch.column(2).to_pylist():
                found = shingle_set(text, hashes, size)
                n.append(len(found))
                ids.append(set_digest(found) if len(found) else None)
                bands.append(band_keys(fast_similarity_sketch(found, cut_as.coordinates), cut_as.bands).view(np.int64) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.field("element", pa.int64())))], names=schema.names
            )

    return docs.select("id", "row_key", "text").mapInArrow(run, schema)


def _with_sets(rows: DataFrame, size: int, cut_as: Layout) -> DataFrame:
    """node, n, bands, text -> node, n, bands, sketch (a byte a coordinate) and elements; equal rows that follow one another once."""
    schema = T.StructType([
        T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.BinaryType()), T.StructField("elements", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        hashes = WordHashes()
        before = None
        for batch in batches_of(batches):
            keep, sketches, sets = [], [], []
            for at, (node, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if node != before:
                    before = node
                    found = shingle_set(text, hashes, size)
                    keep.append(at)
                    sketches.append((fast_similarity_sketch(found, cut_as.coordinates) & np.uint64(255)).astype(np.uint8).tobytes())
                    sets.append(found.tobytes())
            kept = batch.select([0, 1, 2]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sketches, pa.binary()), pa.array(sets, pa.binary())], names=schema.names)

    return rows.select("node", "n", "bands", "text").mapInArrow(run, schema)


def _least_agreement(percent: int, coordinates: int) -> int:
    """Coordinates on which a pair at the threshold agrees but for a chance of 1e-5."""
    p = percent / 100
    return max(1, int(p * coordinates - 4.3 * (coordinates * p * (1 - p)) ** 0.5))


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = overlap(x, y)
    return 100 * common >= percent * (len(x) + len(y) - common)


def _star_links(stars: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b (b the centre) that hold on their full sets.

    Sketches are compared first; full sets travel only for those that agree often
    enough.  A centre with very many pairs is dealt over several tasks.
    """
    least = _least_agreement(percent, layout(percent).coordinates)
    hot = hot_keys(stars.groupBy("b").agg(F.count("*").alias("rows")), "b")

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, rows=4096):
            same = [int((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum()) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(same, pa.bool_()))

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            linked = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    for column, keep in (("sketch", agreeing), ("elements", confirmed)):
        both = stars.join(members.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col(column).alias("of_a")), "a")
        both = lookup(both, members.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col(column).alias("of_b")), "b", hot, "a")
        fitting = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        stars = fitting.select("a", "b", "of_a", "of_b").mapInArrow(keep, "a long, b long")
    return stars


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups (key, i, j) from rows sorted by them, and where each group begins; the end is the last number."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        table = pa.Table.from_batches([*held, batch])
        at = [table.column(c).to_numpy() for c in ("key", "i", "j")]
        begins = (np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0)) + 1).tolist()
        if begins:
            yield table.slice(0, begins[-1]), [0, *begins]
            table = table.slice(begins[-1])
        held = table.to_batches()
    if held and sum(x.num_rows for x in held):
        table = pa.Table.from_batches(held)
        yield table, [0, table.num_rows]


class _Blocks:
    """Rows of some (key, i, j): of each, the members of a block or of two that are compared with each other."""

    def __init__(self, table: pa.Table, percent: int):
        self.percent, self.least = percent, _least_agreement(percent, layout(percent).coordinates)
        self.key, self.i, self.j, self.side, self.node, self.label, self.n = (table.column(c).to_numpy() for c in ("key", "i", "j", "side", "node", "label", "n"))
        self.bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(len(self.node), -1)
        self.sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(self.node), -1)

    def partners(self, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of one group that are of different labels and agree often enough, if this bucket is the first that both are in."""
        within = self.i[start] == self.j[start]
        rows = np.arange(start, end)
        left, right = (rows, rows) if within else (rows[self.side[start:end] == 1], rows[self.side[start:end] == 0])
        step = max(1, PAIRS // max(1, len(right)))
        for at in range(0, len(left), step):
            x = left[at : at + step, None]
            small, large = np.minimum(self.n[x], self.n[right]), np.maximum(self.n[x], self.n[right])
            meet = (self.label[x] != self.label[right]) & (100 * small >= self.percent * large)
            if within:
                meet &= self.node[x] < self.node[right]
            which, others = np.nonzero(meet)
            a, b = x[which, 0], right[others]
            for k in range(0, len(a), PAIRS):
                some_a, some_b = a[k : k + PAIRS], b[k : k + PAIRS]
                alike = (self.sketch[some_a] == self.sketch[some_b]).sum(1) >= self.least
                some_a, some_b = some_a[alike], some_b[alike]
                first = (self.bands[some_a] == self.bands[some_b]).argmax(1)
                here = self.bands[some_a, first] == self.key[start]
                if here.any():
                    yield some_a[here], some_b[here]


def _by_group(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _with_partners(blocks: DataFrame, percent: int) -> DataFrame:
    """The rows of ``blocks`` that have a partner in their block: at most all of them, never their pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for table, begins in _whole_groups(batches):
            found, seen = _Blocks(table, percent), np.zeros(table.num_rows, bool)
            for start, end in itertools.pairwise(begins):
                for a, b in found.partners(start, end):
                    seen[a] = True
                    seen[b] = True
            yield from table.filter(pa.array(seen, pa.bool_())).to_batches()

    return _by_group(blocks).mapInArrow(run, blocks.schema)


def _links_of_blocks(blocks: DataFrame, percent: int) -> DataFrame:
    """Links between components (their labels), confirmed on full sets in the block's own task.

    A pair is looked at unless its two ends are joined in this block already, so that
    a block gives fewer links than it has rows, however many pairs it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for table, begins in _whole_groups(batches):
            found, elements = _Blocks(table, percent), table.column("elements")
            for start, end in itertools.pairwise(begins):
                sets = [np.frombuffer(x, np.uint64) for x in elements.slice(start, end - start).to_pylist()]
                above: dict[int, int] = {}

                def top(label: int, above: dict[int, int] = above) -> int:
                    while label in above:
                        label = above[label]
                    return label

                links: list[tuple[int, int]] = []
                for a, b in found.partners(start, end):
                    for x, y in zip(a.tolist(), b.tolist(), strict=True):
                        own, theirs = top(int(found.label[x])), top(int(found.label[y]))
                        if theirs != own and _linked(sets[x - start], sets[y - start], percent):
                            above[theirs] = own
                            links.append((int(found.label[x]), int(found.label[y])))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    return _by_group(blocks).mapInArrow(run, "a long, b long")


def _blocks_of(labelled: DataFrame, hot: DataFrame) -> DataFrame:
    """key, i, j, side, node, label of the buckets (key, node, n, label) that hold several components.

    The largest component of a bucket needs no comparison within itself: its members
    are dealt to blocks of their own (i < 0), each of which meets the blocks of all
    others (j >= 0); those meet each other too.  So a bucket of one large component
    and a few others costs what the others cost.  A bucket that fits one block is one.
    """
    parts = labelled.groupBy("key", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("elements"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("rows", "label", "elements")).alias("main"), F.sum("rows").alias("rows"), F.sum("elements").alias("elements"), F.count("*").alias("parts")).where("parts > 1")

    def blocks(rows, elements):
        return F.greatest(F.ceil(rows / F.lit(BLOCK)), F.ceil(elements / F.lit(BLOCK_ELEMENTS))).cast("int")

    small = (F.col("rows") <= BLOCK) & (F.col("elements") <= BLOCK_ELEMENTS)
    mixed = mixed.select(
        "key", F.when(~small, F.col("main.label")).alias("main"), blocks(F.col("main.rows"), F.col("main.elements")).alias("mains"),
        F.when(small, 1).otherwise(blocks(F.col("rows") - F.col("main.rows"), F.col("elements") - F.col("main.elements"))).alias("others"),
    )
    left = lookup(labelled, mixed, "key", hot, "node")
    is_main = F.col("label").eqNullSafe(F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    left = left.withColumn("own", own)
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    to_others = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda x: place(F.least(x, "own"), F.greatest(x, "own"), F.col("own") > x))
    of_main = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda x: place(-1 - F.col("own"), x, F.lit(0)))
    to_mains = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda x: place(-1 - x, F.col("own"), F.lit(1)))
    return left.select("key", "node", "label", F.explode(F.when(is_main, of_main).when(F.col("main").isNull(), to_others).otherwise(F.concat(to_others, to_mains))).alias("at")).select("key", "at.i", "at.j", "at.side", "node", "label")


def near_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id, kept.

    Documents with 100 * intersection >= percent * union of their shingle sets are
    linked; ``component_id`` is the smallest id reachable over links, ``kept`` whether
    it is the row's own.  Texts with fewer words than a shingle are one shingle; null
    and empty texts and texts of white space have no shingles and are linked with
    nothing.  Rows that share an id are separate documents of that id; a null id
    counts as larger than any other, and ids of any type that has an order will do.
    An empty table gives an empty result; columns other than the two are left out.
    """
    require(docs, id_col, text_col)
    rows = _components(docs, text_col, id_col, shingle, percent)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _components(docs: DataFrame, text_col: str, id_col: str, shingle: int, percent: int) -> DataFrame:
    """id, row_key, n, component_id and first_key (the row key of the component's first row) of every row."""
    spark, cut_as = docs.sparkSession, layout(percent)
    folder = fresh_folder(spark, "minhash")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _row_key(id_col, text_col).alias("row_key"))
    sketches = written(_sketch_rows(texts, shingle, cut_as), "sketches")
    rank = F.struct(F.col("id").isNull().alias("unknown"), "id", "row_key")
    classes = sketches.where("n > 0").groupBy("set_id").agg(F.min(rank).alias("first"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    # buckets of several classes, with their members; a bucket's centre is the class of the lowest number
    placed = classes.select("node", "n", F.explode("bands").alias("key"))
    buckets = written(placed.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("size")).where("size > 1"), "centres")
    hot = hot_keys(buckets, "key", "size")
    in_buckets = written(lookup(placed, buckets, "key", hot, "node"), "buckets")

    # sets of the classes that are in such buckets
    several = in_buckets.select("node").distinct()
    firsts = classes.join(several, "node", "left_semi").select("node", "n", "bands", F.col("first.row_key").alias("row_key"))
    members = written(_with_sets(firsts.join(texts.select("row_key", "text"), "row_key"), shingle, cut_as), "members")
    if members.groupBy("node").count().where("count > 1").limit(1).count():  # equal rows that did not meet in one task
        members = members.dropDuplicates(["node"])

    stars = in_buckets.where(F.col("node") != F.col("centre")).select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    links = cut(_star_links(cut(stars), members, percent))
    labels = connected(links)

    # pairs of buckets that still hold several components
    labelled = cut(in_buckets.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label")))
    blocks = _blocks_of(labelled, hot).join(members.select("node", "n", "bands", "sketch"), "node")
    involved = cut(_with_partners(blocks, percent))
    more = _links_of_blocks(involved.join(members.select("node", "elements"), "node"), percent)
    # what was one component before is one node now
    merged = connected(cut(more)).select(F.col("node").alias("label"), F.col("label").alias("over"))

    named = classes.join(labels, "node", "left").select("set_id", "rows", "first", F.coalesce("label", "node").alias("label"))
    named = cut(named.join(merged, "label", "left").select("set_id", "rows", "first", F.coalesce("over", "label").alias("label")))
    lowest = named.groupBy("label").agg(F.min("first").alias("lowest"), F.count("*").alias("classes"))
    of_set = lookup(named, lowest, "label", hot_keys(lowest, "label", "classes"), "set_id")
    of_set = of_set.select("set_id", F.col("lowest.id").alias("component_id"), F.col("lowest.row_key").alias("first_key"))
    # a set that very many rows have is dealt over several tasks, and rows without one are not joined at all
    found = lookup(sketches.where("n > 0").select("id", "row_key", "n", "set_id"), of_set, "set_id", hot_keys(named, "set_id"), "row_key")
    return found.select("id", "row_key", "n", "component_id", "first_key").unionByName(
        sketches.where("n = 0").select("id", "row_key", "n", F.col("id").alias("component_id"), F.col("row_key").alias("first_key"))
    )


def keep_one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the first by id, null last, then by a digest of the text.

    Documents count as copies from ``percent`` on.  Texts without words are linked with
    nothing; of rows equal in id and text one stays all the same.  All columns are
    kept; an empty table gives an empty one.
    """
    require(docs, id_col, text_col)
    rows = _components(docs, text_col, id_col, shingle, percent)
    kept = rows.select(F.col("first_key").alias("_kept")).distinct()
    # the document rides along as one column, so that its own columns cannot clash
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), _row_key(id_col, text_col).alias("_key"))
    return keyed.join(kept, F.col("_key") == F.col("_kept"), "left_semi").groupBy("_key").agg(F.first("doc").alias("doc")).select("doc.*")
