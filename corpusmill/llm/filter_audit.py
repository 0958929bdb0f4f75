"""What every order of the filters keeps, removes and loses, by one matrix product.

A document's failures are a mask of five bits.  Documents of a part are counted by
mask, all of them and those with a label, which makes three rows of 32 counts; two
documents of one mask behave alike under every order.  Fixed 32-by-600 matrices of
whole numbers, a column a step of each of the 120 orders, say for a mask whether it
is kept, removed, failed though removed before, and failed by that filter alone; a
part's counts times the matrices are all its outcomes, whatever the number of its
documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import HOT, batches_of, cut, hot_keys, lookup, require, text_or_empty

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(1, len(FILTERS) + 1)]
MASKS = 2 ** len(FILTERS)
#: The bit of filter E, which asks the whole table.
COPY = 1 << FILTERS.index("E")
_LATER_BYTES = bytes(range(0x80, 0xC0))
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SIGNS = b"#$%&*|"
#: What a label of 1 says of its document.
_LABELS = {"quality": "good", "toxic": "toxic"}


def matrices() -> dict[str, np.ndarray]:
    """Masks by steps: 1 where a document of the mask has the outcome; shapley counts the orders in which the step's filter removes it."""
    masks = np.arange(MASKS)[:, None]
    bit = np.array([1 << FILTERS.index(order[step - 1]) for order, step in STEPS])[None, :]
    earlier = np.array([sum(1 << FILTERS.index(f) for f in order[: step - 1]) for order, step in STEPS])[None, :]
    fails, gone = masks & bit != 0, masks & earlier != 0
    removed = (fails & ~gone).astype(np.int64)
    orders = np.zeros((MASKS, len(FILTERS)), np.int64)
    letter = np.array([FILTERS.index(order[step - 1]) for order, step in STEPS])
    for k in range(len(FILTERS)):
        orders[:, k] = removed[:, letter == k].sum(axis=1)
    return {
        "kept": (~fails & ~gone).astype(np.int64),
        "removed": removed,
        "redundant": (fails & gone).astype(np.int64),
        "unique_fails": np.broadcast_to(masks == bit, removed.shape).astype(np.int64),
        "shapley": orders[:, letter],
    }


def own_mask(data: bytes) -> int:
    """The filters that a text fails by itself: all but E."""
    words = data.split()  # the six white-space bytes of ASCII
    chars = len(data.translate(None, _LATER_BYTES))
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    found = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * chars, len(data.translate(None, _SIGNS)) < len(data))
    return sum(1 << k for k, fails in enumerate(found) if fails)


def _measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, mask of every document; the text stays where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            texts = [x or b"" for x in batch.column(2).to_pylist()]
            columns = [pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()), pa.array([own_mask(x) for x in texts], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "part", "digest", "mask"])

    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_or_empty().cast("binary").alias("data"))
    return rows.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("part", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("mask", T.IntegerType())]))


def mask_histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, documents, good, toxic: the documents of each part by the filters they fail, with those labelled good or toxic.

    A null text is empty, a null source the part "".  A document labelled several times
    is good (toxic) if any of its labels says so; null labels and null ids say nothing.
    A row is a copy if a smaller doc_id has the same text, so of repeated rows with the
    smallest id none is; a row without id is never one, nor the one that others copy.

    Rows alike in part, mask and labels are counted under their text's digest before
    they are shuffled, so a text of very many copies is a few rows a task; digests and
    ids that are hot all the same are dealt over several tasks.
    """
    require(docs, "doc_id", "text", "source")
    require(labels, "doc_id", "quality", "toxic")
    rows = _measured(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    # rows without id match no label; their digest deals them out
    rows = rows.withColumn("_side", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(HOT))).otherwise(0))
    says = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)).cast("int")).alias(_LABELS[name])
    told = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(says("quality"), says("toxic")).withColumn("_side", F.lit(0).cast("long"))
    labelled = rows.join(told, ["doc_id", "_side"], "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in _LABELS.values()})
    # of the rows alike: how many, how many without id, their smallest id and how many have it
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    unnamed = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    groups = cut(labelled.groupBy("digest", "part", "mask", *_LABELS.values()).agg(F.sum("n").alias("n"), unnamed.alias("unnamed"), least.alias("least")))
    texts = cut(groups.groupBy("digest").agg(F.min("least.doc_id").alias("original"), F.count("*").alias("rows")))
    found = lookup(groups, texts.select("digest", "original"), "digest", hot_keys(texts, "digest"), "part")
    own = F.col("unnamed") + F.when(F.col("least.doc_id") == F.col("original"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct("mask", own.alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - own).alias("n")))
    dealt = found.select("part", *_LABELS.values(), F.explode(both).alias("x")).where("x.n > 0")
    return dealt.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("documents"), *[F.sum(F.col("x.n") * F.col(c)).alias(c) for c in _LABELS.values()])


def audit_rows(histograms: DataFrame) -> DataFrame:
    """part, filter_order, step and the outcomes, from part, mask, documents, good, toxic.

    One row a part, order and step, zeros included; a part with no row in
    ``histograms`` has none here.
    """
    # at most 32 rows a part
    parts = histograms.groupBy("part").agg(F.collect_list(F.struct("mask", "documents", "good", "toxic")).alias("held")).select("part", "held.mask", "held.documents", "held.good", "held.toxic")
    outcomes = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in outcomes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = matrices()
        orders, steps = pa.array([o for o, _ in STEPS], pa.string()), pa.array([s for _, s in STEPS], pa.int32())
        for batch in batches_of(batches):
            for part, masks, *held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stacked = np.zeros((3, MASKS), np.int64)
                stacked[:, masks] = held
                found = {k: stacked @ m for k, m in by.items()}  # rows: documents, good, toxic
                columns = [found["kept"][0], found["removed"][0], found["redundant"][0], found["unique_fails"][0], found["removed"][1], found["removed"][2], found["shapley"][0]]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(STEPS), pa.string()), orders, steps, *(pa.array(c, pa.int64()) for c in columns)], names=schema.names)

    return parts.mapInArrow(run, schema)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Every part of ``docs`` (its source; null and empty are one) with each of the 600
    steps; see ``mask_histograms`` for nulls, repeats and copies.  An empty table has no
    parts and so no rows.
    """
    return audit_rows(mask_histograms(docs, labels))


#: The same in DuckDB's SQL, each order followed step by step.
ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
    f AS (SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
        coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
    h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
    o AS (SELECT [a, b, c, e, g] AS ls FROM range(5) x(a), range(5) y(b), range(5) z(c), range(5) u(e), range(5) v(g) WHERE len(list_distinct([a, b, c, e, g])) = 5),
    s AS (SELECT part, n, good, toxic, ls, unnest(range(1, 6)) AS step, list_transform(ls, lambda k: fails[k + 1]) AS fs FROM h, o),
    r AS (SELECT *, coalesce(list_bool_or(fs[1:step - 1]), false) AS gone, fs[step] AS fail FROM s),
    q AS (SELECT part, ls, step, sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN gone AND fail THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN fail AND len([x FOR x IN fs IF x]) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN NOT gone AND fail THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND fail THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM r GROUP BY 1, 2, 3)
    SELECT part, list_reduce([substr('ABCDE', (k + 1)::INT, 1) FOR k IN ls], lambda x, y: x || y) AS filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, ls[step]))::BIGINT AS shapley FROM q"""
