"""Vector and keyword search of many questions over a whole corpus at once."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import keyword_index, vector_index
from corpusmill.operators.fusion import ranked
from corpusmill.sources import tables

#: Vectors in a block of questions and of the corpus.
QUERY_BLOCK, CORPUS_BLOCK = 256, 2048
#: Vectors of the corpus in a share.
SHARE = 8 * CORPUS_BLOCK


def _blocks(df: DataFrame, id_col: str, vector_col: str, rows: int, kind: str) -> DataFrame:
    """number, width, ids, vectors: the table in matrices of up to ``rows`` vectors, those of one width together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths = batch.column(0).to_pylist(), pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            numbers, starts = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8"), np.cumsum(lengths) - lengths
            for width in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == width).tolist()
                for start in range(0, len(at), rows):
                    some = sorted(at[start : start + rows], key=ids.__getitem__)  # of equal scores the smaller id comes first
                    matrix = numbers[starts[some][:, None] + np.arange(width)]
                    size = np.linalg.norm(matrix, axis=1, keepdims=True) if width else np.zeros((len(some), 1))
                    matrix = np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)
                    number = crc32(str(ids[some[0]]).encode())
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([width]), pa.array([[ids[i] for i in some]], pa.list_(batch.schema.field(0).type)), pa.array([matrix.tobytes()], pa.binary())], names=["number", "width", "ids", "vectors"])

    tables.small_batches(df.sparkSession)
    return df.select(id_col, vector_col).mapInArrow(run, f"number long, width long, ids array<{kind}>, vectors binary")


def vector_topk(queries: DataFrame, corpus: DataFrame, most: int, digits: int | None = None, spread: int | None = None, ann: bool = False) -> DataFrame:
    """query_id, chunk_id, score, rank of the ``most`` nearest chunks of every question, by cosine.

    ``queries`` has query_id and embedding, ``corpus`` chunk_id and embedding; vectors
    of another width or without direction score 0.  Exact: blocks of questions meet
    blocks of the corpus in an equi join on shares of the corpus, a task multiplies two
    matrices, and each pair of blocks hands on its best ``most`` per question only.
    There is a share for every ``SHARE`` vectors of the corpus, so that a task holds as
    much of it at any size; ``spread`` sets another number.  With ``ann`` the corpus is
    indexed as a graph and walked instead, which may miss some.
    """
    if ann:
        return vector_index.search_index(queries, vector_index.index_vectors(corpus), most, digits)
    if spread is None:
        spread = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-corpus.count() // SHARE))
    qk, ck = queries.schema["query_id"].dataType.simpleString(), corpus.schema["chunk_id"].dataType.simpleString()
    asked = _blocks(queries, "query_id", "embedding", QUERY_BLOCK, qk).select("width", F.col("ids").alias("q_ids"), F.col("vectors").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("share"))
    held = _blocks(corpus, "chunk_id", "embedding", CORPUS_BLOCK, ck).select(F.col("width").alias("c_width"), F.col("ids").alias("c_ids"), F.col("vectors").alias("c"), F.pmod("number", F.lit(spread)).cast("int").alias("share"))

    return _multiplied(asked.join(held, "share"), most, digits, qk, ck)


def _multiplied(pairs: DataFrame, most: int, digits: int | None, qk: str, ck: str) -> DataFrame:
    """query_id, chunk_id, score, rank: each pair of blocks (width, q_ids, q, c_width, c_ids, c) hands on its best ``most`` a question.

    The ids of a block ascend.  A task holds one pair at a time, and a few more as they came.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                width, q_ids, q, c_width, c_ids, c = (batch.column(i)[k] for i in range(6))
                q_ids, c_ids, width = q_ids.values, c_ids.values, width.as_py()
                if width == c_width.as_py() and width:
                    scores = np.frombuffer(q.as_buffer(), "<f8").reshape(-1, width) @ np.frombuffer(c.as_buffer(), "<f8").reshape(-1, width).T
                else:
                    scores = np.zeros((len(q_ids), len(c_ids)))
                if digits is not None:
                    scores = np.round(scores, digits)
                row, place = _best(scores, most)
                columns = [q_ids.take(pa.array(row)), c_ids.take(pa.array(place)), pa.array(scores[row, place])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "score"])

    tables.small_batches(pairs.sparkSession)
    blocks = pairs.select("width", "q_ids", "q", "c_width", "c_ids", "c")
    return ranked(blocks.mapInArrow(best, f"query_id {qk}, chunk_id {ck}, score double"), most=most)


def _best(scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``most`` largest scores of every row, the largest first, of equals the first."""
    n = scores.shape[1]
    if most < n:  # whatever equals the last of them may be among them
        row, place = np.nonzero(scores >= np.partition(scores, n - most, axis=1)[:, n - most, None])
    else:
        row, place = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((place, -scores[row, place], row))
    row, place = row[order], place[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < most
    return row[first], place[first]


def within_topk(queries: DataFrame, corpus: DataFrame, within: str, most: int, digits: int | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: the nearest ``most`` of the chunks that share a question's values of ``within``.

    ``queries`` has query_id, ``within`` and embedding, a row for every value a question
    asks; ``corpus`` chunk_id, ``within`` and embedding.  Exact, and without work on
    values that nobody asks: each value's vectors are cut into blocks of about ``SHARE``
    rows by a hash, so one value of a third of all rows is many tasks, and meet the
    blocks of that value's questions only.  Vectors of another width than the
    question's are not compared; null values of ``within`` match nothing.
    """
    qk, ck = queries.schema["query_id"].dataType.simpleString(), corpus.schema["chunk_id"].dataType.simpleString()
    kind = corpus.schema[within].dataType.simpleString()

    def blocks(df: DataFrame, id_col: str, rows: int) -> DataFrame:
        """within, width, share, ids, vectors; the number of shares follows each value's count."""
        df = df.select(F.col(id_col).alias("_id"), F.col(within).cast(kind).alias(within), "embedding", F.size("embedding").alias("width")).where("width > 0")
        counts = df.groupBy(within, "width").agg(F.ceil(F.count("*") / rows).cast("int").alias("_shares"))
        dealt = df.join(counts, [within, "width"]).withColumn("share", F.pmod(F.xxhash64("_id"), F.col("_shares")).cast("int"))

        def one(group: pa.Table) -> pa.Table:
            width = group.column("width")[0].as_py()
            group = group.sort_by("_id")
            matrix = pc.list_flatten(group.column("embedding")).to_numpy().astype("<f8").reshape(-1, width)
            size = np.linalg.norm(matrix, axis=1, keepdims=True)
            matrix = np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)
            keys = {c: group.column(c).slice(0, 1) for c in (within, "width", "share", "_shares")}
            return pa.table({**keys, "ids": pa.array([group.column("_id").to_pylist()], pa.list_(group.schema.field("_id").type)), "vectors": pa.array([matrix.tobytes()], pa.binary())})

        return dealt.groupBy(within, "width", "share").applyInArrow(one, f"{within} {kind}, width int, share int, _shares int, ids array<{df.schema['_id'].dataType.simpleString()}>, vectors binary")

    held = blocks(corpus, "chunk_id", SHARE).select(within, "width", "share", F.col("_shares"), F.col("ids").alias("c_ids"), F.col("vectors").alias("c"), F.col("width").alias("c_width"))
    spread = corpus.groupBy(within, F.size("embedding").alias("width")).agg(F.ceil(F.count("*") / SHARE).cast("int").alias("_of"))
    asked = blocks(queries, "query_id", QUERY_BLOCK).select(within, "width", F.col("ids").alias("q_ids"), F.col("vectors").alias("q")).join(spread, [within, "width"])
    asked = asked.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("_of") - 1))).drop("_of")
    return _multiplied(asked.join(held, [within, "width", "share"]), most, digits, qk, ck)


def keyword_topk(queries: DataFrame, corpus: DataFrame, most: int) -> DataFrame:
    """query_id, chunk_id, score, rank of chunks (chunk_id, text) that have all words of a question, by cover density.

    The corpus is indexed first, by the questions' words if these are not very many;
    ``keyword_index`` keeps an index for many searches.
    """
    return keyword_index.search_words(queries, keyword_index.index_words(corpus, only=keyword_index.words_of(queries)), most)
