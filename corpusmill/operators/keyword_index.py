"""A positional inverted index of words, and search in it without the texts.

Chunks are indexed in blocks as they lie: of every word, the block's chunks that
have it and where, coded as differences.  A word of very many chunks is a row a
block, never one list.  A search settles on counts which blocks can have all words
of a question; then each such block gets its questions and the postings of their
words, once however many questions want them, intersects and scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as fn
from corpusmill.operators.fusion import ranked
from corpusmill.sources import tables

#: Chunks and words of a block.
BLOCK, BLOCK_WORDS = 256, 400_000
#: Distinct words of questions up to which one search has an index of these words made for it, and else one of all.
ASKED_WORDS = 20_000


@dataclass(frozen=True)
class KeywordIndex:
    """``postings``: word, block, chunks, counts, deltas; ``blocks``: block, ids."""

    postings: DataFrame
    blocks: DataFrame


def _in_order(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _cuts(lengths: np.ndarray, block: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``block`` rows and, but for a single longer one, BLOCK_WORDS words."""
    start = held = 0
    for at, n in enumerate(lengths.tolist()):
        if at > start and (at - start >= block or held + n > BLOCK_WORDS):
            yield start, at
            start, held = at, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def _postings(words: pa.Array, lengths: np.ndarray, position: np.ndarray | None = None) -> tuple[pa.Array, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Words of a block with their chunk numbers, how often each has them and the differences of positions, which count from 0 if not given."""
    coded = pc.dictionary_encode(words)
    code = coded.indices.to_numpy(zero_copy_only=False)
    chunk = np.repeat(np.arange(len(lengths)), lengths)
    if position is None:
        position = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.argsort(code, kind="stable")  # within a word by chunk and position
    code, chunk, position = code[order], chunk[order], position[order]
    begins = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])]) if len(code) else np.empty(0, int)
    delta = np.diff(position, prepend=0)
    delta[begins] = position[begins]
    counts = np.diff(np.r_[begins, len(code)])
    of_word = np.searchsorted(code[begins], np.arange(len(coded.dictionary) + 1))
    places = np.r_[begins, len(code)][of_word]
    split = lambda x, at: [x[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return coded.dictionary, split(chunk[begins], of_word), split(counts, of_word), split(delta, places)


def words_of(queries: DataFrame, most: int = ASKED_WORDS) -> list[str] | None:
    """The distinct words of the questions (query_id, text), or None if they are more than ``most``."""
    words = queries.select(F.explode(fn.lexemes(F.coalesce("text", F.lit("")))).alias("word")).distinct().limit(most + 1).collect()
    return [r["word"] for r in words] if len(words) <= most else None


def index_words(corpus: DataFrame, block: int = BLOCK, only: list[str] | None = None) -> KeywordIndex:
    """The index of ``corpus`` (chunk_id, text), written once to the shared folder; nothing is shuffled.

    Texts without words, null ones too, are in no posting.  Words are lower-cased runs
    of letters and digits.  ``only`` are the words to be posted, as for one search that
    asks for no others; every text is read all the same, and places count all words.
    """
    kind = corpus.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for start, end in _cuts(lengths, block):
                some = batch.slice(start, end - start)
                words, places = some.column(1).flatten(), None
                if only is not None:
                    words, places = words.field("word"), words.field("at").to_numpy(zero_copy_only=False)
                words, chunks, counts, deltas = _postings(words, lengths[start:end], places)
                numbers, ints = pa.array([number] * (len(words) + 1), pa.int64()), pa.list_(pa.int32())
                ids = pa.array([[]] * len(words) + [some.column(0).to_pylist()], pa.list_(batch.schema.field(0).type))
                columns = [pa.concat_arrays([words, pa.nulls(1, pa.string())]), numbers, *(pa.array([*x, []], ints) for x in (chunks, counts, deltas)), ids]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "block", "chunks", "counts", "deltas", "ids"])
                number += 1

    words = _in_order(F.col("text"))
    texts = corpus.select("chunk_id", words.alias("words"))
    if only is not None:  # only what is asked for goes to Python; words are letters and digits, so none has a quote
        placed = F.transform(words, lambda w, at: F.struct(w.alias("word"), at.alias("at")))
        asked = f"x.word IN ({', '.join(f"'{w}'" for w in sorted(only))})" if only else "false"
        texts = corpus.select("chunk_id", placed.alias("words")).withColumn("words", F.expr(f"filter(words, x -> {asked})"))
    rows = texts.mapInArrow(run, f"word string, block long, chunks array<int>, counts array<int>, deltas array<int>, ids array<{kind}>")
    tables.small_batches(corpus.sparkSession)
    held = tables.written(rows)
    return KeywordIndex(held.where("word IS NOT NULL").drop("ids"), held.where("word IS NULL").select("block", "ids"))


def cover_density(positions: list[np.ndarray]) -> float:
    """Sum over the shortest stretches that hold all terms: the longer a stretch, the less it adds."""
    terms = len(positions)
    term = np.repeat(np.arange(terms), [len(p) for p in positions])
    place = np.concatenate(positions)
    order = np.argsort(place, kind="stable")
    term, place = term[order], place[order]
    last = np.full((len(place), terms), -1, np.int64)
    last[np.arange(len(place)), term] = place
    low = np.maximum.accumulate(last, axis=0).min(axis=1)  # where the stretch that ends here begins, -1 if a term is missing
    gains = (low >= 0) & (low > np.r_[-1, low[:-1]])
    return float((0.1 / (1.0 + (place - low + 1 - terms)[gains])).sum())


def _holders(wanted: list[str], posted: dict[str, tuple]) -> np.ndarray:
    """Chunks that have all words: the shortest list is looked up in the others by bisection."""
    lists = sorted((posted[w][0] for w in wanted), key=len)
    held = lists[0]
    for other in lists[1:]:
        at = np.minimum(np.searchsorted(other, held), len(other) - 1)
        held = held[other[at] == held]
        if not len(held):
            break
    return held


def search_words(queries: DataFrame, index: KeywordIndex, most: int) -> DataFrame:
    """query_id, chunk_id, score, rank of the chunks that have all words of a question (query_id, text).

    A question without words, or with a word that no chunk has, finds nothing.  The
    rarest word of a question says which blocks are looked at, and of those only the
    ones that have every other word; no text is read.  A word that leads very many
    questions is dealt over the shuffle's partitions by block.
    """
    spark = queries.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ck = index.blocks.schema["ids"].dataType.elementType.simpleString()
    asked = queries.select("query_id", fn.lexemes(F.coalesce("text", F.lit(""))).alias("wanted")).where(F.size("wanted") > 0)
    # questions of the same words are looked up once
    asked = tables.written(asked.withColumn("wanted", F.array_sort("wanted")).groupBy("wanted").agg(F.collect_list(F.struct("query_id")).alias("askers")).withColumn("q", F.monotonically_increasing_id()))
    terms = asked.select("q", F.size("wanted").alias("terms"), F.explode("wanted").alias("word"))
    where = tables.written(index.postings.join(terms.select("word").distinct(), "word", "left_semi").select("word", "block", F.size("chunks").alias("chunks")))
    counts = where.groupBy("word").agg(F.sum("chunks").alias("chunks"))
    leads = terms.join(counts, "word", "left").groupBy("q", "terms").agg(F.min(F.struct(F.coalesce("chunks", F.lit(0)).alias("chunks"), "word")).alias("lead")).where("lead.chunks > 0")
    leads = leads.select("q", "terms", F.col("lead.word").alias("word"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part"))
    part = F.pmod(F.hash("block"), F.lit(spread)).alias("part")
    found = leads.join(where.select("word", "block", part), ["word", "part"]).select("q", "terms", "block")
    # of those blocks, the ones that have every word
    pairs = found.join(asked.select("q", F.explode("wanted").alias("word")), "q").join(where.select("word", "block"), ["word", "block"])
    full = tables.written(pairs.groupBy("q", "block").agg(F.count("*").alias("have"), F.first("terms").alias("terms")).where("have = terms").select("q", "block"))
    wanted = full.join(asked.select("q", "wanted"), "q")
    needed = index.postings.join(wanted.select("block", F.explode("wanted").alias("word")).distinct(), ["word", "block"], "left_semi")
    postings = needed.select("block", "word", "chunks", "counts", "deltas", F.lit(None).cast(index.blocks.schema["ids"].dataType).alias("ids"))
    named = index.blocks.join(full.select("block").distinct(), "block", "left_semi").select("block", *[F.lit(None).cast(k).alias(c) for c, k in (("word", "string"), ("chunks", "array<int>"), ("counts", "array<int>"), ("deltas", "array<int>"))], "ids")

    def search(questions: pa.Table, held: pa.Table) -> pa.Table:
        posted, ids = {}, []
        for word, chunks, n, deltas, names in zip(*(held.column(c).to_pylist() for c in ("word", "chunks", "counts", "deltas", "ids")), strict=True):
            if word is None:
                ids = names
            else:
                posted[word] = (np.array(chunks), np.cumsum([0, *n]), np.array(deltas))
        out_q, out_id, out_score = [], [], []
        for q, words in zip(questions.column("q").to_pylist(), questions.column("wanted").to_pylist(), strict=True):
            for chunk in _holders(words, posted).tolist():
                places = []
                for word in words:
                    chunks, ends, deltas = posted[word]
                    k = int(np.searchsorted(chunks, chunk))
                    places.append(np.cumsum(deltas[ends[k] : ends[k + 1]]))
                out_q.append(q)
                out_id.append(ids[chunk])
                out_score.append(round(cover_density(places), 9))
        kind = held.schema.field("ids").type.value_type
        return pa.table({"q": pa.array(out_q, pa.int64()), "chunk_id": pa.array(out_id, kind), "score": pa.array(out_score, pa.float64())})

    hits = wanted.select("block", "q", "wanted").groupBy("block").cogroup(postings.unionByName(named).groupBy("block")).applyInArrow(search, f"q long, chunk_id {ck}, score double")
    per_words = ranked(hits.withColumnRenamed("q", "query_id"), most=most)
    each = asked.select(F.col("q").alias("query_id"), F.explode("askers").alias("_asked"))
    return per_words.join(each, "query_id").select(F.col("_asked.query_id").alias("query_id"), "chunk_id", "score", "rank")
