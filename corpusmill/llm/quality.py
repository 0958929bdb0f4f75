"""Document quality by a factorisation machine.

A text becomes a sparse vector: its words hashed into buckets, steps of statistics
of its structure (a share of 0.3 turns on every step up to 0.3) and steps of its
metadata.  The machine adds a weight per entry and, for every pair of entries, the
product of their short vectors; the sum over all pairs is half of the square of the
summed vectors less the sum of their squares, so a text is scored in time linear in
its entries.  It is fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import batches_of, require

#: Buckets of hashed words, and length of an entry's vector.
BUCKETS, RANK = 4096, 8
#: Shares and sizes at which a statistic turns its next entry on.
SHARES = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
SIZES = tuple(2.0**k for k in range(1, 16))
STATISTICS = ("signed", "capital", "commonest", "repeated", "bare", "digits", "triples", "lines", "distinct", "words", "length", "line_words")
_STEPS = {name: SIZES if name in ("words", "length", "line_words") else SHARES for name in STATISTICS}
_SIGN = re.compile(r"[#$%&*|!?<>{}\[\]\\^~_=+@]")
#: Words whose traits a task remembers.
KNOWN = 200_000


def entries(metadata: tuple[str, ...]) -> int:
    """How many entries a text's vector can have."""
    return BUCKETS + sum(map(len, _STEPS.values())) + len(metadata) * len(SIZES)


class Features:
    """Texts to sparse vectors; remembers the traits of words."""

    def __init__(self, metadata: tuple[str, ...]):
        self.known: dict[str, tuple[int, int, int, int, int]] = {}
        self.cuts = [np.array(_STEPS[s]) for s in STATISTICS] + [np.array(SIZES)] * len(metadata)
        self.starts = BUCKETS + np.cumsum([0, *map(len, self.cuts)])

    def traits(self, word: str) -> tuple[int, int, int, int, int]:
        """Bucket, and whether the word has signs, is in capitals, has no letter or digit, has a digit."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            letters = any(map(str.isalpha, word))
            digits = any(map(str.isdigit, word))
            found = self.known[word] = (crc32(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS, bool(_SIGN.search(word)), len(word) > 1 and word.isupper(), not letters and not digits, digits)
        return found

    def statistics(self, text: str, words: list[str], counts: Counter, traits: list[tuple]) -> list[float]:
        n = len(words)
        if not n:
            return [0.0] * len(STATISTICS)
        times = np.fromiter(counts.values(), np.int64, len(counts))
        share = lambda k: float(sum(c for c, t in zip(counts.values(), traits, strict=True) if t[k])) / n
        number = {w: i for i, w in enumerate(counts)}
        ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
        triples = (ids[:-2] * len(counts) + ids[1:-1]) * len(counts) + ids[2:]
        lines = [x for x in text.split("\n") if x.strip()]
        return [
            share(1), share(2), float(times.max()) / n if n >= 20 else 0.0, sum(map(eq, words, words[1:])) / n, share(3), share(4),
            1 - len(np.unique(triples)) / len(triples) if len(triples) else 0.0, 1 - len(set(lines)) / len(lines), len(counts) / n,
            float(n), sum(map(len, counts)) / len(counts), n / len(lines),
        ]

    def vector(self, text: str, metadata: list[float | None]) -> tuple[np.ndarray, np.ndarray]:
        """Entries and their values; null metadata turns nothing on."""
        words = text.split()
        counts = Counter(words)
        traits = [self.traits(w) for w in counts]
        found = self.statistics(text, words, counts, traits) + [abs(float(m)) if m is not None else 0.0 for m in metadata]
        on = [start + np.arange(np.searchsorted(cuts, value, "right")) for start, cuts, value in zip(self.starts, self.cuts, found, strict=False)]
        steps = np.concatenate(on)
        if not words:
            return steps, np.ones(len(steps), np.float32)
        held = np.bincount([t[0] for t in traits], np.log1p(np.fromiter(counts.values(), np.float64, len(counts))), BUCKETS)
        buckets = np.flatnonzero(held)
        value = held[buckets] / np.sqrt((held * held).sum())
        return np.concatenate([buckets, steps]), np.concatenate([value, np.ones(len(steps))]).astype(np.float32)


@dataclass
class Machine:
    """The fitted machine; ``metadata`` names the columns it was fitted with."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    metadata: tuple[str, ...]

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        """Chance of good quality: the pairs' sum is half of the square of the sum less the sum of the squares."""
        mine = self.vectors[at] * value[:, None]
        total = mine.sum(axis=0)
        z = self.bias + float(self.weights[at] @ value) + 0.5 * float((total * total).sum() - (mine * mine).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose crc32 of the id, as text, leaves 1 when divided by 3: never learned from; false without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _rows(docs: DataFrame, metadata: tuple[str, ...], *first: Column) -> DataFrame:
    numbers = [F.col(m).cast("double").alias(f"m{k}") for k, m in enumerate(metadata)]
    return docs.select(*first, F.coalesce(F.col("text"), F.lit("")).alias("text"), *numbers)


def _sample(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...], most_per_class: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Label, weight and vector of at most ``most_per_class`` labelled texts of each class.

    None is held out; the rows are those with the smallest hash of their id.  A
    document labelled twice, differently, is a bad one, and so are equal texts with
    different labels; equal texts count once.  Weights give each class the share that it has of all labels.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    of = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}  # two rows
    ranked = [known.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_per_class) for c in (0, 1)]
    chosen = ranked[0].unionByName(ranked[1])  # bounded: two times most_per_class pairs of numbers
    width = len(metadata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(metadata)
        for batch in batches_of(batches):
            texts, numbers = batch.column(2).to_pylist(), [batch.column(3 + k).to_pylist() for k in range(width)]
            found = [make.vector(t, [c[i] for c in numbers]) for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], names=["digest", "quality", "at", "value"])

    labelled = docs.select("doc_id", "text", *metadata).join(F.broadcast(chosen), "doc_id")
    vectors = _rows(labelled, metadata, F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("digest"), F.col("quality")).mapInArrow(run, "digest string, quality int, at binary, value binary")
    once = vectors.groupBy("digest").agg(F.min("quality").alias("quality"), F.min_by(F.struct("at", "value"), "quality").alias("x"))
    rows = once.orderBy("digest").select("quality", "x.at", "x.value").toArrow()  # bounded like the choice, as sparse vectors
    label = np.array(rows.column(0).to_pylist(), np.float32)
    weight = np.ones(len(label), np.float32)
    for c in (0, 1):
        if (mine := label == c).any():
            weight[mine] = of[c] / sum(of.values()) * len(label) / mine.sum()
    return label, weight, [(np.frombuffer(a, "<i4"), np.frombuffer(v, "<f4")) for a, v in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True)]


def fit(docs: DataFrame, labels: DataFrame, most_per_class: int = 2000, metadata: tuple[str, ...] = ("n_chars",), rounds: int = 30) -> Machine:
    """Fit the machine on at most ``most_per_class`` labelled rows of each class, none of them held out.

    ``metadata`` names numeric columns of ``docs`` that count as entries, by their size;
    labels, lang, source and doc_id are refused.  Without labelled rows every score is
    one half, with those of one class only near that class.
    """
    require(docs, "doc_id", "text", *metadata)
    require(labels, "doc_id", "quality")
    if refused := {"quality", "toxic", "lang", "source", "doc_id"} & set(metadata):
        raise ValueError(f"{sorted(refused)} may not be inputs of a score")
    width = entries(metadata)
    label, weight, vectors = _sample(docs, labels, metadata, most_per_class)
    chance = np.random.RandomState(7)
    machine = Machine(0.0, np.zeros(width), chance.normal(0, 0.02, (width, RANK)), metadata)
    if not len(label):
        return machine
    share = float((weight * label).sum() / weight.sum())
    machine.bias = float(np.log((share * len(label) + 0.5) / ((1 - share) * len(label) + 0.5)))
    return machine if len(set(label.tolist())) < 2 else _descend(machine, label, weight, vectors, chance, rounds)


def _descend(machine: Machine, label: np.ndarray, weight: np.ndarray, vectors: list, chance: np.random.RandomState, rounds: int, block: int = 128, rate: float = 0.01, decay: tuple[float, float] = (1e-4, 1e-3)) -> Machine:
    """Logistic loss by blocks of rows, with step sizes that follow each weight's gradients (Adam)."""
    flat = np.concatenate([[machine.bias], machine.weights, machine.vectors.ravel()])
    width = len(machine.weights)
    mean, square, step = np.zeros_like(flat), np.zeros_like(flat), 0
    for _ in range(rounds):
        order = chance.permutation(len(label))
        for start in range(0, len(order), block):
            some = order[start : start + block]
            x = np.zeros((len(some), width))
            for row, i in enumerate(some):
                x[row, vectors[i][0]] = vectors[i][1]
            w, v = flat[1 : width + 1], flat[width + 1 :].reshape(width, RANK)
            total, squares = x @ v, x * x
            z = flat[0] + x @ w + 0.5 * ((total * total).sum(axis=1) - (squares @ (v * v)).sum(axis=1))
            slope = weight[some] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[some]) / len(some)
            pull = x.T @ (slope[:, None] * total) - (squares.T @ slope)[:, None] * v
            gradient = np.concatenate([[slope.sum()], x.T @ slope + decay[0] * w, (pull + decay[1] * v).ravel()])
            step += 1
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.999 * square + 0.001 * gradient * gradient
            flat = flat - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Machine(float(flat[0]), flat[1 : width + 1].copy(), flat[width + 1 :].reshape(width, RANK).copy(), machine.metadata)


def score_rows(docs: DataFrame, machine: Machine, *keep: str) -> DataFrame:
    """The columns ``keep`` and score, a number in [0, 1], of every row of ``docs``.

    The text and the machine's metadata are the only inputs, so equal rows have equal
    scores; null and empty texts are scored by what their metadata say.  Nothing is
    shuffled, all rows are kept.
    """
    require(docs, "text", *machine.metadata, *keep)
    told = docs.sparkSession.sparkContext.broadcast(machine)
    n, width = len(keep), len(machine.metadata)
    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField("score", T.DoubleType())])
    if "score" in keep:
        raise ValueError("score is a column already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = told.value
        make = Features(found.metadata)
        for batch in batches_of(batches):
            texts, numbers = batch.column(n).to_pylist(), [batch.column(n + 1 + k).to_pylist() for k in range(width)]
            scores = [found.score(*make.vector(t, [c[i] for c in numbers])) for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(scores, pa.float64())], names=schema.names)

    return _rows(docs, machine.metadata, *[F.col(k) for k in keep]).mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Rows with one id are scored each by their own text; a row without id counts as not
    held out; an empty table has no rows.  ``bounds`` are those of ``fit``.
    """
    scored = score_rows(docs, fit(docs, labels, **bounds), "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
