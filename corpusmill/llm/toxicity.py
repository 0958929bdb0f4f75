"""Toxicity by a weighted lexicon and an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters to their Latin shape,
digits and signs that stand for letters to those letters.  The lexicon is learned
from labelled rows: folded words and word beginnings, weighted by how much more
often toxic documents have them.  One pass of the automaton over a folded text
finds every entry; a hit counts if it begins a word (and ends it, for whole
words) and does not lie in an exception phrase.  The summed weight, as it is and
divided by the logarithm of the length in words (runs between ASCII white space), goes into a logistic curve
fitted on the same labelled rows.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import batches_of, fresh_folder, make_room, require

#: Fixed look-alikes: letters and signs that are read as a Latin letter.
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "ο": "o", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "l": "i",
}
_FOLD = str.maketrans(LOOK_ALIKE | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | dict.fromkeys("​‌‍­⁠", ""))
_STROKE = re.compile(r"(?<=\w)[!|](?=\w)")
#: Lengths of word beginnings that may enter the lexicon.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Terms that a task counts before it hands on what it has.
TERMS_HELD = 150_000
#: Phrases in which a listed word insults nobody; matched after folding.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "idiot proof")


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)  # whole words
    beginnings: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-2.0, 1.0, 1.0)  # constant, weight, weight by length

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "Model":
        found = json.loads(text)
        return cls(found["words"], found["beginnings"], tuple(found["exceptions"]), tuple(found["curve"]))


def fold(text: str) -> str:
    """Lower case and Latin shapes; a bar or an exclamation mark inside a word is an i."""
    text = text.lower()
    if "!" in text or "|" in text:
        text = _STROKE.sub("i", text)
    return text.translate(_FOLD)


class Matcher:
    def __init__(self, model: Model):
        self.curve = model.curve
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for kind, found in (("word", model.words), ("begin", model.beginnings)):
            for term, weight in found.items():
                entries.setdefault(term, []).append((kind, weight))
        for phrase in map(fold, model.exceptions):
            entries.setdefault(phrase, []).append(("except", 0.0))
        for term, kinds in entries.items():
            self.automaton.add_word(term, (len(term), kinds))
        self.empty = not entries
        if entries:
            self.automaton.make_automaton()

    def weight(self, folded: str) -> float:
        """Summed weight of the words hit, each once by its heaviest entry; repeats add."""
        if self.empty:
            return 0.0
        hits: dict[int, float] = {}  # by where the word begins
        spared: list[tuple[int, int]] = []
        n = len(folded)
        for last, (length, kinds) in self.automaton.iter(folded):
            start = last + 1 - length
            if start and folded[start - 1].isalnum():
                continue
            ends = last + 1 == n or not folded[last + 1].isalnum()
            for kind, weight in kinds:
                if kind == "except":
                    if ends:
                        spared.append((start, last + 1))
                elif kind == "begin" or ends:
                    hits[start] = max(weight, hits.get(start, 0.0))
        return sum(w for at, w in hits.items() if not any(a <= at < b for a, b in spared))

    def measures(self, text: str) -> tuple[float, float]:
        weight = math.log1p(self.weight(fold(text)))
        return weight, weight / math.log(2 + len(text.encode("utf-8", "surrogatepass").split())) if weight else 0.0

    def score(self, text: str) -> float:
        a, b = self.measures(text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose crc32 of the id, as text, is divisible by 5: never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, most_per_class: int) -> DataFrame:
    """Text and label of at most ``most_per_class`` labelled rows of each class, none held out.

    The rows are those with the smallest hash of their id; the id serves the
    choice only.  A document labelled twice, differently, counts as toxic.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ranked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_per_class) for c in (0, 1)]
    chosen = ranked[0].unionByName(ranked[1])  # bounded: two times most_per_class pairs of numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic"))


def _terms(text: str) -> set[str]:
    out: set[str] = set()
    for word in {w.strip(".,;:?\"'()[]<>*-_") for w in fold(text).split()}:
        if 3 <= len(word) <= 40:
            out.add("=" + word)
            out.update(word[:k] for k in BEGINNINGS if len(word) >= k)
    return out


def _count_terms(rows: DataFrame, model: Model) -> DataFrame:
    """How many clean and toxic rows have each term; toxic rows that the model finds already are left out.

    The term "" counts the rows.
    """
    told = rows.sparkSession.sparkContext.broadcast(model.to_json())

    names = ["term", "clean", "toxic"]

    def out(counts: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        terms = list(counts[0].keys() | counts[1].keys())
        for at in range(0, len(terms), 50_000):
            some = terms[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([c[t] for t in some], pa.int64()) for c in counts)], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        matcher = Matcher(Model.from_json(told.value))
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches_of(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not toxic or not matcher.weight(fold(text or "")):
                    counts[toxic].update(_terms(text or "") | {""})
            if len(counts[0]) + len(counts[1]) > TERMS_HELD:
                yield from out(counts)
                counts = (Counter(), Counter())
        yield from out(counts)

    return rows.select("text", "toxic").mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _telling(found: DataFrame, most: int) -> list[tuple[str, float]]:
    """Terms that toxic rows have too often for chance, given how many terms there are.

    For a term in k toxic and n clean rows, with q the toxic share of all rows,
    (k + n) times the divergence of k / (k + n) from q bounds the logarithm of the
    chance; it must outweigh the logarithm of the number of terms that could pass,
    those in two toxic rows or more.  No share of toxic rows is asked for: a term
    that clean rows have as well weighs less.  The weight is the logarithm of how
    much more often toxic rows have it.
    """
    total = found.agg(F.count_if(F.col("toxic") >= 2).alias("terms"), F.max("clean").alias("clean"), F.max("toxic").alias("toxic")).first()
    if not total["terms"] or not total["toxic"]:
        return []
    q = F.lit((total["toxic"] + 0.5) / (total["toxic"] + (total["clean"] or 0) + 1.0))
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - q))).otherwise(0.0)
    evidence = (F.col("toxic") + F.col("clean")) * (share * F.log(share / q) + rest)
    weight = F.log(((F.col("toxic") + 0.5) / (total["toxic"] + 1)) / ((F.col("clean") + 0.5) / ((total["clean"] or 0) + 1)))
    kept = found.where((F.col("term") != "") & (F.col("toxic") >= 2) & (share > q) & (evidence >= math.log(total["terms"]) + 2))
    return [(r["term"], r["weight"]) for r in kept.select("term", weight.alias("weight"), evidence.alias("evidence")).orderBy(F.col("evidence").desc(), "term").limit(most).collect()]


def fit(docs: DataFrame, labels: DataFrame, most_per_class: int = 6000, most_terms: int = 20000, rounds: int = 4) -> Model:
    """Learn the lexicon and the curve.

    Bounds: ``most_per_class`` labelled rows of each class, ``most_terms`` lexicon
    entries a round (those with the most evidence).  Rows with the same set of
    words count once.  A term enters if toxic rows have it beyond chance; how
    much it weighs follows the odds.  Later rounds look at the toxic rows without a
    hit so far, of which rarer terms stand out.  Without toxic labels the lexicon is
    empty and every score the same.
    """
    spark = docs.sparkSession
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"\s+"))
    alike = F.md5(F.array_join(F.array_sort(words), " "))
    path = fresh_folder(spark, "toxicity-sample")
    training_rows(docs, labels, most_per_class).groupBy(alike.alias("alike"), "toxic").agg(F.min("text").alias("text")).select("text", "toxic").write.parquet(path)
    rows = spark.read.parquet(path)
    model = Model()
    for _ in range(rounds):
        telling = _telling(_count_terms(rows, model), most_terms)
        if not telling:
            break
        model.words |= {t[1:]: w for t, w in telling if t[0] == "="}
        model.beginnings |= {t: w for t, w in telling if t[0] != "="}
    if not model.words and not model.beginnings:
        return Model(curve=(-2.0, 0.0, 0.0))
    told = spark.sparkContext.broadcast(model.to_json())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        matcher = Matcher(Model.from_json(told.value))
        for batch in batches_of(batches):
            found = [matcher.measures(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in found], pa.float64()) for k in (0, 1)), batch.column(1).cast(pa.int64())], names=["a", "b", "y"])

    # at most 2 * most_per_class rows, and equal ones are counted
    points = rows.select("text", "toxic").mapInArrow(measure, "a double, b double, y long").groupBy(F.round("a", 2).alias("a"), F.round("b", 2).alias("b"), "y").count().orderBy("a", "b", "y").collect()
    model.curve = _fit_curve(np.array([[1.0, r["a"], r["b"]] for r in points]), np.array([float(r["y"]) for r in points]), np.array([float(r["count"]) for r in points]))
    return model


def _fit_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.1) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; both classes weigh the same."""
    each = n / np.where(y > 0, max(1.0, n[y > 0].sum()), max(1.0, n[y == 0].sum())) * n.sum() / 2
    beta = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (each * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(3)
        step = np.linalg.solve(hess, x.T @ (each * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def score_column(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score in [0, 1] per row; the text is the only input.

    Null and empty texts get the score of a text without hits.  All rows and
    columns are kept, in no other order; nothing is shuffled.
    """
    require(docs, text_col)
    if name in docs.columns:
        raise ValueError(f"{name} is a column already")
    told = docs.sparkSession.sparkContext.broadcast(model.to_json())
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        matcher = Matcher(Model.from_json(told.value))
        for batch in batches_of(batches):
            scores = pa.array([matcher.score(t or "") for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels, **bounds)
    ids_and_texts = docs.select("doc_id", "text")
    scored = _drop_text(ids_and_texts, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _drop_text(docs: DataFrame, model: Model) -> DataFrame:
    told = docs.sparkSession.sparkContext.broadcast(model.to_json())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        matcher = Matcher(Model.from_json(told.value))
        for batch in batches_of(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([matcher.score(t or "") for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def keep_clean(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The documents that are not predicted toxic, with their columns."""
    model = fit(docs, labels, **bounds)
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    return score_column(docs, model, name=name).where(F.col(name) < 0.5).drop(name)
