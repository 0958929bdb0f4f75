"""Languages by runs of three characters, learned from labelled texts."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.sources import tables

#: Characters in a run, fewest runs of a text that is decided, characters of a stretch handled at once.
LONG, FEWEST, STRETCH = 3, 8, 1 << 16
#: Parts in which the digests of a language are ranked before those that are left are ranked together.
PARTS = 64


@dataclass(frozen=True)
class Languages:
    """Names in order and, for each known run, its log-probability in each of them."""

    names: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]


def runs_of(text: str) -> Counter:
    """The runs of a whole text: lower case, white space as one blank, digits as 0; taken stretch by stretch."""
    plain = " ".join("".join("0" if c.isdigit() else c for c in text.lower()).split())
    counts: Counter = Counter()
    for at in range(0, max(0, len(plain) - LONG + 1), STRETCH):
        some = plain[at : at + STRETCH + LONG - 1]
        counts.update(map("".join, zip(some, some[1:], some[2:], strict=False)))
    return counts


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", most_texts: int | None = None, most_runs: int | None = None) -> Languages:
    """Log-probabilities of all runs by language, from all labelled texts; repeated texts of a language count once.

    ``most_texts`` of each language (those of smallest digest) and the ``most_runs``
    most frequent runs (ties by the run) are taken only if given; reruns agree.  Runs
    are counted in the tasks and summed by Spark; a row for each different run comes to the
    driver, and there are far fewer of them than texts' characters: letters bound them.
    Rows without a label or a text teach nothing; without any, there are no languages.
    """
    tables.small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.sha2(F.col(text).cast("binary"), 256).alias("h"))
    if most_texts is not None:
        # digests are ranked without their texts, and cut where they lie first: a part of a language hands on no more than the language keeps
        digests = rows.select("l", "h").distinct().withColumn("part", F.conv(F.substring("h", 1, 4), 16, 10).cast("int") % PARTS)
        for within in (["l", "part"], ["l"]):
            digests = digests.withColumn("k", F.row_number().over(Window.partitionBy(*within).orderBy("h"))).where(F.col("k") <= most_texts)
        rows = rows.join(F.broadcast(digests.select("l", "h")), ["l", "h"])
    once = rows.groupBy("l", "h").agg(F.min("t").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a batch's texts are added up, or each would hand on its runs
            found: dict[str, Counter] = defaultdict(Counter)
            for name, whole in zip(batch.column(0), batch.column(1), strict=True):
                found[name.as_py()].update(runs_of(whole.as_py()))
            names, runs, counts = zip(*((name, run, n) for name, some in found.items() for run, n in some.items()), strict=True) if any(found.values()) else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(runs, pa.string()), pa.array(counts, pa.int64())], names=["l", "run", "n"])

    counts = once.select("l", "t").mapInArrow(count, "l string, run string, n long").groupBy("run", "l").agg(F.sum("n").alias("n"))
    by_run = counts.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("l", "n"))).alias("by"), F.sum("n").alias("n"))
    if most_runs is not None:
        by_run = by_run.orderBy(F.desc("n"), "run").limit(most_runs)
    held = [(r.run, r.by) for r in by_run.collect()]
    names = tuple(sorted({name for _, by in held for name in by}))
    totals = [sum(by.get(name, 0) for _, by in held) for name in names]
    size = 0.5 * (len(held) + 1)
    weights = {run: tuple(math.log((by.get(name, 0) + 0.5) / (total + size)) for name, total in zip(names, totals, strict=True)) for run, by in held}
    return Languages(names, weights)


def detect(texts: DataFrame, model: Languages, id_col: str = "doc_id", text: str = "text", margin: float = 0.05) -> DataFrame:
    """id, guess, margin: the language of each whole text; null where it is undecided.

    ``margin`` is the mean log-odds a known run between the best language and the next;
    a text below it, or of fewer than ``FEWEST`` known runs, or null, is undecided.
    White space is not needed.  Repeated rows give repeated results, an empty table an
    empty one; other columns are left out.
    """
    weights, names = model.weights, model.names

    def one(whole: str | None) -> tuple[str | None, float]:
        found = [(n, weights[run]) for run, n in runs_of(whole or "").items() if run in weights]
        known = sum(n for n, _ in found)
        if known < FEWEST or not names:
            return None, 0.0
        scores = np.array([n for n, _ in found], float) @ np.array([w for _, w in found]) / known
        order = np.argsort(-scores, kind="stable")
        lead = float(scores[order[0]] - scores[order[1]]) if len(names) > 1 else math.inf
        return (names[order[0]] if lead >= margin else None), lead

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [one(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g for g, _ in told], pa.string()), pa.array([m for _, m in told], pa.float64())], names=[id_col, "guess", "margin"])

    return texts.select(id_col, text).mapInArrow(run, T.StructType([texts.schema[id_col], T.StructField("guess", T.StringType()), T.StructField("margin", T.DoubleType())]))
