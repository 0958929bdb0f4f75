"""Mixing sources to target weights by the cube method.

Every source has a target number of words.  The target over the source's size is
how often a document is to be taken on average: the whole part is taken for sure,
the fraction is an inclusion probability.  The cube method's flight moves these
probabilities, a few documents at a time, through the null space of two
constraints (the sum of the probabilities and the sum of probabilities times
words), until nearly all are 0 or 1; the totals of documents and words stay what
they were.  Blocks of a source fly in parallel; the dozen documents or fewer that
each leaves open fly again together, and the last dozen per source lands by
choosing the rounding whose totals are nearest.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import WORD, cut, require

#: Documents that fly together in one task.
BLOCK = 2_000
#: Sources whose totals the driver works on; more are refused.
MOST_SOURCES = 100_000
#: Documents that a flight leaves open, and that the landing rounds together, over all roundings.
LANDING = 12
_CLOSE = 1e-9


def weights_in_turn(rank: int) -> float:
    return (3.0, 1.0, 2.0)[rank % 3]


def targets_of(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets by weight that sum to ``share`` of all sizes, none above ``most`` times its source.

    What a source cannot take goes to the others by weight, again and again, until
    none is above its bound.
    """
    left, open_, found = share * sum(sizes), [i for i, w in enumerate(weights) if w > 0], [0.0] * len(sizes)
    while open_ and left > 0:
        each = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if each * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                found[i] = each * weights[i]
            break
        for i in full:
            found[i] = most * sizes[i]
            left -= found[i]
        open_ = [i for i in open_ if i not in set(full)]
    return found


def fly(chances: np.ndarray, sizes: np.ndarray, random: np.random.Generator, leave: int = 2) -> np.ndarray:
    """Flight with the constraints (count, words); at most ``leave`` chances, 2 at least, stay open."""
    pi = chances.astype(float).copy()
    pi[pi < _CLOSE] = 0.0
    pi[pi > 1 - _CLOSE] = 1.0
    waiting = np.flatnonzero((pi > 0) & (pi < 1)).tolist()[::-1]
    draws = random.random(3 * len(waiting) + 8).tolist()
    active: list[int] = []
    while len(active) + len(waiting) > leave:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) == 3:
            a, b, c = active
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
        elif len(active) == 2 and sizes[active[0]] == sizes[active[1]]:
            u = (1.0, -1.0)
        else:
            break
        up = down = np.inf  # how far one may go along u and against it
        for i, d in zip(active, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - pi[i]) / d), min(down, pi[i] / d)
            elif d < 0:
                up, down = min(up, -pi[i] / d), min(down, (pi[i] - 1) / d)
        step = up if draws.pop() * (up + down) < down else -down
        stay = []
        for i, d in zip(active, u, strict=True):
            x = pi[i] + step * d
            pi[i] = 0.0 if x < _CLOSE else 1.0 if x > 1 - _CLOSE else x
            if 0 < pi[i] < 1:
                stay.append(i)
        active = stay
    return pi


def land(chances: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Round the few open chances so that words, then counts, come nearest to their totals."""
    pi = chances.copy()
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    if len(open_):
        ways = np.array(list(itertools.product((0.0, 1.0), repeat=len(open_))))
        words = np.abs(ways @ sizes[open_] - pi[open_] @ sizes[open_])
        count = np.abs(ways.sum(1) - pi[open_].sum())
        pi[open_] = ways[np.lexsort((count, words))[0]]
    return pi


def _flight(seed: int, last: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["order", "doc_id", "size"], kind="stable").reset_index(drop=True)
        rank, block = int(frame["rank"].iloc[0]), int(frame["block"].iloc[0])
        sizes = frame["size"].to_numpy(float)
        pi = fly(frame["chance"].to_numpy(), sizes, np.random.default_rng([seed, rank, block]), LANDING)
        frame["chance"] = land(pi, sizes) if last else pi
        return frame.drop(columns="block")

    return run


def mix_plan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weight_of: Callable[[int], float] = weights_in_turn, share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    A document's size is its number of words, 0 for null.  Sources are ranked by code
    point, null last, and weighted by rank; targets are those of ``targets_of``.
    ``copies`` is how often the mix takes the row, at most ``most`` times.  Rows alike
    in id, source and size are planned one by one.  The plan depends on the rows and
    ``seed`` alone, not on their order or partitions.  An empty table gives an empty
    plan; other columns are left out.  Texts are read once and never shuffled.
    """
    require(docs, id_col, text_col, source_col)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    alike = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    alike = cut(alike)
    sums = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sums.sort(key=lambda r: (r["source"] is None, "" if r["source"] is None else str(r["source"])))
    sizes = [r["source_size"] for r in sums]
    targets = targets_of(sizes, [weight_of(i) for i in range(len(sums))], share, most)
    source_type = docs.schema[source_col].dataType.simpleString()
    told = docs.sparkSession.createDataFrame(
        [(r["source"], i, r["source_size"], float(t), t / r["source_size"] if r["source_size"] else 0.0, -(-r["rows"] // BLOCK)) for i, (r, t) in enumerate(zip(sums, targets, strict=True))],
        f"key {source_type}, rank int, source_size long, target double, often double, blocks int",
    )
    units = alike.join(F.broadcast(told), F.col("source").eqNullSafe(F.col("key"))).drop("key")  # at most MOST_SOURCES rows
    whole = F.least(F.floor("often"), F.lit(most))
    units = units.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select(
        "doc_id", "source", "size", "source_size", "target", "rank", "blocks",
        whole.cast("int").alias("sure"),
        F.when(whole >= most, 0.0).otherwise(F.col("often") - whole).alias("chance"),
        F.xxhash64("doc_id", "size", "nth", F.lit(seed)).alias("order"),
    )
    schema = units.schema
    blocks = max([1, *(-(-r["rows"] // BLOCK) for r in sums)])
    done = None
    while True:
        last = blocks == 1
        placed = units.withColumn("block", F.pmod("order", F.col("blocks")).cast("int"))
        flown = cut(placed.groupBy("rank", "block").applyInPandas(_flight(seed, last), schema))
        if last:
            done = flown if done is None else done.unionByName(flown)
            break
        still = (F.col("chance") > 0) & (F.col("chance") < 1)
        done = flown.where(~still) if done is None else done.unionByName(flown.where(~still))
        units = flown.where(still).withColumn("blocks", F.ceil(LANDING * F.col("blocks") / F.lit(BLOCK)).cast("int"))
        blocks = -(-LANDING * blocks // BLOCK)
    copies = (F.col("sure") + F.round("chance").cast("int")).cast("int")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as the plan takes it."""
    plan = mix_plan(docs, text_col, id_col, source_col, **how)
    key = lambda *c: F.md5(F.to_json(F.struct(*[x.cast("string").alias(f"c{i}") for i, x in enumerate(c)])))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    per_key = plan.groupBy(key(F.col("doc_id"), F.col("source"), F.col("size")).alias("key")).agg(F.sum("copies").cast("int").alias("copies"), F.count("*").cast("int").alias("rows"))
    # the document rides along as one column, so that its own columns cannot clash
    rows = docs.select(F.struct(*docs.columns).alias("doc"), key(F.col(id_col), F.col(source_col), size).alias("key"), F.xxhash64(text_col).alias("order"))
    rows = rows.join(per_key.where("copies > 0"), "key")
    # rows alike in key share the key's copies, first come first served in the order of their texts
    at = F.row_number().over(Window.partitionBy("key").orderBy("order"))
    own = F.expr("copies div rows").cast("int") + (F.col("at") <= F.col("copies") % F.col("rows")).cast("int")
    return rows.withColumn("at", at).withColumn("again", F.explode(F.array_repeat(F.lit(1), own))).select("doc.*")
