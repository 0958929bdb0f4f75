"""Ranked lists: fusion by reciprocal rank, diversification and budgets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources import tables

#: Rank constant, weight of relevance, token budget and most passages.
RANK_CONSTANT, RELEVANCE, BUDGET, MOST = 60, 0.7, 6000, 8


def ranked(hits: DataFrame, score: str = "score", most: int | None = None, tie: str = "chunk_id") -> DataFrame:
    """``hits`` with their rank from 1 within query_id, best first; only the first ``most`` if given."""
    found = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), tie)))
    return found.where(F.col("rank") <= most) if most else found


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place from 1 in one order over all; equal rows are told apart by chance.

    Rows are dealt by ranges of the order and numbered in each; what the ranges before
    hold is added, which takes one number a range.  Nulls come first.
    """
    dealt = tables.written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    ranges = dealt.groupBy("_range").count()  # a row a range, so that one task can add them up
    before = ranges.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_range", "_own", "_before")


def reciprocal_rank(lists: list[DataFrame], constant: int = RANK_CONSTANT) -> DataFrame:
    """query_id, chunk_id, score: the sum of 1 / (constant + rank) over the lists (query_id, chunk_id, rank)."""
    rows = reduce(DataFrame.unionByName, [x.select("query_id", "chunk_id", "rank") for x in lists])
    return rows.groupBy("query_id", "chunk_id").agg(F.sum(F.lit(1.0) / (constant + F.col("rank"))).alias("score"))


def _beside(vectors: list[np.ndarray]) -> np.ndarray:
    """The vectors as rows; those of different widths lie in columns of their own, so that their cosine is 0."""
    widths = sorted({len(v) for v in vectors})
    starts = dict(zip(widths, np.cumsum([0, *widths]), strict=False))
    out = np.zeros((len(vectors), sum(widths)))
    for row, v in zip(out, vectors, strict=True):
        row[starts[len(v)] : starts[len(v)] + len(v)] = v
    return out


def diversify(candidates: DataFrame, relevance: float = RELEVANCE, most: int = 2 * MOST) -> DataFrame:
    """query_id, chunk_id, pick: the candidates of each query in order of marginal relevance.

    The next pick has the largest relevance * score - (1 - relevance) * (largest
    cosine to a pick so far, 0 at least: being unlike earns nothing); the best
    candidate comes first, ties go to the earlier.  A query's candidates are the few that search returned.
    """

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "chunk_id"], ascending=[False, True], kind="stable")
        vectors = _beside([np.asarray(v, float) for v in frame["embedding"]])
        sizes = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = np.divide(vectors, sizes, out=np.zeros_like(vectors), where=sizes > 0)
        scores = frame["score"].to_numpy(float)
        nearest = np.zeros(len(frame))
        free, picks = np.ones(len(frame), bool), []
        while free.any() and len(picks) < most:
            worth = np.where(free, relevance * scores - (1 - relevance) * nearest, -np.inf) if picks else np.where(free, scores, -np.inf)
            best = int(worth.argmax())
            picks.append(best)
            free[best] = False
            nearest = np.maximum(nearest, vectors @ vectors[best])
        return pd.DataFrame({"query_id": frame["query_id"].iloc[picks], "chunk_id": frame["chunk_id"].iloc[picks], "pick": range(1, len(picks) + 1)})

    schema = f"query_id {candidates.schema['query_id'].dataType.simpleString()}, chunk_id {candidates.schema['chunk_id'].dataType.simpleString()}, pick int"
    return candidates.select("query_id", "chunk_id", "score", "embedding").groupBy("query_id").applyInPandas(pick, schema)


def within_budget(items: Column, budget: int = BUDGET, most: int = MOST) -> Column:
    """Items of an ordered array (structs with ``tokens``) as long as they fit: one that
    does not is passed over, and smaller ones after it may still be taken."""
    item = F.slice(items, 1, 0)
    start = F.struct(F.lit(0).cast("long").alias("used"), item.alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] + x["tokens"] <= budget) & (F.size(acc["taken"]) < most)
        return F.struct(F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).cast("long").alias("used"), F.when(fits, F.concat(acc["taken"], F.array(x))).otherwise(acc["taken"]).alias("taken"))

    return F.aggregate(items, start, step, lambda acc: acc["taken"])
