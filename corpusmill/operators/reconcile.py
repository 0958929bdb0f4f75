"""Ordered against delivered: exact by key, fuzzy by name."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: likeness from which two names are the same thing.
LEAST_LIKENESS = 0.45


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def likeness(a: str, b: str) -> float:
    """The larger of the match ratio without blanks and signs, and the share of common words."""
    plain = [re.sub(r"[\s\-_.()]", "", x.lower()) for x in (a, b)]
    if plain[0] == plain[1]:
        return 1.0
    words = [set(x.lower().split()) for x in (a, b)]
    either = words[0] | words[1]
    return max(difflib.SequenceMatcher(None, *plain).ratio(), len(words[0] & words[1]) / len(either) if either else 0.0)


#: Names come again in other papers: a Python worker keeps the likeness of so many pairs.
_likeness = lru_cache(1 << 17)(likeness)


def _likest(name: str, free: list[dict]) -> tuple[float, int]:
    """The largest likeness of a name to the free items, and the first place that has it."""
    best = (0.0, 0)
    for k, g in enumerate(free):
        score = _likeness(name, g["item"])
        if score > best[0]:
            best = (score, k)
        if score >= 1.0:
            break
    return best


def _status(ordered: Column, net: Column) -> Column:
    return F.when(net.isNull(), "qty_unreadable").when(F.abs(net - ordered) < 1e-9, "ok").when(net > ordered, "over").otherwise("under")


def by_key(ordered: DataFrame, delivered: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ordered, delivered, status; tables with keys and qty.  One full join: missing and unexpected come with it."""
    want = ordered.select(*keys, F.col("qty").alias("ordered"), F.lit(True).alias("_wanted"))
    got = delivered.select(*keys, F.col("qty").alias("delivered"), F.lit(True).alias("_got"))
    both = want.join(got, keys, "full")
    status = F.when(F.col("_got").isNull(), "missing").when(F.col("_wanted").isNull(), "unexpected").otherwise(_status(F.col("ordered"), F.col("delivered")))
    return both.select(*keys, "ordered", "delivered", status.alias("status"))


def by_name(ordered: DataFrame, delivered: DataFrame, doc: str, least: float = LEAST_LIKENESS) -> DataFrame:
    """Per document: doc, item, ordered, matched, net, status, likeness.

    ``ordered`` has doc, place, item and qty; ``delivered`` doc, place, item and net
    (null if unreadable).  Each ordered item in turn takes the likest delivered item
    that is still free, if alike enough; what nobody takes is unexpected.  The two
    sides of a document, a paper of some lines each, meet in one row of two lists.
    """
    lists = lambda df, *c: df.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("place", *c))).alias("items"))
    want, got = lists(ordered, "item", "qty"), lists(delivered, "item", "net")
    both = want.withColumnRenamed("items", "want").join(got.withColumnRenamed("items", "got"), doc, "full")
    kind = both.schema[doc].dataType.simpleString()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, wanted, had in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                free = list(had or [])
                for w in wanted or []:
                    score, at = _likest(w["item"], free)
                    if not free or score < least:
                        rows.append((key, w["item"], w["qty"], None, None, "missing", round(score, 2)))
                        continue
                    g = free.pop(at)
                    gap = None if g["net"] is None else g["net"] - w["qty"]
                    status = "qty_unreadable" if gap is None else "ok" if abs(gap) < 1e-9 else "over" if gap > 0 else "under"
                    rows.append((key, w["item"], w["qty"], g["item"], g["net"], status, round(score, 2)))
                rows += [(key, None, None, g["item"], g["net"], "unexpected", None) for g in free]
            if rows:
                names = [doc, "item", "ordered", "matched", "net", "status", "likeness"]
                kinds = (batch.schema.field(0).type, pa.string(), pa.float64(), pa.string(), pa.float64(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return both.select(doc, "want", "got").mapInArrow(match, f"{doc} {kind}, item string, ordered double, matched string, net double, status string, likeness double")


def all_ok(lines: DataFrame, doc: str) -> DataFrame:
    return lines.groupBy(doc).agg(F.bool_and(F.col("status") == "ok").alias("all_ok"), F.count_if(F.col("status") != "ok").alias("problems"))
