"""Semi joins, existence checks and citation links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as fn


def prefix_or_exists(df: DataFrame, key: str, column: str, prefix: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose column begins so, or whose key the other table has.

    Two disjoint branches, each with one plain predicate, in place of a join on a
    disjunction.
    """
    begins = F.coalesce(F.col(column).startswith(prefix), F.lit(False))
    there = other.select(F.col(other_key).alias("_key")).distinct()
    return df.where(begins).unionByName(df.where(~begins).join(there, F.col(key) == F.col("_key"), "left_semi"))


def all_found(wanted: DataFrame, group: str, key: str, existing: DataFrame, existing_key: str) -> DataFrame:
    """Per group: how many keys are wanted, how many exist, and whether all do."""
    there = existing.select(F.col(existing_key).alias("_key")).distinct()
    checked = wanted.join(there, F.col(key) == F.col("_key"), "left")
    counts = checked.groupBy(group).agg(F.count("*").alias("wanted"), F.count("_key").alias("found"))
    return counts.withColumn("all_found", F.col("wanted") == F.col("found"))


def cited(answers: DataFrame, offered: DataFrame, keys: list[str], answer: str, index: str) -> DataFrame:
    """Offered sources that the answer of the same key cites as [n]; their numbers stay."""
    named = answers.select(*keys, F.explode(fn.citations(answer)).alias(index))
    return offered.join(named, [*keys, index], "left_semi")
