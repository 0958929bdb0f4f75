"""Snapshots, soft deletion, versions and counters over append-only tables.

Nothing is updated in place: a change appends a newer row, and readers take the
newest per key.  Deletions are tombstones until a purge rewrites the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(df: DataFrame, deleted_at: str = "deleted_at") -> DataFrame:
    return df.where(F.col(deleted_at).isNull())


def latest(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The newest row of each key: the largest of ``order``, all columns kept."""
    by = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), by).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def next_version(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def retire_others(chunks: DataFrame, document: str, version: str, served: DataFrame) -> DataFrame:
    """``chunks`` with ``retired``: whether another version of the document is served."""
    serving = served.select(F.col(document).alias("_doc"), F.col(version).alias("_serving"))
    return chunks.join(serving, F.col(document) == F.col("_doc"), "left").withColumn("retired", F.coalesce(F.col(version) != F.col("_serving"), F.lit(False))).drop("_doc", "_serving")


def purge(df: DataFrame, deleted_at: str, now: Column, hours: int) -> DataFrame:
    """Rows that are live or were deleted less than ``hours`` ago."""
    return df.where(F.col(deleted_at).isNull() | (F.col(deleted_at) >= now - F.make_interval(hours=F.lit(hours))))


def clamp_add(value: Column | str, delta: Column | str) -> Column:
    """A counter after a change, never below zero."""
    value, delta = (F.col(x) if isinstance(x, str) else x for x in (value, delta))
    return F.greatest(F.lit(0), value + delta)


def replace_links(links: DataFrame, key: str, new: DataFrame) -> DataFrame:
    """A bridge table where the keys in ``new`` have their new links only."""
    return links.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def folded(df: DataFrame, keys: list[str], order: str, newest: list[str], pinned: list[str]) -> DataFrame:
    """One row a key from facts that each set some columns: the newest value given to each of ``newest``, the first given to each of ``pinned``."""
    at = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    return df.groupBy(*keys).agg(*[F.max_by(c, at(c)).alias(c) for c in newest], *[F.min_by(c, at(c)).alias(c) for c in pinned])


def agent_states(events: DataFrame, agent: str, order: str, action: str, version: str) -> DataFrame:
    """``events`` with the agent's status, draft and published version after each, and why it was refused.

    An agent begins as a draft of version 1; ``update`` makes the next version its
    draft, ``publish`` serves the draft, ``rollback`` an older ``version``; a draft that
    is served becomes active.  ``pause`` and ``resume`` switch an agent off and on, and
    resuming needs something published.  ``archive`` is final: all but archiving is
    refused after it.  One sort by agent; a refused event changes nothing.
    """
    upto = Window.partitionBy(agent).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(agent).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    does, live = (lambda name: F.col(action) == name), ~F.col("_gone")
    found = events.withColumn("_gone", F.coalesce(F.bool_or(does("archive")).over(before), F.lit(False)))
    found = found.withColumn("draft", 1 + F.count_if(does("update") & live).over(upto))
    known = does("rollback") & F.col(version).between(1, F.col("draft"))
    found = found.withColumn("_served", F.when(live & does("publish"), F.col("draft")).when(live & known, F.col(version)))
    found = found.withColumn("published", F.last("_served", True).over(upto)).withColumn("_before", F.last("_served", True).over(before))
    switched = F.when(live & does("pause"), "paused").when(live & does("resume") & F.col("_before").isNotNull(), "active")
    found = found.withColumn("_switched", switched)
    fresh = ~F.coalesce(F.bool_or(F.col("_switched").isNotNull() | F.col("_served").isNotNull()).over(before), F.lit(False))
    found = found.withColumn("_status", F.when(does("archive"), "archived").otherwise(F.coalesce("_switched", F.when(F.col("_served").isNotNull() & fresh, "active"))))
    refusal = (
        F.when(F.col("_gone") & ~does("archive"), "agent_archived")
        .when(does("rollback") & F.col("_served").isNull(), "version_not_found")
        .when(does("resume") & F.col("_before").isNull(), "nothing_to_publish")
    )
    return found.withColumn("status", F.coalesce(F.last("_status", True).over(upto), F.lit("draft"))).withColumn("refusal", refusal).drop("_gone", "_served", "_before", "_switched", "_status")


def retried(docs: DataFrame, status: str) -> DataFrame:
    """``docs`` after a retry was asked for each: failed ones are queued with a job, others refused as they are."""
    failed = F.coalesce(F.col(status) == "failed", F.lit(False))
    after = docs.withColumn("refusal", F.when(~failed, "document_not_failed")).withColumn("job", F.when(failed, "ingest_document"))
    return after.withColumn(status, F.when(failed, "queued").otherwise(F.col(status)))


def finished_uploads(docs: DataFrame, content: str) -> DataFrame:
    """``docs`` as upload facts: size, digest, status queued, and the job that each puts in the queue."""
    data = F.col(content).cast("binary")
    return docs.select("*", F.octet_length(data).cast("long").alias("size_bytes"), F.sha2(data, 256).alias("content_hash"), F.lit("queued").alias("status"), F.lit("ingest_document").alias("job"))


def discard_failed(chunks: DataFrame, failures: DataFrame, document: str, version: str) -> DataFrame:
    """``chunks`` without those of the document versions that failed half-written."""
    return chunks.join(failures.select(document, version).distinct(), [document, version], "left_anti")


def failure_rows(failures: DataFrame, code: str, message: str, most: int = 1000) -> DataFrame:
    """``failures`` with what their documents show: status failed, the code and the message's first ``most`` characters."""
    return failures.withColumn("status", F.lit("failed")).withColumn("error_code", F.col(code)).withColumn("error_message", F.left(message, F.lit(most)))


def missing_ids(wanted: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return wanted.join(existing.select(key), key, "left_anti")


def cumulative_histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """le, observations: how many values lie at or below each bound, in one pass."""
    counts = df.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("observations")) for i, b in enumerate(bounds)])).alias("x")).select("x.*")


def row_numbers(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
