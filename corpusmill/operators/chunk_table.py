"""A chunk table that is appended to, versioned and served while it is written.

A commit adds whole versions of documents.  A version written again replaces its
older rows alone; a newer version of a document is served once it is committed, and
the older ones stay until they are retired and, hours later, purged.  Which rows
count is settled on (document, version) pairs, a small table beside the chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.commits import Commits


class ChunkTable:
    """Chunks under ``path``; rows have document_id, version and any other columns."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.commits = spark, Commits(spark, path)

    def append(self, chunks: DataFrame, transaction: str | None = None) -> int | None:
        """Add the chunks as whole versions of their documents; the commit's number.

        A transaction that is committed already adds nothing and gives None, so a batch
        that a stream repeats has no second effect.
        """
        counts = chunks.groupBy("document_id", "version").agg(F.count("*").alias("chunks"))
        return self.commits.add("append", {"chunks": chunks, "versions": counts}, transaction)

    def states(self) -> DataFrame | None:
        """document_id, version, chunks, retired_at, discarded and _number, _commit of every version's newest write."""
        written = self.commits.rows("versions")
        if written is None:
            return None
        newest = written.groupBy("document_id", "version").agg(F.max_by(F.struct("chunks", "_commit"), "_number").alias("w"), F.max("_number").alias("_number")).select("document_id", "version", "w.*", "_number")
        marks = self.commits.rows("marks")
        if marks is None:
            return newest.select("*", F.lit(None).cast("timestamp").alias("retired_at"), F.lit(False).alias("discarded"))
        # a mark holds for what was written before it, or with it
        later = newest.select("document_id", "version", F.col("_number").alias("_written")).join(marks.drop("_commit"), ["document_id", "version"]).where("_number >= _written")
        said = later.groupBy("document_id", "version").agg(F.min("retired_at").alias("retired_at"), F.bool_or(F.col("retired_at").isNull()).alias("discarded"))
        return newest.join(said, ["document_id", "version"], "left").withColumn("discarded", F.coalesce("discarded", F.lit(False)))

    def _rows(self, states: DataFrame) -> DataFrame:
        """The chunks of some versions, each version's newest write alone."""
        which = states.select("document_id", "version", "_commit")
        return self.commits.rows("chunks").join(which, ["document_id", "version", "_commit"], "left_semi").drop("_commit", "_number")

    def live(self) -> DataFrame | None:
        """Chunks of all versions that are neither retired nor discarded; None if nothing was ever written."""
        states = self.states()
        return None if states is None else self._rows(states.where("retired_at IS NULL AND NOT discarded"))

    def served(self) -> DataFrame | None:
        """Chunks of the newest live version of every document."""
        states = self.states()
        if states is None:
            return None
        best = states.where("retired_at IS NULL AND NOT discarded").groupBy("document_id").agg(F.max_by(F.struct("version", "_commit"), "version").alias("b"))
        return self._rows(best.select("document_id", "b.*"))

    def live_counts(self) -> DataFrame | None:
        """document_id, chunks: how many live chunks every document with any has; no chunk is read."""
        states = self.states()
        return None if states is None else states.where("retired_at IS NULL AND NOT discarded").groupBy("document_id").agg(F.sum("chunks").alias("chunks"))

    def _mark(self, kind: str, which: DataFrame, at: Column | None, transaction: str | None) -> int | None:
        rows = which.select("document_id", "version", (at if at is not None else F.lit(None)).cast("timestamp").alias("retired_at"))
        return self.commits.add(kind, {"marks": rows}, transaction)

    def retire_others(self, keep: DataFrame, at: Column, transaction: str | None = None) -> int | None:
        """Retire every live version of the documents in ``keep`` (document_id, version) but the one it names."""
        wanted = keep.select("document_id", F.col("version").alias("_keep"))
        return self._mark("retire", self.states().where("retired_at IS NULL AND NOT discarded").join(wanted, "document_id").where("version <> _keep"), at, transaction)

    def retire_documents(self, documents: DataFrame, at: Column, transaction: str | None = None) -> int | None:
        """Retire all live versions of the documents in ``documents`` (document_id)."""
        return self._mark("retire", self.states().where("retired_at IS NULL AND NOT discarded").join(documents.select("document_id").distinct(), "document_id", "left_semi"), at, transaction)

    def discard(self, versions: DataFrame, transaction: str | None = None) -> int | None:
        """Drop versions (document_id, version) that were never to be seen, as after a failure half-way."""
        return self._mark("discard", versions.select("document_id", "version").distinct(), None, transaction)

    def purge(self, now: Column, hours: int) -> int | None:
        """Rewrite the table without what was discarded, or retired more than ``hours`` ago; a single commit replaces all.

        The old folders stay for readers at work until ``vacuum``.  A writer that commits
        while the table is rewritten keeps its rows: the purge then counts for nothing.
        """
        seen = self.commits.history()
        states = self.states()
        if states is None:
            return None
        kept = states.where(~F.col("discarded") & (F.col("retired_at").isNull() | (F.col("retired_at") >= now - F.make_interval(hours=F.lit(hours)))))
        parts = {"chunks": self._rows(kept), "versions": kept.select("document_id", "version", "chunks"), "marks": kept.where("retired_at IS NOT NULL").select("document_id", "version", "retired_at")}
        return self.commits.add("replace", parts, after=seen)

    def vectors(self, base: str, model: str) -> DataFrame | None:
        """base, model, content_hash, embedding of live chunks: what embedding need not be paid for again."""
        rows = self.live()
        return None if rows is None else rows.groupBy(base, model, "content_hash").agg(F.first("embedding", ignorenulls=True).alias("embedding"))
