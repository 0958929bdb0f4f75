"""A queue of jobs with handlers: claims, effects and outcomes as numbered commits.

Jobs, claims and outcomes are rows of one log.  A claim is committed before its jobs
are handled and names the transaction under which their effects are written; the
outcome is committed after.  What was killed in between is found as a claim without an
outcome and handled again under the same name, so a table that knows the name already
(``ChunkTable``, ``Commits``) takes no second effect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources import tables
from corpusmill.sources.commits import Commits
from corpusmill.streaming.jobs import MOST_TRIES, WAITS, claim

#: Jobs of one kind (as they were enqueued, with attempts) and the name of their effects ->
#: job_id, outcome (complete, transient or permanent), message; a job without a row is complete, None: all are.
Handler = Callable[[DataFrame, str], DataFrame | None]


class Dispatcher:
    """The queue in ``path``, for one dispatcher at a time, such as a stream's ``foreachBatch``."""

    def __init__(self, spark: SparkSession, path: str, handlers: dict[str, Handler], most_tries: int = MOST_TRIES):
        self.commits, self.handlers, self.most_tries = Commits(spark, path), handlers, most_tries

    def enqueue(self, jobs: DataFrame, transaction: str | None = None) -> int | None:
        """Add jobs (job_id, kind, priority and what their handlers need); a transaction that is known adds none.

        A job_id that is there already, or twice, is enqueued once, its first; null ids and kinds are refused.
        """
        sound = jobs.where("job_id IS NOT NULL AND kind IS NOT NULL").dropDuplicates(["job_id"])
        held = self.commits.rows("jobs")
        fresh = sound if held is None else sound.join(held.select("job_id"), "job_id", "left_anti")
        return self.commits.add("enqueue", {"jobs": fresh}, transaction)

    def states(self) -> DataFrame | None:
        """Every job with status, attempts, run_after and message; None if nothing was ever enqueued."""
        jobs, told = self.commits.rows("jobs"), self.commits.rows("states")
        if jobs is None:
            return None
        jobs = jobs.drop("_number", "_commit")
        if told is None:
            return jobs.withColumns({"status": F.lit("pending"), "attempts": F.lit(0), "run_after": F.lit(0.0), "message": F.lit(None).cast("string")})
        newest = told.groupBy("job_id").agg(F.max_by(F.struct("status", "attempts", "run_after", "message"), "_number").alias("s")).select("job_id", "s.*")
        first = {"status": F.coalesce("status", F.lit("pending")), "attempts": F.coalesce("attempts", F.lit(0)), "run_after": F.coalesce("run_after", F.lit(0.0))}
        return jobs.join(newest, "job_id", "left").withColumns(first)

    def _open(self) -> list[tuple[str, str]]:
        """Transaction and commit of every claim whose outcome is not committed, oldest first."""
        history = self.commits.history()
        ended = {c.transaction for c in history if c.kind == "outcome"}
        return [(c.transaction, c.name) for c in history if c.kind == "claim" and f"{c.transaction}-done" not in ended]

    def _handle(self, transaction: str, name: str, now: float) -> None:
        """Handle the jobs of a claim, kind by kind in the order of the handlers, and commit what became of them."""
        spark, path = self.commits.spark, self.commits.path
        mine = self.states().join(spark.read.parquet(f"{path}/states/commit={name}").select("job_id"), "job_id", "left_semi")
        mine = tables.written(mine)
        told = mine.where(~F.col("kind").isin(list(self.handlers))).select("job_id", F.lit("permanent").alias("outcome"), F.lit("no handler").alias("message"))
        for kind, handler in self.handlers.items():
            some = mine.where(F.col("kind") == kind).drop("status", "run_after", "message")
            if not some.isEmpty():
                found = handler(some, f"{transaction}-{kind}")
                if found is not None:
                    told = told.unionByName(found.select("job_id", "outcome", "message"))
        worst = told.groupBy("job_id").agg(F.max_by("outcome", F.when(F.col("outcome") == "permanent", 2).when(F.col("outcome") == "transient", 1).otherwise(0)).alias("outcome"), F.max("message").alias("message"))
        again = (F.col("outcome") == "transient") & (F.col("attempts") < self.most_tries)
        wait = F.element_at(F.array(*map(F.lit, WAITS)), F.least("attempts", F.lit(len(WAITS))))
        status = F.when(F.coalesce("outcome", F.lit("complete")) == "complete", "complete").when(again, "pending").otherwise("dead")
        rows = mine.drop("message").join(worst, "job_id", "left").select("job_id", status.alias("status"), "attempts", F.when(again, F.lit(now) + wait).otherwise(F.col("run_after")).alias("run_after"), "message")
        self.commits.add("outcome", {"states": rows}, f"{transaction}-done")

    def run(self, now: float, most: int | None = None) -> int:
        """Handle what a killed run left behind, then claim due jobs until none is; the number of claims.

        A claim takes all due jobs of a priority, so that there are as many claims as priorities however long
        the queue is, for each reads the states of all jobs; ``most`` makes them smaller.
        """
        done = 0
        for transaction, name in self._open():
            self._handle(transaction, name, now)
            done += 1
        while True:
            states = self.states()
            due = states if states is None else tables.written(claim(states, now, most).select("job_id", "attempts"))
            if due is None or due.isEmpty():
                return done
            transaction = f"claim-{len(self.commits.history())}"
            rows = due.select("job_id", F.lit("running").alias("status"), (F.col("attempts") + 1).alias("attempts"), F.lit(now).alias("run_after"), F.lit(None).cast("string").alias("message"))
            self.commits.add("claim", {"states": rows}, transaction)
            self._handle(transaction, self._open()[-1][1], now)
            done += 1

    def follow(self, stream: DataFrame, checkpoint: str, clock: Callable[[int], float]) -> None:
        """Enqueue and run each micro-batch of a stream of jobs to its end; ``clock`` gives the time of a batch's number."""

        def batch(jobs: DataFrame, number: int) -> None:
            self.enqueue(jobs, f"batch-{number}")
            self.run(clock(number))

        stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
