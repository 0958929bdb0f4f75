"""Jobs whose run is killed between effect and commit, retries until dead, and repeated batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusmill.operators.chunk_table import ChunkTable
from corpusmill.streaming.dispatch import Dispatcher


def _jobs(spark, rows):
    return spark.createDataFrame(rows, "job_id long, kind string, priority int, document_id long")


def test_a_killed_run_has_its_effects_once(spark, tmp_path):
    table, seen = ChunkTable(spark, str(tmp_path / "chunks")), []

    def ingest(jobs, transaction):
        seen.append((transaction, sorted(r.job_id for r in jobs.collect())))
        table.append(jobs.select("document_id", F.lit(1).alias("version"), F.lit("text").alias("content")), transaction)
        if len(seen) == 1:
            raise KeyboardInterrupt  # the effect is there, the outcome is not

    queue = Dispatcher(spark, str(tmp_path / "queue"), {"ingest": ingest})
    queue.enqueue(_jobs(spark, [(1, "ingest", 0, 10), (2, "ingest", 0, 20), (2, "ingest", 0, 20), (None, "ingest", 0, 30)]), "batch-0")
    with pytest.raises(KeyboardInterrupt):
        queue.run(5.0)
    assert {r.status for r in queue.states().collect()} == {"running"}
    again = Dispatcher(spark, str(tmp_path / "queue"), {"ingest": ingest})
    again.enqueue(_jobs(spark, [(1, "ingest", 0, 10), (3, "ingest", 0, 40)]), "batch-0")  # the stream repeats its batch
    assert again.run(6.0) == 1 and seen[0] == seen[1] and len(seen) == 2
    assert sorted((r.job_id, r.status, r.attempts) for r in again.states().collect()) == [(1, "complete", 1), (2, "complete", 1)]
    assert sorted(r.document_id for r in table.live().collect()) == [10, 20]
    again.enqueue(_jobs(spark, [(1, "ingest", 0, 10), (4, "ingest", 0, 50)]), "batch-1")  # a job that is known stays as it is
    assert again.run(7.0) == 1 and seen[2][1] == [4] and again.run(8.0) == 0


def test_transient_failures_wait_and_die(spark, tmp_path):
    def flaky(jobs, _):
        return jobs.select("job_id", F.when(F.col("job_id") == 1, "transient").otherwise("permanent").alias("outcome"), F.lit("down").alias("message"))

    queue = Dispatcher(spark, str(tmp_path / "queue"), {"call": flaky}, most_tries=2)
    assert queue.states() is None and queue.run(0.0) == 0
    queue.enqueue(_jobs(spark, [(1, "call", 1, 0), (2, "call", 0, 0), (3, "what", 0, 0)]))
    assert queue.run(100.0, most=2) == 2
    told = {r.job_id: (r.status, r.attempts, r.run_after, r.message) for r in queue.states().collect()}
    assert told == {1: ("pending", 1, 130.0, "down"), 2: ("dead", 1, 100.0, "down"), 3: ("dead", 1, 100.0, "no handler")}
    assert queue.run(129.0) == 0 and queue.run(130.0) == 1
    assert {r.job_id: (r.status, r.attempts) for r in queue.states().collect()}[1] == ("dead", 2)
