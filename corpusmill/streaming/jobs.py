"""A work queue as a stream of job events: claims, retries with waits, and the reaper."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: waits before the tries, most tries, seconds after which a running job is taken back
WAITS, MOST_TRIES, STALE = (30.0, 120.0, 600.0), 4, 900.0


def lifecycle(most_tries: int = MOST_TRIES, stale: float = STALE):
    """Step of one job: ``extra`` is claim, complete, transient or permanent.

    A transient failure waits and is pending again until its tries are used up; a
    claim comes too early before the wait is over; a running job older than
    ``stale`` was left behind and counts as failed once.  Verdict: status, attempts,
    run_after.
    """

    def step(state: tuple | None, at: float, event: Any) -> tuple[tuple, tuple]:
        status, attempts, ready, locked = state if state is not None else ("pending", 0, 0.0, 0.0)

        def failed(transient: bool) -> tuple:
            if transient and attempts < most_tries:
                return "pending", attempts, at + WAITS[min(attempts, len(WAITS)) - 1], 0.0
            return "dead", attempts, ready, 0.0

        if status == "running" and at - locked > stale:
            status, attempts, ready, locked = failed(True)
        if event == "claim" and status == "pending" and at >= ready:
            status, attempts, locked = "running", attempts + 1, at
        elif event == "complete" and status == "running":
            status = "complete"
        elif event in ("transient", "permanent") and status == "running":
            status, attempts, ready, locked = failed(event == "transient")
        return (status, attempts, ready, locked), (status, attempts, ready)

    return step


def claim(jobs: DataFrame, now: float, most: int | None = None) -> DataFrame:
    """The next ``most`` pending jobs that are due, by priority and time; without ``most``, all of the first priority that is due.

    One claimant per micro-batch needs no locks.
    """
    due = jobs.where((F.col("status") == "pending") & (F.col("run_after") <= now))
    if most is not None:
        return due.orderBy("priority", "run_after", "job_id").limit(most)
    first = due.select("priority").orderBy("priority").first()
    return due.where(F.col("priority").eqNullSafe(F.lit(first["priority"] if first else None)))
