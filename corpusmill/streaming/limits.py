"""Rate limits, circuits and throttles as keyed state over a stream.

Each is a small state machine per key: a pure step function (state, time) ->
(state, verdict), driven by Spark's arbitrary state.  Times come from the events,
so a replay gives the same verdicts; rows of a key are taken in time order within
a micro-batch, and by batch across them.  Where state means nothing after some time
without events, ``idle`` says so and Spark drops it once the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

Step = Callable[[tuple | None, float, Any], tuple[tuple, tuple]]


def keyed(events: DataFrame, key: str, time: str, event_id: str, extra: str, step: Step, out: str, state: str, idle: float | None = None, late: float = 2 * 86400.0) -> DataFrame:
    """key, event_id and the verdict columns ``out`` of every event; ``state`` is the schema of a key's state.

    ``events`` has key (long), time (seconds, double), event_id (long) and ``extra``.
    With ``idle``, a key's state is dropped when that many seconds have passed since
    its last event, by a watermark ``late`` seconds behind the latest one; events that
    come later than that, or lie before 1970, are left out.  Verdicts stay the same where the step treats
    state of that age like none.  Without ``idle`` state is kept as long as the stream.
    """
    if idle is not None:
        events = events.withColumn("_at", F.timestamp_micros((F.col(time) * 1_000_000).cast("long"))).withWatermark("_at", f"{late} seconds")

    def run(group: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now = held.get if held.exists else None
        rows = pd.concat(list(frames), ignore_index=True).sort_values([time, event_id], kind="stable")
        verdicts = []
        for at, number, more in zip(rows[time], rows[event_id], rows[extra], strict=True):
            now, verdict = step(now, float(at), more)
            verdicts.append((group[0], number, *verdict))
        if now is not None:
            held.update(now)
            if idle is not None:
                ends = int((float(rows[time].iloc[-1]) + idle) * 1000) + 1
                held.setTimeoutTimestamp(max(ends, held.getCurrentWatermarkMs() + 1))
        names = [key, event_id, *[c.split()[0] for c in out.split(", ")]]
        yield pd.DataFrame(verdicts, columns=names)

    return events.groupBy(key).applyInPandasWithState(run, f"{key} long, {event_id} long, {out}", state, "append", "NoTimeout" if idle is None else "EventTimeTimeout")


def fixed_window(limit: int, seconds: float, count_denied: bool = True) -> Step:
    """A window begins at a key's first hit and ends after ``seconds``; at most ``limit`` hits pass.

    With ``count_denied`` refused hits count too.  Verdict: allowed, remaining, reset (seconds left).
    """

    def step(state: tuple | None, at: float, _: Any) -> tuple[tuple, tuple]:
        began, hits = state if state is not None and at - state[0] < seconds else (at, 0)
        allowed = hits < limit
        hits += allowed or count_denied
        return (began, hits), (allowed, max(0, limit - hits), began + seconds - at)

    return step


def sliding_window(limit: int, seconds: float) -> Step:
    """At most ``limit`` hits in the last ``seconds``; refused hits do not count.  Verdict: allowed, hits."""

    def step(state: tuple | None, at: float, _: Any) -> tuple[tuple, tuple]:
        recent = [x for x in (state[0] if state else []) if at - x < seconds]
        allowed = len(recent) < limit
        recent += [at] * allowed
        return (recent,), (allowed, len(recent))

    return step


def circuit(failures: int = 5, within: float = 60.0, cooldown: float = 30.0) -> Step:
    """Opens after ``failures`` failures within ``within`` seconds; after ``cooldown`` one try is let through.

    ``extra`` says whether the call fails.  Verdict: state before the call (closed,
    half_open or open) and whether the call was made.
    """

    def step(state: tuple | None, at: float, failed: Any) -> tuple[tuple, tuple]:
        recent, opened = (list(state[0]), state[1]) if state else ([], -1.0)
        phase = "closed" if opened < 0 else "half_open" if at - opened >= cooldown else "open"
        if phase == "open":
            return (recent, opened), (phase, False)
        if not failed:
            return ([], -1.0), (phase, True)
        recent = [x for x in recent if at - x < within] + [at]
        if phase == "half_open" or len(recent) >= failures:
            opened = at
        return (recent, opened), (phase, True)

    return step


def throttle(seconds: float) -> Step:
    """Lets through one event in ``seconds``.  Verdict: touched."""

    def step(state: tuple | None, at: float, _: Any) -> tuple[tuple, tuple]:
        touched = state is None or at - state[0] >= seconds
        return (at if touched else state[0],), (touched,)

    return step


def cached(ttl: float) -> Step:
    """A record kept for ``ttl`` seconds after it was loaded.  Verdict: hit."""

    def step(state: tuple | None, at: float, _: Any) -> tuple[tuple, tuple]:
        hit = state is not None and at - state[0] < ttl
        return (state[0] if hit else at,), (hit,)

    return step
