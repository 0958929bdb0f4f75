"""Sessions and rate windows that end: several state variables a key, timers, and events that delete state.

A key's state has a part that lives until a time of its own (a session until it
expires, a rate window until it rolls over) and a part that stays.  Keys are dealt to
groups; a group's timer after the first of these times clears the living parts that are
over, so that a stream holds state of current keys only; an event may clear one
before.  Verdicts do not depend on when timers fire: a part past its time counts as absent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: (living part or None, lasting part, time, event) -> (living part or None, its end, lasting part, verdict)
Turn = Callable[[tuple | None, tuple | None, float, Any], tuple[tuple | None, float, tuple | None, tuple]]


class _Keyed(StatefulProcessor):
    """Takes a group of keys at a time; its maps hold a key's parts of state by the key."""

    def __init__(self, columns: tuple[str, str, str, str], turn: Turn, names: list[str], living: str, lasting: str | None, sweep: float):
        self.columns, self.turn, self.names, self.living, self.lasting, self.sweep = columns, turn, names, living, lasting, int(sweep * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getMapState("live", "key long", f"ends double, {self.living}")
        self.stays = handle.getMapState("stays", "key long", self.lasting) if self.lasting else None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        name, time, event_id, _ = self.columns
        frame = pd.concat(list(rows), ignore_index=True).sort_values([name, time, event_id])
        verdicts, lasts = [], []
        for one, events in groupby(zip(*(frame[c].tolist() for c in self.columns), strict=True), itemgetter(0)):
            held = self.live.getValue((one,))
            ends, now = (held[0], tuple(held[1:])) if held else (0.0, None)
            stayed = self.stays.getValue((one,)) if self.stays is not None else None
            stays = stayed = tuple(stayed) if stayed else None
            for _, at, number, what in events:
                now, ends, stays, verdict = self.turn(now if ends > at else None, stays, float(at), what)
                verdicts.append((one, number, *verdict))
            if now is not None:
                lasts.append(ends)
                self.live.updateValue((one,), (ends, *now))
            elif held:
                self.live.removeKey((one,))
            if self.stays is not None and stays is not None and stays != stayed:
                self.stays.updateValue((one,), stays)
        self._wake(lasts, timerValues)
        yield pd.DataFrame(verdicts, columns=[name, event_id, *self.names], dtype=object)  # plain strings, which Arrow takes as one array

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = [(one, value[0]) for one, value in self.live.iterator()]
        over = timerValues.getCurrentWatermarkInMs()
        for one, ends in held:
            if _millis(ends) <= over:
                self.live.removeKey(one)
        self._wake([ends for _, ends in held if _millis(ends) > over], timerValues)
        return iter(())

    def _wake(self, ends: list[float], timerValues: Any) -> None:
        """A timer of the group at the first of ``ends``, in whole steps of ``sweep``, unless one comes before."""
        if ends:
            first = -(-_millis(min(ends)) // self.sweep) * self.sweep
            if not [t for t in self.handle.listTimers() if timerValues.getCurrentWatermarkInMs() < t <= first]:
                self.handle.registerTimer(first)

    def close(self) -> None:
        pass


def _millis(seconds: float) -> int:
    return int(seconds * 1000) + 1


def keyed(
    events: DataFrame, key: str, time: str, event_id: str, event: str, turn: Turn, out: str, living: str, lasting: str | None = None, late: float = 86400.0, groups: int = 1024, sweep: float = 3600.0
) -> DataFrame:
    """key, event_id and the verdict columns ``out`` of every event of a stream.

    ``events`` has key (long), time (seconds since 1970, double), event_id (long) and
    ``event``; a null in any of them but the event is left out.  ``living`` and
    ``lasting`` are the schemas of a key's two parts of state.  Rows of a key are taken
    in the order of time and id within a micro-batch, and by batch across them; events
    more than ``late`` seconds behind the latest are left out.  Keys are dealt to
    ``groups``, of which a call takes one, as a call costs more than a key's events;
    the number must stay the same as long as a stream's checkpoint is used.  State that
    has ended is cleared at most ``sweep`` seconds later.  Needs the state store that
    ``run.replay`` sets.
    """
    sound = events.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(event_id).isNotNull())
    timed = sound.withColumn("_at", F.timestamp_micros((F.col(time) * 1_000_000).cast("long"))).withWatermark("_at", f"{late} seconds")
    processor = _Keyed((key, time, event_id, event), turn, [c.split()[0] for c in out.split(", ")], living, lasting, sweep)
    grouped = timed.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups))).groupBy("_group")
    return grouped.transformWithStateInPandas(processor, f"{key} long, {event_id} long, {out}", "append", "EventTime")


def sliding_session(ttl: float) -> Turn:
    """Sessions of ``ttl`` seconds; one in use is extended only once less than half of that is left.

    ``event`` says whether the user signs out, which deletes the session.  Living part:
    nothing but its end (began is kept for readers); lasting part: sessions opened so
    far.  Verdict: opened, extended, used, signed_out or none (signing out without a
    session), when the session expires (null without one), sessions opened so far.
    """

    def turn(live: tuple | None, stays: tuple | None, at: float, out: Any) -> tuple:
        opened = stays[0] if stays else 0
        if out:
            return None, 0.0, (opened,), ("signed_out" if live else "none", None, opened)
        if live is None:
            return (at, at + ttl), at + ttl, (opened + 1,), ("opened", at + ttl, opened + 1)
        began, expires = live
        if expires - at < ttl / 2:
            return (began, at + ttl), at + ttl, (opened,), ("extended", at + ttl, opened)
        return live, expires, (opened,), ("used", expires, opened)

    return turn


def forgettable_window(limit: int, seconds: float) -> Turn:
    """At most ``limit`` hits in a window that begins at a key's first hit and lasts ``seconds``; refused hits count.

    ``event`` says whether the key is to be forgotten, as after a success: its window is
    deleted and the event is no hit.  Verdict: allowed (null where forgotten), remaining.
    """

    def turn(live: tuple | None, _: tuple | None, at: float, forget: Any) -> tuple:
        if forget:
            return None, 0.0, None, (None, limit)
        began, hits = live or (at, 0)
        return (began, hits + 1), began + seconds, None, (hits < limit, max(0, limit - hits - 1))

    return turn
