"""The status of each device as a stream: stabilised before it is reported, stale when the device says nothing.

Two clocks drive the same rules. With processing time a device is late when
nothing has come for so long by the wall clock. With event time the watermark
is the clock, so that a replay, whatever its batches, gives the same rows; they
equal those of operators.status.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.streaming.lifecycles import GROUP, KEY, grouped, known, wake_at

_OUT = "user_id long, at long, status string"
_DEVICES = "user_id array<long>, reported array<string>, candidate array<string>, since array<long>, heard array<long>"
#: Readings that wait are numbers alone and stand in the state as one value: elements of arrays are turned one by one, each time a group is woken.
_WAITING = "waiting binary"
_READING = np.dtype([(KEY[0], "?"), (KEY[1], "<i8"), ("at", "<i8"), ("event_id", "<i8"), ("value", "<f8")])


@dataclass(frozen=True)
class StatusRules:
    """'high' at `level` or above, else 'normal', reported when it has stood for `hold` seconds; 'stale' after `stale_after` seconds of silence."""

    level: float
    hold: float
    stale_after: float


class Status:
    """What is known of a device, times in microseconds; both methods return what is to be reported, as (at, status)."""

    def __init__(self, rules: StatusRules, reported: str | None = None, candidate: str | None = None, since: int | None = None, heard: int | None = None) -> None:
        self.rules, self.reported, self.candidate, self.since, self.heard = rules, reported, candidate, since, heard

    def due(self) -> tuple[int, str] | None:
        """The next change that comes without another reading; a status that has stood goes before silence."""
        if self.heard is None:
            return None
        stale = (self.heard + int(self.rules.stale_after * 1e6), "stale")
        if self.candidate is None or self.candidate == self.reported:
            return stale
        stood = (self.since + int(self.rules.hold * 1e6), self.candidate)
        return stood if stood[0] <= stale[0] else stale

    def advance(self, now: int) -> list[tuple[int, str]]:
        """The clock has come to now, and nothing was heard since."""
        out = []
        while (nxt := self.due()) and nxt[0] <= now:
            if nxt[1] != self.reported:  # silence after readings that named nothing is told already
                out.append(nxt)
            self.reported = nxt[1]
            if nxt[1] == "stale":
                self.candidate = self.since = self.heard = None
        return out

    def take(self, at: int, value: float | None) -> list[tuple[int, str]]:
        """A reading; null and NaN only say that the device lives."""
        out = self.advance(at)
        self.heard = at
        if value is not None and value == value:
            named = "high" if value >= self.rules.level else "normal"
            if named != self.candidate:
                self.candidate, self.since = named, at
        return out


def _readings(frame: pd.DataFrame) -> np.ndarray:
    """A frame's rows as _READING; a null value is NaN."""
    out = np.empty(len(frame), _READING)
    for name in _READING.names:
        out[name] = frame[name].to_numpy()
    return out


def _watch(rules: StatusRules, on_arrival: bool):
    """The devices of a group; on_arrival: rows count when they arrive by the wall clock, else when the watermark has passed them."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        *devices, waiting = state.get if state.exists else ([], [], [], [], [], b"")
        known = {user: Status(rules, *rest) for user, *rest in zip(*devices)}
        rows = np.concatenate([np.frombuffer(waiting, _READING), *map(_readings, frames)])
        now = (state.getCurrentProcessingTimeMs() if on_arrival else state.getCurrentWatermarkMs()) * 1000
        is_due = np.full(len(rows), True) if on_arrival else rows["at"] < now
        due, rest = rows[is_due], rows[~is_due]
        out = []
        for none, user, at, _, value in due[np.lexsort((due["event_id"], due["at"], due[KEY[1]], due[KEY[0]]))].tolist():
            user = None if none else user
            if (status := known.get(user)) is None:
                status = known[user] = Status(rules)
            out += [(user, *c) for c in status.take(now if on_arrival else at, value)]
        for user, status in known.items():
            out += [(user, *c) for c in status.advance(now if on_arrival else now - 1)]
        if known or len(rest):
            columns = zip(*[(user, s.reported, s.candidate, s.since, s.heard) for user, s in known.items()])
            state.update((*([list(c) for c in columns] or [[] for _ in devices]), rest.tobytes()))
        elif state.exists:
            state.remove()
        # the next change, or the first of the waiting rows, wakes the group
        times = ([int(rest["at"].min())] if len(rest) else []) + [d[0] for s in known.values() if (d := s.due())]
        if times and on_arrival:
            state.setTimeoutDuration(max(1, (min(times) - now) // 1000 + 1))
        elif times:
            wake_at(state, min(times))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "at", "status"])

    return run


def device_status(stream: DataFrame, rules: StatusRules, late: str | None = None) -> DataFrame:
    """user_id, at, status of each change, of readings (event_id, ts, user_id, value).

    late: readings come in any order within it and the watermark is the clock;
    later ones are left out. None: the wall clock counts, and readings of a batch come at its time.
    Start the query within lifecycles.rocksdb_state(), in append mode. Readings without a time are left out.
    """
    rows = stream.where("ts is not null")
    rows = rows if late is None else rows.withWatermark("ts", late)
    rows = rows.select(*known("user_id"), "ts", F.unix_micros("ts").alias("at"), F.coalesce("event_id", F.lit(0)).alias("event_id"), F.col("value").cast("double").alias("value"))
    clock = "ProcessingTimeTimeout" if late is None else "EventTimeTimeout"
    out = grouped(rows).groupBy(GROUP).applyInPandasWithState(_watch(rules, late is None), _OUT, f"{_DEVICES}, {_WAITING}", "append", clock)
    return out.select("user_id", F.timestamp_micros("at").alias("at"), "status")
