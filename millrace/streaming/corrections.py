"""Segments that late readings correct: what changed since the last batch is sent out, as rows to set or to delete."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.streaming.lifecycles import GROUP, grouped, held, keep, known, taken

CHANGES = "user_id long, start long, last_seen long, on boolean, n long, gone boolean"
_COLUMNS = [c.split()[0] for c in CHANGES.split(", ")]
_READING = ["at", "event_id", "value"]
_SEGMENT = "{0}user_id array<long>, {0}start array<long>, {0}last_seen array<long>, {0}on array<boolean>, {0}n array<long>"
_SETTLED, _SENT = _SEGMENT.format("settled_"), _SEGMENT.format("sent_")
_RECENT = "of array<long>, at array<long>, event_id array<long>, value array<double>"


def fold(segment: tuple | None, rows: list[tuple], low: float, high: float) -> list[tuple]:
    """(start, last_seen, on, n) of each segment of a two-threshold state, from an open one (or none) on through readings in order of time; of those at one moment the last counts."""
    out = [segment] if segment else []
    for (at, _, value), after in zip(rows, [*rows[1:], None]):
        if after and after[0] == at:
            continue
        now = out[-1][2] if out else False
        if value is not None and value == value:
            now = True if value >= high else False if value <= low else now
        if out and out[-1][2] == now:
            start, _, _, n = out[-1]
            out[-1] = (start, at, now, n + 1)
        else:
            out.append((at, at, now, 1))
    return out


def _corrected(low: float, high: float):
    """The devices of a group."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        """Folds the readings of the overlap again from the segment that was open before it, and tells how they differ from what was sent."""
        settled, sent, recent = held(state, _SETTLED, _SENT, _RECENT)
        now = state.getCurrentWatermarkMs() * 1000
        base = {user: tuple(rest) for user, *rest in settled}
        before = defaultdict(dict)
        for user, start, *rest in sent:
            before[user][start] = tuple(rest)
        new = taken(frames, _READING)
        rows = taken((), _READING, [r for r in recent if r[0] in new])
        kept = [r for r in recent if r[0] not in new]
        out = []
        for user, late in new.items():
            mine = sorted([*rows.get(user, ()), *late], key=lambda r: r[:2])
            segments = {s[0]: s[1:] for s in fold(base.get(user), mine, low, high)}
            known = before.pop(user, {})
            out += [(user, start, *rest, False) for start, rest in segments.items() if known.get(start) != rest]
            out += [(user, start, *rest, True) for start, rest in known.items() if start not in segments]

            # what the watermark has passed will not change: it comes down to the segment that is open then
            passed = [r for r in mine if r[0] < now]
            if passed:
                base[user] = fold(base.get(user), passed, low, high)[-1]
            kept += [(user, *r) for r in mine[len(passed) :]]
            floor = base[user][0] if user in base else None
            before[user] = {start: rest for start, rest in segments.items() if floor is None or start >= floor}
        last = [(user, start, *rest) for user, segments in before.items() for start, rest in segments.items()]
        keep(state, [(user, *rest) for user, rest in base.items()], _SETTLED, last, _SENT, kept, _RECENT)
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    return run


def corrected_segments(stream: DataFrame, low: float, high: float, late: str = "2 days") -> DataFrame:
    """user_id, start, last_seen, on, n, gone: changes to the segments of a two-threshold state, batch by batch.

    Readings may be up to `late` behind the newest one of earlier batches; the
    segments of that overlap are made anew with them, those before it are not
    touched. State is the readings of the overlap and the segments sent out
    for it. Start the query within lifecycles.rocksdb_state(), in update mode.
    """
    rows = stream.where("ts is not null").withWatermark("ts", late).select(*known("user_id"), "ts", F.unix_micros("ts").alias("at"), F.coalesce("event_id", F.lit(0)).alias("event_id"), F.col("value").cast("double").alias("value"))
    out = grouped(rows).groupBy(GROUP).applyInPandasWithState(_corrected(low, high), CHANGES, f"{_SETTLED}, {_SENT}, {_RECENT}", "update", "EventTimeTimeout")
    return out.select(*[F.timestamp_micros(c).cast("timestamp_ntz").alias(c) if c in ("start", "last_seen") else F.col(c) for c in _COLUMNS])
