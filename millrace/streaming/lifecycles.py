"""Alarm episodes over many batches: rows in any order within the watermark, open and closed pieces, cuts at midnight.

Readings wait in the state until the watermark has passed them, and an
event-time timeout wakes their group of devices then; so they are taken in order
of time, however files are shuffled. The open episodes of a device, one a signal,
wait beside them. What a batch sends out depends on the watermark alone: a restart, or
other batches, give the same rows.
"""

from __future__ import annotations

import contextlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000_000
PIECES = "user_id long, event_type string, opened timestamp, part int, start timestamp, stop timestamp, reason string, worst double, n long, covered double"
_OUT = "user_id long, event_type string, opened long, part int, start long, stop long, reason string, worst double, n long, covered double"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]
_OPEN = "user_id array<long>, signal array<string>, opened array<long>, start array<long>, part array<int>, worst array<double>, n array<long>, covered array<long>, hit array<long>, missed array<array<long>>"
_WAITING = "of array<long>, at array<long>, event_id array<long>, event_type array<string>, value array<double>"


KEY = ["_none", "_id"]


def known(name: str) -> list[Column]:
    """A whole number as two columns that are never null: rows of a null key would each be a group of their own."""
    return [F.col(name).isNull().alias(KEY[0]), F.coalesce(name, F.lit(0)).alias(KEY[1])]


#: Devices share a state row by a hash of their number, for a call of Python and a row of state cost more than
#: the readings of a device do. The number is part of the checkpoint; devices in a group, and so what a task holds at once, are 1 / GROUPS of all.
GROUPS, GROUP = 2048, "_group"


def grouped(rows: DataFrame) -> DataFrame:
    """rows, which have known() columns, with the group of their device."""
    return rows.withColumn(GROUP, F.pmod(F.xxhash64(*KEY), F.lit(GROUPS)))


def held(state, *shapes: str) -> list[list[tuple]]:
    """The rows of each table that a state holds, a column an array."""
    widths = [len(s.split(", ")) for s in shapes]
    columns = iter(state.get if state.exists else [[]] * sum(widths))
    return [list(zip(*[next(columns) for _ in range(w)])) for w in widths]


def keep(state, *tables: list[tuple] | str) -> None:
    """Holds tables, each with its shape behind it, as held() reads them; a state of no rows is removed."""
    pairs = list(zip(tables[::2], tables[1::2]))
    if any(rows for rows, _ in pairs):
        state.update(tuple(c for rows, shape in pairs for c in ([list(c) for c in zip(*rows)] or [[] for _ in shape.split(", ")])))
    elif state.exists:
        state.remove()


def taken(frames: Iterator[pd.DataFrame], names: list[str], waiting: list[tuple] = ()) -> dict[int | None, list[tuple]]:
    """Readings by device: those that waited (device, names), then those of the frames; of these there are none when a timeout woke the group."""
    out = defaultdict(list)
    for user, *rest in waiting:
        out[user].append(tuple(rest))
    for frame in frames:
        for none, user, *rest in zip(*[frame[c].tolist() for c in [*KEY, *names]]):
            out[None if none else user].append(tuple(rest))
    return out


def wake_at(state, at: int) -> None:
    """A group is woken when the watermark has passed `at` (microseconds), which it has not yet."""
    state.setTimeoutTimestamp(max(1, at // 1000))


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession, idle_batches: bool = True):
    """State in RocksDB, outside the heap, for queries started inside; the session's own settings come back.

    idle_batches: a batch without rows runs when the watermark has moved, which timeouts need.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower()}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@dataclass(frozen=True)
class EpisodeRules:
    """An episode opens with a reading at `level` or above and is cut at each midnight (UTC).

    It closes as of the first of `clear_after` readings in a row below the
    level ('cleared'), or as of its last reading when the signal says nothing
    for more than `silent` seconds ('silent'). Time between two readings is
    covered if they are `pause` seconds apart at most. Null and NaN are not readings.
    """

    level: float
    clear_after: int
    silent: float
    pause: float


class Episode:
    """An open episode, times in microseconds; what it returns are pieces that are complete."""

    def __init__(self, rules: EpisodeRules, opened: int, start: int, part: int, worst: float | None, n: int, covered: int, hit: int, missed: list[int]) -> None:
        self.rules, self.opened, self.start, self.part = rules, opened, start, part
        self.worst, self.n, self.covered, self.hit, self.missed = worst, n, covered, hit, list(missed)

    @classmethod
    def begun(cls, rules: EpisodeRules, at: int, value: float) -> Episode:
        return cls(rules, at, at, 1, value, 1, 0, at, [])

    def state(self) -> tuple:
        return (self.opened, self.start, self.part, self.worst, self.n, self.covered, self.hit, self.missed)

    @property
    def last(self) -> int:
        """When the signal was last heard of."""
        return self.missed[-1] if self.missed else self.hit

    def _piece(self, stop: int, reason: str) -> tuple:
        return (self.opened, self.part, self.start, stop, reason, self.worst, self.n, self.covered / 1e6)

    def _advance(self, a: int, b: int, hit: bool) -> list[tuple]:
        """Goes on from a reading to the next, which are covered if near, with a cut at each midnight between; a hit at midnight is the new day's."""
        near, out = b - a <= self.rules.pause * 1e6, []
        while (midnight := (self.start // DAY + 1) * DAY) < b or hit and midnight == b:
            self.covered += max(0, midnight - max(a, self.start)) if near else 0
            out.append(self._piece(midnight, "day"))
            self.start, self.part, self.worst, self.n, self.covered = midnight, self.part + 1, None, 0, 0
        self.covered += b - max(a, self.start) if near else 0
        return out

    def take(self, at: int, value: float) -> tuple[list[tuple], bool]:
        """A reading: pieces, and whether the episode is over."""
        if value < self.rules.level:
            self.missed.append(at)
            return (self.close("cleared"), True) if len(self.missed) >= self.rules.clear_after else ([], False)
        times, out = [self.hit, *self.missed, at], []
        for a, b in zip(times, times[1:]):
            out += self._advance(a, b, b is times[-1])
        self.worst, self.n, self.hit, self.missed = value if self.worst is None else max(self.worst, value), self.n + 1, at, []
        return out, False

    def close(self, reason: str) -> list[tuple]:
        """As of the first reading that missed, or of the last one if none did."""
        stop = self.missed[0] if self.missed else self.hit
        out = self._advance(self.hit, stop, False)
        return [*out, self._piece(stop, reason)]


def _episodes(rules: EpisodeRules):
    """The devices of a group."""
    silent = int(rules.silent * 1e6)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        opened, waiting = held(state, _OPEN, _WAITING)
        now = state.getCurrentWatermarkMs() * 1000
        known = defaultdict(dict)
        for user, signal, *rest in opened:
            known[user][signal] = Episode(rules, *rest)
        rows = taken(frames, ["at", "event_id", "event_type", "value"], waiting)
        out, later = [], []
        for user in known.keys() | rows.keys():
            episodes, mine = known[user], sorted(r for r in rows.get(user, ()) if r[3] == r[3])  # null is NaN here
            due = [r for r in mine if r[0] < now]
            for at, _, signal, value in due:
                episode = episodes.get(signal)
                if episode and at - episode.last > silent:
                    out += [(user, signal, *p) for p in episodes.pop(signal).close("silent")]
                    episode = None
                if episode:
                    pieces, over = episode.take(at, value)
                    out += [(user, signal, *p) for p in pieces]
                    if over:
                        del episodes[signal]
                elif value >= rules.level:
                    episodes[signal] = Episode.begun(rules, at, value)
            for signal in [s for s, e in episodes.items() if e.last + silent < now]:
                out += [(user, signal, *p) for p in episodes.pop(signal).close("silent")]
            later += [(user, *r) for r in mine[len(due) :]]
        still = [(user, signal, e) for user, episodes in known.items() for signal, e in episodes.items()]
        keep(state, [(user, signal, *e.state()) for user, signal, e in still], _OPEN, later, _WAITING)
        times = [r[1] for r in later] + [e.last + silent for _, _, e in still]
        if times:
            wake_at(state, min(times))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    return run


def episode_pieces(stream: DataFrame, rules: EpisodeRules, late: str = "2 days") -> DataFrame:
    """Pieces (PIECES) of the episodes of each signal of a device, sent out as the watermark, `late` behind the newest reading, passes what completes them.

    Start the query within rocksdb_state(), in append mode. Readings without a time, or
    later than the watermark, are left out; all others may come in any order.
    """
    rows = stream.where("ts is not null").withWatermark("ts", late).select(*known("user_id"), "ts", F.unix_micros("ts").alias("at"), F.coalesce("event_id", F.lit(0)).alias("event_id"), "event_type", F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")).alias("value"))
    out = grouped(rows).groupBy(GROUP).applyInPandasWithState(_episodes(rules), _OUT, f"{_OPEN}, {_WAITING}", "append", "EventTimeTimeout")
    return out.select(*[F.timestamp_micros(c).alias(c) if c in ("opened", "start", "stop") else F.col(c) for c in _COLUMNS])
