"""Which band a reading lies in, with a margin below each band and n readings in a row to confirm a new one.

The tracker is a finite automaton. Its states are: no reading yet; a band; a band
with a candidate for the next one and how many readings in a row have named it.
So what a reading does is a map from states to states, of which there are few, and
what a stretch of readings does is the maps' composition, which is associative:

1. within each (series, time bucket) the maps are composed by a scan, in Arrow
   batches and a logarithmic number of numpy steps each;
2. over the buckets of a series, one map a bucket, the same scan gives the state
   that each bucket starts from;
3. each bucket is scanned again from that state.

No task needs a whole series, and no Python code runs by reading.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.running import beside, following, last_known, previous


@dataclass(frozen=True)
class BandTracker:
    """Bands between rising edges: band i holds edges[i - 1] <= value < edges[i].

    A band is left by a reading at or above its upper edge, or more than margin
    below its lower edge. Such a reading names the band it lies in as candidate;
    n in a row that name the same one confirm it. A reading that stays in the
    current band, or names another candidate, ends the row. Null and NaN say
    nothing. The first reading's band is confirmed at once.
    """

    edges: tuple[float, ...]
    margin: float = 0.0
    n: int = 1

    def __post_init__(self) -> None:
        if list(self.edges) != sorted(set(self.edges)) or not self.edges or self.margin < 0 or self.n < 1:
            raise ValueError("edges must rise, margin be 0 or more, n at least 1")

    @property
    def bands(self) -> int:
        return len(self.edges) + 1

    @cached_property
    def states(self) -> list[tuple[int, int, int]]:
        """(band, candidate, times named); the first is 'no reading yet'."""
        named = [(b, c, k) for b in range(self.bands) for c in range(self.bands) if c != b for k in range(1, self.n)]
        return [(-1, -1, 0), *[(b, -1, 0) for b in range(self.bands)], *named]

    @cached_property
    def steps(self) -> np.ndarray:
        """Values between which all readings do the same."""
        return np.unique([*self.edges, *[e - self.margin for e in self.edges]])

    @cached_property
    def maps(self) -> np.ndarray:
        """maps[i][s]: the state after s and a reading that has i of the steps at or below it; the last row is for no reading."""
        number = {s: i for i, s in enumerate(self.states)}
        out = np.empty((len(self.steps) + 2, len(self.states)), np.uint16)
        out[-1] = np.arange(len(self.states))
        for i, at in enumerate([-np.inf, *self.steps]):
            band = int(np.searchsorted(self.edges, at, "right"))
            for s, (now, candidate, k) in enumerate(self.states):
                if now < 0:
                    after = (band, -1, 0)
                elif band == now or band < now and at >= self.edges[now - 1] - self.margin:
                    after = (now, -1, 0)
                else:
                    k = k + 1 if candidate == band else 1
                    after = (band, -1, 0) if k >= self.n else (now, band, k)
                out[i, s] = number[after]
        return out

    def of(self, values: pa.Array) -> np.ndarray:
        """The map of each reading."""
        x = values.to_numpy(zero_copy_only=False).astype(float)
        return self.maps[np.where(np.isnan(x), len(self.maps) - 1, np.searchsorted(self.steps, x, "right"))]


def _changes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """True where a row differs from the one before in the columns named (nulls are alike); the first is True."""
    out = np.zeros(batch.num_rows, bool)
    out[:1] = True
    for name in names:
        column = pc.dictionary_encode(batch.column(name), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= column[1:] != column[:-1]
    return out


def _composed(maps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The maps from the beginning of each row's group up to and with it (starts: where that group begins)."""
    at, width = np.arange(len(maps)), 1
    while True:
        rows = at[at - width >= starts]
        if not len(rows):
            return maps
        maps, before = maps.copy(), maps
        maps[rows] = np.take_along_axis(before[rows], before[rows - width], axis=1)
        width *= 2


def _scan(batches, groups: list[str], to_maps, emit):
    """Composes maps over batches sorted by group; emit(batch, upto, first, before) makes a batch of each, before being the maps up to the row before."""
    carried, last = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = _changes(batch, groups)
        here = pa.RecordBatch.from_arrays([batch.column(g)[:1] for g in groups], groups)
        if last is not None and here.equals(last):
            change[0] = False
        maps = to_maps(batch)
        identity = np.arange(maps.shape[1], dtype=np.uint16)
        starts = np.maximum.accumulate(np.where(change, np.arange(len(maps)), 0))
        upto = _composed(maps, starts)
        if carried is not None and not change[0]:
            rows = starts == 0
            upto[rows] = np.take_along_axis(upto[rows], np.broadcast_to(carried, upto[rows].shape), axis=1)
        before = np.concatenate([(identity if carried is None else carried)[None], upto[:-1]])
        before[change] = identity
        yield from emit(batch, upto, change, before)
        carried = upto[-1]
        last = pa.RecordBatch.from_arrays([batch.column(g)[-1:] for g in groups], groups)


def track_bands(df: DataFrame, keys: list[str], order: list[str], bucket: str | None, value: str, tracker: BandTracker) -> DataFrame:
    """df with band (confirmed after the reading; null before the first), named (how often in a row it and those before have named a candidate) and confirmed (whether it confirms a band).

    bucket, a column that rises with order, spreads a hot series; without one a
    series is sorted in one task, though held there batch by batch only. Order
    must tell the rows of a series apart; keys may be null.
    """
    groups = [*keys, *([bucket] if bucket else [])]
    columns = list(dict.fromkeys([*groups, *order, value]))
    states = np.array(tracker.states)
    shape = lambda cols: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*cols).schema)

    def summed(batches):
        """One map a group, sent out when the next group begins."""
        held = None

        def emit(batch, upto, change, before):
            nonlocal held
            ends = np.flatnonzero(change) - 1
            out = batch.select(groups).take(pa.array(ends[ends >= 0]))
            maps = [m.tobytes() for m in upto[ends[ends >= 0]]]
            if change[0] and held is not None:
                yield held
            if len(out):
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(maps, pa.binary())], [*groups, "_map"])
            held = pa.RecordBatch.from_arrays([*batch.select(groups).slice(batch.num_rows - 1).columns, pa.array([upto[-1].tobytes()], pa.binary())], [*groups, "_map"])

        yield from _scan(batches, groups, lambda b: tracker.of(b.column(value)), emit)
        if held is not None:
            yield held

    def entered(batches):
        """The state that each bucket starts from."""

        def emit(batch, upto, change, before):
            yield pa.RecordBatch.from_arrays([*batch.select(groups).columns, pa.array(before[:, 0].astype(np.int32))], [*groups, "_from"])

        read = lambda b: np.frombuffer(b"".join(b.column("_map").to_pylist()), np.uint16).reshape(b.num_rows, -1)
        yield from _scan(batches, keys, read, emit)

    def told(batches):
        def emit(batch, upto, change, before):
            began = batch.column("_from").to_numpy() if bucket else np.zeros(batch.num_rows, np.int32)
            at = np.arange(batch.num_rows)
            now, was = states[upto[at, began]], states[before[at, began]]
            band = pa.array(np.where(now[:, 0] < 0, 0, now[:, 0]).astype(np.int32), mask=now[:, 0] < 0)
            kept = batch.select(columns)
            yield pa.RecordBatch.from_arrays([*kept.columns, band, pa.array(now[:, 2].astype(np.int32)), pa.array(now[:, 0] != was[:, 0])], [*columns, "band", "named", "confirmed"])

        yield from _scan(batches, groups, lambda b: tracker.of(b.column(value)), emit)

    # grouped, so that a hot bucket of one series does not pull its neighbours along
    rows = df.select(*columns).repartition(*groups)
    if bucket:
        maps = rows.sortWithinPartitions(*groups, *order).mapInArrow(summed, f"{shape(groups)}, _map binary")
        froms = maps.repartition(*keys).sortWithinPartitions(*groups).mapInArrow(entered, f"{shape(groups)}, _from int")
        rows = beside(rows, froms, groups, "inner")
    return rows.sortWithinPartitions(*groups, *order).mapInArrow(told, f"{shape(columns)}, band int, named int, confirmed boolean")


def band_segments(df: DataFrame, keys: list[str], time: str, order: list[str], bucket: str | None, value: str, tracker: BandTracker) -> DataFrame:
    """Segments of confirmed bands: keys, band, start, stop (null for the last).

    A boundary lies at the first of the readings that confirm the new band, not
    at the one that completes them; the first segment starts at the first reading.
    """
    told = track_bands(df, keys, order, bucket, value, tracker)
    says = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    marked = last_known(told, keys, bucket, order, F.when(says & (F.col("named") == 1), F.col(time)), "_first")
    bounds = previous(marked.where("confirmed"), keys, None, order, F.col("band"), "_was")
    start = F.when(F.col("_was").isNull() | F.lit(tracker.n == 1), F.col(time)).otherwise(F.col("_first"))
    bounds = bounds.select(*keys, *order, "band", start.alias("start"))
    return following(bounds, keys, None, order, F.col("start"), "stop").select(*keys, "band", "start", "stop")
