"""The band tracker against a plain fold."""

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import bands

T0 = datetime(2024, 1, 1)


def fold(values, tracker):
    """(band, named, confirmed, index where the confirmed band began) after each value, by the rules as told."""
    now = candidate = first = None
    k, out = 0, []
    for i, x in enumerate(values):
        confirmed, start = False, None
        if x is not None and x == x:
            z = sum(x >= e for e in tracker.edges)
            if now is None:
                now, confirmed, start = z, True, i
            elif z == now or z < now and x >= tracker.edges[now - 1] - tracker.margin:
                candidate, k = None, 0
            else:
                first, k = (first, k + 1) if z == candidate else (i, 1)
                candidate = z
                if k >= tracker.n:
                    now, candidate, k, confirmed, start = z, None, 0, True, first
        out.append((now, k, confirmed, start))
    return out


def test_ten_thousand_series_by_fold():
    rng = random.Random(4)
    for i in range(10_000):
        edges = tuple(sorted(rng.sample(range(1, 30), rng.randrange(1, 5))))
        tracker = bands.BandTracker(edges, rng.choice([0, 1, 4, 40]), rng.randrange(1, 5))
        values = [rng.choice([None, float("nan"), *range(0, 30)]) for _ in range(rng.randrange(1, 40))]
        maps = tracker.of(pa.array(values, pa.float64()))
        upto = bands._composed(maps, np.zeros(len(maps), int))
        got = [tracker.states[s] for s in upto[:, 0]]
        assert [(None if b < 0 else b, k) for b, _, k in got] == [r[:2] for r in fold(values, tracker)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out, at = [], {}
    for i in range(3000):
        key = rng.choice(["hot"] * 8 + ["a", "b", None])
        at[key] = at.get(key, T0) + timedelta(minutes=rng.choice([0, 5, 30, 400]))
        out.append((i, key, at[key], rng.choice([None, float("nan"), *map(float, range(0, 100, 3))])))
    return out


@pytest.mark.parametrize("bucket", [None, "day"])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_bands_and_segments(spark, rows, bucket, n):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v double").withColumn("day", F.date_trunc("day", "ts"))
        tracker = bands.BandTracker((25.0, 50.0, 75.0), 5.0, n)
        got = {r.id: (r.band, r.named, r.confirmed) for r in bands.track_bands(df, ["k"], ["ts", "id"], bucket, "v", tracker).collect()}
        segments = {(r.k, r.start, r.band, r.stop) for r in bands.band_segments(df, ["k"], "ts", ["ts", "id"], bucket, "v", tracker).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want_segments = set()
    for key in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        want = fold([r[3] for r in mine], tracker)
        assert [got[r[0]] for r in mine] == [w[:3] for w in want]
        starts = [(mine[w[3]][2], w[0]) for w in want if w[2]]
        want_segments |= {(key, t, b, stop) for (t, b), stop in zip(starts, [*[t for t, _ in starts[1:]], None])}
    assert segments == want_segments


def test_a_hot_series_is_spread(spark, rows):
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v double").withColumn("day", F.date_trunc("day", "ts"))
    told = bands.track_bands(df, ["k"], ["ts", "id"], "day", "v", bands.BandTracker((50.0,), 0.0, 2))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would become one partition
    try:
        parts = told.select(F.spark_partition_id().alias("p"), "k").where("k = 'hot'").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1
    assert bands.track_bands(df.limit(0), ["k"], ["ts", "id"], "day", "v", bands.BandTracker((50.0,))).count() == 0


@pytest.mark.parametrize("edges, margin, n", [((), 0, 1), ((2.0, 1.0), 0, 1), ((1.0,), -1, 1), ((1.0,), 0, 0)])
def test_trackers_that_make_no_sense(edges, margin, n):
    with pytest.raises(ValueError):
        bands.BandTracker(edges, margin, n)
