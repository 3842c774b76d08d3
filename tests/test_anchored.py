"""Packet-anchored fill against a walk; exact medians of hot groups against a sort."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import anchored, ranks

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("cell", [None, "day"])
def test_anchored_fill_by_walk(spark, cell):
    rng = random.Random(3)
    when = lambda: T0 + timedelta(minutes=10 * rng.randrange(0, 900))
    key = lambda: rng.choice(["hot", "hot", "hot", "a", None])
    packets = [(key(), when(), i, "x") for i in range(250)]
    samples = [(key(), when(), 1000 + i, rng.choice([None, *range(50)])) for i in range(120)]
    gaps = [(key(), t, rng.choice([t + timedelta(hours=5), t + timedelta(minutes=10), t])) for t in (when() for _ in range(12))] + [("a", T0 + timedelta(days=5), None)]
    frames = [spark.createDataFrame(packets, "k string, ts timestamp_ntz, id long, more string"), spark.createDataFrame(samples, "k string, ts timestamp_ntz, id long, v long"), spark.createDataFrame(gaps, "k string, start timestamp_ntz, stop timestamp_ntz")]
    got = {r.id: (r.more, r.filled, r.carried, r.in_gap) for r in anchored.anchored_fill(*frames, ["k"], "ts", "id", "v", 1800.0, 86400.0, cell).collect()}
    for k, t, i, more in packets:
        mine = [g for g in gaps if g[0] == k and (g[2] is None or g[1] < g[2])]
        in_gap = any(g[1] <= t and (g[2] is None or t < g[2]) for g in mine)
        known = [s for s in samples if s[0] == k and s[3] is not None and s[1] - timedelta(minutes=30) <= t]
        want = (more, None, False, in_gap)
        if known and not in_gap:
            s = max(known, key=lambda s: (s[1], s[2]))
            cut = any(g[1] <= t and (g[2] is None or g[2] > s[1]) for g in mine)
            if not cut and t - s[1] <= timedelta(days=1):
                want = (more, s[3], abs(t - s[1]) > timedelta(minutes=30), in_gap)
        assert got[i] == want, i
    assert len(got) == 250


def test_exact_spread(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 9 + ["b", None]), rng.choice([None, rng.randrange(-5, 5), rng.randrange(-(2**60), 2**60), rng.randrange(10**6)])) for _ in range(1500)] + [("one", -7)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {r.k: (r.n, r.median, r.mad) for r in ranks.exact_spread(spark, df, ["k"], "v").collect()}
    for k in {r[0] for r in rows}:
        mine = sorted(v for x, v in rows if x == k and v is not None)
        twice = mine[(len(mine) - 1) // 2] + mine[len(mine) // 2]
        far = sorted(abs(2 * v - twice) for v in mine)
        four = far[(len(far) - 1) // 2] + far[len(far) // 2]
        assert got[k] == (len(mine), twice / 2, four / 4)
    assert ranks.exact_spread(spark, df.limit(0), ["k"], "v").count() == 0
    assert statistics.median([1, 2]) == 1.5


def test_a_hot_group_is_counted_in_parts(spark):
    df = spark.range(40_000).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 40_009).alias("v"))
    r = ranks.exact_spread(spark, df, ["k"], "v").first()
    values = sorted(i * 7919 % 40_009 for i in range(40_000))
    assert r.n == 40_000 and r.median == statistics.median(values)
