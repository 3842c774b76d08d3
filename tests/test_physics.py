"""Formulas on values known by hand, and step responses against a loop."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import power, thermal
from millrace.operators import transients

T0 = datetime(2024, 1, 1)


def test_power(spark):
    df = spark.createDataFrame([(80.0, 60.0, 1500.0), (0.0, 0.0, 1800.0), (-3.0, 4.0, None)], "p double, q double, rpm double")
    bands = [{"name": "a", "low": 0, "high": 50}, {"name": "b", "low": 50, "high": 80}]
    got = df.select(power.apparent_power(F.col("p"), F.col("q")), power.power_factor(F.col("p"), F.col("q")), power.synchronous_frequency(F.col("rpm"), 4), power.deviation_percent(F.col("p"), F.col("q")), power.band_of(F.col("q"), bands)).collect()
    assert [tuple(r) for r in got] == [(100, 0.8, 50, pytest.approx(100 / 3), "b"), (0, None, 60, None, "a"), (5, -0.6, None, -175, "a")]


def test_cooling(spark):
    y = [20 + 50 * math.exp(-t / 600) for t in (0, 300, 600)]
    df = spark.createDataFrame([tuple(y), (1.0, 2.0, 4.0), (1.0, 1.0, 1.0), (1.0, 2.0, 1.5)], "a double, b double, c double")
    abc = [F.col(c) for c in "abc"]
    got = df.select(thermal.asymptote(*abc).alias("y"), thermal.time_constant(*abc, 300.0).alias("t")).collect()
    assert tuple(got[0]) == pytest.approx((20, 600))
    assert [tuple(r) for r in got[1:]] == [(None, None)] * 3


def test_step_response(spark):
    rng = random.Random(4)
    steps = [(i, rng.choice("ab"), T0 + timedelta(hours=rng.randrange(300))) for i in range(40)] + [(99, "none", T0)]
    readings = [(rng.choice("ab"), T0 + timedelta(minutes=rng.randrange(300 * 60)), rng.choice([None, 40.0, 45.0, 50.0, 52.0, 60.0])) for _ in range(900)]
    got = transients.step_response(spark.createDataFrame(steps, "step_id long, k string, t timestamp_ntz"), spark.createDataFrame(readings, "k string, t timestamp_ntz, v double"), ["k"], "t", "v", 50.0, 36000.0, 12.0).collect()
    assert len(got) == 41
    for r in got:
        own = sorted(((t - r.t).total_seconds(), 2 * (v - 50)) for k, t, v in readings if k == r.k and v is not None and 0 < (t - r.t).total_seconds() <= 36000)
        out = max((a for a, d in own if abs(d) > 12), default=0)
        want = (len(own), max(0, -min(d for _, d in own)), max(0, max(d for _, d in own)), min((a for a, _ in own if a > out), default=None)) if own else (0, None, None, None)
        assert (r.n, r.dip_percent, r.rise_percent, r.recovery_seconds) == want
