"""Summaries on small tables worked out by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import summaries

T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


@pytest.fixture(scope="module")
def df(spark):
    rows = [(1, "a", at(0.5), 10.0), (2, "a", at(3.25), 20.0), (3, "a", at(3.25), 30.0), (4, "a", at(6), None), (5, "b", at(1), 7.0)]
    return spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v double").withColumn("day", F.date_trunc("day", "ts"))


def test_resample(df):
    got = sorted((r.k, r.ts, r.v) for r in summaries.resample(df, ["k"], "ts", "id", "1 hour", "v").collect())
    assert got == [("a", at(h), v) for h, v in ((1, 10.0), (2, 10.0), (3, 10.0), (4, 30.0), (5, 30.0), (6, None))] + [("b", at(1), 7.0)]  # a reading on a grid point is its first
    six = summaries.resample(df, ["k"], "ts", "id", "6 hours", "v", None).collect()
    assert [(r.k, r.ts, r.v) for r in six] == [("a", at(6), None)]  # whole steps of the day, not of the first reading


def test_time_weighted_mean(df):
    got = {r.k: (r.seconds, r.mean) for r in summaries.time_weighted_mean(df, ["k"], "ts", ["ts", "id"], "day", "v").collect()}
    assert got == {"a": (5.5 * 3600, pytest.approx((2.75 * 10 + 2.75 * 30) / 5.5))}


def test_coverage(spark):
    shape = "k string, start timestamp_ntz, stop timestamp_ntz"
    spans = spark.createDataFrame([("a", at(0), at(4)), ("a", at(2), at(10)), ("b", at(0), at(1)), (None, at(0), at(2))], shape)
    gaps = spark.createDataFrame([("a", at(1), at(3)), ("b", at(-1), at(5)), (None, at(1), at(2))], shape)
    got = {r.k: (r.seconds, r.share) for r in summaries.coverage(spans, gaps, ["k"]).collect()}
    assert got == {"a": (36000, 0.8), "b": (3600, 0), None: (7200, 0.5)}


def test_snapshot_diff(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (None, "n")], "id long, s string")
    new = spark.createDataFrame([(1, "x"), (2, "z"), (4, "w"), (None, "m"), (3, None)], "id long, s string")
    got = {(r.id, r.change, r.s, r.old_s) for r in summaries.snapshot_diff(old, new, ["id"], ["s"]).collect()}
    assert got == {(2, "updated", "z", "y"), (4, "opened", "w", None), (None, "updated", "m", "n")}
    assert {(r.id, r.change) for r in summaries.snapshot_diff(old, old.limit(0), ["id"], ["s"]).collect()} == {(i, "closed") for i in (1, 2, 3, None)}


def test_alarm_episodes(spark):
    rows = [("a", at(0), at(1)), ("a", at(1.5), at(2)), ("a", at(5), at(5.1)), ("b", at(0), at(0.2)), ("b", at(0.6), at(0.7))]
    df = spark.createDataFrame(rows, "k string, start timestamp_ntz, stop timestamp_ntz")
    got = {(r.k, r.start, r.stop) for r in summaries.alarm_episodes(df, ["k"], "start", "stop", off_delay=1800.0, on_delay=1000.0).collect()}
    assert got == {("a", at(0), at(2)), ("b", at(0), at(0.7))}


def test_top_rows(df):
    got = sorted((r.k, r.id, r.rank) for r in summaries.top_rows(df, ["k"], [F.desc_nulls_last("v"), F.asc("id")], 2).collect())
    assert got == [("a", 2, 2), ("a", 3, 1), ("b", 5, 1)]
