"""Stabilised status and silence: the fold, its batch form and both clocks of the stream; replays and parity."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_lifecycles import T0, readings, two_partitions  # noqa: F401

from millrace.operators import status as batch
from millrace.streaming import flows, lifecycles, replay, status

EPOCH = datetime(1970, 1, 1)
us = lambda t: (t - EPOCH) // timedelta(microseconds=1)


def test_a_test_clock_drives_the_rules():
    s = status.Status(status.StatusRules(60.0, 10.0, 60.0))
    sec = lambda x: int(x * 1e6)
    assert s.take(sec(0), 70.0) == [] and s.advance(sec(9)) == []
    assert s.advance(sec(10)) == [(sec(10), "high")] and s.advance(sec(59)) == []
    assert s.take(sec(59), 10.0) == [] and s.take(sec(65), 80.0) == [] and s.advance(sec(100)) == []  # a blip
    assert s.take(sec(100), None) == [] and s.advance(sec(159)) == []  # alive
    assert s.advance(sec(500)) == [(sec(160), "stale")] and s.due() is None
    assert s.take(sec(600), 70.0) == [] and s.take(sec(610), 5.0) == [(sec(610), "high")]  # too late to stop it
    assert s.advance(sec(900)) == [(sec(620), "normal"), (sec(670), "stale")]


def folded(rows, rules, until):
    out = []
    for user in {r[2] for r in rows}:
        s = status.Status(rules)
        for _, ts, _, _, value, _ in sorted((r for r in rows if r[2] == user and r[1] < until), key=lambda r: (r[1], r[0])):
            out += [(user, *c) for c in s.take(us(ts), value)]
        out += [(user, *c) for c in s.advance(us(until) - 1)]
    return sorted(map(str, out))


RULES = [status.StatusRules(60.0, 43200.0, 3 * 86400.0), status.StatusRules(60.0, 0.0, 3600.0), status.StatusRules(0.0, 90000.0, 90000.0), status.StatusRules(59.0, 40000.0, 9000.0)]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("rules", RULES)
def test_batch_form_equals_the_fold(spark, rules, seed):
    rows = readings(900, seed)
    until = max(r[1] for r in rows) - timedelta(days=2)
    df = spark.createDataFrame(rows, flows.READINGS).withColumn("day", F.date_trunc("day", "ts"))
    want = folded(rows, rules, until)
    assert len(want) >= 4  # at the least, each device falls silent
    for bucket in (None, "day"):
        got = batch.status_changes(df, ["user_id"], "ts", ["ts", "event_id"], "value", rules.level, rules.hold, rules.stale_after, F.lit(until), bucket)
        assert sorted(str((r.user_id, us(r.at), r.status)) for r in got.collect()) == want


def test_no_rows_and_rows_without_time(spark):
    rows = [(1, None, 1, "a", 70.0, None), (2, T0, 1, "a", 70.0, None)]
    for some, n in ((rows, 2), (rows[:1], 0), ([], 0)):
        df = spark.createDataFrame(some, flows.READINGS)
        assert batch.status_changes(df, ["user_id"], "ts", ["ts", "event_id"], "value", 60.0, 1.0, 5.0, F.lit(T0 + timedelta(days=1))).count() == n


def test_replay_of_late_deliveries_with_a_restart(spark, tmp_path):
    rules, rows = RULES[0], readings(500, 11)
    spark.createDataFrame(rows, flows.READINGS).write.parquet(f"{tmp_path}/all")
    runs = []

    def run(folder):
        changes = status.device_status(flows.read_readings(spark, folder, 3), rules, "2 days")
        with lifecycles.rocksdb_state(spark):
            q = changes.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
        runs.append(spark.read.schema("user_id long").parquet(f"{tmp_path}/rows").count())

    replay.replay(spark.read.schema(flows.READINGS).parquet(f"{tmp_path}/all"), "ts", "event_id", 40 * 3600, 6, f"{tmp_path}/in", run)
    got = spark.read.parquet(f"{tmp_path}/rows").withColumn("at", F.col("at").cast("timestamp_ntz"))
    until = max(r[1] for r in rows) - timedelta(days=2)
    assert sorted(str((r.user_id, us(r.at), r.status)) for r in got.collect()) == folded(rows, rules, until)
    assert 0 < runs[0] < runs[1]


def test_the_wall_clock(spark, tmp_path):
    spark.createDataFrame([(1, T0, 7, "a", 70.0, None), (2, T0, None, "a", 5.0, None)], flows.READINGS).write.parquet(f"{tmp_path}/in")
    changes = status.device_status(flows.read_readings(spark, f"{tmp_path}/in"), status.StatusRules(60.0, 0.2, 1.5))
    with lifecycles.rocksdb_state(spark):
        q = changes.writeStream.outputMode("append").format("memory").queryName("told").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(120):
            rows = spark.table("told").collect()
            if len(rows) >= 4:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    for user, first in ((7, "high"), (None, "normal")):
        told = sorted((r.at, r.status) for r in rows if r.user_id == user)
        assert [s for _, s in told] == [first, "stale"]
        assert told[1][0] - told[0][0] == timedelta(seconds=1.3)


def test_parity_field_by_field(spark):
    shape = "k int, x double, y string"
    a = spark.createDataFrame([(1, 100.0, "p"), (2, None, "q"), (None, float("nan"), None), (3, 0.0, "r"), (4, 5.0, "s"), (6, 1.0, "t"), (6, 1.0, "t")], shape)
    b = spark.createDataFrame([(1, 100.001, "p"), (2, 1.0, "Q"), (None, float("nan"), None), (3, 0.0, "r"), (5, 5.0, "s"), (6, 1.0, "t")], shape)
    got = {r.field: (r.n, r.off, round(r.worst, 6)) for r in replay.parity(a, b, ["k"], 1e-4).collect()}
    assert got == {"rows": (7, 3, 1.0), "x": (7, 3, 1.0), "y": (7, 3, 1.0)}
    assert {(r.off, r.worst) for r in replay.parity(a, a, ["k"]).collect()} == {(0, 0.0)}
    assert {(r.n, r.off, r.worst) for r in replay.parity(a.limit(0), b.limit(0), ["k"]).collect()} == {(0, 0, 0.0)}
