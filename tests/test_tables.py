"""Intervals, sources, streams and parameters."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import intervals
from millrace.plans import config
from millrace.sources import tables
from millrace.streaming import flows

T0 = datetime(2024, 1, 1)
SHAPE = "k string, start timestamp_ntz, stop timestamp_ntz"


def some(rng, n, longest):
    out = []
    for _ in range(n):
        s = rng.randrange(0, 300)
        out.append((rng.choice("ab"), T0 + timedelta(hours=s), T0 + timedelta(hours=s + rng.randrange(0, longest))))
    return out


def hours(rows):
    """The hours that the intervals of each group cover."""
    return {(r[0], h) for r in rows for h in range(int((r[1] - T0).total_seconds() // 3600), int((r[2] - T0).total_seconds() // 3600))}


def test_interval_algebra(spark):
    rng = random.Random(1)
    a, b = some(rng, 60, 9), some(rng, 50, 7)
    x, y = spark.createDataFrame(a, SHAPE), spark.createDataFrame(b, SHAPE)
    merged = sorted(tuple(r) for r in intervals.merge(x, ["k"]).collect())
    assert hours(merged) == hours(a)
    assert all(p[0] != q[0] or p[2] < q[1] for p, q in zip(merged, merged[1:]))
    assert hours(tuple(r) for r in intervals.subtract(x, y, ["k"]).collect()) == hours(a) - hours(b)
    both = [(p[0], max(p[1], q[1]), min(p[2], q[2])) for p in a for q in b if p[0] == q[0] and p[1] < q[2] and q[1] < p[2] and p[1] < p[2] and q[1] < q[2]]
    assert sorted(tuple(r) for r in intervals.intersect(x, y, ["k"]).collect()) == sorted(both)
    days = intervals.cut_at_days(x).collect()
    assert hours((r.k, r.start, r.stop) for r in days) == hours(a) and all(r.day <= r.start < r.stop <= r.day + timedelta(days=1) for r in days)
    low, high = F.lit(T0 + timedelta(hours=50)).cast("timestamp_ntz"), F.lit(T0 + timedelta(hours=90)).cast("timestamp_ntz")
    assert hours(tuple(r) for r in intervals.clip(x, low, high).collect()) == {(k, h) for k, h in hours(a) if 50 <= h < 90}
    assert intervals.merge(x.limit(0), ["k"]).count() == intervals.subtract(x.limit(0), y, ["k"]).count() == 0


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "2.5", "a"), (2, "x", "a"), (3, "NaN", "b"), (4, None, "b")], "id long, value string, part string")
    assert [r.value for r in tables.typed_readings(df).orderBy("id").collect()] == [2.5, None, None, None]
    good, bad = tables.split_rejects(df, {"number": F.col("value").rlike("^[0-9.]+$"), "low": F.col("id") < 3})
    assert [r.id for r in good.collect()] == [1] and {r.id: r.broken_rules for r in bad.collect()} == {2: ["number"], 3: ["number", "low"], 4: ["number", "low"]}
    path = str(tmp_path / "t")
    tables.write_partitioned(df, path, ["part"])
    tables.write_partitioned(df.where("id = 3").withColumn("value", F.lit("9")), path, ["part"])
    assert sorted((r.id, r.value) for r in tables.read_table(spark, path).collect()) == [(1, "2.5"), (2, "x"), (3, "9")]
    df.write.json(str(tmp_path / "j"))
    df.write.option("header", "true").csv(str(tmp_path / "c"))
    for kind in ("json", "csv"):
        assert tables.read_table(spark, str(tmp_path / kind[0]), "id long, value string, part string", kind).count() == 4
        with pytest.raises(ValueError):
            tables.read_table(spark, "x", None, kind)
    old, new = df.withColumn("v", F.lit(1)), df.where("id > 2").withColumn("v", F.col("id") - 2).withColumn("part", F.lit("new"))
    assert {r.id: r.part for r in tables.merge_snapshot(old, new, ["id"], "v").collect()} == {1: "a", 2: "a", 3: "new", 4: "new"}
    assert tables.union_all([df, df.drop("part")]).count() == 8


def drain(df, path, log):
    q = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", log).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def test_streams(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, T0 + timedelta(minutes=10 * i), i % 3, "view", float(rng.randrange(100)), None) for i in range(240)]
    for n in range(4):
        spark.createDataFrame(rows[60 * n : 60 * n + 60], flows.READINGS).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    source = lambda: flows.read_readings(spark, str(tmp_path / "in" / "*"), 1)
    drain(flows.closed_segments(source()), str(tmp_path / "seg"), str(tmp_path / "l1"))
    want = set()
    for u in range(3):
        on, start, last, n = False, None, None, 0
        for _, t, _, _, v, _ in rows[u::3]:
            now = True if v >= 80 else False if v <= 20 else on
            if n and now != on:
                want.add((u, on, start, last, n))
                start, n = None, 0
            on, start, last, n = now, start or t, t, n + 1
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "seg")).collect()} == want
    drain(flows.windowed_counts(source()), str(tmp_path / "win"), str(tmp_path / "l2"))
    got = spark.read.parquet(str(tmp_path / "win")).collect()
    assert len(got) == 39 and {r.n for r in got} == {6}
    drain(flows.sessions(source(), "15 minutes"), str(tmp_path / "ses"), str(tmp_path / "l3"))
    assert {r.n for r in spark.read.parquet(str(tmp_path / "ses")).collect()} == {1}
    drain(flows.without_repeats(source().union(source())), str(tmp_path / "ded"), str(tmp_path / "l4"))
    assert spark.read.parquet(str(tmp_path / "ded")).count() == 240
    q = source().writeStream.foreachBatch(flows.snapshot_writer(str(tmp_path / "snap"), ["user_id"], "ts")).option("checkpointLocation", str(tmp_path / "l5")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.event_id for r in spark.read.parquet(str(tmp_path / "snap" / "3")).collect()} == {237, 238, 239}


def test_parameters():
    base = {"a": {"x": 1, "y": 2}, "b": [1]}
    assert config.layered(base, {"a": {"y": 3, "z": 4}}, {"b": None}) == {"a": {"x": 1, "y": 3, "z": 4}}
    assert base == {"a": {"x": 1, "y": 2}, "b": [1]}
    config.check_bands([{"name": "low", "low": 0, "high": 5}, {"name": "high", "low": 5, "high": 9}])
    with pytest.raises(ValueError, match="overlap.*|named"):
        config.check_bands([{"name": "a", "low": 0, "high": 5}, {"name": "a", "low": 4, "high": 9}, {"name": "c", "low": 3, "high": 1}])
