"""Interval joins of any length and chains of any shape against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import dyadic

T0 = datetime(1969, 12, 20)
SHAPE = "k string, i long, start timestamp_ntz, stop timestamp_ntz"


def spans(rng, n):
    lengths = [timedelta(microseconds=1), timedelta(minutes=17, seconds=53, microseconds=741824), timedelta(minutes=18), timedelta(hours=5), timedelta(days=40), timedelta(days=3653)]
    out = []
    for i in range(n):
        start = T0 + timedelta(minutes=rng.randrange(0, 40_000), microseconds=rng.choice([0, 0, 1]))
        stop = datetime(9999, 1, 1) if rng.random() < 0.1 else start + rng.choice([*lengths, timedelta(0)])
        out.append((rng.choice(["hot"] * 5 + ["b"]), i, start, stop))
    return out


def test_overlaps_by_brute_force(spark):
    rng = random.Random(5)
    a, b = spans(rng, 150), spans(rng, 150)
    want = sorted((x[1], y[1], max(x[2], y[2]), min(x[3], y[3])) for x in a for y in b if x[0] == y[0] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
    out = dyadic.overlap_join(spark.createDataFrame(a, SHAPE), spark.createDataFrame(b, SHAPE), ["k"])
    assert sorted((r.a.i, r.b.i, r.start, r.stop) for r in out.collect()) == want
    assert dyadic.overlap_join(spark.createDataFrame([], SHAPE), spark.createDataFrame(b, SHAPE), ["k"]).count() == 0


def test_an_interval_makes_few_rows(spark):
    rng = random.Random(6)
    df = dyadic._cells(spark.createDataFrame(spans(rng, 400), SHAPE), ["k"], "start", "stop", "a")
    every = F.filter(F.sequence(F.lit(0), F.lit(33)), lambda level: level >= F.col("aown"))
    rows = dyadic._at(df, ["k"], "a", every).groupBy("a.i", "level").count()
    assert rows.agg(F.max("count")).first()[0] <= 2
    own = dyadic._at(df, ["k"], "a", F.array("aown"))
    assert own.where(F.expr(f"shiftright(alo, {dyadic.FINEST} + level) < cell - 1 or shiftright(ahi, {dyadic.FINEST} + level) > cell + 1")).count() == 0


def test_a_chain_of_100_000_links(spark):
    links = spark.range(100_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("b"), F.lit(2).cast("long").alias("v"))
    out = dyadic.chain_sums(spark, links, "id", "b", "v", most_rounds=18)  # 17, and one that finds nothing left
    assert out.where("origin = 0 and hops = node and total = 2 * (node + 1)").count() == 100_000


def test_chains_send_no_tables_through_the_driver(spark):
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1k")  # a broadcast of more raises an error
    try:
        links = spark.range(3_000).select("id", (F.col("id") - 1).alias("b"), F.col("id").alias("v"))
        out = dyadic.chain_sums(spark, links, "id", "b", "v")
        assert out.where("origin = 0 and hops = node and total = node * (node + 1) / 2").count() == 3_000
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_trees_strangers_and_circles(spark):
    rows = [(i, None if i % 10 == 0 else random.Random(i).randrange(i // 10 * 10, i), i) for i in range(1, 60)] + [(100, 999, 5)]
    want, before = {}, {n: b for n, b, _ in rows}
    for n, _, _ in rows:
        path = [n]
        while before.get(path[-1]) in before:
            path.append(before[path[-1]])
        want[n] = (path[-1], len(path) - 1, sum(x if x < 100 else 5 for x in path))
    df = spark.createDataFrame(rows, "n long, b long, v long")
    assert {r.node: (r.origin, r.hops, r.total) for r in dyadic.chain_sums(spark, df, "n", "b", "v").collect()} == want
    assert dyadic.chain_sums(spark, df.limit(0), "n", "b", "v").count() == 0
    with pytest.raises(ValueError):
        dyadic.chain_sums(spark, spark.createDataFrame([(1, 2, 0), (2, 1, 0)], "n long, b long, v long"), "n", "b", "v", most_rounds=5)


def test_operating_days_of_23_and_25_hours(spark):
    from millrace.operators import intervals

    at = datetime.fromisoformat
    df = spark.createDataFrame([(1, at("2024-03-30T00:00:00"), at("2024-04-01T12:00:00")), (2, at("2024-10-27T05:00:00"), at("2024-10-27T05:00:01")), (3, at("2024-10-26T04:00:00"), at("2024-10-27T05:00:00"))], "i long, start timestamp_ntz, stop timestamp_ntz")
    got = sorted((r.i, str(r.day), r.hours, r.start.isoformat(), r.stop.isoformat()) for r in intervals.cut_at_operating_days(df, "Europe/Berlin", 6).collect())
    assert got == [
        (1, "2024-03-29", 24, "2024-03-30T00:00:00", "2024-03-30T05:00:00"),
        (1, "2024-03-30", 23, "2024-03-30T05:00:00", "2024-03-31T04:00:00"),
        (1, "2024-03-31", 24, "2024-03-31T04:00:00", "2024-04-01T04:00:00"),
        (1, "2024-04-01", 24, "2024-04-01T04:00:00", "2024-04-01T12:00:00"),
        (2, "2024-10-27", 24, "2024-10-27T05:00:00", "2024-10-27T05:00:01"),
        (3, "2024-10-26", 25, "2024-10-26T04:00:00", "2024-10-27T05:00:00"),
    ]
