"""Streams over many batches, out of order and with a restart, against their batch forms; the incremental source."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import episodes
from millrace.sources import arrivals
from millrace.streaming import flows, lifecycles

T0 = datetime(2024, 3, 1)


@pytest.fixture(autouse=True)
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def readings(n=700, seed=3):
    """(event_id, ts, user_id, event_type, value, props): ties, pauses, midnights sharp, nulls, NaN, negative values."""
    rng = random.Random(seed)
    rows, at = [], {}
    for i in range(n):
        user = rng.choice([1, 1, 1, 2, 3, None])
        at[user] = at.get(user, T0) + timedelta(seconds=rng.choice([0, 60, 3600, 9000, 40000, 90000]))
        if rng.random() < 0.1:
            at[user] = (at[user] + timedelta(days=1)).replace(hour=0, minute=0, second=0)
        rows.append((i, at[user], user, rng.choice(["a", "b"]), rng.choice([None, float("nan"), -3.0, 10.0, 59.9, 60.0, 75.5, 200.0]), None))
    return rows


@pytest.mark.parametrize("rules", [lifecycles.EpisodeRules(60.0, 2, 2 * 86400.0, 86400.0), lifecycles.EpisodeRules(-5.0, 1, 43200.0, 3600.0), lifecycles.EpisodeRules(60.0, 3, 5 * 86400.0, 0.0)])
def test_episodes_of_shuffled_files_with_a_restart(spark, tmp_path, rules):
    rng = random.Random(7)
    rows = sorted(readings(), key=lambda r: r[1] + timedelta(hours=rng.randrange(0, 40)))
    files = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    shape = flows.READINGS

    def write(parts):
        for part in parts:
            spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def go_on():
        pieces = lifecycles.episode_pieces(flows.read_readings(spark, f"{tmp_path}/in", 2), rules, "2 days")
        with lifecycles.rocksdb_state(spark):
            q = pieces.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    write(files[: len(files) // 2])
    go_on()
    some = spark.read.parquet(f"{tmp_path}/rows").count()
    write(files[len(files) // 2 :])
    go_on()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    cols = ["user_id", "event_type", "opened", "part", "start", "stop", "reason", "worst", "n", "covered"]
    tell = lambda df: sorted(map(str, df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in ("opened", "start", "stop") else c for c in cols]).collect()))
    got = tell(spark.read.parquet(f"{tmp_path}/rows"))
    until = max(r[1] for r in rows) - timedelta(days=2)
    df = spark.createDataFrame(rows, shape).withColumn("day", F.date_trunc("day", "ts"))
    for bucket in (None, "day") if rules.clear_after == 2 else (None,):
        want = episodes.episode_pieces(df, ["user_id", "event_type"], "ts", ["ts", "event_id"], "value", rules.level, rules.clear_after, rules.silent, rules.pause, F.lit(until).cast("timestamp_ntz"), bucket)
        assert got == tell(want)
    assert 0 < some < len(got)


def test_the_worst_of_negative_values(spark, tmp_path):
    rows = [(i, T0 + timedelta(hours=i), 1, "a", v, None) for i, v in enumerate([-5.0, -7.0, -20.0, -20.0])]
    spark.createDataFrame(rows, flows.READINGS).write.parquet(f"{tmp_path}/in")
    q = flows.closed_alarms(flows.read_readings(spark, f"{tmp_path}/in"), -10.0, 2).writeStream.format("memory").queryName("worst_of").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.worst for r in spark.table("worst_of").collect()] == [-5.0]


ROW = "event_id long, received_at timestamp_ntz, v string"


def test_arrivals_at_ties_across_batches_and_restarts(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)

    def write(rows, groups=1):
        spark.createDataFrame(rows, ROW).repartition(groups).write.mode("append").parquet(f"{tmp_path}/in")

    def go_on(**options):
        stream = arrivals.read_arrivals(spark, f"file:{tmp_path}/in", ROW, "received_at", "event_id", **options)
        arrivals.replicate(stream, f"{tmp_path}/out", f"{tmp_path}/log")
        return sorted(r.event_id for r in spark.read.schema(ROW).parquet(f"{tmp_path}/out").collect())

    write([(i, at(i // 4), f"r{i}") for i in range(10)], 3)
    assert go_on() == list(range(10))
    assert go_on() == list(range(10))
    write([(10, at(2), "same time, next tie"), (11, at(2), "x"), (12, at(3), "x")])
    assert go_on() == list(range(13))
    write([(13, at(3), "x"), (14, at(9), "not settled"), (15, at(10), "nor this"), (16, None, "never")], 2)
    assert go_on(clock=at(10).isoformat(), settle=120) == list(range(14))
    assert go_on(clock=at(12).isoformat(), settle=120) == list(range(16))


def test_arrivals_since_and_shape(spark, tmp_path):
    spark.createDataFrame([(i, T0 + timedelta(minutes=i % 5), "x") for i in range(20)], ROW).write.parquet(f"{tmp_path}/in")
    spark.dataSource.register(arrivals.ArrivalSource)
    stream = spark.readStream.format("arrivals").options(path=f"{tmp_path}/in", arrival="received_at", tie="event_id", since=(T0 + timedelta(minutes=3)).isoformat()).load()
    assert [f.simpleString() for f in stream.schema] == ["event_id:bigint", "received_at:timestamp_ntz", "v:string"]
    arrivals.replicate(stream.select("event_id"), f"{tmp_path}/out", f"{tmp_path}/log")
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [i for i in range(20) if i % 5 >= 3]
    with pytest.raises(ValueError):
        arrivals.ArrivalReader({"path": "x"}, None)
