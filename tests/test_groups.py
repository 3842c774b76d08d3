"""Devices that share a state row: as many rows of state as groups, however many devices, and the same results."""

import test_lifecycles
import test_status
import test_tape
from pyspark.sql import functions as F
from test_lifecycles import T0, two_partitions  # noqa: F401

from millrace.streaming import corrections, flows, lifecycles, status


def drained(spark, tmp_path, out, mode="append"):
    """Rows that a stream sends out, and how many rows of state it had at the most."""
    with lifecycles.rocksdb_state(spark):
        writer = out.writeStream.outputMode(mode).foreachBatch(lambda batch, number: batch.write.mode("append").parquet(f"{tmp_path}/out"))
        q = writer.option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    return spark.read.parquet(f"{tmp_path}/out"), max(o.numRowsTotal for p in q.recentProgress for o in p.stateOperators)


def many(spark, tmp_path, devices):
    """A device reads 70 at the start and three days later; one that is heard of after nine days moves the clock on."""
    ts = lambda day: (F.lit(T0) + F.expr(f"interval {day} days")).cast("timestamp_ntz")
    two = spark.range(2 * devices).select("id", F.when(F.col("id") % 2 == 0, ts(0)).otherwise(ts(3)).alias("ts"), F.floor(F.col("id") / 2).alias("user_id"))
    rows = two.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"), ts(9).alias("ts"), F.lit(None).cast("long").alias("user_id")))
    rows.select(F.col("id").alias("event_id"), "ts", "user_id", F.lit("a").alias("event_type"), F.lit(70.0).alias("value"), F.lit(None).cast("string").alias("props")).write.parquet(f"{tmp_path}/in")
    return flows.read_readings(spark, f"{tmp_path}/in", None)


def test_status_keeps_a_row_of_state_a_group(spark, tmp_path):
    stream = many(spark, tmp_path, 3 * 2048)
    rows, state = drained(spark, tmp_path, status.device_status(stream, status.StatusRules(60.0, 3600.0, 86400.0), "2 days"))
    assert state <= 2048
    assert {(r.status, r.n) for r in rows.groupBy("status").agg(F.count("*").alias("n")).collect()} == {("high", 6 * 2048), ("stale", 6 * 2048)}


def test_episodes_keep_a_row_of_state_a_group(spark, tmp_path):
    stream = many(spark, tmp_path, 3 * 2048)
    rows, state = drained(spark, tmp_path, lifecycles.episode_pieces(stream, lifecycles.EpisodeRules(60.0, 2, 86400.0, 3600.0), "2 days"))
    assert state <= 2048
    assert {(r.reason, r.n) for r in rows.groupBy("reason").agg(F.count("*").alias("n")).collect()} == {("silent", 6 * 2048)}


def test_corrections_keep_a_row_of_state_a_group(spark, tmp_path):
    stream = many(spark, tmp_path, 3 * 2048)
    rows, state = drained(spark, tmp_path, corrections.corrected_segments(stream, 20.0, 60.0, "2 days"), "update")
    assert state <= 2048
    assert {(r.on, r.gone, r.n, r["count"]) for r in rows.groupBy("on", "gone", "n").count().collect()} == {(True, False, 2, 3 * 2048), (True, False, 1, 1)}


def test_status_of_devices_in_one_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lifecycles, "GROUPS", 1)
    test_status.test_replay_of_late_deliveries_with_a_restart(spark, tmp_path)


def test_episodes_of_devices_in_one_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lifecycles, "GROUPS", 1)
    test_lifecycles.test_episodes_of_shuffled_files_with_a_restart(spark, tmp_path, lifecycles.EpisodeRules(60.0, 2, 2 * 86400.0, 86400.0))


def test_corrections_of_devices_in_one_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lifecycles, "GROUPS", 1)
    test_tape.test_any_order_within_the_overlap_gives_the_same_tape(spark, tmp_path)
