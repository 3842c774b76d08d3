"""The tape and its corrections against a full rebuild."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.sources import tape
from millrace.streaming import corrections, flows, lifecycles

T0 = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
SHAPE = "k long, start timestamp_ntz, v long, gone boolean"


def told(df):
    return sorted(map(str, df.select("k", "start", "v", "prev_start", "next_start").collect()))


def size_of(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_tape_after_many_batches(spark, tmp_path):
    rng = random.Random(1)
    book = tape.SegmentTape(spark, f"{tmp_path}/tape", "k long", "v long", cell="day", buckets=4)
    assert book.read().count() == 0
    have: dict = {}
    for batch in range(4):
        rows = {}
        for _ in range(25):
            k, start = rng.choice([1, 2, 3, None]), T0 + timedelta(hours=rng.randrange(0, 24 * 12, 3))
            rows[k, start] = (k, start, rng.randrange(100), (k, start) in have and rng.random() < 0.5)
        if batch == 2:  # whole days go
            rows |= {(k, s): (k, s, None, True) for k, s in have if s < T0 + timedelta(days=2)}
        changes = spark.createDataFrame(list(rows.values()), SHAPE)
        book.apply(changes)
        for key, (_, _, v, gone) in rows.items():
            have.pop(key, None) if gone else have.__setitem__(key, v)
        whole = tape.segment_links(spark.createDataFrame([(k, s, v) for (k, s), v in have.items()], "k long, start timestamp_ntz, v long"), ["k"])
        assert told(book.read()) == told(whole)
        if batch == 1:
            book.apply(changes)  # again: nothing changes
            assert told(book.read()) == told(whole)
    assert book.apply(changes.limit(0)) == 0
    with pytest.raises(ValueError):
        book.apply(changes.union(changes))


def test_a_batch_rewrites_its_cells_and_its_neighbours_only(spark, tmp_path):
    book = tape.SegmentTape(spark, f"{tmp_path}/tape", "k long", "v long", cell="day", buckets=1)
    book.apply(spark.createDataFrame([(k, T0 + timedelta(days=d), 0, None) for k in (1, 2) for d in range(0, 40, 2)], SHAPE))
    before = size_of(f"{tmp_path}/tape")
    assert book.apply(spark.createDataFrame([(1, T0 + timedelta(days=9), 5, False)], SHAPE)) == 3
    after = size_of(f"{tmp_path}/tape")
    cells = lambda files: {f.split("_cell=")[1].split("/")[0] for f in files}
    assert cells(set(after) - set(before)) == {"2024-01-09", "2024-01-10", "2024-01-11"} and len(cells(after)) == 21
    row = book.read().where(F.col("start") == F.lit(T0 + timedelta(days=9)).cast("timestamp_ntz")).first()
    assert (row.prev_start, row.next_start) == (T0 + timedelta(days=8), T0 + timedelta(days=10))


def test_any_order_within_the_overlap_gives_the_same_tape(spark, tmp_path):
    rng = random.Random(1)
    rows, at = [], T0
    for i in range(400):
        at += timedelta(minutes=rng.choice([0, 7, 60, 500]))
        rows.append((i, at, rng.choice([1, 2, None]), "a", rng.choice([None, float("nan"), 5.0, 20.0, 50.0, 80.0, 99.0]), None))
    late = sorted(rows, key=lambda r: r[1] + timedelta(hours=rng.randrange(0, 40)))
    book = tape.SegmentTape(spark, f"{tmp_path}/tape", "user_id long", "last_seen timestamp_ntz, on boolean, n long", cell="day", buckets=2)
    seen = []

    def keep(batch, number):
        batch.persist()
        seen.append(batch.where("gone").count())
        book.apply(batch)
        batch.unpersist()

    for lo in range(0, 400, 100):  # a run a file, so each but the first is a restart
        spark.createDataFrame(late[lo : lo + 100], flows.READINGS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        changes = corrections.corrected_segments(flows.read_readings(spark, f"{tmp_path}/in"), 20.0, 80.0, "2 days")
        with lifecycles.rocksdb_state(spark, idle_batches=False):
            q = changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    us = lambda t: int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    want = []
    for user in (1, 2, None):
        mine = corrections.fold(None, [(us(r[1]), r[0], r[4]) for r in sorted(rows, key=lambda r: (r[1], r[0])) if r[2] == user], 20.0, 80.0)
        starts = [s[0] for s in mine]
        want += [(user, *s, p, n) for s, p, n in zip(mine, [None, *starts], [*starts[1:], None])]
    got = [(r.user_id, us(r.start), us(r.last_seen), r.on, r.n, r.prev_start and us(r.prev_start), r.next_start and us(r.next_start)) for r in book.read().collect()]
    order = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert sum(seen)  # some segments had to be taken back
