"""The replay of late deliveries at size: deliveries of many files lose nothing, and what waits is one value of a group's state."""

import random

import pandas as pd
from pyspark.sql import functions as F

from millrace.plans import tracked
from millrace.sources import tables
from millrace.streaming import status

SECOND = 1_000_000


def test_deliveries_of_many_files_are_one_batch_a_run(spark, tmp_path):
    """Forty files a delivery, each of its whole time: rows of later batches would be behind the watermark of those before."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").drop("props").withColumn("props", F.lit(None).cast("string"))
    events.repartition(40, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    home = spark._jvm.org.apache.hadoop.fs.Path(tables.shared_folder(spark))
    fs = home.getFileSystem(spark._jsc.hadoopConfiguration())
    logs = lambda: {str(f.getPath()) for f in fs.listStatus(home) if f.getPath().getName().startswith("replay-")} if fs.exists(home) else set()
    before = logs()
    spark.conf.set("spark.sql.files.minPartitionNum", "1000")  # a file a task, so files stay forty
    try:
        got = {r.field: (r.n, r.off) for r in tracked.replayed_status(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    n = tracked.status_changes(spark, str(tmp_path)).count()
    assert n > 0 and got == {"rows": (n, 0), "at_us": (n, 0)}
    (log,) = logs() - before
    batches = [f.getPath().getName() for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{log}/log/commits"))]
    assert len([b for b in batches if b.isdigit()]) == 4  # a batch of rows and an idle one each time


class State:
    """A group's state, as its function sees it, that passes nothing on."""

    exists, get, now = False, None, 0

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None

    def getCurrentWatermarkMs(self):
        return self.now

    def setTimeoutTimestamp(self, at):
        self.at = at


def test_waiting_readings_are_one_value_of_the_state():
    rules, state, rng = status.StatusRules(60.0, 50.0, 300.0), State(), random.Random(5)
    rows = [(rng.random() < 0.1, 0 if i % 3 == 0 else i % 3, rng.randrange(1, 9000) * SECOND, i, rng.choice([None, 10.0, 70.0])) for i in range(1000)]
    frame = pd.DataFrame([(none, 0 if none else user, *rest) for none, user, *rest in rows], columns=["_none", "_id", "at", "event_id", "value"]).astype({"value": "float64"})
    fold = status._watch(rules, False)
    assert list(fold((0,), iter([frame[:600], frame[600:]]), state)) == []
    assert sum(len(c) for c in state.get if isinstance(c, list)) == 0  # no device is known yet
    assert state.at == frame["at"].min() // 1000
    got = []
    for state.now in (4_000_000, 4_000_001, 9_500_000):  # milliseconds; the last is when all have fallen silent
        got += [tuple(r) for out in fold((0,), iter(()), state) for r in out.itertuples(index=False)]
        assert sum(len(c) for c in state.get if isinstance(c, list)) == 5 * 4
    assert state.get[-1] == b""
    want = []
    for user in (None, 0, 1, 2):
        one = status.Status(rules)
        for none, number, at, _, value in sorted(frame.itertuples(index=False, name=None), key=lambda r: r[2:4]):
            if (None if none else number) == user:
                want += [(user, *c) for c in one.take(at, value)]
        want += [(user, *c) for c in one.advance(9_500_000_000 - 1)]
    tell = lambda rows: sorted((str(None if pd.isna(u) else int(u)), at, s) for u, at, s in rows)
    assert tell(got) == tell(want) and len(want) > 40
