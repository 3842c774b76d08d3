"""Streams of readings: windows with watermarks, sessions, a stateful segmenter, merged snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import merge_snapshot

READINGS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_readings(spark: SparkSession, path: str, files_per_batch: int | None = 8) -> DataFrame:
    """A folder of parquet files as a stream; event times become timestamps, which watermarks need.

    files_per_batch None: all files that are there when a bounded run starts are one batch.
    """
    reader = spark.readStream.schema(READINGS)
    raw = (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Readings, their sum in hundredths and their greatest value by event-time window and signal."""
    windows = stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    out = windows.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.max("value").alias("greatest"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "event_type", "n", "cents", "greatest")


def sessions(stream: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Stretches of a device's readings without a pause of gap or more."""
    out = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def without_repeats(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, as long as its copies come within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


SEGMENTS = "user_id long, on boolean, start timestamp, last_seen timestamp, n long"
_OPEN = "on boolean, start timestamp, last_seen timestamp, n long"


def _segmenter(low: float, high: float):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        on, start, last, n = state.get if state.exists else (False, None, None, 0)
        closed = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for ts, value in zip(rows.ts, rows.value):
            now = on if pd.isna(value) or low < value < high else bool(value >= high)
            if n and now != on:
                closed.append((key[0], on, start, last, n))
                start, n = None, 0
            on, start, last, n = now, ts if start is None else start, ts, n + 1
        state.update((on, start, last, n))
        if closed:
            yield pd.DataFrame(closed, columns=["user_id", "on", "start", "last_seen", "n"])

    return run


def closed_segments(stream: DataFrame, low: float = 20.0, high: float = 80.0) -> DataFrame:
    """Segments of a two-threshold state by device, each sent out when it closes.

    State is one open segment a device. Readings of a device must come in
    order of time from batch to batch; within a batch they are sorted.
    """
    return stream.groupBy("user_id").applyInPandasWithState(_segmenter(low, high), SEGMENTS, _OPEN, "append", "NoTimeout")


def snapshot_writer(path: str, keys: list[str], version: str):
    """For foreachBatch: merges each batch into a snapshot; each batch has a folder of its own, named by its number.

    A batch that is run again writes the same folder again, so the last
    complete folder is always a whole snapshot. Folders older than the one
    that a batch may be run again from are deleted.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number == 0:
            merged = merge_snapshot(batch.limit(0), batch, keys, version)
        else:
            merged = merge_snapshot(spark.read.parquet(f"{path}/{number - 1}"), batch, keys, version)
        merged.write.mode("overwrite").parquet(f"{path}/{number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{number - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return write


def last_snapshot(spark: SparkSession, path: str) -> str | None:
    """The folder of the highest batch that snapshot_writer has completed under path; None if there is none."""
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = home.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(home)] if fs.exists(home) else []
    done = [int(n) for n in names if n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return f"{path}/{max(done)}" if done else None


ALARMS = "user_id long, opened timestamp, closed timestamp, worst double, n long"
_ALARM = "opened timestamp, worst double, n long, missed int, first_miss timestamp"


def _alarms(level: float, clear_after: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        opened, worst, n, missed, first_miss = state.get if state.exists else (None, None, 0, 0, None)
        closed = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for ts, value in zip(rows.ts, rows.value):
            if not pd.isna(value) and value >= level:
                opened, worst, n, missed, first_miss = opened or ts, value if worst is None else max(worst, value), n + 1, 0, None
            elif n:
                missed, first_miss = missed + 1, first_miss or ts
                if missed == clear_after:
                    closed.append((key[0], opened, first_miss, worst, n))
                    opened, worst, n, missed, first_miss = None, None, 0, 0, None
        state.update((opened, worst, n, missed, first_miss))
        if closed:
            yield pd.DataFrame(closed, columns=["user_id", "opened", "closed", "worst", "n"])

    return run


def closed_alarms(stream: DataFrame, level: float, clear_after: int) -> DataFrame:
    """Alarms by device: open from a reading at level or above, closed by clear_after readings below it in a row, as of the first of these.

    Sent out when they close; readings as in closed_segments().
    """
    return stream.groupBy("user_id").applyInPandasWithState(_alarms(level, clear_after), ALARMS, _ALARM, "append", "NoTimeout")
