"""What the operators share: tables, staged results, words and hashes."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import shared_folder

#: Words are maximal runs of anything but these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; null ids get null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


class Staging:
    """Intermediate tables in the shared folder.

    A staged table cuts lineage: after the loss of an executor, work starts
    again from files that all executors can read. Operators drop what they no
    longer read; the tables under a result stay, as the result is lazy. A
    caller that has written the result may let staged_here() delete them.
    """

    opened: list[list[Staging]] = []

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
        self.count = 0
        for scope in self.opened:
            scope.append(self)

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count:03d}-{name}"
        df.write.parquet(path)
        if self.count == 1:
            base = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
            base.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(base)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes staged tables that nothing reads any longer."""
        for df in frames:
            self._delete(df._staged_path)

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def staged_here():
    """Deletes, at its end, the tables that operators staged inside; write their results before."""
    Staging.opened.append([])
    try:
        yield
    finally:
        for staging in Staging.opened.pop():
            staging._delete(staging.base)


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, key: a hash of the text, so that id and key find a text even where ids are null or repeat."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))


def text_of_classes(docs: DataFrame, members: DataFrame) -> DataFrame:
    """One text (fp, text) of each class in members(fp, doc_id, key), looked up in keyed_texts.

    One member is chosen before texts move, so a large class of copies moves
    one text. Hashes may collide: check fp against the text, and drop repeats.
    """
    chosen = members.groupBy("fp").agg(F.min(F.struct("doc_id", "key")).alias("m")).select("fp", F.col("m.doc_id").alias("id"), F.col("m.key").alias("k"))
    return docs.join(chosen, docs.doc_id.eqNullSafe(chosen.id) & (docs.key == chosen.k)).select("fp", "text")


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def slices(batches, rows: int = 1024):
    """Batches in parts of so many rows: what a task makes of a part is gone before the next."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def trimmed(run):
    """run(batches), after which a worker that waits for its next task gives freed memory back to the system."""

    def out(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return out


def whole_groups(batches):
    """Batches in order of their first column -> tables with all rows of each of its values that they have."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.column(0).to_numpy()
        last = int((first == first[-1]).argmax())  # the value that the next batch may go on with begins here
        if held and (last or first[0] != held[-1].column(0)[-1].as_py()):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(column: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values begins and ends."""
    cuts = (np.flatnonzero(np.diff(column)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(column)]))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of every word; bytes.split() cuts at the same six blanks as WORD."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64 (wraps by design)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes, by doubling: O(len * log n)."""
    if len(h) < n:
        return h[:0]
    mult = np.uint64(0x9E3779B97F4A7C15)
    out, power, size, done = None, h, 1, 0
    while True:
        if n & size:  # append a block of this size behind what is there
            out = power if out is None else mix64(out[: len(power) - done] * mult + power[done:][: len(out)])
            done += size
        if done == n:
            return out[: len(h) - n + 1]
        power = mix64(power[: len(power) - size] * mult + power[size:])
        size *= 2
