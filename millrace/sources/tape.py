"""A tape: the segments of many keys, kept up to date by batches of changes, with links to both neighbours.

The table is parquet, partitioned by a hash of the key and by the time cell in
which a segment starts. A batch rewrites the cells that hold one of its segments,
or a neighbour whose link it changes, and no others; so the bytes it writes
follow the batch and not the table. A batch that is applied again changes nothing.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.tables import shared_folder

LINKS = ("prev_start", "next_start")


class SegmentTape:
    """Segments known by keys and start; `columns` are the rest, as DDL. Keys may be null.

    cell is a unit of date_trunc; buckets, the number of key hashes, spreads the
    keys of a cell over files and bounds what is read to find neighbours.
    """

    def __init__(self, spark: SparkSession, path: str, keys: str, columns: str, cell: str = "month", buckets: int = 16) -> None:
        self.spark, self.path, self.cell, self.buckets = spark, path, cell, buckets
        self.keys = T.StructType.fromDDL(keys).names
        self.rest = T.StructType.fromDDL(columns).names
        self.shape = T.StructType.fromDDL(f"{keys}, start timestamp_ntz, {columns}, {LINKS[0]} timestamp_ntz, {LINKS[1]} timestamp_ntz, _bucket int, _cell date")
        self.parts = ["_bucket", "_cell"]

    def _stored(self) -> DataFrame:
        if not self._fs(self.path).exists(self._path(self.path)):
            return self.spark.createDataFrame([], self.shape)
        return self.spark.read.schema(self.shape).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(*self.parts)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _placed(self, df: DataFrame) -> DataFrame:
        hashed = F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")
        return df.withColumn("_bucket", hashed).withColumn("_cell", F.date_trunc(self.cell, "start").cast("date"))

    def _on(self, a: DataFrame, b: DataFrame, names: list[str]):
        out = a["_bucket"] == b["_bucket"]
        for n in names:
            out &= a[n].eqNullSafe(b[n])
        return out

    def apply(self, changes: DataFrame) -> int:
        """Takes rows (keys, start, columns, gone): segments to set, or, where gone, to delete; one row a segment. Returns how many cells were written."""
        work = f"{shared_folder(self.spark)}/tape-{uuid.uuid4().hex}"
        try:
            self._placed(changes.select(*self.keys, "start", *self.rest, F.coalesce("gone", F.lit(False)).alias("gone"))).write.parquet(f"{work}/changes")
            changes = self.spark.read.parquet(f"{work}/changes")
            counted = changes.groupBy(*self.keys, "start", "_bucket").count()
            most, buckets = counted.agg(F.max("count"), F.collect_set("_bucket")).first()  # at most self.buckets numbers
            if not buckets:
                return 0
            if most > 1:
                raise ValueError("a batch has one row a segment")
            stored = self._stored().where(F.col("_bucket").isin(buckets))
            names = [*self.keys, "start"]

            # links of the touched keys, as they are and as they will be; only keys and times are read for it
            touched = changes.select(*self.keys, "_bucket").distinct()
            here = stored.select(*names, *LINKS, *self.parts).alias("s")
            mine = here.join(touched, self._on(here, touched, self.keys), "left_semi")
            stay = mine.join(changes.select(*names, "_bucket"), self._on(mine, changes, names), "left_anti").withColumn("_new", F.lit(False))
            added = changes.where("not gone").select(*names, *[F.lit(None).cast("timestamp_ntz").alias(c) for c in LINKS], *self.parts, F.lit(True).alias("_new"))
            w = Window.partitionBy(*self.keys).orderBy("start")
            linked = stay.unionByName(added).withColumn("_p", F.lag("start").over(w)).withColumn("_n", F.lead("start").over(w))
            moved = linked.where(F.col("_new") | ~F.col("_p").eqNullSafe(F.col(LINKS[0])) | ~F.col("_n").eqNullSafe(F.col(LINKS[1])))
            moved.select(*names, *self.parts, F.col("_p").alias(LINKS[0]), F.col("_n").alias(LINKS[1])).write.parquet(f"{work}/links")
            links = self.spark.read.parquet(f"{work}/links")
            cells = links.select(*self.parts).union(changes.select(*self.parts)).distinct()

            # the rows of those cells: as stored, without what changes, with what is new, and the links that moved
            old = stored.join(cells, self.parts)
            kept = old.join(changes.select(*names, "_bucket"), self._on(old, changes, names), "left_anti")
            rows = kept.select(*names, *self.rest, *LINKS, *self.parts).unionByName(changes.where("not gone").select(*names, *self.rest, *[F.lit(None).cast("timestamp_ntz").alias(c) for c in LINKS], *self.parts))
            other = links.select(*[F.col(c).alias("l_" + c) for c in links.columns])
            on = rows["_bucket"] == other["l__bucket"]
            for n in names:
                on &= rows[n].eqNullSafe(other["l_" + n])
            pick = [F.when(F.col("l_start").isNotNull(), F.col("l_" + c)).otherwise(F.col(c)).alias(c) for c in LINKS]
            whole = rows.join(other, on, "left").select(*names, *self.rest, *pick, *self.parts)
            whole.write.parquet(f"{work}/rows")
            whole = self.spark.read.parquet(f"{work}/rows")
            whole.repartition(*self.parts).write.mode("overwrite").partitionBy(*self.parts).option("partitionOverwriteMode", "dynamic").parquet(self.path)
            # cells that lost all their rows; no more than the batch has
            for r in cells.join(whole.select(*self.parts).distinct(), self.parts, "left_anti").toLocalIterator():
                self._fs(self.path).delete(self._path(f"{self.path}/_bucket={r._bucket}/_cell={quote(str(r._cell))}"), True)
            return cells.count()
        finally:
            self._fs(work).delete(self._path(work), True)


def segment_links(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with prev_start and next_start: what a tape of all its segments holds."""
    w = Window.partitionBy(*keys).orderBy("start")
    return df.withColumn(LINKS[0], F.lag("start").over(w)).withColumn(LINKS[1], F.lead("start").over(w))
