"""An incremental source: rows of parquet files in order of when they arrived, each exactly once.

The offset is the last row taken, as (arrival time, tie), so rows that share the
last arrival time are neither lost nor read again, even if some of them appear
only after the others were read. Rows are taken once they are `settle` seconds
old, so writers that are a little late lose nothing. Footers are read on the
driver, where new files are looked for; rows are read by tasks, from the row
groups whose arrival times meet the batch.

    spark.dataSource.register(ArrivalSource)
    spark.readStream.format("arrivals").schema(...).options(path=..., arrival="received_at", tie="event_id").load()
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

_EPOCH = datetime.datetime(1970, 1, 1)
BEFORE_ALL = -(2**62)


def _micros(value) -> int | None:
    """A moment of a footer's statistics or of an option; zones count, moments without one are UTC."""
    if value is None:
        return None
    if isinstance(value, str):
        value = datetime.datetime.fromisoformat(value)
    if value.tzinfo is not None:
        value = value.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return (value - _EPOCH) // datetime.timedelta(microseconds=1)


class RowGroup(InputPartition):
    """A row group with its least and greatest arrival time, and the offsets between which a batch takes its rows."""

    def __init__(self, path, group, low, high, start=(BEFORE_ALL, BEFORE_ALL), end=(BEFORE_ALL, BEFORE_ALL)):
        super().__init__(None)
        self.path, self.group, self.low, self.high, self.start, self.end = path, group, low, high, start, end


class ArrivalSource(DataSource):
    """Options: path (a folder, by pyarrow's file systems), arrival (a timestamp column), tie (a whole-number column that tells rows of one arrival time apart), settle (seconds, 0), since (a moment; rows that arrived before it are left out), clock (a moment to take for now, for replays)."""

    @classmethod
    def name(cls) -> str:
        return "arrivals"

    def schema(self) -> StructType:
        reader = ArrivalReader(self.options, None)
        first = next(iter(reader.files()), None)
        if first is None:
            raise ValueError(f"no parquet file in {self.options['path']}: give a schema")
        return from_arrow_schema(pq.read_schema(first.path, filesystem=reader.fs), prefer_timestamp_ntz=True)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ArrivalReader(self.options, schema)


class ArrivalReader(DataSourceStreamReader):
    def __init__(self, options, schema: StructType | None) -> None:
        missing = [o for o in ("path", "arrival", "tie") if o not in options]
        if missing:
            raise ValueError(f"options missing: {', '.join(missing)}")
        self.path, self.arrival, self.tie = options["path"], options["arrival"], options["tie"]
        self.settle, self.clock = float(options.get("settle", 0)), options.get("clock")
        self.since = _micros(options.get("since"))
        self.target = None if schema is None else to_arrow_schema(schema)
        self.known: dict[tuple, list[RowGroup]] = {}

    @property
    def fs(self) -> pafs.FileSystem:
        return self._place()[0]

    def _place(self) -> tuple[pafs.FileSystem, str]:
        if self.path.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + self.path[5:].lstrip("/")
        if "://" in self.path:
            return pafs.FileSystem.from_uri(self.path)
        return pafs.LocalFileSystem(), self.path

    def files(self) -> list[pafs.FileInfo]:
        fs, folder = self._place()
        found = fs.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True))
        hidden = lambda p: any(part.startswith(("_", ".")) for part in p[len(folder) :].split("/"))
        return sorted((f for f in found if f.is_file and f.path.endswith(".parquet") and not hidden(f.path)), key=lambda f: f.path)

    def groups(self) -> list[RowGroup]:
        """All row groups that have an arrival time; the footers of files seen before are kept."""
        fs, out = self.fs, {}
        for f in self.files():
            key = (f.path, f.size, f.mtime_ns)
            out[key] = self.known.get(key) or self._footer(fs, f.path)
        self.known = out
        return [g for groups in out.values() for g in groups]

    def _footer(self, fs: pafs.FileSystem, path: str) -> list[RowGroup]:
        file = pq.ParquetFile(path, filesystem=fs)
        at = file.schema_arrow.names.index(self.arrival)
        out = []
        for i in range(file.num_row_groups):
            stats = file.metadata.row_group(i).column(at).statistics
            if stats is not None and stats.has_min_max:
                low, high = _micros(stats.min), _micros(stats.max)
            else:
                times = self._times(file.read_row_group(i, [self.arrival]))
                low, high = pc.min(times).as_py(), pc.max(times).as_py()
            if low is not None:
                out.append(RowGroup(path, i, low, high))
        return out

    def _times(self, table: pa.Table) -> pa.ChunkedArray:
        return table.column(self.arrival).cast(pa.timestamp("us", getattr(table.schema.field(self.arrival).type, "tz", None))).cast(pa.int64())

    def initialOffset(self) -> dict:
        return {"at": BEFORE_ALL if self.since is None else self.since - 1, "tie": 2**62 if self.since is not None else BEFORE_ALL}

    def latestOffset(self) -> dict:
        """The last row that has settled."""
        now = _micros(self.clock) if self.clock else _micros(datetime.datetime.now(datetime.timezone.utc))
        settled, fs = now - int(self.settle * 1e6), self.fs
        best = (BEFORE_ALL, BEFORE_ALL)
        # groups in order of their greatest time: most need not be opened
        for g in sorted(self.groups(), key=lambda g: -g.high):
            if g.low > settled:
                continue
            if g.high < best[0]:
                break
            table = pq.ParquetFile(g.path, filesystem=fs).read_row_group(g.group, [self.arrival, self.tie])
            times, ties = self._times(table), table.column(self.tie).cast(pa.int64())
            ok = pc.and_(pc.less_equal(times, settled), pc.is_valid(ties))
            times, ties = times.filter(ok), ties.filter(ok)
            if len(times):
                at = pc.max(times).as_py()
                best = max(best, (at, pc.max(ties.filter(pc.equal(times, at))).as_py()))
        first = self.initialOffset()
        return max(({"at": best[0], "tie": best[1]}, first), key=lambda o: (o["at"], o["tie"]))

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        lo, hi = (start["at"], start["tie"]), (end["at"], end["tie"])
        return [RowGroup(g.path, g.group, g.low, g.high, lo, hi) for g in self.groups() if lo < hi and g.high >= lo[0] and g.low <= hi[0]]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        file = pq.ParquetFile(partition.path, filesystem=self.fs)
        names = list(dict.fromkeys([*self.target.names, self.arrival, self.tie]))
        for batch in file.iter_batches(row_groups=[partition.group], columns=names):
            table = pa.Table.from_batches([batch])
            times, ties = self._times(table), table.column(self.tie).cast(pa.int64())
            after = lambda t: pc.or_(pc.greater(times, t[0]), pc.and_(pc.equal(times, t[0]), pc.greater(ties, t[1])))
            taken = pc.fill_null(pc.and_(after(partition.start), pc.invert(after(partition.end))), False)
            kept = table.filter(taken).select(self.target.names)
            if len(kept):
                yield from kept.cast(self.target).combine_chunks().to_batches()


def read_arrivals(spark, path: str, schema: str | StructType, arrival: str, tie: str, **options):
    """The source as a stream; options as in ArrivalSource."""
    spark.dataSource.register(ArrivalSource)
    return spark.readStream.format("arrivals").schema(schema).options(path=path, arrival=arrival, tie=tie, **options).load()


def replicate(stream, path: str, log: str):
    """Appends what is there to parquet at path and stops; called again with the same log, it goes on from there."""
    running = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).trigger(availableNow=True).start()
    running.awaitTermination()
    if running.exception():
        raise running.exception()
