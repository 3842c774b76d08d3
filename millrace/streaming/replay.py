"""Replays of a table as late deliveries with a restart between, and how far their result is from the whole table's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from millrace.functions.intervals import micros


def replay(df: DataFrame, time: str, tie: str, late: int, n: int, folder: str, run: Callable[[str], None]) -> None:
    """Delivers df in n parts to `folder`, as parquet; run(folder) goes on reading, after the first half and after the last.

    A row arrives up to `late` seconds after its time, by a hash of `tie`; the
    parts are equal spans of arrival. Rows without a time come last. df is read once a part, so have it staged.
    """
    arrival = micros(F.col(time)) + F.pmod(F.xxhash64(tie), F.lit(late)) * 1_000_000
    low, high = df.agg(F.min(arrival), F.max(arrival)).first()
    span = max(1, ((high or 0) - (low or 0)) // n + 1)
    part = F.coalesce(F.floor((arrival - F.lit(low or 0)) / span), F.lit(n - 1))
    for i in range(n):
        df.where(part == i).write.mode("append").parquet(folder)
        if i in (n // 2 - 1, n - 1):
            run(folder)


def _apart(a: Column, b: Column, number: bool) -> Column:
    """0 where two values are the same, nulls and NaN too; else 1, or for numbers the difference by the greater size."""
    off = F.lit(1.0)
    if number:
        a, b = a.cast("double"), b.cast("double")
        off = F.coalesce(F.nanvl(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)), F.lit(1.0)), F.lit(1.0))
    return F.when(a.eqNullSafe(b), 0.0).otherwise(off)


def parity(full: DataFrame, replayed: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """field, n, off, worst: for each column beside the keys, over the keys of either side, how many are further apart than tolerance, and the most.

    Field 'rows' has how many rows a key has; of repeated ones the least value of each
    field is compared. Null keys agree. A key that one side lacks is off in every field. No rows: worst is 0.
    """
    fields = [c for c in full.columns if c not in keys]
    side = lambda df, mark: df.groupBy(*[F.col(k).alias(f"{mark}_{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias(f"{mark}n"), *[F.min(c).alias(f"{mark}{i}") for i, c in enumerate(fields)])
    on = [F.col(f"a_{i}").eqNullSafe(F.col(f"b_{i}")) for i in range(len(keys))]
    both = side(full, "a").join(side(replayed, "b"), on, "full")
    lacks = F.col("an").isNull() | F.col("bn").isNull()
    apart = {"rows": _apart(F.col("an"), F.col("bn"), True)}
    for i, c in enumerate(fields):
        number = isinstance(full.schema[c].dataType, NumericType)
        apart[c] = F.when(lacks, 1.0).otherwise(_apart(F.col(f"a{i}"), F.col(f"b{i}"), number))
    sums = [F.struct(F.lit(c).alias("field"), F.count("*").alias("n"), F.count_if(d > tolerance).alias("off"), F.coalesce(F.max(d), F.lit(0.0)).alias("worst")) for c, d in apart.items()]
    return both.agg(F.array(*sums).alias("f")).select(F.inline("f"))
