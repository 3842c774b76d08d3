"""The status of a device, stabilised and with silence, in batch: the same changes that streaming.status sends out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.intervals import micros
from millrace.operators.running import following, previous, running_sum

DAY = 86_400_000_000


def status_changes(df: DataFrame, keys: list[str], time: str, order: list[str], value: str, level: float, hold: float, stale_after: float, until: Column, bucket: str | None = None) -> DataFrame:
    """keys, at, status: what is reported of each series before `until`, from its readings before `until`.

    A reading is 'high' at level or above, else 'normal'; null and NaN say no
    status, but that the device lives. A status is reported `hold` seconds after
    the first of readings that name it without another between, if none has come
    by then; one that comes at that very moment is too late to stop it. After
    `stale_after` seconds without a reading 'stale' is reported, and nothing
    counts as named. A status that is reported already is not reported again.
    Rows without a time are left out. until is a literal or a scalar subquery. order must tell the rows of a series apart; bucket spreads a hot series.
    """
    far, stand, end = int(stale_after * 1e6), int(hold * 1e6), micros(until)
    number = F.col(value).cast("double")
    named = F.when(number.isNotNull() & ~F.isnan(number), F.when(number >= level, "high").otherwise("normal"))
    kept = dict.fromkeys([*keys, *order, *([bucket] if bucket else [])])
    rows = df.where(F.col(time) < until).select(*kept, micros(F.col(time)).alias("_at"), named.alias("_named"))
    rows = previous(rows, keys, bucket, order, F.col("_at"), "_p")
    rows = following(rows, keys, bucket, order, F.col("_at"), "_n")
    rows = running_sum(rows, keys, bucket, order, F.when(F.col("_p").isNull() | (F.col("_at") - F.col("_p") >= far), 1).otherwise(0), "_era")
    silent = rows.where(F.col("_n").isNull() | (F.col("_n") - F.col("_at") >= far))
    told = previous(rows.where("_named is not null"), [*keys, "_era"], bucket, order, F.col("_named"), "_before")
    # what may be reported: the first reading of a name, and ends of eras
    first = told.where(~F.col("_before").eqNullSafe(F.col("_named"))).select(*dict.fromkeys([*keys, *order]), F.col("_at").alias("_t"), F.lit(1).alias("_kind"), F.col("_named").alias("status"))
    ends = silent.select(*dict.fromkeys([*keys, *order]), (F.col("_at") + far).alias("_t"), F.lit(0).alias("_kind"), F.lit("stale").alias("status"))
    events = first.unionByName(ends).withColumn("_b", F.floor(F.col("_t") / DAY))
    cell, by = "_b" if bucket else None, ["_t", "_kind", *order]
    events = following(events, keys, cell, by, F.col("_t"), "_then")
    due = F.col("_t") + F.when(F.col("_kind") == 1, stand).otherwise(0)
    events = events.withColumn("_due", due).where((F.col("_due") < end) & ((F.col("_kind") == 0) | (F.col("_then") >= F.col("_due"))))
    events = previous(events, keys, cell, by, F.col("status"), "_before")
    events = events.where(~F.col("_before").eqNullSafe(F.col("status")))
    seconds = (F.col("_due").cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)")
    at = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return events.select(*keys, at.alias("at"), "status")
