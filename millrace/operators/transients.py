"""How a quantity responds to steps: greatest dip and rise, and the time until it has recovered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.intervals import seconds_between
from millrace.functions.power import deviation_percent


def step_response(steps: DataFrame, readings: DataFrame, keys: list[str], time: str, value: str, nominal: float, horizon: float, band: float, cell: str = "day") -> DataFrame:
    """steps(step_id, keys, time) with n, dip_percent, rise_percent, recovery_seconds from readings(keys, time, value).

    Readings later than a step by up to horizon seconds belong to it. Dip and
    rise are the greatest deviations below and above nominal in percent, 0 at
    least. Recovered: from the first reading after the last one that deviates
    by more than band percent; null if there is none. Steps without readings
    have nulls and n = 0. Steps and readings meet by key and time cell, so a
    hot key is spread over its cells.
    """
    end = F.col(time) + F.expr(f"interval {int(horizon)} seconds")
    cells = F.sequence(F.date_trunc(cell, time).cast("timestamp_ntz"), F.date_trunc(cell, end).cast("timestamp_ntz"), F.expr(f"interval 1 {cell}"))
    asked = steps.select("step_id", *keys, F.col(time).alias("_t0"), F.explode(cells).alias("_cell"))
    seen = readings.where(F.col(value).isNotNull()).select(*keys, F.col(time).alias("_t"), F.date_trunc(cell, time).cast("timestamp_ntz").alias("_cell"), deviation_percent(F.col(value), F.lit(nominal)).alias("_d"))
    age = seconds_between(F.col("_t0"), F.col("_t"))
    met = asked.join(seen, [*keys, "_cell"]).withColumn("_age", age).where((F.col("_age") > 0) & (F.col("_age") <= horizon))
    last_out = F.max(F.when(F.abs(F.col("_d")) > band, F.col("_age"))).over(Window.partitionBy("step_id"))
    met = met.withColumn("_out", F.coalesce(last_out, F.lit(0.0)))
    zero = F.lit(0.0)
    found = met.groupBy("step_id").agg(F.count("*").alias("n"), F.greatest(zero, -F.min("_d")).alias("dip_percent"), F.greatest(zero, F.max("_d")).alias("rise_percent"), F.min(F.when(F.col("_age") > F.col("_out"), F.col("_age"))).alias("recovery_seconds"))
    return steps.join(found, "step_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
