"""Values at the times of packets: one carry over packets, samples and gaps together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.intervals import micros
from millrace.operators import intervals
from millrace.operators.gaps import FOREVER
from millrace.operators.running import last_known


def anchored_fill(packets: DataFrame, samples: DataFrame, gaps: DataFrame, keys: list[str], time: str, tie: str, value: str, tolerance: float, max_age: float, cell: str | None = None) -> DataFrame:
    """packets with filled, carried and in_gap: what a sampled value was when each packet came.

    A device sends packets all the time and a sample only when its value
    changes. A sample belongs to the packets that come from `tolerance` seconds
    before it (half a period) to max_age after it, as long as no later one
    does and no gap overlaps the time between it and the packet. carried: it
    is more than `tolerance` away. In a gap nothing is filled (in_gap). Of
    samples at one time the greatest tie counts; null samples say nothing.

    Packets (keys, time, tie, ...), samples (keys, time, tie, value) and gaps
    (keys, start, stop; null: without an end) are merged and sorted once;
    cell ('day') spreads a hot series.
    """
    near = int(tolerance * 1e6)
    early = F.col(time) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(tolerance))
    ends = gaps.withColumn("stop", F.coalesce("stop", F.lit(FOREVER).cast("timestamp_ntz")))
    holes = intervals.merge(ends.select(*keys, "start", "stop"), keys, cell=cell)
    rest = [c for c in packets.columns if c not in (*keys, time, tie)]
    a = packets.select(*keys, F.col(time).alias("_t"), F.lit(2).alias("_side"), F.col(tie).alias("_tie"), F.struct(F.lit(1).alias("_"), *rest).alias("_p"))
    b = samples.where(F.col(value).isNotNull()).select(*keys, early.alias("_t"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"), F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("_s"))
    c = holes.select(*keys, F.col("start").alias("_t"), F.lit(0).alias("_side"), F.struct("start", "stop").alias("_g"))
    both = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    both = both if cell is None else both.withColumn("_cell", F.date_trunc(cell, "_t"))
    bucket, order = None if cell is None else "_cell", ["_t", "_side", "_tie"]
    both = last_known(both, keys, bucket, order, F.col("_s"), "_last")
    both = last_known(both, keys, bucket, order, F.col("_g"), "_gap").where("_side = 2")
    age = micros(F.col("_t")) - micros(F.col("_last.t"))
    in_gap = F.coalesce(F.col("_gap.stop") > F.col("_t"), F.lit(False))
    cut = F.coalesce(F.col("_gap.stop") > F.col("_last.t"), F.lit(False))
    usable = F.coalesce((age <= int(max_age * 1e6)) & ~cut & ~in_gap, F.lit(False))
    return both.select(
        *keys, F.col("_t").alias(time), F.col("_tie").alias(tie), *[F.col(f"_p.{x}").alias(x) for x in rest],
        F.when(usable, F.col("_last.v")).alias("filled"), (usable & (F.abs(age) > near)).alias("carried"), in_gap.alias("in_gap"),
    )
