"""Alarm episodes in batch: the same pieces that streaming.lifecycles sends out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.intervals import micros
from millrace.operators.running import beside, last_known, previous, running_sum


def _day() -> Column:
    return F.expr("interval 1 day")


def _days(first: Column, last: Column) -> Column:
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")
    return F.when(day(first) <= day(last), F.sequence(day(first), day(last), _day())).otherwise(F.array())


def episode_pieces(df: DataFrame, keys: list[str], time: str, order: list[str], value: str, level: float, clear_after: int, silent: float, pause: float, until: Column, bucket: str | None = None) -> DataFrame:
    """keys, opened, part, start, stop, reason, worst, n, covered of the readings before `until`.

    An episode opens with a reading at level or above. It closes as of the first
    of clear_after readings in a row below it ('cleared'), or, when more than
    `silent` seconds pass without a reading (before `until`), as of the first
    reading below it since the last one above, if any, else as of that one ('silent'). It is
    cut at midnights ('day'); of one that is open, the pieces before its last
    reading's day are returned. covered: seconds between readings at most
    `pause` apart; n and worst: its readings at level or above. Null and NaN
    are not readings. bucket spreads a hot series.
    """
    far = int(silent * 1e6)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.col(time) < until)).withColumn("_hit", F.col(value) >= level)
    rows = previous(rows, keys, bucket, order, F.col(time), "_p")
    rows = running_sum(rows, keys, bucket, order, F.when(F.col("_p").isNull() | (micros(F.col(time)) - micros(F.col("_p")) > far), 1).otherwise(0), "_era")
    rows = running_sum(rows, keys, bucket, order, F.lit(1), "_i")
    within = [*keys, "_era"]
    rows = last_known(rows, within, bucket, order, F.when(F.col("_hit"), F.col("_i")), "_at")
    rows = rows.withColumn("_m", F.col("_i") - F.col("_at"))
    over = F.when(F.col("_m") == clear_after, 1).otherwise(0)
    rows = running_sum(rows, within, bucket, order, over, "_ep").withColumn("_ep", F.col("_ep") - over)

    one = [*within, "_ep"]
    found = rows.groupBy(*one).agg(
        F.min(F.when(F.col("_hit"), F.col(time))).alias("opened"), F.max(F.when(F.col("_hit"), F.struct(F.col("_i").alias("i"), F.col(time).alias("t")))).alias("_last"),
        F.max(F.when(F.col("_m") == 1, F.struct(F.col("_i").alias("i"), F.col(time).alias("t")))).alias("_miss"), F.max(over).alias("_over"),
    ).where("opened is not null")
    heard = rows.groupBy(*within).agg(F.max(time).alias("_heard"), F.first(until).alias("_now"))
    found = beside(found, heard, within, "inner")
    reason = F.when(F.col("_over") == 1, "cleared").when(micros(F.col("_heard")) + far < micros(F.col("_now")), "silent")
    found = found.withColumn("reason", reason).withColumn("stop", F.when(F.col("_miss.i") > F.col("_last.i"), F.col("_miss.t")).otherwise(F.col("_last.t")))
    found = found.withColumn("_until", F.when(F.col("reason").isNull(), F.col("_last.t")).otherwise(F.col("stop")))

    # the last piece: at a midnight sharp there is one only for a reading that is part of the episode
    sharp = (F.date_trunc("day", "stop").cast("timestamp_ntz") == F.col("stop")) & (F.col("_last.t") < F.col("stop"))
    final = F.when(F.col("reason").isNull(), F.col("_last.t") - _day()).when(sharp, F.col("stop") - _day()).otherwise(F.col("stop"))
    pieces = found.withColumn("_n", F.size(_days(F.col("opened"), final))).select(*one, "opened", "reason", "stop", "_n", F.posexplode(_days(F.col("opened"), final)).alias("_k", "_day"))
    last = F.col("reason").isNotNull() & (F.col("_k") == F.col("_n") - 1)
    pieces = pieces.select(
        *one, "_day", "opened", (F.col("_k") + 1).alias("part"), F.greatest("opened", "_day").alias("start"),
        F.when(last, F.col("stop")).otherwise(F.col("_day") + _day()).alias("stop"), F.when(last, F.col("reason")).otherwise("day").alias("reason"),
    )

    day = F.date_trunc("day", time).cast("timestamp_ntz").alias("_day")
    hits = rows.where("_hit").groupBy(*one, day).agg(F.max(F.col(value).cast("double")).alias("worst"), F.count("*").alias("n"))
    near = rows.where(F.col("_p").isNotNull() & (micros(F.col(time)) - micros(F.col("_p")) <= int(pause * 1e6))).select(*one, "_p", F.col(time).alias("_t"))
    near = beside(near, found.select(*one, "opened", "_until"), one, "inner").where("_t > opened and _t <= _until")
    near = near.select(*one, "_p", "_t", F.explode(_days(F.col("_p"), F.col("_t"))).alias("_day"))
    held = micros(F.least(F.col("_t"), F.col("_day") + _day())) - micros(F.greatest("_p", "_day"))
    covered = near.groupBy(*one, "_day").agg(F.sum(held).alias("covered"))

    out = beside(beside(pieces, hits, [*one, "_day"]), covered, [*one, "_day"])
    return out.select(*keys, "opened", "part", "start", "stop", "reason", "worst", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("covered", F.lit(0)) / 1e6).alias("covered"))
