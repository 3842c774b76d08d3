"""Exact medians of groups of any size: ranks found by counts of ever longer prefixes of the values."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.running import beside
from millrace.sources.tables import shared_folder

#: Bits of a whole number that one round decides; a window then holds 2 ** DIGIT counts at most.
DIGIT = 16
#: A group's values are dealt to so many parts, so that no task gets all of them.
SALTS = 32


def values_at_ranks(counts: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, which, value: the value at each rank (from 1) of wanted(keys, which, rank) among counts(keys, value long, n), one row a value.

    Four rounds of 16 bits: each counts the values that share what is known of
    the wanted ones by their next 16 bits, and picks the bits where the rank
    falls. What moves is counts, combined before the exchange, and the wanted
    ranks; the values themselves stay spread over (key, part).
    """
    salt = F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int")
    spread = counts.select(*keys, "value", "n", salt.alias("_salt"))
    state = wanted.select(*keys, "which", F.col("rank").alias("_left"), F.lit(0).cast("long").alias("_prefix"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        first = shift + DIGIT == 64
        prefix = F.lit(0).cast("long") if first else F.shiftright("value", shift + DIGIT)
        # the leading digit has the sign; the others are plain
        digit = F.shiftright("value", shift) if first else F.shiftright("value", shift).bitwiseAND(2**DIGIT - 1)
        live = spread.withColumn("_prefix", prefix)
        if not first:
            known = state.select(*keys, "_prefix").distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            live = beside(live, known, [*keys, "_prefix", "_salt"], "left_semi")
        found = live.groupBy(*keys, "_prefix", digit.alias("_digit")).agg(F.sum("n").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*keys, "_prefix").orderBy("_digit"))
        state = beside(state, found.withColumn("_upto", upto), [*keys, "_prefix"], "inner").where("_left <= _upto and _left > _upto - _n")
        longer = F.col("_digit") if first else F.shiftleft("_prefix", DIGIT).bitwiseOR(F.col("_digit"))
        state = state.select(*keys, "which", (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"), longer.alias("_prefix"))
    return state.select(*keys, "which", F.col("_prefix").alias("value"))


def _twice_median(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, n, name: the sum of the two middle values of each group (twice the one, if n is odd)."""
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("n"))
    middle = F.array(F.struct(F.lit(0).alias("which"), F.expr("(n + 1) div 2").alias("rank")), F.struct(F.lit(1).alias("which"), F.expr("n div 2 + 1").alias("rank")))
    wanted = sizes.select(*keys, F.explode(middle).alias("_m")).select(*keys, "_m.*")
    both = values_at_ranks(counts, wanted, keys).groupBy(*keys).agg(F.sum("value").alias(name))
    return beside(sizes, both, keys, "inner")


def exact_spread(spark: SparkSession, df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, median, mad (double) of a whole-number column (below 2 ** 61) by group; nulls are left out.

    Both are exact. No task holds a group's distinct values: a group that has
    all rows is counted in parts. The counts by value are staged, as they are read nine times.
    """
    home = f"{shared_folder(spark)}/ranks-{uuid.uuid4().hex}"
    df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("long").alias("value")).agg(F.count("*").alias("n")).write.parquet(f"{home}/values")
    counts = spark.read.parquet(f"{home}/values")
    _twice_median(counts, keys, "_twice").write.parquet(f"{home}/medians")
    medians = spark.read.parquet(f"{home}/medians")
    every = medians.select(*keys, "_twice", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = counts.withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int"))
    off = beside(salted, every, [*keys, "_salt"], "inner").select(*keys, F.abs(2 * F.col("value") - F.col("_twice")).alias("value"), "n")
    off.groupBy(*keys, "value").agg(F.sum("n").alias("n")).write.parquet(f"{home}/distances")
    mads = _twice_median(spark.read.parquet(f"{home}/distances"), keys, "_four").drop("n")
    both = beside(medians, mads, keys, "inner")
    return both.select(*keys, "n", (F.col("_twice") / 2).alias("median"), (F.col("_four") / 4).alias("mad"))
