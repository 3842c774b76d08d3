"""Interval joins over cells of rising size, for intervals of any length, and chains of links of any shape."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.intervals import micros
from millrace.sources.tables import shared_folder

#: Cells of level 0 last 2 ** FINEST microseconds (18 minutes); those of level l, 2 ** l times that.
FINEST = 30


def _cells(df: DataFrame, keys: list[str], start: str, stop: str, p: str) -> DataFrame:
    """df with lo, hi (microseconds) and own: the least level at which two cells hold the interval."""
    lo, hi = micros(F.col(start)), micros(F.col(stop))
    live = df.where(F.col(start) < F.col(stop)).select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(p), lo.alias(p + "lo"), (hi - 1).alias(p + "hi"))
    bits = F.length(F.bin(F.col(p + "hi") - F.col(p + "lo")))  # so no cell of that level is shorter than the interval
    own = F.greatest(F.lit(0), bits - FINEST)
    return live.withColumn(p + "own", own)


def _at(df: DataFrame, keys: list[str], p: str, levels: Column) -> DataFrame:
    """One row for each cell, of the levels given, that an interval touches: two at most a level."""
    out = df.withColumn("level", F.explode(levels))
    cell = lambda c: F.expr(f"shiftright({p}{c}, {FINEST} + level)")
    return out.withColumn("cell", F.explode(F.array_distinct(F.array(cell("lo"), cell("hi")))))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """keys, a, b (structs of the other columns), start, stop of each overlap of an interval of a with one of b of the same keys.

    Two intervals meet at the level of the longer one, where it touches two
    cells at most: the longer ones are dealt to their own level, all to the
    levels above theirs that the other side has. So an interval makes two rows
    a level that is in use (30 in 8,000 years), however long it is, and short ones
    do not meet in the cells of the long. The join is on equal values; a hot key
    is spread over its cells. Keys are not null; intervals of no length are left out.
    """
    left, right = _cells(a, keys, start, stop, "a"), _cells(b, keys, start, stop, "b")

    def met(long: DataFrame, lp: str, short: DataFrame, sp: str, strictly: bool) -> DataFrame:
        mine = _at(long, keys, lp, F.array(F.col(lp + "own")))
        # 34 numbers at most, however large the sides are
        levels = long.select(F.col(lp + "own").alias("level")).distinct().agg(F.collect_set("level").alias("_levels"))
        known = short.join(F.broadcast(levels))
        low = F.col(sp + "own") + (1 if strictly else 0)
        theirs = _at(known, keys, sp, F.filter("_levels", lambda level: level >= low)).drop("_levels")
        return mine.join(theirs, [*keys, "level", "cell"])

    both = met(left, "a", right, "b", False).unionByName(met(right, "b", left, "a", True))
    first = F.greatest("alo", "blo")
    both = both.where((first <= F.least("ahi", "bhi")) & (F.expr(f"shiftright(greatest(alo, blo), {FINEST} + level)") == F.col("cell")))
    return both.select(*keys, "a", "b", F.greatest(f"a.{start}", f"b.{start}").alias(start), F.least(f"a.{stop}", f"b.{stop}").alias(stop))


def chain_sums(spark: SparkSession, links: DataFrame, node: str, before: str, value: str, most_rounds: int = 40) -> DataFrame:
    """node, origin, hops, total: for each node the first of its chain, how many links lie between, and the sum of value from the origin on.

    links has one row a node; before is the node that it follows (null, or one
    that is no node, for an origin). Nodes may follow each other in any order
    and share their predecessor. By pointer doubling: each round a node that
    points at p takes over what p points at and the sum that p has gathered, so
    a chain of n links takes log2(n) rounds, each an equi-join staged in the
    shared folder. Both sides of a round grow with the table, so they are
    shuffled: broadcasts would pass the table through the driver once a round.
    Chains that run in a circle raise an error.
    """
    home = f"{shared_folder(spark)}/chains-{uuid.uuid4().hex}"
    nodes = links.select(F.col(node).alias("node"))
    first = links.select(F.col(node).alias("node"), F.col(before).alias("_b"), F.col(value).alias("total"))
    here = first.join(nodes.select(F.col("node").alias("_b"), F.lit(True).alias("_known")).hint("merge"), "_b", "left")
    state = here.select("node", F.when(F.col("_known"), F.col("_b")).alias("at"), F.lit(0).cast("long").alias("hops"), "total", F.col("node").alias("origin"))
    state = state.withColumn("hops", F.when(F.col("at").isNotNull(), 1).otherwise(0).cast("long")).withColumn("origin", F.coalesce("at", "origin"))
    for i in range(most_rounds):
        path = f"{home}/{i:02d}"
        state.write.parquet(path)
        state = spark.read.parquet(path)
        if i:  # the round before is read no longer
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/{i - 1:02d}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        going = state.where("at is not null")
        if not going.limit(1).count():
            return state.select("node", "origin", "hops", "total")
        ahead = state.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), F.col("total").alias("_total"), F.col("origin").alias("_origin"))
        moved = going.join(ahead.hint("merge"), "at").select("node", F.col("_at").alias("at"), (F.col("hops") + F.col("_hops")).alias("hops"), (F.col("total") + F.col("_total")).alias("total"), F.col("_origin").alias("origin"))
        state = state.where("at is null").unionByName(moved)
    raise ValueError(f"chains of more than 2 ** {most_rounds} links, or in a circle")
