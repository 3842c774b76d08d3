"""Mixing sources to target word counts by Efraimidis-Spirakis sampling.

All of it is DataFrame expressions. Each source gets a target by weight; whole
epochs of a source come first, the rest of its target is a weighted sample
without replacement: exponential keys -ln(u) / quality, smallest first, summed
up to the budget. The prefix sum has two levels: key ranges of a source are
summed and ranked, and only rows of one range are ever sorted together, so a
source that holds a third of all rows is spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, Staging, n_words

#: Key ranges per source.
RANGES = 4096


def uniform(*parts: Column) -> Column:
    """In (0, 1), from the first 13 hex digits of an MD5: the same wherever MD5 is."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """sources(source, source_size) -> with weight, target.

    By code point, null last, the weights repeat over the sources. Targets are
    in proportion to weight and sum to share of all sizes; none is above most
    times its size, what is cut there goes to the others by weight. In order of
    size / weight the capped sources come first, so one pass of prefix sums
    finds the level where resharing ends.
    """
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    up = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("place"))
    below = up.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    out = sources.withColumn("place", F.row_number().over(by_name) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    total = F.sum("source_size").over(every) * F.lit(share)
    size_below = F.coalesce(F.sum("source_size").over(below), F.lit(0))
    weight_from = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    out = out.withColumn("level", (total - F.lit(most) * size_below) / weight_from)
    # the first source whose cap is above its share sets the level of all after it
    out = out.withColumn("free", F.col("level") * F.col("weight") <= F.lit(most) * F.col("source_size"))
    out = out.withColumn("level", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.lit(most) * F.col("source_size")).otherwise(F.col("level") * F.col("weight"))
    return out.select("source", "source_size", "weight", target.cast("double").alias("target"))


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: str = "mix", ranges: int = RANGES, staging: Staging | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text, source): doc_id, source, size, source_size, weight, target, epochs, taken.

    size: words of the text. quality(doc_id, quality) holds positive sampling
    weights; documents without one get 1. taken: epochs * size, plus size if
    the sample of the last, partial epoch holds the document, plus fewer for
    the document at its edge, whose first words fill the budget.

    Null and blank texts have size 0 and take nothing. Null is a source of its
    own. Rows that share an id are separate rows; ties in the key fall back on
    id and size, and rows equal in these are interchangeable. Where quality
    repeats an id, its largest value counts; null, non-finite or non-positive
    values count as 1. Extra columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    st = staging or Staging(spark, "mixing")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("text|"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))).alias("told"), F.col("source").cast("string").alias("source"), n_words(text).alias("size"))
    if quality is not None:
        q = quality.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
        rows = rows.join(q.where("quality > 0 and quality < double('inf')").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    else:
        rows = rows.withColumn("quality", F.lit(1.0))
    q = F.coalesce(F.col("quality"), F.lit(1.0))
    u = uniform(F.lit(seed), F.col("told"))
    # -ln(u) / quality rises as u ** (1 / quality) falls, and 1 - that lies in (0, 1): its slices are the ranges
    slice_ = F.least(F.lit(ranges - 1), F.floor((1 - F.pow(u, 1 / q)) * ranges))
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    rows = st.put(rows.select("doc_id", "text_key", "source", "size", name.alias("name"), (-F.log(u) / q).alias("key"), slice_.cast("int").alias("slice")), "sizes")

    slices = rows.groupBy("name", "slice").agg(F.sum("size").alias("slice_size"), F.first("source").alias("source"))
    slices = slices.withColumn("before", F.coalesce(F.sum("slice_size").over(Window.partitionBy("name").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sources = slices.groupBy("name").agg(F.sum("slice_size").alias("source_size"), F.first("source").alias("source"))
    plan = source_targets(sources.select("source", "source_size"), weights, share, most)
    plan = plan.withColumn("name", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    slices = slices.select("name", "slice", "slice_size", "before").join(plan.select("name", "source_size", "weight", "target", "epochs", "rest"), "name")

    out = rows.join(slices, ["name", "slice"])
    whole, none = F.col("before") + F.col("slice_size") <= F.col("rest"), F.col("before") >= F.col("rest")
    edge = out.where(~whole & ~none)
    order = Window.partitionBy("name", "slice").orderBy("key", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    shape = ["doc_id", "text_key", "source", "size", "source_size", "weight", "target", "epochs"]
    taken = lambda extra: (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken")
    return out.where(whole | none).select(*shape, taken(F.when(whole, F.col("size")).otherwise(F.lit(0)))).unionByName(edge.select(*shape, taken(part)))


_ORDERED = ("bigint", "int", "smallint", "tinyint", "string", "double", "float", "date", "timestamp", "timestamp_ntz", "boolean")


def first_words(text: Column, k: Column) -> Column:
    """The text up to its k-th word, with the blanks between as they are."""
    blank = r"[\x20\x09-\x0D]"
    words = F.split(F.regexp_replace(text, f"^{blank}+|{blank}+$", ""), f"(?<={blank})(?!{blank})")
    return F.regexp_replace(F.array_join(F.slice(words, F.lit(1), k.cast("int")), ""), f"{blank}+$", "")


def mixed_rows(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as taken; the partial one cut to its words.

    Rows with the same id, text and source are one document, whose takings are
    summed up: nulls and ids that repeat with other texts make no difference.
    Null and blank texts are not in the mix. docs may have other columns of any
    name; the repeated row with the least of them stands for all.
    """
    same = ["id", "text_key", "name"]
    keys = lambda at: [F.coalesce(F.col(at + "doc_id").cast("long").cast("string"), F.lit("null")).alias("id"), F.coalesce(F.concat(F.lit("s"), F.col(at + "source").cast("string")), F.lit("null")).alias("name")]
    plan = mix_sources(docs, quality, **options).where("taken > 0").select(*keys(""), "text_key", "size", "taken")
    plan = plan.groupBy(*same).agg(F.max("size").alias("size"), F.sum("taken").alias("taken"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")).where(F.col("d.text").cast("string").rlike(WORD))
    row = row.select("d", *keys("d."), F.xxhash64(F.col("d.text").cast("string")).alias("text_key"))
    # repeated rows come down to one before the exchange
    least = F.struct(*[F.col(f"d.`{c}`") for c in docs.columns if c != "text" and docs.schema[c].dataType.simpleString() in _ORDERED])
    out = row.groupBy(*same).agg(F.min_by("d", least).alias("d")).join(plan, same)
    full, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), F.col("taken") % F.col("size")
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), full), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    out = out.select("d", F.explode(copies).alias("cut"))
    text = F.when(F.col("cut") < 0, F.col("d.text")).otherwise(first_words(F.col("d.text"), F.col("cut")))
    return out.select(*[text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
