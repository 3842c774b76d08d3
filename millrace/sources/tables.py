"""Reading and writing tables: checked schemas, rejected rows, partitioned files, merged snapshots."""

from __future__ import annotations

import tempfile
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share; a local session without it gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or _own_folder()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="millrace-")


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None, kind: str = "parquet", **options) -> DataFrame:
    """A table of parquet, csv or json files; csv and json need a schema, so no pass infers one."""
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown kind of files: {kind}")
    if schema is None and kind != "parquet":
        raise ValueError(f"{kind} files need a schema")
    reader = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}), **options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def split_rejects(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet every rule, and the rest with the names of the rules they break (null counts as broken)."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(name)) for name, r in rules.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("broken_rules", broken)
    return marked.where(F.size("broken_rules") == 0).drop("broken_rules"), marked.where(F.size("broken_rules") > 0)


def typed_readings(df: DataFrame, value: str = "value") -> DataFrame:
    """value as a finite double: what does not parse, NaN and infinities become null."""
    number = F.expr(f"try_cast(`{value}` AS double)")
    return df.withColumn(value, F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number))


def write_partitioned(df: DataFrame, path: str, by: list[str], rows_per_file: int = 5_000_000) -> None:
    """Overwrites the partitions that df has and leaves the others; large partitions go to several files."""
    writer = df.repartition(*by, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").partitionBy(*by)
    writer.option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).parquet(path)


def merge_snapshot(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The rows of both by key, the greatest version winning and the new row where versions tie."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    newest = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_i", F.row_number().over(newest)).where("_i = 1").drop("_i", "_new")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Tables one below the other by column name; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _paired(old: DataFrame, new: DataFrame, keys: list[str], how: str) -> DataFrame:
    side = lambda df, p: df.select(*[F.col(k).alias(p + k) for k in keys], F.struct(*[c for c in df.columns if c not in keys]).alias(p), F.lit(True).alias(p + "here"))
    return side(old, "o_").join(side(new, "n_"), [F.col("o_" + k).eqNullSafe(F.col("n_" + k)) for k in keys], how)


def fill_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, with nulls filled from the new row of the same key, and the rows of new keys; one row a key on either side."""
    both = _paired(old, new, keys, "full_outer")
    names = [F.when(F.col("o_here"), F.col("o_" + k)).otherwise(F.col("n_" + k)).alias(k) for k in keys]
    return both.select(*names, *[F.coalesce(F.col(f"o_.{c}"), F.col(f"n_.{c}")).alias(c) for c in old.columns if c not in keys])


def merge_open(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, with what the new row of the same key has in place of it where that is not null, and the rows of new keys; one row a key on either side.

    Columns that only old has are kept, and are null in rows of new keys; columns that only new has are left out.
    """
    both = _paired(old, new, keys, "full_outer")
    names = [F.when(F.col("o_here"), F.col("o_" + k)).otherwise(F.col("n_" + k)).alias(k) for k in keys]
    rest = [c for c in old.columns if c not in keys]
    return both.select(*names, *[(F.coalesce(F.col(f"n_.{c}"), F.col(f"o_.{c}")) if c in new.columns else F.col(f"o_.{c}")).alias(c) for c in rest]).select(*old.columns)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old as it is, and the rows of new whose keys it lacks: values are set once."""
    lacking = _paired(new, old, keys, "left_anti")
    return old.unionByName(lacking.select(*[F.col("o_" + k).alias(k) for k in keys], "o_.*").select(*old.columns))


def delete_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of old whose keys `gone` does not have; null is a key."""
    return _paired(old, gone, keys, "left_anti").select(*[F.col("o_" + k).alias(k) for k in keys], "o_.*").select(*old.columns)
