"""Nested JSON documents: rows with their parts as one text each, and back, with what does not parse set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.running import beside

#: Times as text to the microsecond, so that a document gives back what it was made of.
OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def documents(rows: DataFrame, parts: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    """keys, document: each row of `rows` as JSON, with its parts as an array `name`, sorted by `order` (nulls first).

    The parts of one row must fit a document; a row without any has an empty
    array, parts without a row are left out. Null keys agree; one row a key.
    """
    inner = [*order, *[c for c in parts.columns if c not in keys and c not in order]]
    gathered = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*inner))).alias(name))
    both = beside(rows, gathered, keys)
    empty = F.array().cast(gathered.schema[name].dataType)
    both = both.withColumn(name, F.coalesce(F.col(name), empty))
    return both.select(*keys, F.to_json(F.struct(*rows.columns, name), OPTIONS).alias("document"))


def read_documents(df: DataFrame, document: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """The documents' fields beside df's other columns, as `fields`, and the rows whose text is no such document (null texts too)."""
    shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = T.StructType([*shape.fields, T.StructField("_broken", T.StringType())])
    read: Column = F.from_json(document, kept, {**OPTIONS, "columnNameOfCorruptRecord": "_broken"})
    marked = df.withColumn("_read", read)
    good = F.col("_read").isNotNull() & F.col("_read._broken").isNull() & F.col(document).isNotNull()
    fields = F.struct(*[F.col(f"_read.`{f.name}`").alias(f.name) for f in shape.fields])
    return marked.where(good).select(*[c for c in df.columns if c != document], fields.alias("fields")), marked.where(~good).drop("_read")
