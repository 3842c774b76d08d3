"""From raw documents to packed sequences, in five stages.

language_id      documents without a language (no text, no letter) go; a null lang becomes the one predicted
near_dedup       one document of each near-duplicate group stays
substring_dedup  passages of 35 words and more that also stand elsewhere go; documents left without words go
mixing           sources are repeated and sampled to their target weights
packing          the mix is tokenised and packed; returns pieces

Each stage reads the rows its predecessor wrote, takes (spark, docs, sf_dir),
and returns documents' columns; the last returns one row per packed piece.

A row is known by its id and a hash of its text: null ids and ids that repeat
with other texts are documents of their own in every stage. Any column may be
null, texts may be empty or very long, columns that documents does not have are
left out whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import DOCUMENT_COLUMNS, WORD, Staging, staged_here, table
from millrace.llm.langid import identify
from millrace.llm.mixing import mixed_rows
from millrace.llm.neardup import near_duplicate_groups
from millrace.llm.packing import pack_documents
from millrace.llm.queries import label_quality
from millrace.llm.substring import substring_dedup


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long").cast("string"), F.lit("null"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows of docs as d, beside their id as text (null is one) and the hash of their text."""
    return docs.select(F.struct(*DOCUMENT_COLUMNS).alias("d"), _id(F.col("doc_id")).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key"))


def _retold(text: Column) -> list[Column]:
    """documents' columns of d with another text, and n_chars to match."""
    n = F.when(text.eqNullSafe(F.col("d.text")), F.col("d.n_chars")).otherwise(F.length(text).cast("long"))
    return [{"text": text.alias("text"), "n_chars": n.alias("n_chars")}.get(c, F.col(f"d.{c}")) for c in DOCUMENT_COLUMNS]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that get a language, and gives it to those without one; null, empty and letterless texts go. Repeated rows stay."""
    said = identify(docs, carry=DOCUMENT_COLUMNS).where("lang_pred <> 'und'")
    return said.select(*[F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"row.{c}") for c in DOCUMENT_COLUMNS])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: that with the least id, then the least hash of the text; null ids come last.

    Rows that repeat a text are one group, whatever their ids. Of rows that are
    equal in id and text, that with the least other columns stays. Rows without
    words are in no group and stay.
    """
    rows = near_duplicate_groups(docs).where("root is not null")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    first = rows.groupBy("root").agg(F.min(place).alias("p")).select(_id(F.col("p.doc_id")).alias("id"), F.col("p.key").alias("key"))
    worded = F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    # repeated rows come down to one before the exchange, which then serves the join too
    rest = F.struct(*[F.col(f"d.{c}") for c in DOCUMENT_COLUMNS if c != "text"])
    one = _keyed(docs.where(worded)).groupBy("id", "key").agg(F.min_by("d", rest).alias("d"))
    return one.join(first, ["id", "key"]).select("d.*").unionByName(docs.where(~worded).select(*DOCUMENT_COLUMNS))


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; a document that loses every word goes, as do repeated rows (all their words repeat)."""
    cut = substring_dedup(docs).where("n_removed > 0").select(_id(F.col("doc_id")).alias("id"), "key", "kept_text", (F.col("n_removed") == F.col("n_words")).alias("gone")).dropDuplicates(["id", "key"])
    rows = _keyed(docs).join(cut, ["id", "key"], "left")
    return rows.where("gone is null or not gone").select(*_retold(F.coalesce("kept_text", "d.text")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents to the sources' target weights; null and blank texts, which weigh nothing, go."""
    mixed = mixed_rows(docs.select(*DOCUMENT_COLUMNS, F.col("text").alias("before")), label_quality(table(spark, sf_dir, "labels")))
    return mixed.select(F.struct(F.col("before").alias("text"), *[c for c in DOCUMENT_COLUMNS if c != "text"]).alias("d"), "text").select(*_retold(F.col("text")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix; copies of a document are packed one by one, a null text as an empty one."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup_stage),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging, docs = Staging(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with staged_here():
            docs = staging.put(stage(spark, docs, sf_dir), name)
    return docs


#: Signatures, automata and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
