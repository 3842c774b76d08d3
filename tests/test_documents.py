"""Nested documents, open rows and mapped names."""

from datetime import datetime

from pyspark.sql import functions as F

from millrace.functions.mapping import mapped
from millrace.sources import documents, tables

T0 = datetime(2024, 3, 31, 2, 30, 0, 123456)
SHAPE = "id long, at timestamp_ntz, note string, parts array<struct<n int, v double>>"


def test_documents_round_trip_with_rejects(spark):
    rows = spark.createDataFrame([(1, T0, "a \"b\"\n"), (2, None, None), (None, T0, "")], "id long, at timestamp_ntz, note string")
    parts = spark.createDataFrame([(1, 2, 0.1), (1, 1, None), (None, 5, -0.0), (7, 1, 1.0), (1, None, 3.0)], "id long, n int, v double")
    made = documents.documents(rows, parts, ["id"], "parts", ["n"])
    odd = spark.createDataFrame([(8, "{\"id\": "), (9, None), (10, "[]"), (11, "{\"id\": \"x\"}")], "id long, document string")
    good, bad = documents.read_documents(made.unionByName(odd), "document", SHAPE)
    got = {r.id: (r.fields.id, r.fields.at, r.fields.note, [tuple(p) for p in r.fields.parts]) for r in good.collect()}
    assert got == {1: (1, T0, "a \"b\"\n", [(None, 3.0), (1, None), (2, 0.1)]), 2: (2, None, None, []), None: (None, T0, "", [(5, -0.0)])}
    assert sorted(r.id for r in bad.collect()) == [8, 9, 10, 11] and bad.columns == ["id", "document"]
    good, bad = documents.read_documents(documents.documents(rows.limit(0), parts, ["id"], "parts", ["n"]), "document", SHAPE)
    assert good.count() == bad.count() == 0


def test_open_rows_keep_what_new_ones_lack(spark):
    old = spark.createDataFrame([(1, "a", "seen"), (2, None, "sent"), (None, "n", None)], "k int, v string, status string")
    new = spark.createDataFrame([(1, None, 5), (2, "b", 6), (None, "m", 7), (3, "c", 8)], "k int, v string, extra int")
    got = tables.merge_open(old, new, ["k"])
    assert got.columns == old.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(1, "a", "seen"), (2, "b", "sent"), (None, "m", None), (3, "c", None)]))
    assert sorted(map(str, tables.merge_open(old, new.limit(0), ["k"]).collect())) == sorted(map(str, old.collect()))


def test_mapped_names(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), (" Low",), ("HIGH ",), ("odd",)], "s string")
    got = [r[0] for r in df.select(mapped(F.col("s"), {"low": "1", "High": "2"}, "none", "?")).collect()]
    assert got == ["none", "none", "none", "1", "2", "?"]
    assert [r[0] for r in df.select(mapped(F.col("s"), {}, None, "?")).collect()] == [None, None, None, "?", "?", "?"]
