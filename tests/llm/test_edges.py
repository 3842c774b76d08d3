"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from pyspark.sql import functions as F

from millrace.llm import embeddings, langid, licenses, mixing, neardup, packing, quality, substring, toxicity, urls


def test_mixing(spark, odd, empty, odd_rows):
    out = mixing.mix_sources(odd).collect()
    assert len(out) == len(odd_rows)
    assert all(0 <= r.taken <= 3 * r.size for r in out)
    assert {r.size for r in out if r.doc_id in (3, 4, 5)} == {0}
    assert mixing.mix_sources(empty).count() == 0
    q = spark.createDataFrame([(1, 2.0), (1, 5.0), (None, 1.0), (6, None), (7, float("nan")), (9, -1.0)], "doc_id long, quality double")
    assert mixing.mix_sources(odd, q).count() == len(odd_rows)
    assert mixing.mixed_rows(odd).columns == odd.columns


def test_substring(odd, empty, odd_rows):
    out = substring.substring_dedup(odd, 35).collect()
    assert len(out) == len(odd_rows)
    gone = {(r.doc_id, r.n_words): r.n_removed for r in out}
    assert gone[1, 120] == 120 and gone[3, 0] == gone[4, 0] == gone[5, 0] == 0 and gone[None, 0] == 0
    assert gone[6, 30_000] == 30_000 and gone[7, 30_001] == 30_000 and gone[None, 121] == 120
    assert substring.substring_dedup(empty, 35).count() == 0


def test_packing(odd, empty, odd_rows):
    out = packing.pack_documents(odd, window=2048).collect()
    assert {r.doc_id for r in out} == {r[0] for r in odd_rows}
    ends = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
        assert ends[r.sequence_id] <= 2048
    assert sum(r.doc_tokens for r in out if r.start == 0) == sum(r.length for r in out)
    assert packing.pack_documents(empty).count() == 0


def test_toxicity(spark, odd, empty, odd_rows):
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (6, 0), (8, 1), (9, 0)], "doc_id long, toxic int")
    out = toxicity.score(odd, toxicity.fit(odd, marks)).collect()
    assert len(out) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0
    assert toxicity.score(odd, toxicity.fit(odd, none)).count() == len(odd_rows)


def test_near_duplicates(odd, empty, odd_rows):
    out = neardup.near_duplicates(odd).collect()
    assert len(out) == len(odd_rows)
    by = {(r.doc_id, r.n_shingles): r for r in out}
    assert by[2, 116].component_id == 1 and not by[2, 116].kept and by[1, 116].kept
    assert by[None, 117].component_id == 1
    assert by[3, 0].kept and by[4, 0].component_id == 4 and by[5, 0].component_id == 5 and by[None, 0].component_id is None
    assert by[7, 29_997].component_id == 6 and by[9, 1].n_shingles == 1
    assert neardup.near_duplicates(empty).count() == 0


def test_urls(spark):
    rows = [(1, "http://a.b.example.com/x/y.html", "2024-02-01"), (1, "http://a.b.example.com/x/y.html", "2024-02-01"), (2, None, "2024-02-01"), (3, "no url", "2024-02-01"), (4, "http://A.b.example.com", None), (None, "http://u:p@example.com:80/x/?q", "2024-02-01")]
    captures = spark.createDataFrame(rows, "page_id long, url string, d string").withColumn("fetched_at", F.col("d").cast("timestamp_ntz")).withColumn("kept", F.lit("x"))
    log = spark.createDataFrame([("d:example.com", "block", "2024-01-01"), ("d:example.com", "block", "2024-01-01"), ("p:a.b.example.com/x/", "allow", "2024-02-01"), (None, "block", "2024-01-01"), ("d:example.com", None, "2024-01-05")], "key string, verdict string, d string").withColumn("at", F.col("d").cast("timestamp_ntz"))
    for name in ("key", "at", "day", "start", "stop", "entry", "verdict", "row", "n", "kind", "_url", "_at"):
        captures = captures.withColumn(name, F.lit("x"))
    out = urls.filter_urls(captures, log).collect()
    assert {r.key for r in out} == {"x"}
    assert len(out) == 6
    assert [r.verdict for r in out if r.page_id == 1] == ["allow", "allow"]
    assert [r.kept for r in out if r.page_id in (2, 3, 4)] == [True, True, True]
    assert [(r.entry, r.kept) for r in out if r.page_id is None] == [("d:example.com", False)]
    assert urls.filter_urls(captures, log.limit(0)).where("kept").count() == 6
    assert urls.filter_urls(captures.limit(0), log).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [float("inf"), 1.0], 1), (8, [], 1), (9, [1.0, 0.0], None), (None, [1.0, 0.001], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1e300, 1e299], 3), (12, [1e-300, 1e-301], 3)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("fp", F.lit(1)).withColumn("own", F.lit(2))
    out = embeddings.near_duplicate_vectors(v).collect()
    assert len(out) == len(rows)
    links = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in out)
    assert links == sorted([(1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (0, 3, 1), (10, 0, 10), (11, 1, 11), (12, 1, 11)])
    assert embeddings.near_duplicate_vectors(v.limit(0)).count() == 0


def test_language(odd, empty, odd_rows):
    for name in ("share", "h", "i", "size", "held_out", "letters"):
        odd = odd.withColumn(name, F.lit("x"))
    out = langid.identify(odd).collect()
    assert len(out) == len(odd_rows) and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (3, 4, 5, 10)} == {"und"}
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(empty)).collect()} == {"und"}


def test_quality(odd, empty, odd_rows):
    out = quality.quality_rules(odd).collect()
    assert len(out) == len(odd_rows)
    assert all(r.base_failed and not r.kept for r in out if r.n_words < 50)
    assert quality.quality_rules(empty).count() == 0


def test_licenses(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.txt", "nothing"), (2, "a/b/c/x.txt", "nothing"), (3, "a/b/LICENSE.md", "licensed under the GNU General Public License, version 3"), (4, None, "Licensed under CC BY-NC 4.0."), (5, "x.txt", None), (6, "a/y", ""), (None, "a/b/z", None), (7, "/top", "licence " * 5000), (None, "a/b/z", "Released under the MIT License"), (8, "n/LICENSE", "MIT"), (8, "n/x", "MIT")]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("line", F.lit("x")).withColumn("term", F.lit(1))
    out = licenses.scan_licenses(docs).collect()
    got = sorted((r.doc_id or 0, r.license or "", r.inherited_from or "") for r in out)
    assert got == sorted([(0, "GPL-3.0", "a/b"), (1, "MIT", ""), (2, "GPL-3.0", "a/b"), (2, "GPL-3.0", "a/b"), (3, "GPL-3.0", ""), (4, "CC-BY-NC-4.0", ""), (5, "", ""), (6, "MIT", "a"), (0, "MIT", ""), (7, "", ""), (8, "", ""), (8, "", "")])
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
