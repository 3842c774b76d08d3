"""Every stage on odd rows and on an empty table, and the whole run against brute force."""

import zlib

import numpy as np
import pytest
from conftest_llm import frame
from test_results import brute_components, brute_cut

import corpus_pipeline as pipeline
from millrace.llm import queries
from millrace.llm.common import DOCUMENT_COLUMNS
from millrace.llm.mixing import mix_sources

SF = "/root/testdata/sf0.001"


def stage(name):
    return dict(pipeline.STAGES)[name]


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stage_takes_odd_and_empty_tables(spark, odd, empty, name):
    out = stage(name)(spark, odd, SF)
    assert out.count() > 0
    if name != "packing":
        assert tuple(out.columns) == DOCUMENT_COLUMNS
    assert stage(name)(spark, empty, SF).count() == 0


def test_stages_decide(spark, odd):
    left = [r.doc_id for r in stage("language_id")(spark, odd, SF).collect()]
    assert not {3, 4, 5, 10} & set(left) and left.count(1) == 3
    kept = [(r.doc_id, (r.text or "")[:20]) for r in stage("near_dedup")(spark, odd, SF).collect()]
    assert len([i for i, _ in kept if i == 1]) == 2 and (1, "another text under a") in kept  # two texts under one id
    assert not {2, 7} & {i for i, _ in kept} and len(kept) == len(set(kept))
    cut = {(r.doc_id, r.text) for r in stage("substring_dedup")(spark, odd, SF).collect()}
    assert {i for i, _ in cut} == {None, 1, 3, 4, 5, 7, 9, 10} and (7, "tail") in cut and (None, "end") in cut


def test_near_dedup_keeps_every_document_without_id(spark):
    text = lambda tag, n=60: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(1, text("a")), (None, text("a", 61)), (None, text("b")), (None, text("b", 61)), (None, text("c")), (None, text("c")), (None, text("z")), (2, text("d")), (3, text("d"))]
    got = sorted((r.doc_id or 0, r.text[0]) for r in stage("near_dedup")(spark, frame(spark, [(i, t, "en", "a") for i, t in rows]), SF).collect())
    assert got == [(0, "b"), (0, "c"), (0, "z"), (1, "a"), (2, "d")]


def test_run_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    said = {r.doc_id: r.lang_pred for r in queries.op8_language_id(spark, SF).collect()}
    texts = {i: r.text for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}
    assert set(texts) == {i for i, x in said.items() if x != "und"}
    _, root = brute_components(texts, 5)
    texts = {i: t for i, t in texts.items() if root[i] == i}
    cut = brute_cut(texts, 35)
    texts = {i: t for i, t in texts.items() if cut[i][0] == 0 or cut[i][1] < cut[i][0]}

    for name in ("language_id", "near_dedup", "substring_dedup"):
        docs = stage(name)(spark, docs, SF)
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == set(texts)
    assert all(len((r.text or "").encode().split()) == cut[i][0] - cut[i][1] for i, r in got.items())
    assert all(r.n_chars == len(r.text) for i, r in got.items() if cut[i][1])
    plan = {r.doc_id: r for r in mix_sources(docs, queries.label_quality(spark.read.parquet(f"{SF}/labels.parquet"))).collect()}

    pieces = pipeline.run(spark, SF).toPandas()
    assert set(pieces.doc_id) == {i for i, r in plan.items() if r.taken}
    copies = pieces[pieces.start == 0].groupby("doc_id").size().to_dict()
    assert copies == {i: -(-r.taken // r.size) for i, r in plan.items() if r.taken}
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in plan.items():
        if r.taken and r.taken % r.size == 0:
            ids = np.append(tokenizer.encode(got[i].text, add_special_tokens=False).ids, 1).astype("<u4")
            want = {(s, zlib.crc32(ids[s : s + 2048].tobytes())) for s in range(0, len(ids), 2048)}
            assert {(p.start, p.ids_crc32) for p in pieces[pieces.doc_id == i].itertuples()} == want
    used = pieces.groupby("sequence_id").length.sum()
    assert used.max() <= 2048 and pieces.groupby("sequence_id").offset.min().max() == 0


def test_every_stage_keeps_all_documents_under_null_and_repeated_ids(spark):
    """30 texts without id and 30 under one id, of two sources: each stage keeps what brute force keeps."""
    text = lambda tag, n=60: " ".join(f"{tag}word{i}" for i in range(n))
    rows = [(None if i % 2 else 7, text(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}"), None if i % 3 else "en", f"s{i % 2}") for i in range(60)]
    rows += [rows[0], rows[1], (None, None, "en", "s0"), (7, "", "en", "s0")]
    docs = frame(spark, [(i, t, g, s) for i, t, g, s in rows])
    labelled = docs.union(frame(spark, [(100 + i, text("english", 80), "en", "s0") for i in range(20)]))
    said = stage("language_id")(spark, labelled, SF).where("doc_id is null or doc_id = 7").collect()
    assert len(said) == 62 and {r.lang for r in said} == {"en"}
    kept = stage("near_dedup")(spark, docs, SF)
    assert kept.count() == 62
    words_only = kept.where("text <> ''")
    assert words_only.count() == 60 and words_only.select("text").distinct().count() == 60
    cut = stage("substring_dedup")(spark, docs.where("text <> ''"), SF).collect()
    assert len(cut) == 58 and {r.text for r in cut} == {t for _, t, _, _ in rows[2:60]}
    mixed = stage("mixing")(spark, words_only, SF).collect()
    total = {s: sum(len(r.text.split()) for r in mixed if r.source == s) for s in ("s0", "s1")}
    assert abs(total["s0"] - 3600 * 5 / 7) <= 1 and abs(total["s1"] - 3600 * 2 / 7) <= 1
    per_text = {}
    for r in mixed:
        per_text.setdefault(r.text.split()[0], []).append(len(r.text.split()))
    assert all(sum(v) <= 180 for v in per_text.values()) and len([k for k in per_text if k[0] == "t"]) >= 40
    packed = stage("packing")(spark, words_only, SF)
    assert packed.count() == 60
