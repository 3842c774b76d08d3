"""Results against brute force, exact round trips, SQL and held-out accuracy."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest_llm import frame, words

from millrace.llm import components, embeddings, langid, licenses, mixing, neardup, packing, quality, queries, substring, toxicity
from millrace.llm.common import Staging, window_hashes, word_hashes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    n = min(k, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute_components(texts: dict, k: int):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    ids, links = sorted(sets), []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= 80 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    links.append((a, b))
    return sets, roots(ids, links)


def chain_of_copies(rng, n):
    """A group of near copies, graded and chained, so that many pairs lie on either side of 0.8."""
    base = [f"t{i}" for i in range(120)]
    rows = [list(base)]
    for i in range(n - 1):
        w = list(rows[rng.randrange(len(rows))] if i % 3 else base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append(w)
    return [" ".join(w) for w in rows]


@pytest.mark.parametrize("block, bucket", [(250_000, 1024), (600, 7)])
def test_near_duplicates_by_brute_force(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(neardup, "GROUP_BLOCK", block)
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", bucket)
    rng = random.Random(3)
    texts = dict(enumerate(chain_of_copies(rng, 90) + [words(rng, rng.randrange(1, 90)) for _ in range(40)] + ["", None]))
    got = {r.doc_id: r for r in neardup.near_duplicates(frame(spark, [(i, t, "en", "a") for i, t in texts.items()]), shingle=4).collect()}
    sets, want = brute_components(texts, 4)
    assert {i: got[i].component_id for i in texts} == want
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (want[i] == i) for i in texts)


def test_op5_by_brute_force(spark, documents):
    got = {r.doc_id: r for r in queries.op5_minhash_near_dedup(spark, SF).collect()}
    _, want = brute_components(dict(zip(documents.doc_id, documents.text)), 4)
    assert {i: r.component_id for i, r in got.items()} == want


def test_forests_span_what_signatures_join():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    base = rng.integers(0, 256, (6, 128)).astype(np.uint8)
    rows = []
    for place in (3, 5, 8):
        for k in range(40):
            x = base[rng.integers(0, 6)].copy()
            x[rng.random(128) < rng.choice([0.02, 0.1, 0.3])] = 7
            rows.append((place, b"%d-%02d" % (place, k), int(rng.integers(90, 130)), x.tobytes()))
    table = pa.table(dict(zip(("place", "fp", "n", "sig"), map(list, zip(*rows)))))
    found = []
    for size in (1, 7, 1000):
        found.append(sorted((a, b) for x in neardup._forests(80, 100)(iter(table.to_batches(size))) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())))
    assert found[0] == found[1] == found[2]
    near = lambda p, q: p[0] == q[0] and min(p[2], q[2]) * 100 >= 80 * max(p[2], q[2]) and (np.frombuffer(p[3], np.uint8) == np.frombuffer(q[3], np.uint8)).mean() >= 0.8 - neardup.MARGIN
    want = roots([r[1] for r in rows], [(p[1], q[1]) for i, p in enumerate(rows) for q in rows[i + 1 :] if near(p, q)])
    assert roots([r[1] for r in rows], found[0]) == want and len(found[0]) == len(rows) - len(set(want.values()))


def test_super_minhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    sig = neardup.super_minhash([a, b, a[:1]], 256)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.12
    assert (np.sort(sig[2] >> np.uint64(32)) == np.arange(256)).all()  # one element visits every place once
    assert (neardup.super_minhash([b], 256)[0] == sig[1]).all()


def test_components_in_rounds(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 560)] + [(700, i) for i in range(701, 740)]
    df = spark.createDataFrame([*links, (None, 1), (5, 5)], "a long, b long")
    want = roots({n for ab in links for n in ab}, links)
    for limit in (0, 10**6):
        got = dict(components.connected_components(df, Staging(spark, "test"), limit).collect())
        assert got == {n: r for n, r in want.items() if n in got} and {n for n, r in want.items() if r != n} <= set(got)
    none = components.connected_components(df.limit(0), Staging(spark, "test"), 0)
    assert none.count() == 0


def brute_cut(texts: dict, length: int):
    split = {i: (t or "").encode().split() for i, t in texts.items()}
    seen = Counter(b" ".join(w[j : j + length]) for w in split.values() for j in range(len(w) - length + 1))
    out = {}
    for i, w in split.items():
        keep = [True] * len(w)
        for j in range(len(w) - length + 1):
            if seen[b" ".join(w[j : j + length])] > 1:
                keep[j : j + length] = [False] * length
        left = b" ".join(x for x, k in zip(w, keep) if k)
        out[i] = (len(w), len(w) - sum(keep), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("length", [2, 5, 35])
def test_substrings_by_brute_force(spark, length):
    rng = random.Random(length)
    passage = words(rng, 2 * length + 3)
    texts = {i: words(rng, 60, 5 if i % 4 == 0 else 50) + (f" {passage} " if i % 3 == 0 else " ") + words(rng, 30) for i in range(60)}
    texts |= {100: "a " * 80, 101: texts[1], 102: passage, 103: passage[len(passage) // 2 :]}
    got = substring.substring_dedup(frame(spark, [(i, t, "en", "a") for i, t in texts.items()]), length).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_cut(texts, length)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got if r.kept_text is not None)


def test_op2_by_brute_force(spark, documents):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op2_substring_dedup(spark, SF).collect()}
    assert got == brute_cut(dict(zip(documents.doc_id, documents.text)), 35)


def test_window_hashes():
    h = word_hashes(b"a b c a b c d e f a b c d")
    for n in (1, 2, 3, 5, 7, 13):
        w = window_hashes(h, n)
        assert len(w) == 14 - n
        assert all((w[i] == w[j]) == (h[i : i + n] == h[j : j + n]).all() for i in range(len(w)) for j in range(len(w)))
    assert len(window_hashes(h, 14)) == 0


def test_op3_round_trip(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.append(tokenizer.encode(t or "", add_special_tokens=False).ids, 1).astype("<u4") for i, t in zip(documents.doc_id, documents.text)}
    rows = queries.op3_pack_sequences(spark, SF).toPandas()
    for r in rows.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert rows.length.sum() == sum(map(len, ids.values()))
    used = rows.groupby("sequence_id").length.sum()
    assert used.max() <= 2048 and used.sum() / (2048 * len(used)) > 0.97
    again = queries.op3_pack_sequences(spark, SF).toPandas()
    key = list(rows.columns)
    assert rows.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_same_ids_as_tokenizers_on_a_whole_table(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.01"
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    want = Counter()
    for i, e in zip(docs.doc_id, tokenizer.encode_batch([t or "" for t in docs.text], add_special_tokens=False)):
        ids = np.append(e.ids, 1).astype("<u4")
        want.update((i, s, zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048))
    got = queries.op3_pack_sequences(spark, sf).collect()
    assert Counter((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in got) == want


def test_same_ids_as_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "", "  \n\n x\t\ty", "é́日本語😀​", "x" * 3000, " " * 99 + "a", "\x00\x01", "it's 1234's"]
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    packed = packing.packed_sequences(docs).collect()
    got = {}
    for s in packed:
        assert len(s.ids) == 2048 or len(s.ids) & (len(s.ids) - 1) == 0
        at = 0
        for d, n in zip(s.doc_ids, s.lengths):
            got.setdefault(d, []).append(s.ids[at : at + n])
            at += n
    for i, t in enumerate(texts):
        assert [x for part in got[i] for x in part] == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_pieces_of_one_id_are_dealt_apart(spark):
    docs = frame(spark, [(None, f"text {i % 40}", "en", "a") for i in range(400)] + [(7, "same", "en", "a")] * 400)
    got = packing.pack_documents(docs, group=50).toPandas()
    per_group = got.groupby(got.sequence_id // 2**32).size()
    assert len(got) == 800 and len(per_group) == 16 and per_group.max() < 100
    assert (got.doc_id == 7).sum() == 400


def test_best_fit_decreasing_by_brute_force():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 101, 500))[::-1]
    which, offset = packing.best_fit_decreasing(lengths, 100)
    room: list[int] = []
    for n, w, o in zip(lengths, which, offset):
        fits = [r for r in room if r >= n]
        assert (min(fits) if fits else 100) == 100 - o
        if w == len(room):
            room.append(100)
        room[w] -= n


def test_restored_words(spark):
    text = "the loser was an idiot and stupid people are worthless trash moron clown " * 20
    model = toxicity.Characters(*toxicity.character_model(frame(spark, [(1, text, "en", "a")])))
    for written, meant in [("l0ser", "loser"), ("1d1ot", "idiot"), ("stuuuupid", "stupid"), ("m.o.r.o.n", "moron"), ("tr@$h", "trash"), ("cl0wn", "clown")]:
        assert meant in toxicity._forms(written, model)
    assert toxicity._forms("hello,", model) == ["hello"]
    assert "loser" in [f for w in toxicity.words_of("such a l o s e r") for f in toxicity._forms(w, model)]


def test_restored_words_of_another_script(spark):
    text = "погода была хорошая и дорога шла вдоль реки а кабан спал под дубом зной загар " * 20
    model = toxicity.Characters(*toxicity.character_model(frame(spark, [(1, text, "ru", "a"), (2, "the road was long and the dog slept " * 20, "en", "a")])))
    for written, meant in [("д0р0га", "дорога"), ("к@бан", "кабан"), ("к.а.б.а.н", "кабан"), ("р0ad", "рoad"), ("r0ad", "road"), ("3ной", "зной")]:
        assert meant in toxicity._forms(written, model), written
    assert model.row(model.symbol("д"), model.symbol("о"))[model.symbol("р")] > model.row(model.symbol("д"), model.symbol("о"))[model.symbol("o")] + 1


def test_character_model_counts_every_letter_of_a_large_script(spark):
    """Probabilities against plain counts; 3,000 letters beside Latin ones, none of which share anything."""
    rng = random.Random(5)
    texts = ["".join(rng.choice([chr(0x4E00 + min(int(rng.expovariate(1 / 400)), 2999)), chr(0x4E00 + rng.randrange(3000)), " "]) for _ in range(400)) for _ in range(60)]
    texts += ["the road was long and the dog slept", "", None]
    places, cells = toxicity.character_model(frame(spark, [(i, t, "zh", "a") for i, t in enumerate(texts)]))
    model = toxicity.Characters(places, cells)
    x = [ord(c) if c.isalpha() else 0 for t in texts if t for c in t + "  "]
    letters = Counter(x)
    assert len(letters) > 2500  # of 3,000 drawn from
    n3, n2 = Counter(zip(x, x[1:], x[2:])), Counter(zip(x, x[1:]))
    off = 0
    for a, b, c in rng.sample(sorted(n3), 3000):
        one = (letters[c] + 1) / (sum(letters.values()) + toxicity.UNSEEN)
        two = (n2[b, c] + 5 * one) / (letters[b] + 5)
        want = math.log((n3[a, b, c] + 5 * two) / (n2[a, b] + 5))
        off += abs(model.row(a, b)[c] - want) > (0.05 if 0 in (a, b) else 1e-3)
    assert off <= 30  # the two cells of a run are both shared at times
    assert model.row(0, ord("t"))[ord("h")] > model.row(0, ord("t"))[0x4E00] + 2


def test_restore_by_brute_force(spark):
    """The Viterbi search against every path through the lattice."""
    import itertools

    text = "the loser was an idiot and stupid people are worthless trash moron clown said an ass дорога была длинной " * 20
    model = toxicity.Characters(*toxicity.character_model(frame(spark, [(1, text, "en", "a")])))
    rng = random.Random(3)

    def paths(word):
        choices = []
        for i, ch in enumerate(word):
            own = [(ch, 0.0)] if ch.isalpha() else [(c, toxicity.SIGN_COST) for c in toxicity.SIGNS.get(ch, "")]
            choices.append(own + ([("", toxicity.DROP_COST)] if not own or i and word[i - 1] == ch else []))
        for path in itertools.product(*choices):
            out = "".join(c for c, _ in path)
            score, a, b = sum(x for _, x in path), 0, 0
            for s in [*map(model.symbol, out), 0]:
                score, a, b = score + model.row(a, b)[s], b, s
            yield score, out

    for _ in range(150):
        word = "".join(rng.choice("loser1d10t@$$4ssдо0.-ee") for _ in range(rng.randrange(1, 8)))
        got = toxicity.restore(word, model)
        best = max(x for x, _ in paths(word))
        assert max(x for x, w in paths(word) if w == got) >= best - 1e-9, word
    for _ in range(300):  # words of letters: as the search has it, where that gains enough
        word = "".join(c * rng.choice((1, 1, 1, 2)) for c in (rng.choice("loseridatumп") for _ in range(rng.randrange(2, 8))))
        if toxicity._tripled.search(word) or not toxicity._doubled.search(word):
            continue
        back = toxicity.restore(word, model)
        gain = model.score(back) / (len(back) + 1) >= model.score(word) / (len(word) + 1) + toxicity.DOUBLED_GAIN
        assert toxicity._undoubled(word, model) == (back if gain and back != word else None), word


def test_restored_doubled_and_all_sign_words(spark):
    text = "the loser was an idiot and stupid people are worthless trash moron clown said an ass " * 20
    model = toxicity.Characters(*toxicity.character_model(frame(spark, [(1, text, "en", "a")])))
    for written, meant in [("iiddiioott", "idiot"), ("sttuuppid", "stupid"), ("llooserr", "loser"), ("4$$", "ass"), ("@$5!", "ass"), ("455", "ass")]:
        assert meant in toxicity._forms(written, model), written
    for written, meant in [("so $ t u p i d", "stupid"), ("an @ s s!", "ass"), ("4 $ $", "ass"), ("a (l 0 $ e r!", "loser"), ("1-d-!-0-+", "idiot")]:
        assert meant in [f for w in toxicity.words_of(written) for f in toxicity._forms(w, model)], written
    for plain in ("***", "--", "..."):
        assert toxicity._forms(plain, model) == []


def test_op4_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_toxicity(spark, sf).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    both = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = both[both.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]).all()
    assert ((held.predicted == 1) == (held.toxic == 1)).mean() > 0.93
    assert held[held.toxic == 0].predicted.mean() < 0.03


def test_op4_by_brute_force(spark, documents):
    """Weights and scores of every document against plain loops over words, without memory, sampling or Spark."""
    import math

    labels = pd.read_parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fitted = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    model = toxicity.Characters(*fitted["model"])
    text = {i: t or "" for i, t in zip(documents.doc_id, documents.text)}

    def evidence(t):  # feature -> in how many distinct words
        n = Counter()
        for word in set(toxicity.words_of(t)):
            n.update({f for form in toxicity._forms(word, model) for f in toxicity._features(form)})
        return n

    found = {i: evidence(t) for i, t in text.items()}
    marks = {r.doc_id: int(r.toxic) for r in labels.itertuples() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in text and not pd.isna(r.toxic)}
    size = Counter(marks.values())
    n: dict = {}
    for i, y in marks.items():
        for f, times in found[i].items():
            for k in range(min(times, toxicity.TIMES)):
                n.setdefault(f + k, [0, 0])[y] += 1
    weights = {}
    for f, (n0, n1) in n.items():
        if n1:
            expected = (n0 + n1) * size[1] / (size[0] + size[1])
            g = n1 * math.log(n1 / expected) + (n0 * math.log(n0 / (n1 + n0 - expected)) if n0 else 0)
            w = math.log((n1 + 0.5) / (size[1] + 1)) - math.log((n0 + 0.5) / (size[0] + 1)) - math.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
            if g >= toxicity.UNLIKELY[(f & 15) // toxicity.TIMES] and w > 0:
                weights[f] = w
    assert set(weights) == set(fitted["weights"]) and all(abs(w - fitted["weights"][f]) < 1e-9 for f, w in weights.items()) and weights
    got = {r.doc_id: r for r in toxicity.score(docs, fitted).collect()}
    b0, b1, b2 = fitted["beta"]
    for i, seen in found.items():
        parts = [max((weights.get(f + k, 0.0) for k in range(min(times, toxicity.TIMES))), default=0.0) for f, times in seen.items()]
        parts = [p for p in parts if p] or [0.0]
        want = 1 / (1 + math.exp(-(b0 + b1 * max(parts) + b2 * math.log1p(max(0.0, sum(parts) - max(parts))))))
        assert abs(got[i].score - want) < 1e-9 and got[i].predicted == (want >= 0.5)


def test_op7_query_by_brute_force(spark, tmp_path):
    """The table of sf0.01 with copies at all distances beside the threshold, in groups of one to sixty."""
    table = pd.read_parquet("/root/testdata/sf0.01/embeddings.parquet")
    rng, more = np.random.default_rng(2), []
    for i, r in enumerate(table.head(40).itertuples()):
        x = np.array(r.embedding, float)
        for _ in range(60 if i % 10 == 0 else 1 + i % 5):
            away = rng.normal(size=len(x)) * np.linalg.norm(x) / np.sqrt(len(x))
            more.append((10**6 + len(more), (x + rng.choice([0, 0.1, 0.18, 0.2, 0.22]) * away).tolist(), r.label))
    table = pd.concat([table[["vec_id", "embedding", "label"]], pd.DataFrame(more, columns=["vec_id", "embedding", "label"])], ignore_index=True)
    table["embedding"] = [np.array(x, np.float64) for x in table.embedding]
    table.to_parquet(tmp_path / "embeddings.parquet")
    got = {r.vec_id: r for r in queries.op7_embedding_near_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == len(table)
    links, n = [], Counter()
    for _, part in table[table.label.notna() & table.embedding.notna()].groupby("label"):
        ids = part.vec_id.to_numpy()
        v = np.array([np.array(x, float) for x in part.embedding])
        norm = np.linalg.norm(v, axis=1)
        ok = np.isfinite(v).all(axis=1) & (norm > 0)
        u, ids = v[ok] / norm[ok][:, None], ids[ok]
        a, b = np.nonzero(np.triu(u @ u.T >= 0.98, 1))
        links += list(zip(ids[a], ids[b]))
    for a, b in links:
        n.update((a, b))
    want = roots(table.vec_id.tolist(), links)
    assert len(links) > 1000 and sum(r.n_links for r in got.values()) >= 0.999 * sum(n.values()) and all(r.n_links <= n[i] for i, r in got.items())
    assert {i: r.component_id for i, r in got.items()} == want and all(r.kept == (r.component_id == i) for i, r in got.items())


def test_op7_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL_BLOCK", 40)
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(6, 64))
    v = np.concatenate([rng.normal(size=(200, 64)), *(c + s * rng.normal(size=(70, 64)) for c, s in zip(centre, (0.02, 0.1, 0.13, 0.14, 0.15, 0.2)))])
    v[300] = v[301] = v[302]
    label = rng.integers(0, 2, len(v))
    df = spark.createDataFrame([(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, label))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicate_vectors(df).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    hit = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    n = np.array([got[i].n_links for i in range(len(v))])
    assert hit.sum() > 5000 and (n <= hit.sum(axis=1)).all() and n.sum() >= 0.999 * hit.sum()
    assert {i: r.component_id for i, r in got.items()} == roots(range(len(v)), zip(*np.nonzero(np.triu(hit))))


def test_nearest_lattice_point():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8)) * 2
    p = embeddings.nearest_e8(x)
    step = embeddings.roots_of_e8()
    assert ((2 * p) % 1 == 0).all() and (p.sum(axis=1) % 2 == 0).all()
    for point, near in zip(x, p):  # no neighbour is nearer
        assert ((point - near - step) ** 2).sum(axis=1).min() >= ((point - near) ** 2).sum() - 1e-9


def test_op8_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_language_id(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/documents.parquet"), on="doc_id")
    held = got[got.held_out]
    assert len(got) == 1000 and (held.lang == held.lang_pred).mean() > 0.98


def test_suffix_automaton_parse():
    text = [1, 2, 1, 3, 1, 2, 1, 1, 2]
    steps = langid.packed(langid.suffix_automaton(text))

    def brute(x):
        n, i = 0, 0
        while i < len(x):
            k = 0
            while i + k < len(x) and any(text[j : j + k + 1] == x[i : i + k + 1] for j in range(len(text))):
                k += 1
            n, i = n + 1, i + k + 1
        return n

    rng = random.Random(1)
    seqs = sorted([[rng.randrange(5) for _ in range(rng.randrange(1, 30))] for _ in range(50)], key=len, reverse=True)
    _, grid, lengths = next(langid._grids([np.array(s, np.uint32) for s in seqs], 50))
    assert langid.phrase_counts(grid, lengths, steps).tolist() == [brute(s) for s in seqs]


def test_packed_automaton_has_the_same_steps():
    rng = random.Random(11)
    for alphabet in (2, 9, 61, 900):
        nxt = langid.suffix_automaton([rng.randrange(alphabet) for _ in range(3000)])
        steps = langid.packed(nxt)
        assert len(steps) < 3 * sum(map(len, nxt)) + 3500
        todo, place = [0], {0: int(steps[0])}
        while todo:
            s = todo.pop()
            for c in range(alphabet):
                v = int(steps[place[s] + c])
                assert (v & langid.NO_SYMBOL == c) == (c in nxt[s])
                if c in nxt[s] and nxt[s][c] not in place:
                    place[nxt[s][c]] = v >> langid.BITS
                    todo.append(nxt[s][c])
                assert c not in nxt[s] or place[nxt[s][c]] == v >> langid.BITS
        assert len(place) == len(nxt) == len(set(place.values()))


def test_op8_by_brute_force(spark, documents):
    """Phrases by the longest match in plain strings of the sampled texts, for every document of the table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_language_id(spark, SF).collect()}
    parts: dict = {}
    for r in langid.sample(docs).collect():
        parts.setdefault(r.lang, []).append(r.text)

    def letters(t):
        out = " "
        for ch in t:
            low = ch.lower() if len(ch.lower()) == 1 else ch
            if ch.isalpha():
                out += low
            elif out[-1] != " ":
                out += " "
        return out

    known = {}
    for lang, texts in parts.items():
        x = "".join(letters(t) for t in sorted(texts))
        known[lang] = (x, np.log2(len(x)))
    wrong = 0
    for i, t in zip(documents.doc_id, documents.text):
        x = letters(t or "")
        n = len(x.replace(" ", ""))
        if not n:
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        if n > 6000:
            continue
        cost = {}
        for lang, (text, scale) in known.items():
            phrases = 0
            for lo in range(0, len(x), langid.PIECE):
                z, at = x[lo : lo + langid.PIECE], 0
                while at < len(z):
                    k = 1
                    while at + k <= len(z) and z[at : at + k] in text:
                        k += 1
                    phrases, at = phrases + 1, at + k
            cost[lang] = phrases * scale / n
        best = sorted((c, lang) for lang, c in cost.items())
        assert got[i].lang_pred == best[0][1] and abs(got[i].score - (1 - best[0][0] / best[1][0])) < 1e-9


def test_languages_of_many_letters(spark, tmp_path):
    """A Chinese-like script and two of 2,500 letters in the same block, beside the four of the table."""
    rng = np.random.default_rng(5)
    rows = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    extra = []
    for lang, first, n in (("zh", 0x4E00, 3000), ("la", 0x5A00, 2500), ("lb", 0x5C00, 2500)):
        weights = 1 / np.arange(1, n + 1)
        letters = rng.permutation(np.arange(first, first + n))
        for _ in range(300):
            drawn = rng.choice(letters, rng.integers(60, 400), p=weights / weights.sum())
            extra.append("".join(chr(c) + (" " if rng.random() < 0.1 else "") for c in drawn))
    more = pd.DataFrame({"doc_id": np.arange(10**6, 10**6 + len(extra)), "text": extra, "lang": [x for x in ("zh", "la", "lb") for _ in range(300)], "source": "new", "n_chars": 0})
    pd.concat([rows, more]).to_parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_language_id(spark, str(tmp_path)).toPandas().merge(pd.concat([rows, more])[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out]
    right = (held.lang == held.lang_pred).groupby(held.lang).mean()
    assert (right >= 0.97).all() and (held.lang == held.lang_pred).mean() >= 0.98, right


def test_languages_are_learned_from_whole_texts(spark, monkeypatch):
    rows = [(i, "ab" * (i + 1), "x", "s") for i in range(40)] + [(100, "c" * 500, "y", "s"), (101, "d" * 300, "y", "s"), (104, "e" * 400, "y", "s")]
    docs = frame(spark, rows)
    texts = {r[1] for r in rows}
    picked = [(r.lang, r.text) for r in langid.sample(docs, 200).collect()]
    assert {t for _, t in picked} <= texts and sum(len(t) for lang, t in picked if lang == "x") <= 200
    left = [r for r in rows if r[2] == "y" and zlib.crc32(str(r[0]).encode()) % 5]
    assert [t for lang, t in picked if lang == "y"] == [min((r[1] for r in left), key=len)]
    monkeypatch.setattr(langid, "MODEL_BYTES", 36 * 200)
    with pytest.raises(ValueError):
        langid.fit(docs, 200)


def test_op9_base_counts(spark, documents):
    import re

    got = queries.op9_quality_rules(spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(documents.doc_id, documents.text):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        again = {j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}
        r = got.loc[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert got[~got.base_failed].kept.mean() > 0.95


class PlainKneserNey:
    """Modified Kneser-Ney over the texts, by dictionaries."""

    def __init__(self, texts, order=5):
        counts = Counter()
        for s in texts:
            s = "\n" * (order - 1) + s
            counts.update(s[i : i + order] for i in range(len(s) - order + 1))
        self.levels = [counts]
        while len(self.levels) < order:
            self.levels.insert(0, Counter(g[1:] for g in self.levels[0]))
        self.cuts, self.totals, self.lost = [], [], []
        for c in self.levels:
            n1, n2, n3, n4 = (sum(v == i for v in c.values()) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 else 0
            d = [1 - 2 * y * n2 / max(n1, 1), 2 - 3 * y * n3 / max(n2, 1), 3 - 4 * y * n4 / max(n3, 1)]
            d = [min(max(x, 0.1), i + 0.9) for i, x in enumerate(d)]
            total, lost = Counter(), Counter()
            for g, v in c.items():
                total[g[:-1]] += v
                lost[g[:-1]] += d[min(v, 3) - 1]
            self.cuts.append(d)
            self.totals.append(total)
            self.lost.append(lost)

    def p(self, gram):
        p = 1 / (len(self.levels[0]) + 1)
        for k, c in enumerate(self.levels):
            g = gram[len(gram) - k - 1 :]
            if self.totals[k][g[:-1]]:
                p = (max(0, c[g] - self.cuts[k][min(c[g], 3) - 1]) if c[g] else 0) / self.totals[k][g[:-1]] + self.lost[k][g[:-1]] / self.totals[k][g[:-1]] * p
        return p

    def nats(self, s):
        s = "\n" * 4 + s
        return -sum(np.log(self.p(s[i : i + 5])) for i in range(len(s) - 4))


def test_op9_by_brute_force(spark, documents):
    """Perplexities, bands and verdicts of every document against a plain model; both ways to bring the model give them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    half = {r.doc_id: r.half for r in docs.selectExpr("doc_id", "pmod(xxhash64(text), 2) half").collect()}
    squeezed = {i: " ".join((t or "").split()) for i, t in zip(documents.doc_id, documents.text)}
    lang = dict(zip(documents.doc_id, documents.lang))
    models = {(g, h): PlainKneserNey([s for i, s in squeezed.items() if s and lang[i] == g and half[i] == h]) for g in set(lang.values()) for h in (0, 1)}
    got = quality.quality_rules(docs).toPandas().set_index("doc_id")
    other = quality.quality_rules(docs, send_bytes=-1).toPandas().set_index("doc_id")
    assert (got.kept == other.kept).all() and np.allclose(got.log_perplexity, other.log_perplexity, equal_nan=True, rtol=1e-6)
    nats = {i: models[lang[i], 1 - half[i]].nats(s) / got.n_words[i] for i, s in squeezed.items() if got.n_words[i]}
    assert all(abs(got.log_perplexity[i] - x) < 1e-5 for i, x in nats.items())
    good = got[~got.base_failed]
    for g, part in good.groupby("lang"):
        x = np.array([nats[i] for i in part.index])
        middle = np.sort(x)[(len(x) - 1) // 2]
        assert abs(np.sort(x)[len(x) // 2] - middle) < 0.5 and got.low[part.index].max() < middle < got.high[part.index].min()
        t = np.sort((x - middle) * np.sqrt(part.n_words))
        spread = (t[-(-3 * len(t) // 4) - 1] - t[-(-len(t) // 4) - 1]) / 1.349
        width = np.sqrt(spread**2 / part.n_words + (0.01 * middle) ** 2)
        assert np.allclose(part.low, middle - 3.5 * width, atol=1e-4) and np.allclose(part.high, middle + 7 * width, atol=1e-4)
        assert (part.kept == ((x >= part.low) & (x <= part.high))).all()


def test_long_texts_and_rare_letters_share_the_model(spark, monkeypatch):
    rng = random.Random(12)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 9000)]
    texts = ["".join(rng.choice(letters) + (" " if j % 7 == 0 else "") for j in range(900)) for _ in range(40)]
    docs = frame(spark, [(i, t, "zh", "a") for i, t in enumerate(texts)])
    whole = quality.quality_rules(docs).toPandas().set_index("doc_id").log_perplexity
    monkeypatch.setattr(quality, "CHUNK", 100)
    monkeypatch.setattr(quality, "HELD", 500)
    cut = spark.createDataFrame(docs.toPandas())  # workers see the small bounds: checked in this process
    rows = [(r.doc_id, r.lang, i % 2, r.text) for i, r in enumerate(cut.collect())]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows])], names=["lang", "half", "text"])
    counted = Counter()
    for b in quality._count([batch]):
        counted.update({(h, g): n for h, g, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())})
    want = Counter()
    for _, _, h, t in rows:
        s = "\n" * 4 + " ".join(t.split())
        want.update((h, s[i : i + 5]) for i in range(len(s) - 4))
    assert len(whole) == 40 and sum(counted.values()) == sum(want.values()) and set(counted) == set(want)


def test_noise_and_lists_leave_the_band(spark):
    rng = random.Random(9)
    common = [f"{a}{b}" for a in ("ka", "to", "mi", "re", "su") for b in ("na", "lo", "ri")]
    rows = [(i, " ".join(rng.choice(common) for _ in range(80)), "en", "a") for i in range(150)]
    noise = lambda: " ".join("".join(rng.choice("qxzjvwk0987#") for _ in range(6)) for _ in range(80))
    rows += [(1000 + i, noise(), "en", "a") for i in range(2)]
    rows += [(2000 + i, " ".join(rng.choice("ab") for _ in range(400)), "en", "a") for i in range(2)]
    got = {r.doc_id: r for r in quality.quality_rules(frame(spark, rows)).collect()}
    assert not any(r.kept for i, r in got.items() if i >= 1000) and all(r.kept for i, r in got.items() if i < 1000)
    assert all(r.log_perplexity > r.high for i, r in got.items() if 1000 <= i < 2000)


def test_clean_texts_stay_and_strewn_symbols_go(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op9_quality_rules(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/documents.parquet"), on="doc_id").merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id", how="left")
    got = got[~got.base_failed]
    strewn = got.text.str.count(r"[#$%&*]{3}") > 20
    assert got[got.quality == 1].kept.mean() > 0.96 and got[~strewn].kept.mean() > 0.96 and got[strewn].kept.mean() < 0.2


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.sql(queries.ORACLE_SQL[name]).df()

    def rows(df):
        df = df[sorted(df.columns)]
        return sorted(str([None if pd.isna(x) else round(float(x), 6) if isinstance(x, (float, int, np.number)) and not isinstance(x, bool) else str(x) for x in r]) for r in df.itertuples(index=False))

    assert rows(got) == rows(want)


def test_targets_are_capped_and_reshared(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 2000), ("d", 0)], "source string, source_size long")
    got = {r.source: (r.weight, r.target) for r in mixing.source_targets(sources).collect()}
    assert {s: w for s, (w, _) in got.items()} == {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    assert got["a"][1] == 30 and got["c"][1] == 15 and got["d"][1] == 0
    assert got["b"][1] == pytest.approx((3015 - 45) / 2) and got[None][1] == pytest.approx((3015 - 45) / 2)


def test_mix_meets_targets_and_repeats(spark):
    rng = random.Random(2)
    docs = frame(spark, [(i, words(rng, rng.randrange(0, 60)), "en", "s" if i % 7 else "t") for i in range(400)])
    plan = mixing.mix_sources(docs, ranges=16)
    first = sorted(plan.collect())
    assert sorted(mixing.mix_sources(docs.repartition(7), ranges=16).collect()) == first
    total = plan.groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 1 for r in total)
    rows = mixing.mixed_rows(docs, ranges=16)
    got = {r.doc_id: r.n for r in rows.selectExpr("doc_id", r"size(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)) n").groupBy("doc_id").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert got == {r.doc_id: r.taken for r in first if r.taken}


def test_high_quality_comes_first(spark):
    docs = frame(spark, [(i, "one two three", "en", "a" if i < 2000 else "b") for i in range(3000)])
    q = spark.createDataFrame([(i, 4.0 if i % 2 else 1.0) for i in range(3000)], "doc_id long, quality double")
    taken = mixing.mix_sources(docs, q, weights=(1, 3)).where("source = 'a'").collect()
    good, rest = sum(r.taken for r in taken if r.doc_id % 2), sum(r.taken for r in taken if not r.doc_id % 2)
    assert good > 1.3 * rest


#: Notices as they stand in files: commented, wrapped, with names and years.
NOTICES = {
    "MIT": """MIT License

Copyright (c) 2021 Jane Roe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
""",
    "BSD-3-Clause": """Copyright 2019 The Example Authors. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.
* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.
* Neither the name of Example nor the names of its contributors may be used to
  endorse or promote products derived from this software without specific
  prior written permission.
""",
    "GPL-3.0": """/* frob.c -- frobnicate
 * Copyright (C) 2008 Jane Roe
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
int main(void) { return 0; }
""",
    "LGPL-2.1": """                  GNU LESSER GENERAL PUBLIC LICENSE
                       Version 2.1, February 1999

 Copyright (C) 1991, 1999 Free Software Foundation, Inc.
""",
    "Apache-2.0": """#!/usr/bin/env python
# Copyright 2020 The Example Authors
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#      http://www.apache.org/licenses/LICENSE-2.0
#
import os
""",
    "ISC": """// Permission to use, copy, modify, and/or distribute this software for any
// purpose with or without fee is hereby granted, provided that the above
// copyright notice and this permission notice appear in all copies.
""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
""",
}


def test_docstrings_projects_and_choices_of_licences(spark):
    mit = next(w for i, w in licenses.TEMPLATES if i == "MIT" and w.startswith("Permission"))
    files = {
        '"""\n' + mit.replace(", ", ",\n", 3) + '\n"""\nimport os\nx = 1\n': "MIT",
        "# A project\n\nThis project is licensed under the terms of the MIT license.\n": "MIT",
        "# SPDX-License-Identifier: MIT OR Apache-2.0\nint x;": "Apache-2.0 OR MIT",
        "// SPDX-License-Identifier: MIT\nint x;": "MIT",
        "// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt or copy at\n// http://www.boost.org/LICENSE_1_0.txt)\n": "BSL-1.0",
        "Eclipse Public License - v 2.0": "EPL-2.0",
        "plain text about the mit and a license to kill, with many words around": None,
    }
    docs = spark.createDataFrame([(i, f"{i}/x.py", t) for i, t in enumerate(files)], "doc_id long, path string, text string")
    got = {r.doc_id: r.own_license for r in licenses.scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(files))] == list(files.values())


def test_notices_as_they_stand_in_files_are_found(spark):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id + 1000 doc_id", "concat('corpus/', doc_id) path", "text")
    rng = random.Random(4)
    rows = []
    for i, (name, text) in enumerate(NOTICES.items()):
        code = "\n".join(words(rng, 8) for _ in range(200))
        rows += [(2 * i, f"{name}/LICENSE.txt", text), (2 * i + 1, f"{name}/src/a/file", text + "\n" + code), (500 + i, f"{name}/src/b/c/other", code)]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string").union(sf)
    got = {r.path: r for r in licenses.scan_licenses(docs).where("doc_id < 1000").collect()}
    for name in NOTICES:
        assert got[f"{name}/LICENSE.txt"].own_license == name and got[f"{name}/src/a/file"].own_license == name, name
        r = got[f"{name}/src/b/c/other"]
        assert (r.own_license, r.license, r.inherited_from) == (None, name, name)


def test_the_bound_on_parts_loses_nothing():
    rng = random.Random(8)
    vocabulary = [w for _, t in licenses.TEMPLATES for w in licenses.terms(t)]
    idf = {t: 1 + rng.random() * 6 for t in vocabulary}
    for _ in range(300):
        part = Counter(rng.choice(vocabulary) if rng.random() < 0.6 else f"x{rng.randrange(99)}" for _ in range(rng.randrange(1, 30)))
        w = {t: n * idf.get(t, 8.0) for t, n in part.items()}
        on, all_ = sum(x * x for t, x in w.items() if t in idf), sum(x * x for x in w.values())
        for _, wording in licenses.TEMPLATES:
            v = {t: n * idf[t] for t, n in Counter(licenses.terms(wording)).items()}
            cosine = sum(x * v.get(t, 0) for t, x in w.items()) / np.sqrt(all_ * sum(x * x for x in v.values()))
            assert cosine <= np.sqrt(on / all_) + 1e-9


def test_url_filter_by_brute_force(spark):
    """Many events of few patterns, captures at and between them, in any order."""
    import datetime as dt

    from millrace.llm import urls

    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    moment = lambda: start + dt.timedelta(hours=rng.randrange(24 * 20), minutes=rng.choice((0, 30)))
    keys = ["d:example.com", "d:a.example.com", "p:a.example.com/x/", "d:other.org"]
    events = [(rng.choice(keys), rng.choice(("block", "allow", "remove")), moment()) for _ in range(120)]
    sites = ["http://a.example.com/x/y", "http://a.example.com/z", "http://b.example.com/", "https://other.org/x/", "http://none.net/"]
    captures = [(i, rng.choice(sites), moment()) for i in range(600)]
    got = urls.filter_urls(spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp_ntz"), spark.createDataFrame(events, "key string, verdict string, at timestamp_ntz")).collect()
    covers = {sites[0]: [2, 1, 0], sites[1]: [1, 0], sites[2]: [0], sites[3]: [3], sites[4]: []}
    for r in got:
        want = (None, None)
        for k in covers[r.url]:
            past = [(at, v) for key, v, at in events if key == keys[k] and at <= r.fetched_at]
            if past and max(past)[1] != "remove":
                want = (keys[k], max(past)[1])
                break
        assert (r.entry, r.verdict) == want and r.kept == (want[1] != "block")
