"""Substring dedup by level-wise doubling over windows of words.

A window is `length` consecutive words of one text; words covered by a window
whose sequence also starts elsewhere are removed. Windows that repeat at one
length alone go on to twice that length: a quarter of the length, a half, the
whole. A long window repeats only if the shorter ones inside it do.

The first level does not need a window at every word. In each full window the
quarter window with the least hash is its anchor; equal full windows have equal
anchors at the same place, so only anchors (about 2 in length - quarter + 2
places) are counted. Repeated anchors are doubled to the half window that runs
on from the anchor, or up to it, inside the full window; repeated halves are
doubled to the full windows round them. When no candidates survive a level,
the later ones do not run. The last level sorts windows and looks at neighbours
in one pass, whatever the size of a group.

Texts with the same words form a class and enter once; a class of several
texts has all its windows repeated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Staging, is_empty, keyed_texts, mix64, slices, text_of_classes, trimmed, window_hashes, word_hashes


def _levels(length: int) -> tuple[int, int]:
    half = (length + 1) // 2
    return (half + 1) // 2, half


def anchors(h: np.ndarray, length: int, quarter: int) -> np.ndarray:
    """For each full window its anchor: where its least quarter window starts (the first, if tied)."""
    q = window_hashes(h, quarter)
    width, n = length - quarter + 1, len(q)
    if n < width:
        return np.empty(0, np.int64)
    order = np.argsort(q, kind="stable")  # ties stay from left to right
    rank = np.empty(n + -n % width, np.int64)
    rank[n:] = n
    rank[order] = np.arange(n)
    # sliding minimum: of the rest of one block and the start of the next
    v = rank.reshape(-1, width)
    left = np.minimum.accumulate(v, axis=1).ravel()[:n]
    right = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return order[np.minimum(right[: n - width + 1], left[width - 1 :])]


def _scan(length: int):
    quarter, _ = _levels(length)

    def run(batches):
        for b in slices(batches):
            fps, sizes, shas, hashes = [], [], [], []
            for t in b.column(1).cast(pa.binary()):
                words = (t.as_py() or b"").split()
                joined = b" ".join(words)
                fps.append(xxhash.xxh3_128_digest(joined))
                sizes.append(len(words))
                shas.append(hashlib.sha256(joined).hexdigest())
                h = word_hashes(joined)
                places = np.unique(anchors(h, length, quarter))
                hashes.append(window_hashes(h, quarter)[places].view(np.int64) if len(places) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "key", "fp", "n_words", "sha256", "anchors"])

    return run


def _half_places(at: np.ndarray, length: int) -> np.ndarray:
    """Where each full window's half starts: at its anchor, or so as to end with it."""
    quarter, half = _levels(length)
    starts = np.arange(len(at))
    return np.where(at + half <= starts + length, at, at + quarter - half)


def _halves(length: int):
    """Rows (fp, text, repeated anchors) -> (fp, half windows at those anchors, each place once)."""
    quarter, half = _levels(length)

    def run(batches):
        for b in batches:
            out = []
            for t, known in zip(b.column(1).cast(pa.binary()), b.column(2)):
                h = word_hashes(t.as_py() or b"")
                at = anchors(h, length, quarter)
                hit = np.isin(window_hashes(h, quarter).view(np.int64)[at], known.values.to_numpy(zero_copy_only=False))
                places = np.unique(_half_places(at, length)[hit])
                out.append(window_hashes(h, half)[places].view(np.int64) if len(places) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["fp", "halves"])

    return run


#: Windows in one batch that a task sends on.
SEND = 100_000


def _wholes(length: int):
    """Rows (fp, text, repeated halves) -> (fp, whole_1, whole_2, place, sure) of the full windows round those halves.

    Windows that repeat within a batch are sure already: they get keys of
    their own, and one row stands for all of them under the common key, so the
    exchange has a hot window once a batch.
    """
    quarter, half = _levels(length)

    def run(batches):
        for b in batches:
            fps, counts, cols = [], [], ([], [], [])

            def send():
                one, two, place = (np.concatenate(c) for c in cols)
                owner = np.repeat(np.arange(len(fps)), counts)
                order = np.lexsort((two, one))
                same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
                sure, follows = np.zeros((2, len(one)), bool)
                sure[order[1:][same]] = True
                sure[order[:-1][same]] = True
                follows[order[1:][same]] = True
                speaks = np.flatnonzero(sure & ~follows)
                spread = mix64(one.view(np.uint64) ^ mix64((owner * (1 << 32) + place).astype(np.uint64) ^ np.uint64(xxhash.xxh3_64_intdigest(b"".join(fps))))).view(np.int64)
                at = np.concatenate([np.arange(len(one)), speaks])
                one = np.concatenate([np.where(sure, spread, one), one[speaks]])
                names = pa.array(fps, pa.binary()).take(pa.array(owner[at]))
                flag = np.concatenate([sure, np.zeros(len(speaks), bool)])
                for x in (fps, counts, *cols):
                    x.clear()
                return pa.RecordBatch.from_arrays([names, pa.array(one), pa.array(two[at]), pa.array(place[at]), pa.array(flag)], names=["fp", "whole_1", "whole_2", "place", "sure"])

            for fp, t, known in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2)):
                h = word_hashes(t.as_py() or b"")
                places = _half_places(anchors(h, length, quarter), length)
                starts = np.flatnonzero(np.isin(window_hashes(h, half).view(np.int64)[places], known.values.to_numpy(zero_copy_only=False)))
                if not len(starts):
                    continue
                fps.append(fp)
                counts.append(len(starts))
                # two independent hashes: 128 bits keep different windows apart at any size
                cols[0].append(window_hashes(h, length)[starts].view(np.int64))
                cols[1].append(window_hashes(h ^ np.uint64(0x5851F42D4C957F2D), length)[starts].view(np.int64))
                cols[2].append(starts.astype(np.int32))
                if sum(counts) >= SEND:
                    yield send()
            if fps:
                yield send()

    return run


def _repeated(batches):
    """Rows sorted by window -> (fp, place) of those that repeat; a batch's last row waits for the next batch."""
    last, pending = None, None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy() for i in (1, 2)])
        same = np.zeros(b.num_rows + 1, bool)
        same[1:-1] = (keys[:, 1:] == keys[:, :-1]).all(axis=0)
        same[0] = last is not None and bool((keys[:, 0] == last).all())
        hit = same[:-1] | same[1:] | b.column(4).to_numpy(zero_copy_only=False)
        if same[0] and pending is not None:
            yield pending
        out = b.select([0, 3])
        last = keys[:, -1].copy()
        pending = None if hit[-1] else out.slice(b.num_rows - 1)
        yield out.filter(pa.array(hit, pa.bool_()))


def _cut(length: int):
    def run(batches):
        for b in batches:
            gone, kept, texts = [], [], []
            for t, starts in zip(b.column(1).cast(pa.binary()), b.column(2)):
                words = (t.as_py() or b"").split()
                mark = np.zeros(len(words) + 1, np.int32)
                s = np.unique(starts.values.to_numpy(zero_copy_only=False))
                np.add.at(mark, s, 1)
                np.add.at(mark, s + length, -1)
                keep = np.cumsum(mark[:-1]) == 0
                left = b" ".join([w for w, k in zip(words, keep) if k])
                gone.append(len(words) - int(keep.sum()))
                kept.append(hashlib.sha256(left).hexdigest())
                texts.append(left)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], names=["fp", "n_removed", "kept_sha256", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept_text, key.

    kept_text: the words left, joined by one space, where some but not all are
    removed; null where the text stays as it is or loses every word (see
    n_removed). kept_sha256 is always that of the words left; key is xxhash64 of
    the text, which tells texts under one id apart.

    Null, empty and blank texts have no words; texts shorter than the window
    lose nothing. Repeated rows are separate texts, so they lose every window.
    Ids are carried along only: null or repeated ids make no difference. Other
    columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    st = Staging(spark, "substring")
    docs = keyed_texts(docs, id_col, text_col)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    scanned = st.put(docs.mapInArrow(trimmed(_scan(length)), "doc_id long, key long, fp binary, n_words long, sha256 string, anchors array<long>"), "scanned")
    classes = scanned.where(F.col("n_words") >= length).groupBy("fp").agg(F.count("*").alias("copies"), F.first("anchors").alias("anchors"))
    classes = st.put(classes, "classes")

    # level 1: anchors that repeat, within a text or among texts
    known = _survivors(st, classes.select("fp", F.explode("anchors").alias("h")))
    cut = None
    if not is_empty(known):
        # one text of each class that has candidates
        texts = text_of_classes(docs, scanned.join(known.select("fp"), "fp", "left_semi"))
        texts = texts.mapInArrow(trimmed(_same_words), "fp binary, text string").dropDuplicates(["fp"])
        texts = st.put(texts.join(known, "fp").select("fp", "text", "known"), "texts")
        st.drop(known)
        staged = texts
        # level 2: halves that repeat
        halves = texts.mapInArrow(trimmed(_halves(length)), "fp binary, halves array<long>")
        known = _survivors(st, halves.select("fp", F.explode("halves").alias("h")))
        if not is_empty(known):
            # the last level: whole windows that repeat; only texts that lose some, but not all, are cut
            once = classes.where("copies = 1").select("fp")
            texts = texts.select("fp", "text")
            rows = texts.join(known, "fp").mapInArrow(trimmed(_wholes(length)), "fp binary, whole_1 long, whole_2 long, place int, sure boolean")
            rows = rows.repartition(F.col("whole_1")).sortWithinPartitions("whole_1", "whole_2")
            hits = rows.mapInArrow(trimmed(_repeated), "fp binary, place int").groupBy("fp").agg(F.collect_list("place").alias("places"))
            hits = texts.join(hits.join(once, "fp", "left_semi"), "fp").select("fp", "text", "places")
            cut = st.put(hits.mapInArrow(trimmed(_cut(length)), "fp binary, n_removed long, kept_sha256 string, kept_text string"), "cut")
            st.drop(staged, known)

    out = scanned.select("doc_id", "key", "fp", "n_words", "sha256").join(classes.where("copies > 1").select("fp", F.lit(True).alias("copied")), "fp", "left")
    copied = F.coalesce(F.col("copied"), F.lit(False))
    if cut is None:
        out = out.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("n_removed", "long"), ("kept_sha256", "string"), ("kept_text", "string"))))
    else:
        out = out.join(cut, "fp", "left")
    removed = F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    sha = F.when(copied, empty).otherwise(F.coalesce("kept_sha256", "sha256"))
    return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), sha.alias("kept_sha256"), "kept_text", "key")


def _survivors(st: Staging, hashes: DataFrame) -> DataFrame:
    """(fp, h) -> (fp, known): of each text the hashes that occur at two places or more in all."""
    # staged, so that the join has a plain exchange on either side and Spark can split a hot hash
    often = st.put(hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "often")
    known = st.put(hashes.join(often, "h", "left_semi").groupBy("fp").agg(F.collect_set("h").alias("known")), "known")
    st.drop(often)
    return known


def _same_words(batches):
    """Keeps the rows (fp, text) whose words have that fingerprint."""
    for b in batches:
        ok = [xxhash.xxh3_128_digest(b" ".join((t.as_py() or b"").split())) == f for f, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()))]
        yield b.filter(pa.array(ok, pa.bool_()))
