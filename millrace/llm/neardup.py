"""MinHash near-duplicates: SuperMinHash, banding, exact checks, union-find.

Ertl's SuperMinHash gives each element one random permutation of the signature
places; its value at the j-th place visited is j plus a random fraction. Values
of visit j + 1 are above all of visit j, so elements are taken visit by visit
and a document stops as soon as every place holds a value of an earlier visit.

Documents with equal shingle sets form a class first. Classes meet in band
buckets, where their signatures alone are compared, in blocks of bounded size:
each bucket gives a spanning forest of the pairs whose estimate is near the
threshold or above, likeliest links first, never the pairs. Texts move for the
links of these forests only, which are checked on full sets. Where classes
that forests join are not in one component after that, those outside the
largest component are held against the rest, likeliest first, in blocks with a
union-find in each: pairs that are in one component by then need no check, all
others with an estimate near the threshold get one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Staging, group_bounds, keyed_texts, mix64, slices, text_of_classes, trimmed, whole_groups, window_hashes, word_hashes
from millrace.llm.components import connected_components

#: 32 bands of 4: a pair at 0.8 is missed with probability (1 - 0.8**4)**32 < 1e-7.
BANDS, ROWS = 32, 4
#: Signatures that agree on a smaller share are over 5 standard deviations below 0.8.
MARGIN = 0.18
#: Classes in one block of a bucket; a comparison holds two blocks of signatures.
BUCKET_BLOCK = 1024
#: Shingles in one block of a mixed group; a task holds two blocks.
GROUP_BLOCK = 250_000
#: Shingles worked on at once (their permutation state takes 128 bytes each).
BLOCK = 32_768


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words: the whole sequence as one."""
    h = word_hashes(text.lower())  # bytes.lower() changes A-Z alone
    if not len(h):
        return h
    return np.unique(window_hashes(h, min(k, len(h))))


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (len(sets), m) of non-empty sets; level-synchronous SuperMinHash."""
    n_sets = len(sets)
    x = np.concatenate(sets)
    owner = np.repeat(np.arange(n_sets), [len(s) for s in sets])
    sig = np.full(n_sets * m, np.iinfo(np.uint64).max, np.uint64)
    perm = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(x), m)).copy()
    live = np.arange(len(x))
    for j in range(m):
        own = owner[live]
        r = mix64(x[live] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        k = j + ((r >> np.uint64(32)) % np.uint64(m - j)).astype(np.int64)
        place = perm[live, k]
        perm[live, k] = perm[live, j]
        np.minimum.at(sig, own * m + place, (r & np.uint64(0xFFFFFFFF)) | np.uint64(j << 32))
        open_ = sig.reshape(n_sets, m).max(axis=1) >= np.uint64((j + 1) << 32)
        if not open_.any():
            break
        live = live[open_[own]]
    return sig.reshape(n_sets, m)


def _sign(k: int, bands: int, rows: int):
    m = bands * rows
    salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches):
        for batch in slices(batches):
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            fps, sizes, codes, sigs = [], [], [None] * len(texts), [None] * len(texts)
            block: list[tuple[int, np.ndarray]] = []

            def flush():
                if block:
                    v = super_minhash([s for _, s in block], m).reshape(len(block), bands, rows)
                    h = np.broadcast_to(salt, v.shape[:2]).copy()
                    for i in range(rows):
                        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + v[:, :, i])
                    low = (v & np.uint64(255)).astype(np.uint8).reshape(len(block), m)
                    for (i, _), c, x in zip(block, h.view(np.int64), low):
                        codes[i], sigs[i] = c, x.tobytes()
                    block.clear()

            held = 0
            for i, t in enumerate(texts):
                s = shingle_set(t.as_py() or b"", k)
                sizes.append(len(s))
                fps.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    block.append((i, s))
                    held += len(s)
                    if held >= BLOCK:
                        flush()
                        held = 0
            flush()
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(codes, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["doc_id", "key", "fp", "n_shingles", "codes", "sig"])

    return run


def likely_forest(sig: np.ndarray, size: np.ndarray, num: int, den: int) -> tuple[list[int], list[int]]:
    """Links of a spanning forest over the sets whose signatures (rows of bytes) agree well enough, likeliest first (Prim).

    Sizes bound the similarity of two sets exactly; signatures estimate it.
    """
    n = len(sig)
    best, by = np.full(n, -1.0), np.zeros(n, np.int64)
    todo = np.ones(n, bool)
    a, b, at = [], [], 0
    for _ in range(n - 1):
        todo[at] = False
        rest = np.flatnonzero(todo)
        share = (sig[rest] == sig[at]).mean(axis=1)
        share[np.minimum(size[rest], size[at]) * den < np.maximum(size[rest], size[at]) * num] = -1
        better = share > best[rest]
        best[rest[better]], by[rest[better]] = share[better], at
        at = rest[best[rest].argmax()]
        if best[at] >= num / den - MARGIN:
            a.append(int(by[at]))
            b.append(int(at))
    return a, b


def _forests(num: int, den: int):
    """Rows (place, fp, n, sig) in order of place, a comparison's number -> links (a, b) of each place's forest."""

    def run(batches):
        for t in whole_groups(batches):
            fp, size = t.column("fp").to_pylist(), t.column("n").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(fp), -1)
            a, b = [], []
            for lo, hi in group_bounds(t.column("place").to_numpy()):
                x, y = likely_forest(sig[lo:hi], size[lo:hi], num, den)
                a += [fp[lo + i] for i in x]
                b += [fp[lo + i] for i in y]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def _matching_text(k: int):
    """Keeps the rows whose text has the wanted set (ids may repeat with other texts)."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            ok = [xxhash.xxh3_128_digest(shingle_set(t.as_py() or b"", k).tobytes()) == f for t, f in zip(texts, b.column(0).to_pylist())]
            yield b.filter(pa.array(ok, pa.bool_()))

    return run


def _confirm(k: int, num: int, den: int):
    """Rows (a, b, text of a, text of b) -> links (a, b): den * |A and B| >= num * |A or B|."""

    def run(batches):
        last: dict = {}

        def of(fp, text):
            if fp not in last:
                if len(last) >= 4:
                    last.clear()
                last[fp] = shingle_set(text, k)
            return last[fp]

        for b in batches:
            fa, fb = b.column(0).to_pylist(), b.column(1).to_pylist()
            ta, tb = b.column(2).cast(pa.binary()), b.column(3).cast(pa.binary())
            ok = []
            for i in range(len(fa)):
                x, y = of(fa[i], ta[i].as_py()), shingle_set(tb[i].as_py(), k)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    return run


def _link_block(k: int, num: int, den: int, m: int):
    """Classes of one or two blocks of a group -> links that join their components further.

    Within a block the pairs are those inside it, between two blocks those across.
    """

    def run(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_pylist() for c in ("own", "fp", "root", "inside")}
        order = sorted(range(len(col["fp"])), key=lambda i: col["fp"][i])
        texts = table.column("text").cast(pa.binary())
        sets = [shingle_set(texts[i].as_py(), k) for i in order]
        own, inside = (np.array([col[c][i] for i in order]) for c in ("own", "inside"))
        fps = [col["fp"][i] for i in order]
        across = table.column("i")[0] != table.column("j")[0]
        size = np.array([len(x) for x in sets])
        sig, lo = [], 0
        while lo < len(sets):  # signatures a few sets at a time
            hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo:]), BLOCK)))
            sig.append(super_minhash(sets[lo:hi], m).astype(np.uint16))  # 16 bits tell agreeing places apart well enough
            lo = hi
        sig = np.concatenate(sig)
        _, at = np.unique(np.array([col["root"][i] for i in order], dtype=object), return_inverse=True)
        parent = list(range(int(at.max()) + 1))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        a, b = [], []
        for x in np.flatnonzero(~inside):
            fits = (np.minimum(size, size[x]) * den >= np.maximum(size, size[x]) * num) & (at != at[x])
            if across:
                fits &= own != own[x]
            ys = np.flatnonzero(fits)
            share = (sig[ys] == sig[x]).mean(axis=1)
            likely = share >= num / den - MARGIN
            ys = ys[likely][np.argsort(-share[likely], kind="stable")]
            for y in ys.tolist():
                rx, ry = find(at[x]), find(at[y])
                if rx == ry:
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if den * both >= num * (size[x] + size[y] - both):
                    parent[max(rx, ry)] = min(rx, ry)
                    a.append(fps[x])
                    b.append(fps[y])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = (80, 100), bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Links join documents whose word-shingle sets have a Jaccard similarity of
    similarity[0] / similarity[1] or more; component_id is the smallest id that
    links reach. kept: doc_id = component_id (null-safe).

    Null, empty and blank texts have an empty set and link with nothing. Equal
    sets always link, so repeated rows share a component. Rows with a null id
    take part; they get the smallest id of their component, or null if it has
    none. Other columns of docs are ignored; an empty table gives an empty one.
    """
    groups = near_duplicate_groups(docs, id_col, text_col, shingle, similarity, bands, rows)
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = (80, 100), bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """As near_duplicates, but with key and root in the place of kept.

    key is xxhash64 of the text; id and key tell rows apart where ids are null
    or repeat. root is the component itself, null for an empty set.
    """
    spark = docs.sparkSession
    num, den = similarity
    st = Staging(spark, "neardup")
    docs = keyed_texts(docs, id_col, text_col)
    signed = st.put(docs.mapInArrow(trimmed(_sign(shingle, bands, rows)), "doc_id long, key long, fp binary, n_shingles long, codes array<long>, sig binary"), "signed")
    thin = signed.select("doc_id", "key", "fp", "n_shingles")

    codes = signed.where("n_shingles > 0").groupBy("fp").agg(*(F.first(c).alias(c) for c in ("codes", "n_shingles", "sig")))
    classes = st.put(codes.withColumnRenamed("n_shingles", "n"), "classes")
    entries = classes.select("fp", F.explode("codes").alias("bucket"))
    # of buckets with the same classes one will do
    full = entries.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y")).where("size > 1")
    full = full.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("size") / BUCKET_BLOCK).cast("int").alias("blocks"))
    full = st.put(full, "full")  # staged: Spark can then split a hot bucket's join
    members = entries.join(full, "bucket").withColumn("own", F.pmod(F.hash("fp"), F.col("blocks")))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("place")
    members = members.select("fp", place).join(classes.select("fp", "n", "sig"), "fp").select("place", "fp", "n", "sig")
    forest = members.repartition("place").sortWithinPartitions("place", "fp").mapInArrow(trimmed(_forests(num, den)), "a binary, b binary")
    forest = st.put(forest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "forest")

    linked = forest.select(F.col("a").alias("fp")).union(forest.select("b")).distinct()
    texts = text_of_classes(docs, signed.select("fp", "doc_id", "key").join(linked, "fp", "left_semi"))
    texts = st.put(texts.mapInArrow(trimmed(_matching_text(shingle)), "fp binary, text string").dropDuplicates(["fp"]), "texts")
    one, other = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    pairs = forest.join(other, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    links = st.put(pairs.mapInArrow(trimmed(_confirm(shingle, num, den)), "a binary, b binary"), "links")
    roots = connected_components(links, st)

    # groups that forests join, where more than one component is left after that
    group = connected_components(forest, st).toDF("fp", "grp")
    known = group.join(classes.select("fp", "n"), "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    by_root = known.groupBy("grp", "root").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    mixed = by_root.groupBy("grp").agg(F.sum("k").alias("size"), F.count("*").alias("roots"), F.max(F.struct("k", "root")).getField("root").alias("main"), F.sum("n").alias("n"))
    mixed = mixed.where("roots > 1 and size > 2").select("grp", "main", F.ceil(F.col("n") / GROUP_BLOCK).cast("int").alias("blocks"))
    known = known.select("fp", "grp", "root").join(mixed, "grp")
    own = F.pmod(F.hash("fp"), F.col("blocks"))
    known = known.select("grp", "fp", F.col("root").eqNullSafe(F.col("main")).alias("inside"), "root", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = st.put(known.join(texts, "fp").select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "root", "inside", "text"), "dealt")
    found = dealt.groupBy("grp", "i", "j").applyInArrow(_link_block(shingle, num, den, bands * rows), "a binary, b binary")
    roots = connected_components(links.union(found), st)
    st.drop(classes, full, forest, texts, links, dealt)

    ids = thin.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = ids.join(roots.withColumnRenamed("node", "fp"), "fp")
    named = joined.groupBy("root").agg(F.min("least").alias("component"))
    linked = joined.join(named, "root").select("fp", "root", "component")
    by_class = ids.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"), F.coalesce("root", "fp").alias("root"))
    by_class = st.put(by_class, "classes")  # staged: Spark can then split the join of a class of very many copies
    out = thin.join(by_class, "fp", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "key", "n_shingles", component.alias("component_id"), F.when(F.col("n_shingles") > 0, F.col("root")).alias("root"))
