"""Quality rules: base counts of a text, and bands of its n-gram perplexity.

The model is a modified Kneser-Ney model (Chen and Goodman) of character
5-grams over all code points, one for each language and half of the texts,
counted by Spark over every text. It is kept as sorted arrays of 64-bit n-gram
hashes beside discounted probabilities and back-off weights, cut into shards
of bounded size, and looked up by binary search. A text is judged by the model
of the half that it is not in (halves go by a hash of the text, so copies
never judge themselves), and the logarithm of its perplexity by word is held
against its language's band; texts far below (lists, boilerplate) or far above
it (noise) are rejected. The mean over n words of a text varies by 1 / sqrt(n),
so the band of a language is the wider, the shorter the text.

The model grows with the corpus. Up to SEND_BYTES it is sent to the tasks
whole; beyond that, texts form batches in the shared folder, each batch asks
for the distinct n-grams it has, and joins bring it those alone. Both ways
give the same results.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Staging, slices, trimmed, window_hashes, word_hashes

ORDER = 5
#: Stands before each text; no text has it, as runs of blanks become one space.
START = "\n" * (ORDER - 1)
#: Characters worked on at once, and n-grams that a counting task holds before it merges them.
CHUNK, HELD = 1_000_000, 1_000_000
#: Entries in a shard of the model; bytes of a model that tasks get whole; bytes of text in a batch.
SHARD, SEND_BYTES, BATCH = 2**18, 256 * 2**20, 64 * 2**20
#: A hash and a value.
ENTRY_BYTES = 12
#: Slots of the model: 0 the uniform share, k the k-grams, BACK + k their contexts' back-off weights.
BACK = 10
#: Half widths of the band, in standard deviations below and above the median: about 1 in 1000 clean texts is lost.
BELOW, ABOVE = 3.5, 7.0
#: Long texts count as varying by this share of the median at least.
LEAST_SPREAD = 0.01
MULT = 0x9E3779B97F4A7C15


def pieces_of(texts):
    """Texts -> (number of the text, characters with ORDER - 1 of context before them), CHUNK characters at most."""
    for i, t in enumerate(texts):
        s = " ".join((t.as_py() or "").split())
        for lo in range(0, len(s), CHUNK):
            yield i, (s[lo - ORDER + 1 : lo] if lo else START) + s[lo : lo + CHUNK]


def _chunks(texts):
    """Pieces, about CHUNK characters at a time: (numbers of the texts, code points + 1, ends of n-grams, n-grams a piece)."""
    rows, parts, size = [], [], 0
    for i, s in pieces_of(texts):
        rows.append(i)
        parts.append(s)
        size += len(s)
        if size >= CHUNK:
            yield _windows(rows, parts)
            rows, parts, size = [], [], 0
    if rows:
        yield _windows(rows, parts)


def _windows(rows, parts):
    x = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
    size = np.array([len(p) for p in parts])
    inside = np.ones(len(x), bool)
    inside[((np.cumsum(size) - size)[:, None] + np.arange(ORDER - 1)).ravel()] = False
    return np.array(rows), x, np.flatnonzero(inside), size - (ORDER - 1)


def hash_of(columns: list[np.ndarray], n: int) -> np.ndarray:
    """Hash of n n-grams whose characters, last first, are the columns: the sum of characters by powers, modulo 2**64."""
    h, power = np.zeros(n, np.uint64), 1
    for c in columns:
        h += c.astype(np.uint64) * np.uint64(power)
        power = power * MULT % 2**64
    return h.view(np.int64)


def _distinct(x: np.ndarray, ends: np.ndarray):
    """(which distinct n-gram stands at each end, the code points of each distinct one, last first)."""
    which, seen = pd.factorize(hash_of([x[ends - j] for j in range(ORDER)], len(ends)))
    at = np.empty(len(seen), np.int64)
    at[which] = ends
    return which, [x[at - j] for j in range(ORDER)]


def _count(batches):
    """Texts (lang, half, text) -> (lang, half, gram, n), merged by task."""
    held: dict[tuple, list] = {}
    size = 0

    def merged(key):
        parts = held.pop(key)
        grams = np.concatenate([g for g, _ in parts])
        which, seen = pd.factorize(hash_of(list(grams.T), len(grams)))
        n = np.bincount(which, np.concatenate([c for _, c in parts])).astype(np.int64)
        at = np.empty(len(seen), np.int64)
        at[which] = np.arange(len(which))
        return grams[at], n

    def out():
        for key in list(held):
            grams, n = merged(key)
            text = (grams[:, ::-1] - np.uint32(1)).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            words = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
            for lo in range(0, len(words), 50_000):
                part = slice(lo, lo + 50_000)
                k = len(words[part])
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * k, pa.string()), pa.array([key[1]] * k, pa.int32()), pa.array(words[part], pa.string()), pa.array(n[part])], names=["lang", "half", "gram", "n"])

    for b in batches:
        for key, rows in _groups(b.column(0), b.column(1)):
            for _, x, ends, _ in _chunks(b.column(2).take(rows)):
                which, chars = _distinct(x, ends)
                held.setdefault(key, []).append((np.stack(chars, axis=1), np.bincount(which).astype(np.int64)))
                size += len(chars[0])
        if size >= HELD:
            for key in list(held):
                held[key] = [merged(key)]
            size = sum(len(g) for parts in held.values() for g, _ in parts)
            if size >= HELD:
                yield from out()
                size = 0
    yield from out()


def _groups(*columns):
    """Rows of equal values in all columns, with those values."""
    rows: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(c.to_pylist() for c in columns))):
        rows.setdefault(key, []).append(i)
    return [(key, pa.array(r)) for key, r in rows.items()]


def counted_grams(grams: DataFrame, staging: Staging) -> DataFrame:
    """N-grams (lang, half, gram, n) -> staged (lang, half, k, gram, c), k from 1 to ORDER.

    The longest ones count as they occur; shorter ones count the different
    characters to their left.
    """
    key = ["lang", "half", "k"]
    longest = grams.groupBy("lang", "half", "gram").agg(F.sum("n").alias("c"))
    # each n-gram and its suffixes; for k below ORDER the suffix of k + 1 characters, which counts once for its last k
    ends = [F.struct(F.lit(k).alias("k"), F.substring("gram", ORDER - k, k + 1).alias("gram"), F.lit(1).cast("long").alias("c")) for k in range(1, ORDER)]
    ends.append(F.struct(F.lit(ORDER).alias("k"), F.col("gram"), F.col("c")))
    once = longest.select("lang", "half", F.explode(F.array(*ends)).alias("s")).groupBy("lang", "half", "s.k", "s.gram").agg(F.max("s.c").alias("c"))
    counted = once.groupBy(*key, F.expr(f"if(k < {ORDER}, substring(gram, 2), gram)").alias("gram")).agg(F.sum("c").alias("c"))
    return staging.put(counted, "counted")


def model_entries(counted: DataFrame) -> DataFrame:
    """counted_grams() -> entries (lang, half, slot, gram, value) of the model.

    P(c after h) of order k is value(k, hc) + value(BACK + k, h) * P of order
    k - 1, where n-grams that are not there count 0 and contexts that are not
    there pass on all weight; order 0 is uniform. Discounts are those for
    counts of one, two, and three or more.
    """
    key = ["lang", "half", "k"]
    n = [F.count(F.when(F.col("c") == i, 1)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    many = counted.groupBy(*key).agg(*n, F.count("*").alias("types"))
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.0)
    best = [i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1.0)) for i in (1, 2, 3)]
    discounts = many.select(*key, "types", *[F.least(F.greatest(d, F.lit(0.1)), F.lit(i - 0.1)).alias(f"d{i}") for i, d in zip((1, 2, 3), best)])

    cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    counted = counted.join(discounts, key).select(*key, "gram", F.expr("substring(gram, 1, k - 1)").alias("before"), "c", cut.alias("cut"))
    contexts = counted.groupBy(*key, "before").agg(F.sum("c").alias("total"), F.sum("cut").alias("lost"))
    own = counted.join(contexts, [*key, "before"])
    own = own.select("lang", "half", F.col("k").alias("slot"), "gram", ((F.col("c") - F.col("cut")) / F.col("total")).alias("value"))
    back = contexts.select("lang", "half", (F.col("k") + BACK).alias("slot"), F.col("before").alias("gram"), (F.col("lost") / F.col("total")).alias("value"))
    uniform = discounts.where("k = 1").select("lang", "half", F.lit(0).alias("slot"), F.lit("").alias("gram"), (1 / (F.col("types") + 1)).alias("value"))
    return own.unionByName(back).unionByName(uniform)


def _hashed(batches):
    """Entries (lang, half, slot, gram, value) -> the same with the hash of the gram."""
    for b in batches:
        slots, out = b.column(2).to_numpy(), np.zeros(b.num_rows, np.int64)
        for slot in np.unique(slots):
            rows = np.flatnonzero(slots == slot)
            size = int(slot) if slot < BACK else int(slot) - BACK - 1
            if size:
                text = "".join(b.column(3).take(pa.array(rows)).to_pylist())
                chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), size) + np.uint32(1)
                out[rows] = hash_of(list(chars.T[::-1]), len(rows))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out), b.column(4)], names=["lang", "half", "slot", "key", "value"])


def _sorted(table: pa.Table) -> pa.Table:
    """A shard's entries as one row of sorted arrays."""
    keys, values = table.column("key").to_numpy(), table.column("value").to_numpy()
    order = np.argsort(keys, kind="stable")
    first = {c: table.column(c)[:1] for c in ("lang", "half", "slot", "shard")}
    return pa.table({**first, "keys": pa.array([keys[order].tobytes()], pa.binary()), "vals": pa.array([values[order].astype(np.float32).tobytes()], pa.binary())})


def sorted_shards(entries: DataFrame, n: int) -> DataFrame:
    """Entries (at most n) as sorted arrays (lang, half, slot, shard, keys, vals); shards are ranges of the hash of at most about SHARD entries."""
    bits = max(0, int(np.ceil(np.log2(max(1, n) / SHARD))))
    shard = F.expr(f"shiftright(key, {64 - bits})") if bits else F.lit(0).cast("long")
    groups = entries.withColumn("shard", shard).groupBy("lang", "half", "slot", "shard")
    return groups.applyInArrow(_sorted, "lang string, half int, slot int, shard long, keys binary, vals binary")


def _found(tables: dict, slot: int, keys: np.ndarray, default: float) -> np.ndarray:
    if slot not in tables:
        return np.full(len(keys), default)
    known, values = tables[slot]
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at].astype(np.float64), default)


def log_probabilities(chars: list[np.ndarray], tables: dict) -> np.ndarray:
    """Of each n-gram's last character after the others; tables: slot -> (sorted hashes, values)."""
    n = len(chars[0])
    p = _found(tables, 0, np.zeros(n, np.int64), 1.0)
    for k in range(1, ORDER + 1):
        p = _found(tables, k, hash_of(chars[:k], n), 0.0) + _found(tables, BACK + k, hash_of(chars[1:k], n), 1.0) * p
    return np.log(p)


_BLANK, _SYMBOL, _STARTS = 1, 2, 4


def base_counts(text: bytes, kinds: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    kind = np.bincount(kinds[np.frombuffer(text, np.uint8)], minlength=8)
    blanks = int(kind[_BLANK | _STARTS])
    chars = int(kind[[k for k in range(8) if k & _STARTS]].sum()) - blanks
    seen, repeated = set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            if line in seen:
                repeated += 1
            seen.add(line)
    h = word_hashes(text)
    n = len(h)
    w = window_hashes(h, 3)
    if len(w):
        _, at, times = np.unique(w, return_inverse=True, return_counts=True)
        starts = times[at] > 1
        cover = np.zeros(n, bool)
        for i in range(3):
            cover[i : i + len(starts)] |= starts
        again = int(cover.sum())
    else:
        again = 0
    return n, chars, int(kind[_SYMBOL | _STARTS]), repeated, again


def byte_kinds() -> np.ndarray:
    """By byte: does it start a code point, is it one of the six blanks, is it a symbol of the rules?"""
    out = np.full(256, _STARTS, np.uint8)
    out[0x80:0xC0] = 0
    out[[0x20, *range(9, 14)]] |= _BLANK
    out[list(b"#*$%&|<>")] |= _SYMBOL
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCORED = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS) + ", log_perplexity double"


def _scored(b: pa.RecordBatch | pa.Table, tables_of) -> list:
    """Columns SCORED of rows (doc_id, lang, half, text); tables_of(lang, half) has the model to judge by, or nothing."""
    kinds = byte_kinds()
    counts = [base_counts(t.as_py() or b"", kinds) for t in b.column(3).cast(pa.binary())]
    total, known = np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
    for (lang, half), rows in _groups(b.column(1), b.column(2)):
        tables, own = tables_of(lang, half), rows.to_numpy()
        if not tables:
            continue
        for of, x, ends, n in _chunks(b.column(3).take(rows)):
            which, chars = _distinct(x, ends)
            logp = log_probabilities(chars, tables)[which]
            np.add.at(total, own[of], np.add.reduceat(logp, np.cumsum(n) - n))
            known[own[of]] = True
    words = np.array([c[0] for c in counts], np.int64)
    ppl = pa.array(-total / np.maximum(words, 1), mask=~(known & (words > 0)))
    return [b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in zip(*counts)], ppl]


def _score_by(sent):
    """Judges texts by the whole model: (lang, half) -> slot -> (bytes of hashes, bytes of values)."""

    def run(batches):
        model = {key: {slot: (np.frombuffer(k, np.int64), np.frombuffer(v, np.float32)) for slot, (k, v) in slots.items()} for key, slots in sent.value.items()}
        for b in slices(batches, 4096):
            yield pa.RecordBatch.from_arrays(_scored(b, lambda lang, half: model.get((lang, 1 - half))), names=["doc_id", "lang", *COUNTS, "log_perplexity"])

    return run


def _dealt(batch_bytes: int):
    """Adds a batch to rows (doc_id, lang, half, text): about so many bytes of text in the order of the task."""

    def run(batches):
        name, size = uuid.uuid4().int >> 65, 0
        for b in batches:
            names = []
            for t in b.column(3).cast(pa.binary()):
                if size > batch_bytes:
                    name, size = uuid.uuid4().int >> 65, 0
                names.append(name)
                size += len(t.as_py() or b"")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.int64())], names=[*b.schema.names, "batch"])

    return run


def _asked(batches):
    """Rows of _dealt -> the distinct entries (batch, lang, half, slot, key) that they need."""
    for b in batches:
        for (batch, lang, half), rows in _groups(b.column(4), b.column(1), b.column(2)):
            for _, x, ends, _ in _chunks(b.column(3).take(rows)):
                _, chars = _distinct(x, ends)
                n = len(chars[0])
                wanted = [(0, np.zeros(1, np.int64))]
                for k in range(1, ORDER + 1):
                    wanted += [(k, np.unique(hash_of(chars[:k], n))), (BACK + k, np.unique(hash_of(chars[1:k], n)))]
                for slot, keys in wanted:
                    m = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, batch)), pa.array([lang] * m, pa.string()), pa.array(np.full(m, 1 - half, np.int32)), pa.array(np.full(m, slot, np.int32)), pa.array(keys)], names=["batch", "lang", "half", "slot", "key"])


def _score_batch(docs: pa.Table, answers: pa.Table) -> pa.Table:
    model: dict[tuple, dict] = {}
    for key, rows in _groups(answers.column("lang"), answers.column("half"), answers.column("slot")):
        part = answers.take(rows)
        keys, values = part.column("key").to_numpy(), part.column("value").to_numpy().astype(np.float32)
        order = np.argsort(keys)
        model.setdefault(key[:2], {})[key[2]] = (keys[order], values[order])
    cols = _scored(docs.select(["doc_id", "lang", "half", "text"]), lambda lang, half: model.get((lang, 1 - half)))
    return pa.table(cols, names=["doc_id", "lang", *COUNTS, "log_perplexity"])


def scored_texts(docs: DataFrame, staging: Staging, send_bytes: int = SEND_BYTES, batch_bytes: int = BATCH) -> DataFrame:
    """Staged columns SCORED of all rows of docs(doc_id, lang, half, text)."""
    counted = counted_grams(docs.select("lang", "half", "text").mapInArrow(trimmed(_count), "lang string, half int, gram string, n long"), staging)
    entries = model_entries(counted).mapInArrow(_hashed, "lang string, half int, slot int, key long, value double")
    n = 2 * counted.count()  # contexts are no more than n-grams
    if n * ENTRY_BYTES <= send_bytes:
        parts: dict[tuple, dict[int, list]] = {}
        for r in sorted(sorted_shards(entries, n).collect(), key=lambda r: r.shard):
            parts.setdefault((r.lang, r.half), {}).setdefault(r.slot, []).append((r.keys, r.vals))
        model = {key: {slot: tuple(b"".join(c) for c in zip(*rows)) for slot, rows in slots.items()} for key, slots in parts.items()}
        sent = docs.sparkSession.sparkContext.broadcast(model)  # send_bytes at most
        return staging.put(docs.mapInArrow(trimmed(_score_by(sent)), SCORED), "scored")
    entries = staging.put(entries, "entries")
    dealt = staging.put(docs.mapInArrow(_dealt(batch_bytes), "doc_id long, lang string, half int, text string, batch long"), "batches")
    asked = dealt.mapInArrow(_asked, "batch long, lang string, half int, slot int, key long").distinct()
    answers = asked.join(entries, ["lang", "half", "slot", "key"]).select("batch", "lang", "half", "slot", "key", "value")
    return staging.put(dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_score_batch, SCORED), "scored")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, below: float = BELOW, above: float = ABOVE, least_spread: float = LEAST_SPREAD, send_bytes: int = SEND_BYTES) -> DataFrame:
    """One row per row of docs(doc_id, text, lang): the base counts, base_failed, log_perplexity, low, high, kept.

    log_perplexity is in nats a word; low and high are its language's band for
    a text of so many words. Median and spread cover all texts that pass the
    base rules.

    Null, empty and blank texts have counts of 0 and fail the base rules. A
    null lang is a language of its own. A text that passes the base rules and
    has no log_perplexity (the other half has no text in its language) or no
    band is kept. Repeated rows count as often as they occur and get equal
    results; ids are carried along only. Other columns are ignored; an empty
    table gives an empty one.
    """
    staging = Staging(docs.sparkSession, "quality")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "lang", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"), "text")
    scored = scored_texts(rows, staging, send_bytes).withColumn("base_failed", base_failed())
    good = scored.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull())
    # one row a language; staged, so that Spark knows their size and how to join them
    middle = staging.put(good.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("median")), "middle")
    off = good.join(middle, "lang").select("lang", "median", ((F.col("log_perplexity") - F.col("median")) * F.sqrt("n_words")).alias("t"))
    quartile = off.groupBy("lang").agg(F.first("median").alias("median"), F.percentile_approx("t", [0.25, 0.75], 10_000).alias("q"))
    bands = staging.put(quartile.select("lang", "median", ((F.col("q")[1] - F.col("q")[0]) / 1.349).alias("spread")), "bands")
    width = F.sqrt(F.col("spread") * F.col("spread") / F.greatest(F.col("n_words"), F.lit(1)) + F.pow(least_spread * F.col("median"), 2))
    out = scored.join(bands, "lang", "left").withColumn("low", F.col("median") - below * width).withColumn("high", F.col("median") + above * width)
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return out.drop("median", "spread").withColumn("kept", ~F.col("base_failed") & inside)
