"""Language ID by cross-parsing entropy over suffix automata.

Per language, a suffix automaton holds every substring of some labelled text.
A text is parsed from left to right into phrases, each the longest match in
that automaton plus the character that ends it; the fewer phrases, the better
the language explains the text (Ziv and Merhav's cross-parsing). Phrase counts
are normalised by log2 of the labelled text's length over the text's length.

Symbols are letters, however many a script has; one that a language's sample
lacks ends the phrase. The automata come from a bounded sample of whole texts (a
fitted classifier), each in a task of its own and packed into one array;
everything else covers whole texts.
Inside a task many texts advance together: one numpy lookup per character place
and language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from millrace.llm.common import fold, held_out, slices, trimmed

#: Labelled characters to learn a language from: whole texts, as many as have so many together.
SAMPLE_CHARS = 120_000
#: Bytes of all languages' automata that are sent to tasks; more are refused.
MODEL_BYTES = 1 << 30
#: Bits of a step that hold its symbol; all of them set mark an empty place.
BITS = 21
NO_SYMBOL = (1 << BITS) - 1
#: Texts are parsed in pieces of so many characters, each from a fresh phrase.
PIECE = 2048
_said = StructType().add("lang_pred", StringType()).add("score", DoubleType()).add("n_letters", LongType())


def letter_table() -> np.ndarray:
    """For every code point: its lower-case code point if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x34000):  # Unicode has no letter beyond
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def squeezed(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Lower-case letters with single zeros between runs of them, and one at the start."""
    x = np.concatenate([np.zeros(1, np.uint32), table[points]])
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    return x[keep]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton by state; state 0 is the start (Blumer et al.)."""
    nxt: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def packed(nxt: list[dict[int, int]]) -> np.ndarray:
    """An automaton as one array by row displacement; its first entry is the place of state 0.

    A state is its place, its step by symbol c stands at place + c, as the
    place of the next state times 2 ** BITS, plus c. Places differ, so another
    state's step, or none, never looks like one's own: its symbol is another.
    The largest rows are placed first; all look for room by a fixed row of
    pseudo-random places, however many symbols there are.
    """
    steps, width = sum(map(len, nxt)), 2 + max((c for to in nxt for c in to), default=0)
    room = int(1.5 * max(steps, len(nxt))) + 2 * width
    while True:
        used, place, taken = bytearray(room + width), [-1] * len(nxt), bytearray(room)
        seed = 1
        for s in sorted(range(len(nxt)), key=lambda s: -len(nxt[s])):
            to = nxt[s]
            for _ in range(10_000):
                seed = seed * 1103515245 + 12345 & 0x7FFFFFFF
                at = 1 + seed % (room - 1)
                if not taken[at] and not any(used[at + c] for c in to):
                    break
            else:
                break
            place[s], taken[at] = at, 1
            for c in to:
                used[at + c] = 1
        if min(place) > 0:
            break
        room *= 2
    out = np.full(room + width, NO_SYMBOL, np.int64)
    out[0] = place[0]
    for s, to in enumerate(nxt):
        for c, t in to.items():
            out[place[s] + c] = (place[t] << BITS) + c
    return out


def _learned(table: pa.Table) -> pa.Table:
    """The sampled texts of one language -> its letters, automaton and scale."""
    lookup = letter_table()
    x = np.concatenate([squeezed(code_points(t), lookup) for t in sorted(table.column("text").to_pylist())])
    own = np.unique(x[x != 0]).astype(np.uint32)
    auto = packed(suffix_automaton(symbols(own)[x].tolist()))
    return pa.table({"lang": table.column("lang")[:1], "letters": [own.tobytes()], "steps": [auto.tobytes()], "scale": [float(np.log2(max(2, len(x))))]})


def symbols(letters: np.ndarray) -> np.ndarray:
    """By lower-case code point. 0: between words; 1 to n: the letters; n + 1: a letter that the language's sample lacks, which no state has a step for."""
    out = np.full(0x110000, len(letters) + 1, np.uint32)
    out[0] = 0
    out[letters] = np.arange(1, len(letters) + 1)
    return out


def sample(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """docs(doc_id, text, lang) -> (lang, text): whole labelled texts, fold not 0, of sample_chars together in each language.

    The same in every run: rows in order of a hash of their id, as long as
    their lengths add up to sample_chars; texts that are longer than that are
    passed over. A language that has only such gives its shortest one. Rows
    are thinned by hash first, to a few times what is wanted, so that few are
    sorted.
    """
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & (F.length("text") > 0)).withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(2**32)))
    known = known.withColumn("size", F.length("text")).withColumn("over", F.col("size") > sample_chars)
    # one row a language, as in the model itself; 50 rows more than the mean size asks for, against odd luck
    fit = F.when(~F.col("over"), F.col("size"))
    share = known.groupBy("lang").agg((4.0 * (sample_chars / F.avg(fit) + 50) / F.count(fit)).alias("share"), F.min("size").alias("least"))
    low = known.join(F.broadcast(share), "lang").where(F.when(F.col("share").isNull(), F.col("size") == F.col("least")).otherwise(~F.col("over") & (F.col("h") < F.col("share") * 2**32)))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text"))
    picked = low.withColumn("sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("i", F.row_number().over(order))
    return picked.where((F.col("sum") <= sample_chars) | (F.col("i") == 1)).select("lang", "text")


def fit(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> list:
    """Rows (lang, letters, steps, scale) of the model, by language; each is learned in a task of its own.

    A language has at most 3 * sample_chars transitions, of about 12 bytes each
    (about 3 MB in all). Models of more than MODEL_BYTES together raise an
    error before they come to the driver: lang then holds something else than languages.
    """
    learned = sample(docs, sample_chars).groupBy("lang").applyInArrow(_learned, "lang string, letters binary, steps binary, scale double")
    n = docs.select("lang").where("lang is not null").distinct().limit(MODEL_BYTES // (36 * sample_chars) + 1).count()
    if n * 36 * sample_chars > MODEL_BYTES:
        raise ValueError(f"more than {n - 1} languages: their models would not fit beside the tasks")
    return sorted(learned.collect(), key=lambda r: r.lang)  # of bounded size, as just checked


def phrase_counts(grid: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Phrases of each sequence, a column of symbols in grid; sequences must fall in length."""
    root = steps[0]
    state = np.full(len(lengths), root, np.int64)
    ended = np.zeros(len(lengths), np.int64)
    live = np.searchsorted(-lengths, -np.arange(1, len(grid) + 1), "right")  # sequences that reach each place
    for t in range(len(grid)):
        n = live[t]
        to = steps[state[:n] + grid[t, :n]]
        miss = (to & NO_SYMBOL) != grid[t, :n]  # no such step: it ends the phrase and leads to the start
        ended[:n] += miss
        state[:n] = np.where(miss, root, to >> BITS)
    return ended + (state != root)


def _grids(seqs: list[np.ndarray], width: int):
    """Sequences that fall in length, side by side as columns, `width` at a time."""
    for lo in range(0, len(seqs), width):
        part = seqs[lo : lo + width]
        grid = np.zeros((len(part[0]), len(part)), np.uint32)
        for i, p in enumerate(part):
            grid[: len(p), i] = p
        yield lo, grid, np.array([len(p) for p in part])


def _predict(sent, piece: int):
    """Rows (text, other columns...), or structs `row` with a text, -> the other columns or the struct, lang_pred, score, n_letters."""

    def run(batches):
        table = letter_table()
        langs = [r.lang for r in sent.value]
        models = [(symbols(np.frombuffer(r.letters, np.uint32)), np.frombuffer(r.steps, np.int64), r.scale) for r in sent.value]
        for b in slices(batches):
            first = b.column(0)
            carried = pa.types.is_struct(first.type)
            seqs, owner, size = [], [], np.zeros(b.num_rows, np.int64)
            for i, t in enumerate(first.field("text") if carried else first):
                x = squeezed(code_points(t.as_py() or ""), table)
                size[i] = int((x != 0).sum())
                if size[i]:
                    for j in range(0, len(x), piece):
                        seqs.append(x[j : j + piece])
                        owner.append(i)
            cost = np.zeros((b.num_rows, len(langs)))
            order = np.argsort([-len(s) for s in seqs], kind="stable")
            seqs, owner = [seqs[i] for i in order], np.array(owner, np.int64)[order]
            for lo, grid, lengths in _grids(seqs, 4096) if langs else ():
                for k, (symbol, steps, scale) in enumerate(models):
                    counts = phrase_counts(symbol[grid], lengths, steps)
                    cost[:, k] += scale * np.bincount(owner[lo : lo + len(lengths)], counts, minlength=b.num_rows)
            cost /= np.maximum(size, 1)[:, None]
            lang, score = [], np.zeros(b.num_rows)
            for i in range(b.num_rows):
                if not size[i] or not langs:
                    lang.append("und")
                    continue
                best = int(cost[i].argmin())
                lang.append(langs[best])
                others = np.delete(cost[i], best)
                score[i] = 1.0 if not len(others) else 1.0 - cost[i, best] / max(others.min(), 1e-12)
            kept = 0 if carried else 1
            yield pa.RecordBatch.from_arrays([*b.columns[kept:], pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(size)], names=[*b.schema.names[kept:], "lang_pred", "score", "n_letters"])

    return run


def predict(docs: DataFrame, model: list, piece: int = PIECE, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, lang_pred, score, n_letters.

    score: how far the best language's cost lies below the second's, 0 to 1.
    Null texts, and texts without a letter, are `und` with score 0; so is every
    text if no language was learned. Ties go to the language first by name.
    Repeated rows get equal results; null ids are not held out. Columns of docs
    named in carry, text among them, stand, as one struct `row`, in the place of doc_id and
    held_out; others are ignored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # a bounded model a language
    text = F.col("text").cast("string").alias("text")
    if carry:
        rows = docs.select(F.struct(*[text if c == "text" else c for c in carry]).alias("row"))
        shape = StructType([*rows.schema.fields, *_said.fields])
    else:
        rows = docs.select(text, F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"))
        shape = StructType([*rows.schema.fields[1:], *_said.fields])
    return rows.mapInArrow(trimmed(_predict(sent, piece)), shape)


def identify(docs: DataFrame, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """fit() on the labelled rows of docs, then predict() for all of them."""
    return predict(docs, fit(docs, **options), carry=carry)
