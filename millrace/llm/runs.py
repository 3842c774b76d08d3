"""Periodic runs of words: maximal stretches that repeat with a period, found by uniting suffix classes.

Suffixes of a text that share their first l words form a class. Classes grow as
l falls: in the suffix array, neighbours with a longest common prefix (LCP) of l
are united, greatest LCP first, by union-find over ordered sets of positions, the
smaller set going into the larger. Two positions i < j that become neighbours in
a set at level l share exactly l words; if they are at most l apart, the words
from i to j + l have period j - i. It is their smallest: a smaller one would put
another position of the class between i and j. So a pair whose stretch cannot
start earlier is a run, and every run is such a pair, namely its start and the
place one period on.

A run of `shortest` words has a pair of LCP shortest / 2 at least, so classes are
united down to there and no further. A text of n words costs O(n log n).
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, trimmed

SHAPE = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string"
#: Words whose suffixes are sorted together, unless one text has more.
WORDS = 150_000


def word_codes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, texts one behind the other, no number in two texts; and where each text begins (and the last ends)."""
    parts, base = [], 0
    for words in texts:
        seen: dict[bytes, int] = {}
        parts.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) + base)
        base += len(seen)
    return np.concatenate([*parts, np.empty(0, np.int64)]), np.cumsum([0, *map(len, texts)])


def _starts(change: np.ndarray) -> np.ndarray:
    """For each place, where its stretch without a change began (change[0] is set)."""
    return np.maximum.accumulate(np.where(change, np.arange(len(change)), 0))


def suffix_levels(codes: np.ndarray) -> list[np.ndarray]:
    """Ranks of all positions by their first 1, 2, 4, ... words (prefix doubling); equal words, equal ranks; the last level has no two alike.

    A rank is the place in the suffix array where the position's class begins.
    Only positions that still share their rank are sorted again.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    change = np.append(True, np.diff(codes[order]) != 0)
    rank = np.empty(n, np.int64)
    rank[order] = _starts(change)
    levels, width = [rank.astype(np.int32)], 1
    shared = order[~(change & np.append(change[1:], True))]
    while len(shared):
        beyond = shared + width
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)], -1)
        by = np.argsort(rank[shared] * (n + 1) + second + 1, kind="stable")
        shared, second = shared[by], second[by]
        outer = np.append(True, np.diff(rank[shared]) != 0)
        change = outer | np.append(True, np.diff(second) != 0)
        rank[shared] += _starts(change) - _starts(outer)
        shared = shared[~(change & np.append(change[1:], True))]
        levels.append(rank.astype(np.int32))
        width *= 2
    return levels


def neighbours(levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of suffixes beside each other in the suffix array that share `least` words or more, and how many they share."""
    n = len(levels[-1])
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1], order[1:]
    k = min(max(least, 1).bit_length() - 1, len(levels) - 1)
    alike = levels[k][a] == levels[k][b]  # most pairs part here
    a, b = a[alike], b[alike]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < n) & (y < n)
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        common += same.astype(np.int64) << k
    enough = common >= least
    return a[enough], b[enough], common[enough]


def runs_of(codes: np.ndarray, shortest: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of `shortest` words and two periods or more, by start, then period."""
    if len(codes) < 2:
        return []
    left, right, common = neighbours(suffix_levels(codes), -(-shortest // 2))
    greatest_first = np.argsort(-common, kind="stable")
    word = codes.tolist()
    owner: dict[int, list[int]] = {}  # the ordered set that a position is in
    found = []

    def seed(i: int, j: int, shared: int) -> None:
        if j - i <= shared and j - i + shared >= shortest and (i == 0 or word[i - 1] != word[j - 1]):
            found.append((i, j - i + shared, j - i))

    for a, b, shared in zip(left[greatest_first].tolist(), right[greatest_first].tolist(), common[greatest_first].tolist()):
        small, large = owner.get(a) or [a], owner.get(b) or [b]
        if len(small) > len(large):
            small, large = large, small
        if len(large) == 1:
            owner[large[0]] = large
        before = None  # of the small set, gone in already
        for x, following in zip(small, [*small[1:], None]):
            at = bisect_left(large, x)
            if at and large[at - 1] != before:
                seed(large[at - 1], x, shared)
            if at < len(large) and (following is None or large[at] < following):
                seed(x, large[at], shared)
            large.insert(at, x)
            owner[x] = large
            before = x
    return sorted((i, n, q) for i, n, q in found)


def _judge(ids: list[int | None], texts: list[list[bytes]], shortest: int) -> pa.RecordBatch:
    codes, bounds = word_codes(texts)
    found = runs_of(codes, shortest)
    dropped = np.zeros(len(codes) + 1, np.int64)
    for i, n, q in found:
        dropped[i + q] += 1
        dropped[i + n] -= 1
    keep = (np.cumsum(dropped)[:-1] == 0).tolist()
    at = np.searchsorted(bounds, [r[0] for r in found], "right") - 1 if found else np.empty(0, np.int64)
    column = lambda k: np.array([r[k] for r in found], np.int64)
    rows = pa.StructArray.from_arrays([pa.array(column(0) - bounds[at]), pa.array(column(1)), pa.array(column(2))], ["start", "length", "period"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(texts)))]).astype(np.int32)
    kept = [b" ".join([w for w, k in zip(words, keep[lo : lo + len(words)]) if k]) for words, lo in zip(texts, bounds.tolist())]
    names = ["doc_id", "n_words", "runs", "kept_text"]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), rows), pa.array(kept, pa.binary()).cast(pa.string())], names)


def find_runs(docs: DataFrame, shortest: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), kept_text: runs of each text, and what is left when each keeps its first period.

    A run is a stretch of words with smallest period q, `shortest` words and two
    periods or more, that no word on either side continues. A word goes if any
    run has it beyond its first q words. Runs are those of the text as it is.

    A null, empty or blank text has no words, no runs and an empty kept_text.
    Repeated rows are judged each for itself. A text is taken whole, however
    long; its task holds some hundred bytes a word. Columns but the two named
    are left out, whatever their names; an empty table gives an empty one.
    """

    def run(batches):
        for part in slices(batches, 4096):
            ids, texts, n = [], [], 0
            for i, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary())):
                ids.append(i)
                texts.append((text.as_py() or b"").split())
                n += len(texts[-1])
                if n >= WORDS:
                    yield _judge(ids, texts, shortest)
                    ids, texts, n = [], [], 0
            if ids:
                yield _judge(ids, texts, shortest)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(run), SHAPE)
