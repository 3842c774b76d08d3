"""Fill-in-middle transformation: lines of a text rearranged around a hole, as one Arrow pipeline a batch.

A batch of texts becomes a list array of lines. Its flat lines keep the index of
the text they came from; their ordinals within it, held against two cuts, give
each line a role (prefix, middle, suffix). Lines are filtered by role, rebuilt to
lists, joined to one string a text and role, and the three strings are joined
with the sentinels. No Python code runs by text or line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, trimmed

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SHAPE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
#: Rows of a batch that are rearranged together.
ROWS = 512


def _draw(doc_id: Column, seed: int, i: int) -> Column:
    """The i-th (from 1) 8-digit group of sha256('seed:id') as a number; a null id draws by 'seed:' alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")


def units(texts: pa.Array) -> pa.ListArray:
    """The lines of each text with their line feeds; what follows the last one is a line if there is anything."""
    parts = pc.split_pattern(texts, "\n")
    flat, parent = pc.list_flatten(parts), pc.list_parent_indices(parts)
    last = np.append(np.diff(parent.to_numpy()) > 0, True)[: len(flat)]
    lines = pc.binary_join_element_wise(flat, pc.if_else(pa.array(last), pa.scalar("", flat.type), pa.scalar("\n", flat.type)), pa.scalar("", flat.type))
    there = pc.greater(pc.binary_length(lines), 0)
    return _lists(pc.filter(lines, there), pc.filter(parent, there), len(texts))


def _lists(flat: pa.Array, parent: pa.Array, n: int) -> pa.ListArray:
    """flat values and the list that each belongs to (in order) -> n lists."""
    ends = np.cumsum(np.bincount(parent.to_numpy(zero_copy_only=False), minlength=n))
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int64()), flat)


def rearrange(batch: pa.RecordBatch, rate: int, spm: int) -> pa.RecordBatch:
    """doc_id, text, h1 to h4 -> the columns of SHAPE."""
    texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    h = [batch.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)]
    lists = units(texts)
    n = pc.list_value_length(lists).to_numpy()
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    lines, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    of = parent.to_numpy()
    ordinal = np.arange(len(of)) - lists.offsets.to_numpy()[of]
    role = (ordinal >= np.minimum(a, b)[of]).astype(np.int8) + (ordinal >= np.maximum(a, b)[of])
    pieces = []
    for r in range(3):
        mask = pa.array(role == r)
        pieces.append(pc.binary_join(_lists(pc.filter(lines, mask), pc.filter(parent, mask), len(texts)), pa.scalar("", pa.large_string())))
    prefix, middle, suffix = pieces
    mark = lambda s: pa.scalar(s, pa.large_string())
    join = lambda *x: pc.binary_join_element_wise(*x, mark(""))
    psm = join(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle)
    spm_ = join(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle)
    taken = pc.equal(texts, mark(""))
    for s in (PREFIX, SUFFIX, MIDDLE):
        taken = pc.or_(taken, pc.match_substring(texts, s))
    plain = pc.or_(taken, pa.array(h[2] % 100 >= rate))
    first = pa.array(h[3] % 100 < spm)
    chars = lambda x: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64()))
    form = pc.if_else(plain, pa.scalar("plain"), pc.if_else(first, pa.scalar("spm"), pa.scalar("psm")))
    output = pc.if_else(plain, texts, pc.if_else(first, spm_, psm))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), form, chars(prefix), chars(middle), output], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars, output: each text once, with its middle moved behind prefix and suffix.

    Both cuts, the form and whether a text stays plain are drawn from a hash of
    seed and id, so reruns agree: `rate` in 100 texts are rearranged, `spm` in
    100 of these with the suffix first. Cuts lie between lines, or at an end.

    A null text counts as an empty one; empty texts and those that contain a
    sentinel stay as they are (plain). Rows that repeat are rearranged alike,
    each for itself; null ids share one draw. Blank lines are lines. A text of
    any length is one value of a batch. Columns but the two named are left out,
    whatever their names; an empty table gives an empty one.
    """

    def run(batches):
        for part in slices(batches, ROWS):
            yield rearrange(part, rate, spm)

    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[_draw(doc_id, seed, i).alias(f"h{i}") for i in (1, 2, 3, 4)])
    return rows.mapInArrow(trimmed(run), SHAPE)


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle() was given, from what it made."""
    cut = F.split(output, "<[PSM]>")
    parts = {"psm": (1, 3, 2), "spm": (2, 3, 1)}  # where prefix, middle and suffix stand behind the empty start
    whole = lambda f: F.concat(*[cut[i] for i in parts[f]])
    return F.when(form == "psm", whole("psm")).when(form == "spm", whole("spm")).otherwise(output)
