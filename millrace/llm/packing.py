"""Packing token sequences by best-fit decreasing.

Documents are tokenised where they lie; what moves afterwards is one thin row
per piece. Overlong documents are cut into full windows first. The rests are
dealt to packing groups of bounded size; in a group, pieces from long to short
each go to the tightest open window, which a segment tree indexed by remaining
capacity finds in O(log window) steps.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Staging, trimmed

WINDOW = 2048
#: Pieces that one packing task holds (a few MB).
GROUP = 100_000
SPECIAL = "<|endoftext|>"


def _encoder(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


def tokenizer_files() -> tuple[str, str]:
    """Place of the public byte-level vocabulary (as ranks) and its split pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _pieces(files, window: int, end_id: int, with_ids: bool):
    def run(batches):
        enc = _encoder(*files)
        for b in batches:
            ids, start, length, crc, total, full, tokens = [], [], [], [], [], [], []
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1)):
                got = np.append(enc.encode(t.as_py() or "", allowed_special={SPECIAL}, disallowed_special=()), end_id).astype("<u4")
                for i in range(0, len(got), window):
                    part = got[i : i + window]
                    ids.append(doc_id)
                    start.append(i)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(got))
                    tokens.append(part.view("<i4"))
            cols = [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(tokens, pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

    return run


class OpenWindows:
    """Open windows by remaining capacity, over a segment tree that tells which capacities occur."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.any = bytearray(2 * self.size)
        self.held: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, capacity: int, which: int) -> None:
        self.held[capacity].append(which)
        node = capacity + self.size
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out a window with the least capacity that is not below need: (capacity, window)."""
        node = need + self.size
        if not self.any[node]:
            while node & 1 or not self.any[node + 1]:  # up, until a right neighbour has something
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.size:
                node = 2 * node + (not self.any[2 * node])
        capacity = node - self.size
        which = self.held[capacity].pop()
        if not self.held[capacity]:
            self.any[node] = 0
            while node > 1 and not self.any[node ^ 1]:
                node >>= 1
                self.any[node] = 0
        return capacity, which


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; lengths must fall from 1st to last and be 1 to window."""
    tree, count = OpenWindows(window), 0
    which, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        found = tree.tightest(n) if n < window else None
        if found is None:
            capacity, w = window, count
            count += 1
        else:
            capacity, w = found
        which[i], offset[i] = w, window - capacity
        if capacity > n:
            tree.add(capacity - n, w)
    return which, offset


def _pack(window: int):
    def run(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy() for c in ("group", "start", "length", "ids_crc32", "doc_tokens")}
        ids = table.column("doc_id").to_pandas().fillna(-1).to_numpy().astype(np.int64)
        order = np.lexsort((col["ids_crc32"], col["start"], ids, -col["length"]))
        which, offset = best_fit_decreasing(col["length"][order], window)
        out = table.take(pa.array(order)).drop_columns(["group"])
        base = int(col["group"][0]) << 32
        return out.append_column("sequence_id", pa.array(which + base)).append_column("offset", pa.array(offset))

    return run


def _numbered(pieces: DataFrame, block: int = 10_000) -> DataFrame:
    """Equal pieces numbered by copy, so that rows that share an id are dealt apart; no task holds or sorts them."""
    n = pieces.groupBy(*pieces.columns).agg(F.count("*").alias("n"))
    blocks = n.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))
    copies = F.explode(F.sequence(F.col("b") * block, F.least(F.col("n"), (F.col("b") + 1) * block) - 1))
    return blocks.select(*pieces.columns, copies.alias("copy"))


def pack_documents(docs: DataFrame, window: int = WINDOW, end_id: int = 1, files: tuple[str, str] | None = None, group: int = GROUP, staging: Staging | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and end_id behind them; a null text is an empty
    one, so it still has that one id. start is the place of the piece in its
    document. Sequence ids are unique, not dense; offsets in a sequence have no
    gaps and start at 0. Equal texts and repeated rows are packed as often as
    they occur; ties in length go by id, start and checksum, so reruns agree. A
    null id is kept. Other columns are ignored; an empty table gives an empty one.

    Ids are those of the public vocabulary in the `tokenizers` library; its
    rank file gives the same ids faster (tests compare both).
    """
    st = staging or Staging(docs.sparkSession, "packing")
    files = files or tokenizer_files()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = st.put(docs.mapInArrow(trimmed(_pieces(files, window, end_id, False)), shape), "pieces")
    groups = max(1, -(-pieces.count() // group))
    dealt = _numbered(pieces).withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32", "copy"), F.lit(groups))).drop("copy")
    return dealt.groupBy("group").applyInArrow(_pack(window), f"{shape}, sequence_id long, offset long")


def packed_sequences(docs: DataFrame, window: int = WINDOW, end_id: int = 1, pad_id: int = 0, files: tuple[str, str] | None = None, group: int = GROUP) -> DataFrame:
    """The sequences themselves: sequence_id, ids (padded, but not at a power of two), doc_ids, lengths.

    doc_id must tell documents apart here, as pieces find their tokens by it.
    """
    files = files or tokenizer_files()
    packed = pack_documents(docs, window, end_id, files, group)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"
    tokens = docs.mapInArrow(trimmed(_pieces(files, window, end_id, True)), shape).select("doc_id", "start", "ids")
    rows = packed.select("doc_id", "start", "length", "sequence_id", "offset").join(tokens, ["doc_id", "start"])
    parts = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    ids = F.flatten("p.ids")
    n = F.size(ids)
    power = n.bitwiseAND(n - 1) == 0
    padded = F.when(power, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(window) - n)))
    return parts.select("sequence_id", padded.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
