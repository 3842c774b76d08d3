"""Embedding near-duplicates by lattice hashing.

In each of several tables a vector's unit form is projected at random to two
8-dimensional blocks, and each block is decoded to the nearest point of the E8
lattice; the two points name the vector's cell. A vector lies in its own cell
and also looks into the neighbouring cells that are next nearest to it. Vectors
that meet in a cell, in the same partition (label), are compared by cosine in
double precision.

Equal vectors form a class first. A cell with many classes is dealt out as
pairs of blocks of bounded size, so no task sees all of it, and a pair that
meets in several tables counts in the first alone: tasks send on link counts
and a spanning forest, never the pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Staging, group_bounds, mix64, whole_groups
from millrace.llm.components import connected_components

#: At cosine 0.98 a pair meets in one table with probability 0.76 (simulated): 1e-5 are missed by all 8.
TABLES, BLOCKS, PROBES, SCALE = 8, 2, 4, 1.6
#: Classes in one block of a cell; a task holds two blocks.
CELL_BLOCK = 1024


def roots_of_e8() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1.0, -1.0), repeat=8) if s.count(-1.0) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and turn the worst coordinate round if the sum is odd."""
    near = np.rint(x)
    gap = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(gap[odd]).argmax(axis=1)
    near[odd, worst] += np.where(gap[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by 1/2 (Conway and Sloane)."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def lattice_cells(units: np.ndarray, salt: np.ndarray, tables: int, probes: int, scale: float, seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Own cells (n, tables) and neighbouring cells (n, tables, probes) of unit vectors, as 64-bit hashes with salt (n)."""
    n, dim = units.shape
    wide = max(dim, 8 * BLOCKS)
    x = np.zeros((n, wide))
    x[:, :dim] = units
    roots = roots_of_e8()
    rng = np.random.default_rng([seed, wide])
    own, near = np.empty((n, tables), np.uint64), np.empty((n, tables, probes), np.uint64)

    def hashed(points: np.ndarray, t: int) -> np.ndarray:
        h = mix64(salt + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % 2**64))
        for c in (2 * points).astype(np.int64).view(np.uint64).T:  # entries are multiples of 1/2
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + c)
        return h

    loss = np.empty((n, 240 * BLOCKS), np.float32)
    for t in range(tables):
        turn = np.linalg.qr(rng.normal(size=(wide, wide)))[0][: 8 * BLOCKS] * np.sqrt(wide / 8)
        z = (x @ turn.T) * scale
        point = np.concatenate([nearest_e8(z[:, 8 * k : 8 * k + 8]) for k in range(BLOCKS)], axis=1)
        for k in range(BLOCKS):
            np.matmul((point - z)[:, 8 * k : 8 * k + 8].astype(np.float32), roots.T.astype(np.float32), out=loss[:, 240 * k : 240 * k + 240])
        own[:, t] = hashed(point, t)
        steps = np.argpartition(loss, probes - 1, axis=1)[:, :probes]
        for p in range(probes):
            moved = point.copy()
            for k in range(BLOCKS):
                here = steps[:, p] // 240 == k
                moved[here, 8 * k : 8 * k + 8] += roots[steps[here, p] % 240]
            near[:, t, p] = hashed(moved, t)
    return own, near


def _by_length(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors (rows, values) of each length; null entries become NaN, null and empty vectors are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(size)
    out = []
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        out.append((rows, flat[(ends[rows] - n)[:, None] + np.arange(n)]))
    return out


def _hash(tables: int, probes: int, scale: float):
    def run(batches):
        for b in batches:
            labels = b.column(2).to_pylist()
            named = np.array([x is not None for x in labels], bool)
            fps, units, owns, nears = ([None] * b.num_rows for _ in range(4))
            for rows, x in _by_length(b.column(1)):
                fit = named[rows] & np.isfinite(x).all(axis=1) & x.any(axis=1)
                rows, x = rows[fit], x[fit]
                if not len(rows):
                    continue
                dim = x.shape[1]
                u = x / np.abs(x).max(axis=1)[:, None]  # so that squares neither overflow nor vanish
                u = u / np.sqrt((u * u).sum(axis=1))[:, None]
                salts = {v: xxhash.xxh3_64_intdigest(f"{dim}:{v}") for v in {labels[i] for i in rows}}
                own, near = lattice_cells(u, np.array([salts[labels[i]] for i in rows], np.uint64), tables, probes, scale)
                own, near = own.view(np.int64), near.reshape(len(rows), -1).view(np.int64)
                for k, i in enumerate(rows.tolist()):
                    fps[i] = xxhash.xxh3_128_digest(f"{dim}:{labels[i]}:".encode() + x[k].tobytes())
                    units[i], owns[i], nears[i] = u[k].tobytes(), own[k].tobytes(), near[k].tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary()), *(pa.array(c, pa.binary()) for c in (units, owns, nears))], names=["vec_id", "fp", "unit", "own", "near"])

    return run


def _cells(probes: int):
    """Classes (fp, own, near) -> their entries (fp, t, cell, home), home in their own cells and not in those they look into."""

    def run(batches):
        for b in batches:
            own, near = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.int64).reshape(b.num_rows, -1) for i in (1, 2))
            tables = own.shape[1] if b.num_rows else 0
            width = tables * (1 + probes)
            cell = np.concatenate([own, near], axis=1).ravel()
            t = np.tile(np.concatenate([np.arange(tables), np.repeat(np.arange(tables), probes)]), b.num_rows)
            home = np.tile(np.arange(width) < tables, b.num_rows)
            for lo in range(0, len(cell), 50_000):
                part = slice(lo, lo + 50_000)
                at = np.arange(lo, min(lo + 50_000, len(cell))) // width
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(t[part].astype(np.int32)), pa.array(cell[part]), pa.array(home[part])], names=["fp", "t", "cell", "home"])

    return run


def _links_of(least: float, v: np.ndarray, own: np.ndarray, near: np.ndarray, mult: np.ndarray, block: np.ndarray, home: np.ndarray, t: int, across: bool):
    """Of one or two blocks of a cell in table t: link counts, and for each class the least one that links reach."""
    size = len(v)
    hit = (v @ v.T >= least) & (home[:, None] | home[None, :])
    if across:
        hit &= block[:, None] != block[None, :]
    a, b = np.nonzero(np.triu(hit, 1))
    for s in range(t):  # pairs that an earlier table has
        met = (own[a, s] == own[b, s]) | (near[a, s] == own[b, s][:, None]).any(axis=1) | (near[b, s] == own[a, s][:, None]).any(axis=1)
        a, b = a[~met], b[~met]
    h, o = np.where(home[a], a, b), np.where(home[a], b, a)  # where each looks into the other's cell, one cell has the pair
    both = ~home[o] & (near[h, t] == own[o, t][:, None]).any(axis=1) & (own[h, t] > own[o, t])
    a, b = a[~both], b[~both]
    count = np.bincount(a, mult[b], size) + np.bincount(b, mult[a], size)
    root = np.arange(size)
    while len(a):  # the least class that links reach, all at once
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return count, root


def _compare(least: float, tables: int, probes: int):
    """Rows in order of place, one or two blocks of a cell -> (a, n, b): link counts (b null) and spanning links (n = 0)."""

    def run(batches):
        for table in whole_groups(batches):
            get = lambda c: table.column(c).to_numpy()
            fp, unit = table.column("fp").to_pylist(), table.column("unit").to_pylist()
            own = np.frombuffer(b"".join(table.column("own").to_pylist()), np.int64).reshape(len(fp), tables)
            near = np.frombuffer(b"".join(table.column("near").to_pylist()), np.int64).reshape(len(fp), tables, probes)
            mult, block, home, t, across = map(get, ("mult", "block", "home", "t", "across"))
            first, n, second = [], [], []
            for lo, hi in group_bounds(get("place")):
                # a cell's name is salted with label and length; lengths could differ only if names collided
                width = max(map(len, unit[lo:hi]))
                v = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in unit[lo:hi]), np.float64).reshape(hi - lo, -1)
                part = slice(lo, hi)
                count, root = _links_of(least, v, own[part], near[part], mult[part], block[part], home[part], int(t[lo]), bool(across[lo]))
                some, linked = np.flatnonzero(count), np.flatnonzero(root != np.arange(hi - lo))
                first += [fp[lo + i] for i in [*some, *linked]]
                n += [*count[some].astype(np.int64), *[0] * len(linked)]
                second += [*[None] * len(some), *[fp[lo + i] for i in root[linked]]]
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.binary()), pa.array(n, pa.int64()), pa.array(second, pa.binary())], names=["a", "n", "b"])

    return run


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Rows link when their labels are equal and not null and their cosine is at
    least `cosine`. n_links counts the other rows linked directly, repeated
    rows among them; component_id is the smallest id that links reach.

    Null vectors, empty ones, ones with null or non-finite entries or with
    zeros alone, and rows with a null label link with nothing; vectors of
    different lengths never link. Rows with a null id take part and get the
    smallest id of their component (null if it has none). Other columns are
    ignored; an empty table gives an empty one.
    """
    st = Staging(vectors.sparkSession, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    hashed = st.put(rows.mapInArrow(_hash(tables, probes, scale), "vec_id long, fp binary, unit binary, own binary, near binary"), "hashed")
    ids = hashed.select("vec_id", "fp")
    classes = hashed.where("fp is not null").groupBy("fp").agg(F.count("*").alias("mult"), F.min("vec_id").alias("least"), *(F.first(c).alias(c) for c in ("unit", "own", "near")))
    classes = st.put(classes, "classes")

    entries = classes.select("fp", "own", "near").mapInArrow(_cells(probes), "fp binary, t int, cell long, home boolean")
    mark = lambda seed: F.bit_xor(F.xxhash64("fp", "home", F.lit(seed)))
    shared = entries.groupBy("cell").agg(F.count("*").alias("k"), F.max("home").alias("any"), F.min("t").alias("t"), mark(0).alias("x"), mark(1).alias("y")).where("k > 1 and any")
    # of cells with the same classes, those of the first table will do
    first = shared.groupBy("k", "x", "y").agg(F.min("t").alias("first"), F.collect_list(F.struct("t", "cell")).alias("cells"))
    shared = first.select("k", "first", F.explode("cells").alias("c")).where("c.t = first").select("c.cell", F.ceil(F.col("k") / CELL_BLOCK).cast("int").alias("blocks"))
    shared = st.put(shared, "shared")  # staged: Spark can then split a hot cell's join
    dealt = entries.join(shared, "cell").withColumn("block", F.pmod(F.hash("fp"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")).alias("place")
    dealt = dealt.select(place, "t", "fp", "home", "block", (F.col("block") != F.col("other")).alias("across"))
    met = dealt.join(classes.select("fp", "unit", "own", "near", "mult"), "fp").select("place", "fp", "t", "home", "block", "across", "unit", "own", "near", "mult")
    met = met.repartition("place").sortWithinPartitions("place", "fp")
    out = st.put(met.mapInArrow(_compare(cosine, tables, probes), "a binary, n long, b binary"), "links")

    counts = out.groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("others"))
    roots = connected_components(out.where("b is not null").select("a", "b"), st).toDF("fp", "root")
    known = classes.select("fp", "mult", "least").join(counts, "fp", "left").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(named, "root").select("fp", (F.col("mult") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component")
    out = ids.join(known, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
