"""Near-duplicate embeddings by lattice hashing.

A table of the hash projects every unit vector at random onto BLOCKS times eight dimensions and
decodes each eight to the nearest point of the lattice E8; the points name the vector's cell.
A vector is stored in its own cell and also asks the neighbouring cells that it comes closest to:
those whose points differ by one of E8's 240 least vectors in one block or two. Vectors that meet
in a cell, one of them stored there, are compared by their cosine in double precision.

A cell's members are compared block against block by matrix products, so a cell of any size is
many tasks of bounded memory. What leaves a task is a number of links per vector and a spanning
forest of the links, never the pairs. A pair that meets more than once is counted where it meets
first, which both vectors' cells decide; cells are worked out in exact arithmetic (vectors and
projections are rounded to fixed binary places first), so every task finds the same ones.

With the settings below two vectors in 64 dimensions meet with a probability of 0.992 at a cosine
of 0.95 and 0.9999 at 0.98; unrelated ones with less than 0.0001.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from junctura.llm.bagminhash import GOLD, scrambled
from junctura.llm.components import components
from junctura.llm.scratch import stored

THRESHOLD = 0.95
TABLES, BLOCKS, PROBES = 5, 4, 8
#: Width of the cells in distances at the threshold.
WIDTH = 3.8
#: Neighbours looked at in a block, and those combined with another block's.
SINGLE, PAIRED = 4, 2
#: Rows of a cell compared at once, and rows of the left side at a time.
BLOCK, STRIP = 4096, 256


def least_vectors() -> np.ndarray:
    """The 240 least vectors of E8."""
    whole = [[a * (k == i) + b * (k == j) for k in range(8)] for i, j in combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    half = [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half, np.float64)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest whole-number point with an even sum: round, and move the worst coordinate where the sum is odd."""
    point = np.rint(x)
    off = x - point
    worst = np.abs(off).argmax(-1)[..., None]
    step = np.where(np.take_along_axis(off, worst, -1) >= 0, 1.0, -1.0) * (point.sum(-1, keepdims=True) % 2 != 0)
    np.put_along_axis(point, worst, np.take_along_axis(point, worst, -1) + step, -1)
    return point


def e8_nearest(x: np.ndarray) -> np.ndarray:
    """The point of E8 nearest to each row of eight: of the whole-number points or of those halfway between."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(-1, keepdims=True) <= ((x - half) ** 2).sum(-1, keepdims=True)
    return np.where(nearer, whole, half)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; ``vectors`` are finite and not zero."""
    scaled = vectors.astype(np.float64)
    scaled = scaled / np.abs(scaled).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _fixed(x: np.ndarray, places: int) -> np.ndarray:
    return np.rint(x * float(1 << places)) / float(1 << places)


def projections(dimensions: int, threshold: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions x TABLES x BLOCKS x 8 matrix, shifts): orthogonal within a table where there is room."""
    rng = np.random.default_rng([seed, dimensions])
    wide, scale = 8 * BLOCKS, 1 / (WIDTH * np.sqrt(2 - 2 * threshold))
    tables = []
    for _ in range(TABLES):
        drawn = rng.standard_normal((dimensions, max(dimensions, wide)))
        tables.append(np.linalg.qr(drawn)[0][:, :wide] * np.sqrt(dimensions / 8) if dimensions >= wide else drawn[:, :wide] / np.sqrt(8))
    shifts = _fixed(rng.random((TABLES, BLOCKS, 8)) * 2, 16)
    return _fixed(np.stack(tables, 1) * scale, 16).reshape(dimensions, -1), shifts


def _substitutions() -> list[tuple[tuple[int, int], ...]]:
    """Which blocks move to which of their nearest neighbours: one block, or two."""
    one = [((b, t),) for b in range(BLOCKS) for t in range(SINGLE)]
    two = [((b, t), (c, u)) for b, c in combinations(range(BLOCKS), 2) for t in range(PAIRED) for u in range(PAIRED)]
    return one + two


def cells(unit: np.ndarray, threshold: float = THRESHOLD, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(own, near) of unit rows: TABLES cell numbers each, and TABLES x PROBES neighbouring ones."""
    matrix, shifts = projections(unit.shape[1], threshold, seed)
    least = least_vectors()
    salt = scrambled(np.arange(1, TABLES * BLOCKS + 1, dtype=np.uint64).reshape(TABLES, BLOCKS) * GOLD + np.uint64(unit.shape[1]))
    x = (_fixed(unit, 24) @ matrix).reshape(-1, TABLES, BLOCKS, 8) + shifts
    point = e8_nearest(x)
    gaps = 2 - 2 * ((x - point) @ least.T)  # how much further away each neighbour is, squared
    nearest = np.argsort(gaps, axis=-1, kind="stable")[..., :SINGLE]
    gaps = np.take_along_axis(gaps, nearest, -1)
    points = np.concatenate([point[..., None, :], point[..., None, :] + least[nearest]], -2)
    hashed = np.broadcast_to(salt[..., None], points.shape[:-1])
    for k in range(8):
        hashed = scrambled(hashed + GOLD) + (2 * points[..., k]).astype(np.int64).view(np.uint64)
    hashed = scrambled(hashed)
    own = hashed[..., 0].sum(-1)
    moves = _substitutions()
    further = np.stack([sum(gaps[:, :, b, t] for b, t in move) for move in moves], -1)
    moved = np.stack([sum(hashed[:, :, b, t + 1] - hashed[:, :, b, 0] for b, t in move) for move in moves], -1)
    chosen = np.argsort(further, axis=-1, kind="stable")[..., :PROBES]
    near = own[..., None] + np.take_along_axis(moved, chosen, -1)
    return scrambled(own).view(np.int64), scrambled(near).view(np.int64)


def _bytes_column(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows], pa.binary())


def numbered_vectors(rows: DataFrame, dtype: str) -> DataFrame:
    """(vec_id, digest, vector): the vector as bytes; digest and vector NULL where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            lists, digests, vectors = batch.column(1), [], []
            values = lists.values
            numbers = np.asarray(values.to_numpy(zero_copy_only=False), dtype) + np.dtype(dtype).type(0)  # NULL is NaN, -0.0 is 0.0
            ends = lists.offsets.to_numpy()
            for k, valid in enumerate(lists.is_valid().to_pylist()):
                vector = numbers[ends[k] : ends[k + 1]] if valid else numbers[:0]
                fit = len(vector) and np.isfinite(vector).all() and vector.any()
                vectors.append(vector.tobytes() if fit else None)
                digests.append(xxhash.xxh3_128_digest(vectors[-1]) if fit else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], ["vec_id", "digest", "vector"])

    return rows.mapInArrow(run, "vec_id long, digest binary, vector binary")


def _same_width(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
    """(places, bytes) for each length among the vectors."""
    lengths = np.array([len(x) for x in blobs])
    for length in np.unique(lengths):
        yield np.flatnonzero(lengths == length), int(length)


def celled(heads: DataFrame, dtype: str, threshold: float, seed: int) -> DataFrame:
    """(vec_id, own, near) of (vec_id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                blobs = batch.column(1).to_pylist()
                for at, length in _same_width(blobs):
                    table = np.frombuffer(b"".join(blobs[k] for k in at), dtype).reshape(len(at), -1)
                    own, near = cells(units(table), threshold, seed)
                    lists = [
                        pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (own, near.reshape(len(at), -1))
                    ]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *lists], ["vec_id", "own", "near"])

    return heads.select("vec_id", "vector").mapInArrow(run, "vec_id long, own array<long>, near array<long>")


def _asked(near: np.ndarray, cells_asked: np.ndarray) -> np.ndarray:
    """Which of the sorted ``cells_asked`` each row asks."""
    out = np.zeros((len(near), len(cells_asked)), bool)
    at = np.minimum(np.searchsorted(cells_asked, near), len(cells_asked) - 1)
    row, probe = np.nonzero(cells_asked[at] == near)
    out[row, at[row, probe]] = True
    return out


def _counted_here(own: np.ndarray, near: np.ndarray, i: np.ndarray, j: np.ndarray, cell: int) -> np.ndarray:
    """Whether the pairs (i, j) that meet in ``cell`` are counted there.

    They are counted in the first table in which they meet; where each asks the other's cell in
    that table, in the lesser of the two cells.
    """
    (rows, i), (columns, j) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
    elsewhere, here = np.zeros(len(i), bool), np.zeros(len(i), bool)
    for t in range(TABLES):
        left, right = own[rows, t], own[columns, t]
        (lefts, left_at), (rights, right_at) = np.unique(left, return_inverse=True), np.unique(right, return_inverse=True)
        a, b = left[i], right[j]
        b_asks, a_asks = _asked(near[columns, t], lefts)[j, left_at[i]], _asked(near[rows, t], rights)[i, right_at[j]]
        first = np.where(b_asks, np.where(a_asks, np.minimum(a, b), a), b)
        met = (a == b) | b_asks | a_asks
        elsewhere |= met & ~here & (first != cell)
        here |= met
    return ~elsewhere


def _compared(cell: int, rows: list[tuple], dtype: str, threshold: float, seed: int) -> tuple[list, list, list]:
    """(vec_id, root, links) of a cell's members (left, right, stored, vec_id, copies, vector).

    Stored members on the left meet all on the right. Of two stored members each is on the left
    once, so only the left one's links are counted; others' links are counted on both sides.
    """
    ids, roots, counts = [], [], []
    for at, _ in _same_width([r[5] for r in rows]):
        left, right, own = (np.array([rows[k][c] for k in at], bool) for c in range(3))
        if not left.any() or not right.any():
            continue
        names, copies = (np.array([rows[k][c] for k in at], np.int64) for c in (3, 4))
        unit = units(np.frombuffer(b"".join(rows[k][5] for k in at), dtype).reshape(len(at), -1))
        lefts, rights = np.flatnonzero(left), np.flatnonzero(right)
        links, parent = np.zeros(len(at), np.int64), np.arange(len(at))
        numbers: dict = {}

        def ends(x: np.ndarray, parent: np.ndarray = parent) -> np.ndarray:
            while (parent[x] != x).any():
                x = parent[x]
            return x

        for low in range(0, len(lefts), STRIP):
            strip = lefts[low : low + STRIP]
            cosine = unit[strip] @ unit[rights].T
            i, j = np.nonzero(cosine >= threshold - 1e-9)
            close = np.abs(cosine[i, j] - threshold) <= 1e-9
            i, j = strip[i], rights[j]
            keep = names[i] != names[j]
            # products of matrices round by their shape; near the threshold the sum is taken in one fixed order
            keep[close] &= np.array([float(np.cumsum(unit[p] * unit[q])[-1]) >= threshold for p, q in zip(i[close], j[close], strict=True)], bool)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            linked, starts = np.unique(i, return_index=True)
            for row, start, end in zip(linked, starts, [*starts[1:], len(i)], strict=True):
                tops = ends(j[start:end])
                top = ends(np.array([row]))[0]
                if (tops != top).any():
                    least = min(tops.min(), top)
                    parent[tops] = parent[top] = parent[row] = parent[j[start:end]] = least
            if "own" not in numbers:
                numbers["own"], numbers["near"] = np.zeros((len(at), TABLES), np.int64), np.zeros((len(at), TABLES, PROBES), np.int64)
                numbers["known"] = np.zeros(len(at), bool)
            new = np.unique(np.concatenate([i, j]))
            new = new[~numbers["known"][new]]
            for start in range(0, len(new), 1024):
                part = new[start : start + 1024]
                numbers["own"][part], numbers["near"][part] = cells(unit[part], threshold, seed)
            numbers["known"][new] = True
            here = _counted_here(numbers["own"], numbers["near"], i, j, cell)
            i, j = i[here], j[here]
            asked = ~own[j]
            for to, by in ((i, copies[j]), (j[asked], copies[i[asked]])):
                links += np.rint(np.bincount(to, by, len(links))).astype(np.int64)
        top = ends(np.arange(len(at)))
        told = np.flatnonzero((top != np.arange(len(at))) | (links > 0))
        ids += names[told].tolist()
        roots += names[top[told]].tolist()
        counts += links[told].tolist()
    return ids, roots, counts


def meetings(entries: DataFrame, dtype: str, threshold: float, seed: int) -> DataFrame:
    """(vec_id, root, links) found in each cell, from (cell, stored, vec_id, copies, vector, lefts, alls).

    A cell with ``alls`` members, ``lefts`` of them stored, is cut into blocks of BLOCK on both sides.
    """
    n_left, n_right = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("lefts", "alls"))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), n.cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    single = (n_left == 1) & (n_right == 1)
    fields = ("stored", "vec_id", "copies", "vector")
    once = entries.where(single).select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("stored").alias("left"), F.lit(True).alias("right"), *fields)
    large = entries.where(~single)
    lefts = large.where("stored").select("cell", own(n_left).alias("i"), every(n_right).alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right"), *fields)
    rights = large.select("cell", every(n_left).alias("i"), own(n_right).alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"), *fields)
    rows = once.unionByName(lefts).unionByName(rights).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def told() -> Iterator[pa.RecordBatch]:
            found = _compared(unit[0], held, dtype, threshold, seed) if held else ([], [], [])
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["vec_id", "root", "links"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(9)]
            for key, row in zip(zip(*columns[:3], strict=True), zip(*columns[3:], strict=True), strict=True):
                if key != unit:
                    yield from told()
                    unit, held = key, []
                held.append(row)
        yield from told()

    return rows.mapInArrow(run, "vec_id long, root long, links long")


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, seed: int = 0) -> DataFrame:
    """One row per vec_id of ``rows`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Equal vectors are compared once and count as often as they are. Vectors that are NULL, empty,
    zero or hold NULL or non-finite components link with nothing, as do vectors of different
    lengths. Rows that repeat a vec_id are one vector, the one of least digest where they differ.
    A row without a vec_id links with nothing, has no component and is kept. Other columns are
    not read. An empty table gives an empty result.
    """
    single = isinstance(rows.schema["embedding"].dataType, ArrayType) and isinstance(rows.schema["embedding"].dataType.elementType, FloatType)
    dtype = "<f4" if single else "<f8"
    given = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    nameless = given.where("vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    numbered = stored(numbered_vectors(given.where("vec_id IS NOT NULL"), dtype), "vectors")
    names = stored(numbered.groupBy("vec_id").agg(F.min("digest").alias("digest")), "names")
    equal = stored(names.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("head"), F.count(F.lit(1)).alias("copies")), "equal")
    first = equal.select(F.col("head").alias("vec_id"), "digest", "copies")
    # rows that repeat a vec_id with its vector are alike in all columns
    heads = stored(numbered.join(first, ["vec_id", "digest"]).dropDuplicates(["vec_id"]).select("vec_id", "copies", "vector"), "heads")
    found = stored(celled(heads, dtype, threshold, seed), "cells")
    asks = lambda name, stored_here: found.select(F.explode(name).alias("cell"), "vec_id", F.lit(stored_here).alias("stored"))
    entries = asks("own", True).unionByName(asks("near", False))
    sizes = entries.groupBy("cell").agg(F.sum(F.col("stored").cast("long")).alias("lefts"), F.count(F.lit(1)).alias("alls"))
    active = entries.join(sizes.where("lefts > 0 AND alls > 1"), "cell")
    met = stored(meetings(active.join(heads, "vec_id").select("cell", "stored", "vec_id", "copies", "vector", "lefts", "alls"), dtype, threshold, seed), "met")
    links = met.groupBy("vec_id").agg(F.sum("links").alias("links"))
    roots = components(met.where("vec_id <> root").select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    told = equal.join(links, equal["head"] == links["vec_id"], "left").drop("vec_id").join(roots, F.col("head") == F.col("node"), "left")
    told = told.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "head").alias("component_id"))
    out = names.join(told, "digest", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )
    return out.unionByName(nameless)
