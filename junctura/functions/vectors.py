"""Numeric vectors held as array<double>: column expressions and numpy kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(u: Column, v: Column) -> Column:
    return F.aggregate(
        F.zip_with(u, v, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, term: total + term
    )


def euclidean(u: Column, v: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(squared_distance(u, v))


def vector_sum(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda total, x: total + x)


def significance(share: Column) -> Column:
    """How far a label share leans to one side: max(a, 1 - a)."""
    return F.greatest(share, F.lit(1.0) - share)


def column_range(vec: Column, first: int, last: int) -> Column:
    """Positions first..last of a vector, counted from 1, both ends included."""
    return F.slice(vec, first, last - first + 1)


def dense_vector(index: Column, value: Column, size: int) -> Column:
    """Spread (index, value) lists, index from 0, over a dense array of ``size``."""

    @F.pandas_udf("array<double>")
    def spread(indices: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for at, val in zip(indices, values):
            row = np.zeros(size)
            row[np.asarray(at, dtype=np.int64)] = np.asarray(val, dtype=np.float64)
            out.append(row)
        return pd.Series(out)

    return spread(index, value)


def stack(series: pd.Series) -> np.ndarray:
    """A column of arrays as one matrix."""
    return np.stack(series.to_numpy()).astype(np.float64, copy=False)


def pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise distance, added up coordinate by coordinate.

    This is the same order of additions as ``euclidean``, so both give equal bits and a
    neighbour lying exactly on a radius is inside it whichever one measured the radius.
    """
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        step = a[:, j] - b[:, j]
        total += step * step
    return np.sqrt(total)


def rough_squared_distances(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All squared distances by one matrix product, and a bound on their error per row."""
    a2 = np.einsum("ij,ij->i", a, a)
    b2 = np.einsum("ij,ij->i", b, b)
    squared, product = a2[:, None] + b2[None, :], a @ b.T
    product *= 2.0
    squared -= product
    scale = a2 + (b2.max() if len(b2) else 0.0)
    return np.maximum(squared, 0.0, out=squared), 1e-13 * (a.shape[1] + 16) * (scale + 1e-300)


#: Squared lengths that single precision holds with room for their sums.
SINGLE = (1e-25, 1e30)


class RoughBlock:
    """Rows that queries are compared with by one matrix product a slice, in single precision where it holds the squares.

    The rows are shifted by their mean, so that little is lost. With ``reach`` a row's squared reach is
    taken off its squared distances: what is not above 0 is then within reach.
    """

    def __init__(self, rows: np.ndarray, reach: np.ndarray | None = None):
        self.rows, self.size = rows.shape
        self._source, self._reach, self._right = rows, reach, {}
        self.shift = rows.mean(axis=0) if self.rows else np.zeros(self.size)
        self.raw = np.einsum("ij,ij->i", rows, rows).max(initial=0.0)
        self._moved_squares = np.einsum("ij,ij->i", rows - self.shift, rows - self.shift)
        self.far = self._moved_squares.max(initial=0.0)
        own = np.zeros(1) if reach is None else reach[np.isfinite(reach)] ** 2
        self.reach = own.max(initial=0.0)

    def right(self, kind: type) -> np.ndarray:
        if kind not in self._right:
            out = np.empty((self.size + 1, self.rows), kind)
            out[:-1] = (self._source - self.shift).T
            out[-1] = self._moved_squares if self._reach is None else self._moved_squares - self._reach**2 * (1 + 1e-12)
            self._right[kind] = out
        return self._right[kind]

    def asked(self, a: np.ndarray) -> RoughQueries:
        return RoughQueries(self, a)


class RoughQueries:
    """Queries beside a block: ``values`` are squared distances less ``squares``, each wrong by at most ``slack``."""

    def __init__(self, block: RoughBlock, a: np.ndarray):
        moved = a - block.shift
        self.block, self.squares = block, np.einsum("ij,ij->i", moved, moved)
        low, high = SINGLE
        single = low < block.far < high and block.reach < high and self.squares.max(initial=0.0) < high
        self.kind, unit = (np.float32, 2.0**-23) if single else (np.float64, 1e-13)
        scale = self.squares + 2 * block.far + block.reach
        raw = np.einsum("ij,ij->i", a, a) + block.raw
        self.slack = (a.shape[1] + 16) * (unit * scale + 1e-13 * raw + 1e-300)
        self.left = np.empty((len(a), a.shape[1] + 1), self.kind)
        self.left[:, :-1], self.left[:, -1] = -2 * moved, 1
        self._room = np.empty((len(a), 0), self.kind)

    def values(self, first: int, last: int) -> np.ndarray:
        """Those to the block's rows from ``first`` up to ``last``; the next call takes their place."""
        other = self.block.right(self.kind)[:, first:last]
        if self._room.shape[1] != other.shape[1]:
            self._room = np.empty((len(self.left), other.shape[1]), self.kind)
        return np.matmul(self.left, other, out=self._room)

    def up(self, limit: np.ndarray) -> np.ndarray:
        """Limits in the precision of ``values``, rounded up."""
        return np.nextafter(limit.astype(self.kind), self.kind(np.inf))
