"""Recursive k-means and the subject-by-cluster feature table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from junctura.functions.vectors import rough_squared_distances, stack
from junctura.operators.neighborhoods import subject_frequencies
from junctura.session import cut_lineage

MIN_SPLIT = 10  # a cluster is split only if it has more rows than this
STARTS = 10  # runs from different first centres, of which the cheapest is kept
MAX_CENTER_BYTES = 256 * 1024 * 1024  # most bytes of centres: clusters x starts x dimensions x 8
DRAWN = pa.schema([("parent", pa.int32()), ("start", pa.int32()), ("time", pa.float64()), ("id", pa.int64()), ("vec", pa.list_(pa.float64()))])
SUMS = pa.schema([("parent", pa.int32()), ("start", pa.int32()), ("sub", pa.int32()), ("sums", pa.list_(pa.float64()))])


def kmeans(vectors: DataFrame, n: int = 20, seed: int = 0, iterations: int = 300, starts: int = STARTS) -> DataFrame:
    """One level: adds ``cluster``, of ``starts`` runs the one of least cost."""
    whole = vectors.withColumn("parent", F.lit(0))
    return _split_all(whole, n, f"{seed}:0", iterations, 0, MAX_CENTER_BYTES, starts).drop("parent").withColumnRenamed("sub", "cluster")


def recursive_kmeans(
    vectors: DataFrame,
    n: int = 20,
    depth: int = 2,
    seed: int = 0,
    iterations: int = 300,
    min_split: int = MIN_SPLIT,
    center_bytes: int = MAX_CENTER_BYTES,
    starts: int = STARTS,
) -> DataFrame:
    """k-means, then k-means inside every cluster of more than ``min_split`` rows, and so on.

    Adds ``cluster``, a dense number over all leaves. A cluster too small to split stays
    whole. All clusters of one level and all ``starts`` are refined together, until no centre
    moves or for ``iterations`` rounds; each cluster keeps the start of least cost. More than
    ``center_bytes`` of centres raise ValueError.
    """
    if depth < 1:
        raise ValueError("depth must be at least 1")
    rows = cut_lineage(vectors.withColumn("parent", F.lit(0)))
    for level in range(depth):
        split = _split_all(rows, n, f"{seed}:{level}", iterations, min_split if level else 0, center_bytes, starts)
        rows = cut_lineage(_renumber(split, ["parent", "sub"], "_next").drop("parent", "sub").withColumnRenamed("_next", "parent"))
    return rows.withColumnRenamed("parent", "cluster")


def _renumber(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Dense numbers for the combinations of keys; there are at most n**depth of them."""
    ids = df.select(*keys).distinct().withColumn(out, F.row_number().over(Window.orderBy(*keys)) - 1)
    return df.join(F.broadcast(ids), keys)


def _draws(ids: np.ndarray, salt: str) -> np.ndarray:
    """A fixed number in (0, 1) for each id and salt."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64(int.from_bytes(hashlib.md5(salt.encode(), usedforsecurity=False).digest()[:8], "little"))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53) + 2.0**-54


def _by_parent(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(parent, places in the batch, vectors) of a batch's parents; no vector becomes an object of its own."""
    if not batch.num_rows:
        return
    parent = batch.column("parent").to_numpy()
    x = batch.column("vec").flatten().to_numpy().reshape(len(parent), -1)
    order = np.argsort(parent, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(parent[order])) + 1):
        yield int(parent[at[0]]), at, x[at]


def _seeded(large: DataFrame, split: list[int], n: int, seed: str, starts: int) -> dict[tuple[int, int], np.ndarray]:
    """First centres per (parent, start), one more a pass: a row is drawn in proportion to its squared
    distance from the centres so far. The row whose exponential time at that rate is over first is
    the one drawn, so a pass is a minimum and tasks send one row per parent and start.
    """
    centers: dict[tuple[int, int], np.ndarray] = {(p, s): np.empty((0, 0)) for p in split for s in range(starts)}
    for number in range(n):
        shared = large.sparkSession.sparkContext.broadcast(centers)

        def draw(batches, shared=shared, number=number):
            best: dict[tuple[int, int], tuple] = {}
            for batch in batches:
                all_ids = batch.column("row_id").to_numpy()
                for parent, at, x in _by_parent(batch):
                    ids = all_ids[at]
                    for start in range(starts):
                        known = shared.value[parent, start]
                        if len(known) < number:  # no row was left to draw in an earlier pass
                            continue
                        rate = pair_least(x, known) if number else np.ones(len(x))
                        time = np.full(len(x), np.inf)
                        np.divide(-np.log(_draws(ids, f"{seed}:{start}:{number}")), rate, out=time, where=rate > 0)
                        first = np.lexsort((ids, time))[0]
                        if np.isfinite(time[first]):
                            found = (float(time[first]), int(ids[first]), x[first].tolist())
                            key = (parent, start)
                            best[key] = min(best.get(key, found), found, key=lambda f: f[:2])
            if best:
                yield pa.RecordBatch.from_pylist([dict(zip(DRAWN.names, (*key, *f), strict=True)) for key, f in best.items()], schema=DRAWN)

        found = large.select("parent", "row_id", "vec").mapInArrow(draw, "parent int, start int, time double, id bigint, vec array<double>")
        first = found.groupBy("parent", "start").agg(F.min_by("vec", F.struct("time", "id")).alias("vec"))
        centers = dict(centers)
        for row in first.collect():  # one row per parent and start
            key = (row["parent"], row["start"])
            centers[key] = np.array([row["vec"]]) if not number else np.vstack([centers[key], row["vec"]])
    return centers


def pair_least(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distance to the nearest centre; exactly 0 for a centre itself."""
    squared, slack = rough_squared_distances(vectors, centers)
    least = squared.min(axis=1)
    return np.where(least <= 2 * slack, 0.0, least)


def _split_all(rows: DataFrame, n: int, seed: str, iterations: int, min_split: int, center_bytes: int, starts: int) -> DataFrame:
    """Lloyd's algorithm in every parent and for every start at once: adds ``sub``.

    The centres (parents x starts x n x dimensions numbers, fixed by the parameters) are held by
    the driver. Tasks add up their own rows per centre, so only those sums are shuffled
    and a parent with most of the rows is still spread over all tasks.
    """
    spark = rows.sparkSession
    # one row per parent: at most n ** depth rows
    sizes = {row["parent"]: row["n"] for row in rows.groupBy("parent").agg(F.count("*").alias("n")).collect()}
    split = [parent for parent, size in sizes.items() if size > min_split]
    width = rows.select(F.max(F.size("vec"))).first()[0] or 0
    size = 8 * len(split) * starts * n * width
    if size > center_bytes:
        raise ValueError(f"{size} bytes of centres: choose a smaller n or depth, or fewer starts")
    large = rows.where(F.col("parent").isin(split))
    centers = _seeded(large, split, n, seed, starts)
    active, cost = set(centers), dict.fromkeys(centers, np.inf)
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast({key: centers[key] for key in active})
        # rows of parents whose starts have all come to rest stay where they are
        moving = large.where(F.col("parent").isin(sorted({parent for parent, _ in active}))).select("parent", "vec")
        partial = moving.mapInArrow(_center_sums(shared, starts), "parent int, start int, sub int, sums array<double>")
        totals = partial.groupBy("parent", "start", "sub").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")).toArrow()
        moved, shift = {key: centers[key].copy() for key in active}, dict.fromkeys(active, 0.0)
        spent = dict.fromkeys(active, 0.0)
        numbers = pc.list_flatten(totals["sums"]).to_numpy().reshape(len(totals), 2 + width)
        # one row per centre; a centre without rows keeps its place
        for parent, start, sub, sums in zip(*(totals[c].to_pylist() for c in ("parent", "start", "sub")), numbers, strict=True):
            key, mean = (parent, start), sums[2:] / sums[0]
            shift[key] = max(shift[key], float(((mean - centers[key][sub]) ** 2).sum()))
            spent[key] += sums[1]
            moved[key][sub] = mean
        centers, cost = centers | moved, cost | spent
        active = {key for key in active if shift[key] > 1e-8}
        shared.destroy()
        if not active:
            break
    best = {parent: min(range(starts), key=lambda s: (cost[parent, s], s)) for parent in split}
    shared = spark.sparkContext.broadcast({parent: centers[parent, start] for parent, start in best.items()})

    @F.pandas_udf("int")
    def nearest(parent: pd.Series, vec: pd.Series) -> pd.Series:
        out = np.zeros(len(parent), dtype=np.int32)
        for key, at in parent.groupby(parent).indices.items():
            if key in shared.value:
                out[at] = _nearest_center(stack(vec.iloc[at]), shared.value[key])
        return pd.Series(out)

    return rows.withColumn("sub", nearest("parent", "vec"))


def _nearest_center(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return rough_squared_distances(vectors, centers)[0].argmin(axis=1)


def _center_sums(shared, starts: int):
    """Per task and start: row count, cost and vector sum of every centre, as one array [n, cost, sum...]."""

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for parent, _, x in _by_parent(batch):
                for start in range(starts):
                    centers = shared.value.get((parent, start))
                    if centers is None:  # has come to rest
                        continue
                    squared = rough_squared_distances(x, centers)[0]
                    sub = squared.argmin(axis=1)
                    least = squared[np.arange(len(x)), sub]
                    mine = (sub[:, None] == np.arange(len(centers))).astype(np.float64)
                    add = np.column_stack([mine.sum(axis=0), mine.T @ least, mine.T @ x])
                    key = (parent, start)
                    sums[key] = sums[key] + add if key in sums else add
        rows = [(*key, sub, v) for key, found in sums.items() for sub, v in enumerate(found) if v[0]]
        if rows:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=SUMS.names), schema=SUMS, preserve_index=False)

    return run


def cluster_cost(clustered: DataFrame, vec: str = "vec") -> float:
    """Sum of squared distances of the rows to their cluster's mean."""
    spread = clustered.groupBy("cluster").agg(vector_to_array(Summarizer.variance(array_to_vector(vec))).alias("v"), F.count("*").alias("n"))
    return spread.agg(F.sum(F.aggregate("v", F.lit(0.0), lambda t, x: t + x) * (F.col("n") - 1))).first()[0] or 0.0


def cluster_counts(clustered: DataFrame, data: DataFrame, subject: str) -> DataFrame:
    """(subject, feature, n): rows of each subject in each cluster."""
    return (
        clustered.select("row_id", F.col("cluster").alias("feature"))
        .join(data.select("row_id", subject), "row_id")
        .groupBy(subject, "feature")
        .agg(F.count("*").alias("n"))
    )


def diversity_share(table: DataFrame, subject: str = "subject") -> DataFrame:
    """(feature, top_percent): how much of a feature's total comes from its top subject."""
    return (
        table.where(F.col("feature").isNotNull())
        .groupBy("feature")
        .agg(F.try_divide(100.0 * F.max("freq"), F.sum("freq")).alias("top_percent"))
    )


def diversity_filter(table: DataFrame, threshold: float = 100.0) -> DataFrame:
    """Drop features whose top subject holds strictly more than ``threshold`` percent.

    Shares are compared to nine decimals, so that the order in which they are added up in
    different runs can't decide.
    """
    top = diversity_share(table).where(F.round("top_percent", 9) > threshold)
    return table.join(top.select("feature"), "feature", "left_anti")


def cluster_feature_table(
    clustered: DataFrame, data: DataFrame, subject: str = "SUBJECT", threshold: float = 100.0
) -> DataFrame:
    """(subject, feature, n, freq) after the diversity filter."""
    counts = cluster_counts(clustered, data, subject)
    return diversity_filter(subject_frequencies(counts, data, subject), threshold)


def cluster_features(
    vectors: DataFrame,
    labels: DataFrame,
    label_column: str,
    n: int = 20,
    depth: int = 2,
    threshold: float = 100.0,
    ignore: list[str] | None = None,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Clusters and the feature table of a vectors table: (row_id, cluster), feature table."""
    rows = vectors.drop(*(ignore or [])).select("row_id", "vec")
    clustered = recursive_kmeans(rows, n, depth, seed).select("row_id", "cluster")
    return clustered, cluster_feature_table(clustered, labels, label_column, threshold)
