"""Trees grown as deep as Spark ML grows them, whatever their number of nodes.

Spark ML passes over all rows for every group of nodes that fits its memory, so that the passes grow
with the nodes of a deep tree. Here nodes of more than LOCAL_ROWS rows are cut a level per pass; the rows
of a smaller one meet in one task, which grows all that is below it. Values are kept as bin numbers, a byte
each. Thresholds and cuts are those of ``tree_models``: Spark's own on up to TREE_ROWS rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.functions.vectors import stack
from junctura.operators.splits import BINS, _gini, _reached, _thresholds
from junctura.session import cut_lineage

#: Rows of a node that one task grows to its end.
LOCAL_ROWS = 16_384
#: Bytes of counts by node, feature, bin and class that are cut at once.
CELL_BYTES = 8 * 1024 * 1024


def _cells(bins: np.ndarray, label: np.ndarray, slot: np.ndarray, nodes: int, width: int, classes: int) -> np.ndarray:
    """Rows by (node, feature, bin, class)."""
    d = bins.shape[1]
    cell = ((slot[:, None] * d + np.arange(d)) * width + bins) * classes + label[:, None]
    return np.bincount(cell.ravel(), minlength=nodes * d * width * classes).astype(np.float64).reshape(nodes, d, width, classes)


def _cut(n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(feature, cut, gain, lower, upper) of each node's best threshold; of equal gains the first feature's first."""
    whole, lower = n[:, 0].sum(axis=1), n.cumsum(axis=2)[:, :, :-1]
    upper, total = whole[:, None, None] - lower, whole.sum(axis=1)[:, None, None]
    below, above = lower.sum(axis=-1), upper.sum(axis=-1)
    gain = _gini(whole)[:, None, None] - below / total * _gini(lower) - above / total * _gini(upper)
    gain[(below < 1) | (above < 1)] = -1.0
    flat, every = gain.reshape(len(n), -1).argmax(axis=1), np.arange(len(n))
    feature, cut = np.divmod(flat, gain.shape[2])
    return feature, cut, gain[every, feature, cut], lower[every, feature, cut], upper[every, feature, cut]


def _grown(bins: np.ndarray, label: np.ndarray, levels: int, width: int, classes: int) -> tuple[np.ndarray, ...]:
    """(feature, cut, left, class) of the nodes below one that holds these rows, itself first; a leaf's feature is -1."""
    some = max(1, CELL_BYTES // (8 * bins.shape[1] * width * classes))
    parts = [(np.array([-1]), np.array([0]), np.array([0]), np.array([np.bincount(label, minlength=classes).argmax()]))]
    size, active, rows, slot = 1, np.zeros(1, dtype=np.int64), np.arange(len(label)), np.zeros(len(label), dtype=np.int64)
    for level in range(levels):
        if not len(active):
            break
        order = np.argsort(slot, kind="stable")
        rows, slot = rows[order], slot[order]
        found = []
        for first in range(0, len(active), some):
            count = min(some, len(active) - first)
            here = slice(*np.searchsorted(slot, [first, first + count]))
            found.append(_cut(_cells(bins[rows[here]], label[rows[here]], slot[here] - first, count, width, classes)))
        feature, cut, gain, lower, upper = (np.concatenate(x) for x in zip(*found, strict=True))
        grows = gain > 0
        left = np.where(grows, size + 2 * (np.cumsum(grows) - 1), 0)
        tree, node = [np.concatenate(x) for x in zip(*parts, strict=True)], active[grows]
        tree[0][node], tree[1][node], tree[2][node] = feature[grows], cut[grows], left[grows]
        sides = np.stack([lower[grows], upper[grows]], axis=1).reshape(-1, classes)
        leaf = np.full(len(sides), -1)
        parts = [tuple(tree), (leaf, np.zeros_like(leaf), np.zeros_like(leaf), sides.argmax(axis=1))]
        children = size + np.arange(len(sides))
        mixed = np.count_nonzero(sides, axis=1) > 1
        # each row goes on to its child's slot among the mixed children
        stays = grows[slot]
        rows, slot = rows[stays], slot[stays]
        child = left[slot] + (bins[rows, feature[slot]] > cut[slot]) - size
        size += len(sides)
        kept = mixed[child]
        rows, slot, active = rows[kept], (np.cumsum(mixed) - 1)[child[kept]], children[mixed]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


@dataclass
class DeepTree:
    """The decision tree Spark ML grows, to ``max_depth``."""

    max_depth: int

    def fit(self, train: DataFrame) -> DeepTreeModel:
        key = F.col("row_id") if "row_id" in train.columns else F.xxhash64("features")
        rows = cut_lineage(
            train.select(
                key.alias("row_id"),
                F.col("features").cast("array<double>").alias("features"),
                F.col("class").cast("int").alias("class"),
                F.array().cast("array<int>").alias("tests"),
            )
        )
        n, d, top = rows.agg(F.count("*"), F.max(F.size("features")), F.max("class")).first()
        if not n:
            raise ValueError("a tree needs rows to grow on")
        classes, width, spark = top + 1, max(2, min(BINS, n)), rows.sparkSession
        cuts = _thresholds(rows, d, width, 0, 1)[0]
        shared = spark.sparkContext.broadcast(cuts)

        def binned(batches):
            for batch in batches:
                if len(batch):
                    x = stack(batch["features"])
                    bins = np.stack([np.searchsorted(c, v) for c, v in zip(shared.value, x.T, strict=True)], axis=1)
                    bins[np.isnan(x)] = 0
                    yield pd.DataFrame({"bins": [b.tobytes() for b in bins.astype(np.uint8)], "class": batch["class"]})

        data = cut_lineage(rows.select("features", "class").mapInPandas(binned, "bins binary, class int"))
        tree = _upper_tree(data, n, d, width, classes, self.max_depth)
        feature, cut, left, said = _lower_trees(data, tree, d, width, classes, self.max_depth)
        threshold = np.where(feature >= 0, cuts[feature, np.minimum(cut, width - 2)], 0.0)
        return DeepTreeModel(feature, threshold, left, said.astype(np.int32))


def _matrix(column: pd.Series, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), d)


def _upper_tree(data: DataFrame, n: int, d: int, width: int, classes: int, max_depth: int) -> dict[str, list]:
    """The nodes of more than LOCAL_ROWS rows and their children, a level a pass."""
    tree = {"feature": [-1], "cut": [0], "left": [0], "class": [0], "level": [0], "open": [True]}
    large, some = [0] if n > LOCAL_ROWS else [], max(1, CELL_BYTES // (8 * d * width * classes))
    while large:
        grown = []
        for at in range(0, len(large), some):
            nodes = np.array(large[at : at + some])
            shared = data.sparkSession.sparkContext.broadcast((nodes, *(np.array(tree[x]) for x in ("feature", "cut", "left"))))

            def count(batches):
                places, *held = shared.value
                sums = np.zeros((len(places), d, width, classes))
                for batch in batches:
                    if len(batch):
                        bins = _matrix(batch["bins"], d)
                        node = _reached(bins, np.arange(len(bins)), np.zeros(len(bins), dtype=np.int64), *held)
                        slot = np.minimum(np.searchsorted(places, node), len(places) - 1)
                        mine = places[slot] == node
                        sums += _cells(bins[mine], batch["class"].to_numpy()[mine], slot[mine], len(places), width, classes)
                if sums.any():
                    yield pd.DataFrame({"node": places, "sums": list(sums.reshape(len(places), -1))})

            partial = data.mapInPandas(count, "node int, sums array<double>")
            summed = partial.groupBy("node").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))

            def choose(batches):
                for batch in batches:
                    if len(batch):
                        feature, cut, gain, lower, upper = _cut(np.stack(batch["sums"]).reshape(-1, d, width, classes))
                        yield pd.DataFrame({"node": batch["node"], "feature": feature, "cut": cut, "gain": gain, "lower": list(lower), "upper": list(upper)})

            told = summed.mapInPandas(choose, "node int, feature int, cut int, gain double, lower array<double>, upper array<double>")
            for node, feature, cut, gain, lower, upper in told.toPandas().sort_values("node").itertuples(index=False):  # a row per node
                tree["class"][node], tree["open"][node] = int(np.argmax(np.asarray(lower) + np.asarray(upper))), False
                if gain <= 0:
                    continue
                tree["feature"][node], tree["cut"][node], tree["left"][node] = feature, cut, len(tree["feature"])
                level = tree["level"][node] + 1
                for side in (np.asarray(lower), np.asarray(upper)):
                    mixed = level < max_depth and np.count_nonzero(side) > 1
                    if mixed and side.sum() > LOCAL_ROWS:
                        grown.append(len(tree["feature"]))
                    for name, value in (("feature", -1), ("cut", 0), ("left", 0), ("class", int(np.argmax(side))), ("level", level), ("open", mixed)):
                        tree[name].append(value)
        large = grown
    return tree


def _lower_trees(data: DataFrame, tree: dict[str, list], d: int, width: int, classes: int, max_depth: int) -> tuple[np.ndarray, ...]:
    """(feature, cut, left, class) of the whole tree: what is below each open node is grown in one task."""
    held = tuple(np.array(tree[x]) for x in ("feature", "cut", "left", "class"))
    ends, level = np.array(tree["open"]), np.array(tree["level"])
    if not ends.any():
        return held
    shared = data.sparkSession.sparkContext.broadcast((held[:3], ends, level))

    def place(batches):
        nodes, wanted, _ = shared.value
        for batch in batches:
            if len(batch):
                bins = _matrix(batch["bins"], d)
                node = _reached(bins, np.arange(len(bins)), np.zeros(len(bins), dtype=np.int64), *nodes)
                yield batch.assign(node=node.astype(np.int32))[wanted[node]]

    def grow(rows: pa.Table) -> pa.Table:
        root = rows["node"][0].as_py()
        bins, label = _matrix(rows["bins"].to_pylist(), d), rows["class"].to_numpy().astype(np.int64)
        found = _grown(bins, label, max_depth - int(shared.value[2][root]), width, classes)
        names = ("feature", "cut", "left", "said")
        return pa.table({"node": pa.array(np.full(len(found[0]), root, np.int32)), "at": pa.array(np.arange(len(found[0]), dtype=np.int32))} | {x: pa.array(v.astype(np.int32)) for x, v in zip(names, found, strict=True)})

    tasks = max(int(ends.sum()), 1)
    placed = data.mapInPandas(place, "bins binary, class int, node int").repartition(min(tasks, 1024), "node")
    below = placed.groupBy("node").applyInArrow(grow, "node int, at int, feature int, cut int, left int, said int")
    below = below.toPandas().sort_values(["node", "at"])  # numbers only: as many rows as the tree has nodes
    parts, size = [list(held)], len(held[0])
    for root, part in below.groupby("node"):
        # the node itself keeps its number, those below it get the next ones
        first = size - 1
        feature, cut, left, said = (part[x].to_numpy().astype(np.int64) for x in ("feature", "cut", "left", "said"))
        left = np.where(feature >= 0, left + first, 0)
        for x, v in zip(parts[0], (feature, cut, left, said), strict=True):
            x[root] = v[0]
        parts.append([feature[1:], cut[1:], left[1:], said[1:]])
        size += len(part) - 1
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


@dataclass
class DeepTreeModel:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    classes: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.feature, self.threshold, self.left, self.classes))

        @F.pandas_udf("int")
        def say(features: pd.Series) -> pd.Series:
            *tree, classes = shared.value
            if not len(features):
                return pd.Series([], dtype="int32")
            x = stack(features)
            return pd.Series(classes[_reached(x, np.arange(len(x)), np.zeros(len(x), dtype=np.int64), *tree)])

        return df.withColumn("predicted", say("features"))
