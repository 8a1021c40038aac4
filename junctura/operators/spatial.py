"""Variance ratios, mean distances and spatial autocorrelation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.operators.neighbors import knn_self
from junctura.operators.ranking import running_totals

BLOCK_ROWS = 8192  # most locations of one side in one task's group
TILE_ROWS = 512  # locations of a block compared at a time
TILE_FACTORS = (1, 4, 16, 64)
CELL_LOCATIONS = 2048


def variance_ratio(table: DataFrame, value: str, cluster: str = "cluster") -> DataFrame:
    """(general, pooled, ratio): sample variance, and pooled within clusters of more than one row."""
    general = table.agg(F.var_samp(value).alias("general"))
    pooled = (
        table.groupBy(cluster)
        .agg(F.count(value).alias("n"), F.var_samp(value).alias("v"))
        .where(F.col("n") > 1)
        .agg(F.try_divide(F.sum((F.col("n") - 1) * F.col("v")), F.sum(F.col("n") - 1)).alias("pooled"))
    )
    # one row on either side
    both = general.withColumn("_k", F.lit(1)).join(pooled.withColumn("_k", F.lit(1)), "_k")
    return both.select("general", "pooled", F.try_divide(F.col("general"), F.col("pooled")).alias("ratio"))


def mean_distance(table: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Each row's mean |difference| to all rows (of its group), itself included: adds ``mean_distance``.

    From running counts and sums over the sorted distinct values instead of all pairs. A row
    whose value or group is NULL stays, with a NULL distance.
    """
    by = list(by)
    totals = running_totals(table, value, {"_c": F.count("*"), "_s": F.sum(F.col(value).cast("double"))}, by)
    x = F.col(value)
    below = x * F.col("cum__c") - F.col("cum__s")
    above = (F.col("all__s") - F.col("cum__s")) - x * (F.col("all__c") - F.col("cum__c"))
    per_value = totals.select(*by, value, ((below + above) / F.col("all__c")).alias("mean_distance"))
    return table.join(per_value, [*by, value], "left")


def band_sums(points: DataFrame, threshold: float, values: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """For every distinct location: its own and its band's counts and sums.

    Points at one place are added up first. Locations meet through a grid of cells at least
    as wide as the threshold, in blocks of bounded size; only sums leave the tasks, never pairs.
    Columns: x, y, n, s_<v>, q_<v> (sum of squares), band_n, band_<v>; the band includes
    the location itself.
    """
    own = points.groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(
        F.count("*").alias("n"),
        *[F.sum(F.col(v).cast("double")).alias(f"s_{v}") for v in values],
        *[F.sum(F.col(v).cast("double") * F.col(v).cast("double")).alias(f"q_{v}") for v in values],
    )
    reach = float(threshold)
    width = (reach if reach > 0 else 1.0) * _tile_factor(own, reach)
    cell = own.withColumn("cx", F.floor(F.col("x") / width)).withColumn("cy", F.floor(F.col("y") / width))
    # every cell a location's band can touch; a little wider, as the exact test follows
    edge = reach * (1 + 1e-9)
    touched = lambda c: F.sequence(F.floor((F.col(c) - edge) / width), F.floor((F.col(c) + edge) / width))
    near = own.withColumn("cx", F.explode(touched("x"))).withColumn("cy", F.explode(touched("y")))
    own_blocks, near_blocks = _block_counts(cell, "_own"), _block_counts(near, "_near")
    sizes = own_blocks.join(near_blocks, ["cx", "cy"])
    spot = F.xxhash64("x", "y")
    left = cell.join(sizes, ["cx", "cy"]).withColumn("ob", F.pmod(spot, F.col("_own")).cast("int")).withColumn(
        "nb", F.explode(F.sequence(F.lit(0), F.col("_near") - 1))
    )
    right = near.join(sizes, ["cx", "cy"]).withColumn("nb", F.pmod(spot, F.col("_near")).cast("int")).withColumn(
        "ob", F.explode(F.sequence(F.lit(0), F.col("_own") - 1))
    )
    names = ["n", *[f"s_{v}" for v in values]]
    out = ["band_n", *[f"band_{v}" for v in values]]

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in ["x", "y", *out]})
        bx, by_ = b["rx"].to_numpy(), b["ry"].to_numpy()
        sums = b[names].to_numpy(dtype=np.float64)
        parts = []
        for at in range(0, len(a), TILE_ROWS):
            tile = a.iloc[at : at + TILE_ROWS]
            dx = tile["x"].to_numpy()[:, None] - bx[None, :]
            dy = tile["y"].to_numpy()[:, None] - by_[None, :]
            inside = np.sqrt(dx * dx + dy * dy) <= threshold
            part = pd.DataFrame(inside.astype(np.float64) @ sums, columns=out)
            parts.append(part.assign(x=tile["x"].to_numpy(), y=tile["y"].to_numpy()))
        return pd.concat(parts, ignore_index=True)[["x", "y", *out]]

    schema = "x double, y double, " + ", ".join(f"{c} double" for c in out)
    keys = ["cx", "cy", "ob", "nb"]
    # both sides come from one table, so the right side's keys get names of their own
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in keys], F.col("x").alias("rx"), F.col("y").alias("ry"), *names)
    met = (
        left.select(*keys, "x", "y")
        .groupBy(*keys)
        .cogroup(right.groupBy(*[f"r_{c}" for c in keys]))
        .applyInPandas(meet, schema)
    )
    bands = met.groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in out])
    return own.join(bands, ["x", "y"])


def _tile_factor(locations: DataFrame, threshold: float) -> int:
    """How many thresholds wide a cell may be: the most that keeps every cell small.

    Sparse points would otherwise make one tiny group per cell; dense ones keep factor 1.
    """
    width = threshold if threshold > 0 else 1.0
    fine = (
        locations.groupBy(F.floor(F.col("x") / width).alias("cx"), F.floor(F.col("y") / width).alias("cy"))
        .agg(F.count("*").alias("n"))
        .withColumn("factor", F.explode(F.array(*[F.lit(f) for f in TILE_FACTORS])))
    )
    coarse = fine.groupBy(
        "factor", F.floor(F.col("cx") / F.col("factor")).alias("cx"), F.floor(F.col("cy") / F.col("factor")).alias("cy")
    ).agg(F.sum("n").alias("n"))
    largest = coarse.groupBy("factor").agg(F.max("n").alias("n")).where(F.col("n") <= CELL_LOCATIONS)
    return largest.agg(F.max("factor")).first()[0] or 1


def _block_counts(cells: DataFrame, name: str) -> DataFrame:
    return cells.groupBy("cx", "cy").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name))


def morans_i(
    points: DataFrame,
    values: Sequence[str],
    thresholds: Sequence[float],
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """(threshold, property, morans_i, expected): Moran's I with row-standardised band weights.

    A point with no neighbour in the band carries no weight.
    """
    stats = points.agg(F.count("*").alias("n"), *[F.avg(F.col(v).cast("double")).alias(f"m_{v}") for v in values]).first()
    n = stats["n"]
    centred = points.select(
        F.col(x).alias("x"), F.col(y).alias("y"), *[(F.col(v).cast("double") - F.lit(stats[f"m_{v}"])).alias(v) for v in values]
    )
    out = None
    for threshold in thresholds:
        band = band_sums(centred, threshold, values)
        others = F.col("band_n") - 1
        weight = F.sum(F.when(others > 0, F.col("n")).otherwise(0)).alias("s0")
        cross = [
            F.sum(F.try_divide(F.col(f"band_{v}") * F.col(f"s_{v}") - F.col(f"q_{v}"), others)).alias(f"c_{v}") for v in values
        ]
        square = [F.sum(f"q_{v}").alias(f"z_{v}") for v in values]
        row = band.agg(weight, *cross, *square)
        entries = F.array(
            *[
                F.struct(
                    F.lit(v).alias("property"),
                    F.try_divide(F.lit(n) * F.col(f"c_{v}"), F.col("s0") * F.col(f"z_{v}")).alias("morans_i"),
                )
                for v in values
            ]
        )
        part = row.select(F.explode(entries).alias("e")).select(
            F.lit(float(threshold)).alias("threshold"),
            "e.property",
            "e.morans_i",
            F.lit(-1.0 / (n - 1) if n > 1 else math.nan).alias("expected"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def knn_weights(points: DataFrame, k: int = 2, x: str = "x", y: str = "y", row_id: str = "row_id") -> DataFrame:
    """(row_id, neighbor, weight): the k nearest other points in the plane, weight 1."""
    flat = points.select(F.col(row_id).alias("row_id"), F.array(F.col(x).cast("double"), F.col(y).cast("double")).alias("vec"))
    return knn_self(flat, k).where(F.col("rank") > 0).select("row_id", "neighbor", F.lit(1.0).alias("weight"))
