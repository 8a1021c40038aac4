"""Neighbourhoods: label shares, greedy non-overlapping selection, radius features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.functions.vectors import significance
from junctura.operators.neighbors import neighbour_radius, radius_join
from junctura.session import cut_lineage

WALKED = 4_000_000  # edges that one task walks; it holds at most as many ids
ROUNDS = 3  # rounds over all edges before the best ones are walked


def neighbourhood_subjects(neighbours: DataFrame, data: DataFrame, subject: str, label: str) -> DataFrame:
    """Each distinct (row_id, subject, label) of a row's neighbours."""
    about = data.select(F.col("row_id").alias("neighbor"), F.col(subject).alias("subject"), F.col(label).alias("label"))
    return neighbours.select("row_id", "neighbor").join(about, "neighbor").select("row_id", "subject", "label").distinct()


def neighbourhood_stats(neighbours: DataFrame, data: DataFrame, subject: str = "FILENAME", label: str = "labels") -> DataFrame:
    """(row_id, how_many_subjects, label, share): shares are over distinct subjects, not rows.

    Only labels that occur are listed; a label that is absent has share 0.
    """
    seen = neighbourhood_subjects(neighbours, data, subject, label)
    per_label = seen.groupBy("row_id", "label").agg(F.count("*").alias("n"))
    totals = per_label.groupBy("row_id").agg(F.sum("n").alias("how_many_subjects"))
    return per_label.join(totals, "row_id").select(
        "row_id", "how_many_subjects", "label", (F.col("n") / F.col("how_many_subjects")).alias("share")
    )


def label_share(
    neighbours: DataFrame, data: DataFrame, value: str, subject: str = "FILENAME", label: str = "labels"
) -> DataFrame:
    """(row_id, how_many_subjects, share) of one label value, 0 where it does not occur."""
    seen = neighbourhood_subjects(neighbours, data, subject, label)
    return seen.groupBy("row_id").agg(
        F.count("*").alias("how_many_subjects"),
        (F.count_if(F.col("label") == value) / F.count("*")).alias("share"),
    )


def neighbour_lists(neighbours: DataFrame, stats: DataFrame) -> DataFrame:
    """Statistics with the neighbour ids as one array, nearest first."""
    lists = neighbours.groupBy("row_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "neighbor"))), lambda s: s["neighbor"]).alias("neighbors")
    )
    return stats.join(lists, "row_id")


def candidates(shares: DataFrame, min_significance: float = 0.6, min_subjects: int = 10) -> DataFrame:
    """Rows whose neighbourhood leans strictly more than asked and has strictly more subjects."""
    scored = shares.withColumn("significance", significance(F.col("share")))
    return scored.where((F.col("significance") > min_significance) & (F.col("how_many_subjects") > min_subjects))


def _walk(edges: DataFrame) -> DataFrame:
    """(row_id): the rows that the walk over ``edges`` (src, sig, dst) drops, in one task.

    The edges stream by in the order of their sources; only the dropped ids are held.
    """

    def walk(batches):
        dropped = set()
        for batch in batches:
            fresh = []
            for src, dst in zip(batch["src"].tolist(), batch["dst"].tolist(), strict=True):
                if src not in dropped and dst not in dropped:
                    dropped.add(dst)
                    fresh.append(dst)
            yield pd.DataFrame({"row_id": pd.Series(fresh, dtype="int64")})

    ordered = edges.select("src", "sig", "dst").repartition(1).sortWithinPartitions(F.desc("sig"), "src")
    return ordered.mapInPandas(walk, "row_id bigint")


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select(F.col("row_id").alias("src")), "src", "left_anti").join(gone.select(F.col("row_id").alias("dst")), "dst", "left_anti")


def select_non_overlapping(candidate_rows: DataFrame, neighbours: DataFrame, walked: int = WALKED) -> DataFrame:
    """Greedy selection: best first, skipping rows inside the list of a selected row.

    Order: significance descending, then row_id. A row's fate depends on better rows only, so
    parts can be decided apart from the walk's order. While more than ``walked`` edges between
    undecided rows are left, ROUNDS rounds go over all of them (a row that no undecided better row
    lists is selected and drops what it lists), then the best ``walked`` edges are walked in one
    task, so that long chains don't take a round per link. The last ``walked`` edges are one walk.
    """
    nodes = cut_lineage(candidate_rows.select("row_id", "significance"))
    other = nodes.select(F.col("row_id").alias("dst"), F.col("significance").alias("dst_sig"))
    better = (F.col("significance") > F.col("dst_sig")) | (
        (F.col("significance") == F.col("dst_sig")) & (F.col("row_id") < F.col("dst"))
    )
    edges = cut_lineage(
        neighbours.select("row_id", F.col("neighbor").alias("dst"))
        .where(F.col("row_id") != F.col("dst"))
        .join(nodes, "row_id")
        .join(other, "dst")
        .where(better)
        .select(F.col("row_id").cast("long").alias("src"), F.col("significance").alias("sig"), F.col("dst").cast("long").alias("dst"))
    )
    gone = []
    while (left := edges.count()) > walked:
        for _ in range(ROUNDS):
            fresh = edges.select("src").join(edges.select(F.col("dst").alias("src")), "src", "left_anti").distinct()
            dropped = cut_lineage(edges.join(fresh, "src", "left_semi").select(F.col("dst").alias("row_id")).distinct())
            gone.append(dropped)
            edges = cut_lineage(_without(edges.join(fresh, "src", "left_anti"), dropped))
        left = edges.count()
        if left > walked:
            first = cut_lineage(edges.orderBy(F.desc("sig"), "src", "dst").limit(walked))
            last = first.agg(F.min(F.struct("sig", (-F.col("src")).alias("at"))).alias("last")).first()["last"]
            decided = F.struct("sig", (-F.col("src")).alias("at")) >= F.struct(F.lit(last["sig"]), F.lit(last["at"]))
            lost = cut_lineage(_walk(first))
            # the last source may have more edges than were walked
            selected = edges.where(decided).join(lost.select(F.col("row_id").alias("src")), "src", "left_anti")
            dropped = cut_lineage(lost.unionByName(selected.select(F.col("dst").alias("row_id"))).distinct())
            gone.append(dropped)
            edges = cut_lineage(_without(edges.where(~decided), dropped))
    if left:
        gone.append(cut_lineage(_walk(edges)))
    if not gone:
        return nodes
    return nodes.join(reduce(DataFrame.unionByName, gone), "row_id", "left_anti")


def threshold_sweep(candidate_rows: DataFrame, selected: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, gross, net) for many thresholds from one selection at the lowest of them.

    A selection depends on better rows only, so the selection at a higher threshold is the
    part of this one that lies above it.
    """
    marks = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    flagged = candidate_rows.select("significance", F.lit(1).alias("gross"), F.lit(0).alias("net")).unionByName(
        selected.select("significance", F.lit(0).alias("gross"), F.lit(1).alias("net"))
    )
    # rows of one significance are added up first, so the sweep is over few distinct values
    totals = flagged.groupBy("significance").agg(F.sum("gross").alias("gross"), F.sum("net").alias("net"))
    above = F.col("significance") > F.col("threshold")
    return (
        totals.select("significance", "gross", "net", marks)
        .groupBy("threshold")
        .agg(
            F.sum(F.when(above, F.col("gross")).otherwise(0)).alias("gross"),
            F.sum(F.when(above, F.col("net")).otherwise(0)).alias("net"),
        )
    )


def feature_list(selected: DataFrame, neighbours: DataFrame, vectors: DataFrame) -> DataFrame:
    """(feature_index, max_distance, center) of the selected rows."""
    ids = selected.select("row_id")
    radius = neighbour_radius(neighbours.join(ids, "row_id", "left_semi"))
    return vectors.join(radius, "row_id").select(
        F.col("row_id").alias("feature_index"), "max_distance", F.col("vec").cast("array<double>").alias("center")
    )


def feature_owner(selected: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(row_id, feature): each listed row belongs to the last selected row that lists it."""
    lists = neighbours.join(selected, "row_id").select(
        F.col("neighbor").alias("row_id"), F.col("row_id").alias("feature"), "significance"
    )
    return lists.groupBy("row_id").agg(
        F.max_by("feature", F.struct(-F.col("significance"), F.col("feature"))).alias("feature")
    )


def subject_frequencies(counts: DataFrame, subjects: DataFrame, subject: str, feature: str = "feature") -> DataFrame:
    """(subject, feature, n, freq) from counts; a subject without any hit stays, with NULL freq."""
    totals = counts.groupBy(subject).agg(F.sum("n").alias("_all"))
    return (
        subjects.select(subject)
        .distinct()
        .join(totals, subject, "left")
        .join(counts, subject, "left")
        .select(
            subject,
            feature,
            F.coalesce("n", F.lit(0).cast("long")).alias("n"),
            F.try_divide(F.col("n").cast("double"), F.col("_all")).alias("freq"),
        )
    )


def owner_feature_table(owners: DataFrame, data: DataFrame, subject: str = "FILENAME") -> DataFrame:
    """Feature table of the training rows, every row counted for its owner only."""
    counts = owners.join(data.select("row_id", subject), "row_id").groupBy(subject, "feature").agg(F.count("*").alias("n"))
    return subject_frequencies(counts, data, subject)


def radius_feature_table(
    vectors: DataFrame, data: DataFrame, features: DataFrame, subject: str = "FILENAME", lists: DataFrame | None = None
) -> DataFrame:
    """Feature table of any rows, seen or unseen: share of each subject's hits per feature; ``lists`` as for ``radius_join``."""
    hits = radius_join(vectors, features, lists=lists)
    counts = hits.join(data.select("row_id", subject), "row_id").groupBy(subject, "feature").agg(F.count("*").alias("n"))
    return subject_frequencies(counts, data, subject)


def multiple_hits(hits: DataFrame) -> DataFrame:
    """How many rows hit any feature, and how many hit more than one."""
    per_row = hits.groupBy("row_id").agg(F.count("*").alias("n"))
    return per_row.agg(F.count("*").alias("rows_hit"), F.count_if(F.col("n") > 1).alias("rows_hit_many"))


def subject_count_distribution(shares: DataFrame) -> DataFrame:
    """How many neighbourhoods have each subject count, with their mean share."""
    return shares.groupBy("how_many_subjects").agg(F.count("*").alias("n"), F.avg("share").alias("mean_share"))


def label_prevalence(data: DataFrame, label: str, value: str) -> DataFrame:
    """Share of rows with a label value."""
    return data.agg(F.avg(F.when(F.col(label) == value, 1.0).otherwise(0.0)).alias("prevalence"))


