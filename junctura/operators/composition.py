"""Clusters of n-grams: centres, property means, amino-acid composition, pairwise distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from junctura.functions.sequences import AMINO_ACIDS, letters

# The eight physico-chemical properties of an n-gram.
PROPERTIES = (
    "CDR3_AA_GRAVY",
    "CDR3_AA_BULK",
    "CDR3_AA_ALIPHATIC",
    "CDR3_AA_POLARITY",
    "CDR3_AA_CHARGE",
    "CDR3_AA_BASIC",
    "CDR3_AA_ACIDIC",
    "CDR3_AA_AROMATIC",
)


def cluster_centers(points: DataFrame, x: str = "dim1", y: str = "dim2") -> DataFrame:
    return points.groupBy("cluster").agg(
        F.count("*").alias("length"), F.avg(x).alias("center_x"), F.avg(y).alias("center_y")
    )


def property_means(table: DataFrame, properties: Sequence[str] = PROPERTIES) -> DataFrame:
    return table.groupBy("cluster").agg(*[F.avg(p).alias(p) for p in properties])


def letter_counts(ngrams: DataFrame, ngram: str = "Ngram") -> DataFrame:
    """(cluster, letter, n): how often each letter occurs in a cluster's n-grams."""
    return (
        ngrams.select("cluster", F.explode(letters(F.col(ngram))).alias("letter"))
        .groupBy("cluster", "letter")
        .agg(F.count("*").alias("n"))
    )


def letter_maps(ngrams: DataFrame, ngram: str = "Ngram") -> DataFrame:
    """(cluster, length, logo): number of n-grams and a map letter -> count."""
    logo = letter_counts(ngrams, ngram).groupBy("cluster").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("letter", "n")))).alias("logo")
    )
    sizes = ngrams.groupBy("cluster").agg(F.count("*").alias("length"))
    return sizes.join(logo, "cluster")


def composition(ngrams: DataFrame, ngram: str = "Ngram") -> DataFrame:
    """(cluster, length, letter, freq): letter count per n-gram, all twenty letters listed."""
    sizes = ngrams.groupBy("cluster").agg(F.count("*").alias("length"))
    alphabet = F.array(*[F.lit(a) for a in AMINO_ACIDS])
    grid = sizes.withColumn("letter", F.explode(alphabet))
    return grid.join(letter_counts(ngrams, ngram), ["cluster", "letter"], "left").select(
        "cluster", "length", "letter", (F.coalesce("n", F.lit(0)) / F.col("length")).alias("freq")
    )


def all_pairs(table: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Every pair a < b of a table of clusters, with both sides' values (suffixes _a, _b).

    All pairs of clusters are the result here, so it is quadratic in the number of
    clusters, a parameter of the clustering and not of the data.
    """
    ranked = table.select(key, *values).withColumn("_i", F.row_number().over(Window.orderBy(key)))
    count = F.count("*").over(Window.partitionBy())
    left = (
        ranked.withColumn("_n", count)
        .where(F.col("_i") < F.col("_n"))
        .withColumn("_j", F.explode(F.sequence(F.col("_i") + 1, F.col("_n").cast("int"))))
        .select(F.col(key).alias("a"), *[F.col(v).alias(f"{v}_a") for v in values], "_j")
    )
    right = ranked.select(F.col(key).alias("b"), *[F.col(v).alias(f"{v}_b") for v in values], F.col("_i").alias("_j"))
    return left.join(right, "_j").drop("_j")


def property_distances(table: DataFrame, key: str, value: str) -> DataFrame:
    """(a, b, distance): |difference| of one property for every pair of clusters."""
    return all_pairs(table, key, [value]).select(
        "a", "b", F.abs(F.col(f"{value}_a") - F.col(f"{value}_b")).alias("distance")
    )


def cluster_pairs(
    points: DataFrame, properties: Sequence[str] = PROPERTIES, ngram: str = "Ngram", x: str = "dim1", y: str = "dim2"
) -> DataFrame:
    """For every pair of clusters: distance of centres (CM), of compositions (logo), of each property."""
    logo = composition(points, ngram).groupBy("cluster").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("letter", "freq"))), lambda s: s["freq"]).alias("logo")
    )
    means = points.groupBy("cluster").agg(
        F.avg(x).alias("x"), F.avg(y).alias("y"), *[F.avg(p).alias(p) for p in properties]
    )
    pairs = all_pairs(means.join(logo, "cluster"), "cluster", ["x", "y", "logo", *properties])
    cm = F.sqrt(F.pow(F.col("x_a") - F.col("x_b"), 2) + F.pow(F.col("y_a") - F.col("y_b"), 2))
    squares = F.zip_with("logo_a", "logo_b", lambda p, q: (p - q) * (p - q))
    return pairs.select(
        "a",
        "b",
        cm.alias("CM"),
        F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, t: s + t)).alias("logo"),
        *[F.abs(F.col(f"{p}_a") - F.col(f"{p}_b")).alias(p) for p in properties],
    )
