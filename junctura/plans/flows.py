"""The three flows: reads to vectors, k-means features, proximity features."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.operators.cluster import cluster_feature_table, recursive_kmeans
from junctura.operators.corpus import build_corpus
from junctura.operators.embedding import embedding_table, mean_vectors, sequence_vectors, train_embedding
from junctura.operators.evaluate import Evaluation, feature_matrix, labelled_matrix, run_classifier
from junctura.operators.labels import add_labels
from junctura.operators.metrics import accuracy
from junctura.operators.neighborhoods import (
    candidates,
    feature_list,
    label_share,
    radius_feature_table,
    select_non_overlapping,
)
from junctura.operators.neighbors import fold_lists, knn_folds, knn_self
from junctura.operators.reads import preprocess_reads, unique_reads
from junctura.operators.reduce import fit_pca
from junctura.operators.sampling import subject_folds
from junctura.schemas import SCORES
from junctura.session import cut_lineage


def reads_to_vectors(
    reads: DataFrame,
    n: int = 3,
    frame: int | None = None,
    trim: tuple[int, int] | None = None,
    min_rows: int = 3000,
    unique: bool = True,
    **training,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Filter, translate, (collapse,) train and embed: (reads, embedding, vectors)."""
    clean = preprocess_reads(reads, trim, min_rows)
    if unique:
        clean = unique_reads(clean)
    clean = cut_lineage(clean)
    model = train_embedding(build_corpus(clean, n, frame, text="JUNC_AA"), **training)
    embedding = embedding_table(model)
    return clean, embedding, sequence_vectors(clean, embedding, n, frame or 1)


def kmeans_flow(
    vectors: DataFrame,
    data: DataFrame,
    dictionary: DataFrame,
    subject: str = "SUBJECT",
    dims: int | None = 50,
    n: int = 20,
    depth: int = 2,
    threshold: float = 100.0,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Reduce, cluster, count, label: (feature table, labelled matrix, classes)."""
    rows = vectors.select("row_id", "vec")
    if dims:
        rows = fit_pca(rows, dims).transform(rows)
    clustered = recursive_kmeans(rows, n, depth, seed)
    table = cut_lineage(cluster_feature_table(clustered, data, subject, threshold))
    matrix, _ = feature_matrix(table, subject)
    labelled = add_labels(matrix, dictionary, "observation", "label", subject)
    numbered, classes = labelled_matrix(labelled)
    return table, cut_lineage(numbered), classes


@dataclass(frozen=True)
class Proximity:
    """What the proximity flow learns from its training rows."""

    neighbours: DataFrame
    shares: DataFrame
    selected: DataFrame
    features: DataFrame


def fit_proximity(
    vectors: DataFrame,
    data: DataFrame,
    label_value: str,
    k: int = 100,
    min_significance: float = 0.6,
    min_subjects: int = 10,
    subject: str = "FILENAME",
    label: str = "labels",
    neighbours: DataFrame | None = None,
) -> Proximity:
    """Neighbours (``knn_self`` unless given), label shares, greedy selection and the feature list."""
    neighbours = cut_lineage(knn_self(vectors, k) if neighbours is None else neighbours)
    shares = cut_lineage(label_share(neighbours, data, label_value, subject, label))
    selected = select_non_overlapping(candidates(shares, min_significance, min_subjects), neighbours)
    return Proximity(neighbours, shares, selected, cut_lineage(feature_list(selected, neighbours, vectors)))


def proximity_flow(vectors: DataFrame, data: DataFrame, label_value: str, subject: str = "FILENAME", **settings) -> DataFrame:
    """Feature table of the rows the features were learned from."""
    fitted = fit_proximity(vectors, data, label_value, subject=subject, **settings)
    return radius_feature_table(vectors, data, fitted.features, subject)


def proximity_folds(
    vectors: DataFrame,
    data: DataFrame,
    label_value: str,
    folds: int = 5,
    subject: str = "FILENAME",
    seed: int = 0,
    k: int = 100,
    **settings,
) -> DataFrame:
    """Feature tables of train and test subjects of every fold, features learned on train only.

    The neighbours within the training rows of all folds come from one search, as do the rows within a
    feature's radius wherever no row's key stands twice.
    """
    fold_of = cut_lineage(subject_folds(data, subject, folds, seed))
    numbered = data.join(fold_of, subject).select("row_id", "fold")
    lists = fold_lists(vectors, numbered, k, folds)
    twice = not vectors.groupBy("row_id").count().where("count > 1").isEmpty() or not numbered.groupBy("row_id").count().where("count > 1").isEmpty()
    out = None
    for number, neighbours in enumerate(knn_folds(vectors, numbered, k, folds, lists)):
        roles = fold_of.select(subject, F.when(F.col("fold") == number, "test").otherwise("train").alias("role"))
        placed = cut_lineage(data.join(roles, subject))
        train = placed.where(F.col("role") == "train")
        fitted = fit_proximity(vectors.join(train, "row_id", "left_semi"), train, label_value, k, subject=subject, neighbours=neighbours, **settings)
        # one pass over all vectors: a subject's counts are its own, and its fold tells its role
        rows = vectors.join(placed, "row_id", "left_semi")
        table = radius_feature_table(rows, placed, fitted.features, subject, None if twice else lists)
        part = table.join(roles, subject).select(F.lit(number).alias("fold"), "role", *table.columns)
        out = part if out is None else out.unionByName(part)
    return out


def classify_mean_vectors(
    vectors: DataFrame,
    data: DataFrame,
    dictionary: DataFrame,
    model: str,
    subject: str = "SUBJECT",
    columns: tuple[int, int] | None = None,
    **run,
) -> Evaluation:
    """Classify subjects by their mean vectors, without clustering."""
    means = mean_vectors(vectors, data, subject).withColumnRenamed("vec", "features")
    if columns:
        means = means.withColumn("features", F.slice("features", columns[0], columns[1] - columns[0] + 1))
    numbered, _ = labelled_matrix(add_labels(means, dictionary, "observation", "label", subject))
    return run_classifier(cut_lineage(numbered), model, **run)


def experiment_grid(
    vectors: DataFrame,
    data: DataFrame,
    dictionary: DataFrame,
    subject: str = "SUBJECT",
    dims: Iterable[int | None] = (2, 50),
    clusters: Iterable[int] = (20,),
    classifiers: Sequence[str] = ("LR", "DT"),
    depth: int = 2,
    threshold: float = 100.0,
    repeats: int = 1000,
    source: str = "",
    model_name: str = "",
    seed: int = 0,
) -> DataFrame:
    """One score per (dimensions, clusters, classifier). Reduction and clustering are reused."""
    spark = vectors.sparkSession
    sizes = list(dims)
    largest = max((d for d in sizes if d), default=None)
    base = vectors.select("row_id", "vec")
    reduced = cut_lineage(fit_pca(base, largest).transform(base)) if largest else base
    out = None
    for size in sizes:
        rows = base if size is None else reduced.withColumn("vec", F.slice("vec", 1, size))
        for n in clusters:
            table, numbered, classes = kmeans_flow(rows, data, dictionary, subject, None, n, depth, threshold, seed)
            features = table.select("feature").where(F.col("feature").isNotNull()).distinct().count()
            for name in classifiers:
                said = run_classifier(numbered, name, repeats, seed=seed).predictions
                known = {
                    "Inputfile": F.lit(source),
                    "model_name": F.lit(model_name),
                    "dimension_reduction_method": F.lit("PCA" if size else "none"),
                    "number_of_dimensions": F.lit(size),
                    "clustering_method": F.lit("kmeans"),
                    "number_of_clusters": F.lit(features),
                    "diversity_TH": F.lit(float(threshold)),
                    "classification_method": F.lit(name),
                    "score": F.col("accuracy"),
                }
                row = accuracy(said).select(*[known[f.name].cast(f.dataType).alias(f.name) for f in SCORES.fields])
                out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame([], SCORES)
