"""Repeated-split evaluation, model comparison, sweeps and the experiment grid."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.functions.vectors import dense_vector
from junctura.operators.classify import NearestNeighbours, canonical_name, make_classifier, tree_depth
from junctura.operators.metrics import accuracy, binary_scores, class_report, coefficient_sums, confusion_matrix, top_coefficients
from junctura.operators.reduce import PCA_SIZES, min_max_scale, pca_sweep
from junctura.operators.ranking import shuffled_rank
from junctura.operators.sampling import split_train_test
from junctura.operators.splits import FITS, TREE_ROWS, bayes_models, bayes_said, discriminants_on_splits, fits, fitted_on_splits, held_out, logistic_models, logistic_said, neighbours_on_splits, on_all, tree_models, tree_said
from junctura.schemas import SCORES
from junctura.session import cut_lineage


# fixed values: the models compared with each other, and those compared over dimensions
MODELS = ("kNN", "LSVM", "RBF_SVM", "DT", "RF", "ADA", "NB")
DIMENSION_MODELS = (("DT", {"max_depth": None}), ("kNN", {"k": 5}))
#: Columns a matrix may have; their names are a table on the driver.
MOST_COLUMNS = 100_000
COEFFICIENTS = "split int, class int, position int, coef double"
def feature_matrix(table: DataFrame, subject: str, features: Sequence | None = None) -> tuple[DataFrame, list]:
    """Long (subject, feature, freq) as (subject, features array); absent cells are 0.

    Returns the matrix and the order of its columns. Pass ``features`` to give a second
    table the columns of the first. More features than MOST_COLUMNS raise ValueError.
    """
    if features is None:
        rows = table.where(F.col("feature").isNotNull()).select("feature").distinct().orderBy("feature").limit(MOST_COLUMNS + 1).collect()
        if len(rows) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} features")
        features = [row[0] for row in rows]
    order = table.sparkSession.createDataFrame(
        [(f, i) for i, f in enumerate(features)], f"feature {table.schema['feature'].dataType.simpleString()}, _at int"
    )
    cells = table.join(order, "feature", "left")
    some = F.col("_at").isNotNull() & F.col("freq").isNotNull()
    grouped = cells.groupBy(subject).agg(
        F.collect_list(F.when(some, F.struct("_at", "freq"))).alias("cells")
    )
    at = F.transform("cells", lambda c: c["_at"])
    value = F.transform("cells", lambda c: c["freq"])
    return grouped.select(subject, dense_vector(at, value, len(features)).alias("features")), list(features)


def labelled_matrix(matrix: DataFrame, labels: str = "labels", classes: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Number the rows (row_id) and the classes (class) of a matrix with a label column.

    Row ids follow from the key columns, one row per key, so they do not depend on how the
    table is partitioned.
    """
    if classes is None:
        classes = [r[0] for r in matrix.where(F.col(labels).isNotNull()).select(labels).distinct().orderBy(labels).collect()]
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(labels)) - 1
    keys = [c for c in matrix.columns if c not in ("features", labels, "row_id")]
    out = matrix.withColumn("class", number.cast("int")).where(F.col("class") >= 0)
    if "row_id" not in matrix.columns:
        key = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in keys])
        keyed = out.withColumn("_row_key", key)
        ids = shuffled_rank(keyed.select("_row_key"), "_row_key", rank="_rank")
        out = keyed.join(ids, "_row_key").withColumn("row_id", F.col("_rank") - 1).drop("_row_key", "_rank")
    return out, list(classes)


def leading_features(table: DataFrame, n: int) -> DataFrame:
    return table.withColumn("features", F.slice("features", 1, n))


def pick_features(table: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Keep the feature positions (from 0) in the given order."""
    return table.withColumn("features", F.array(*[F.get("features", F.lit(int(p))) for p in positions]))


@dataclass(frozen=True)
class Evaluation:
    """Predictions pooled over the splits, for the test rows and the verification rows."""

    predictions: DataFrame
    verification: DataFrame | None
    coefficients: DataFrame | None

    def confusion(self) -> DataFrame:
        return confusion_matrix(self.predictions)

    def scores(self, positive: int = 1) -> DataFrame:
        return binary_scores(self.predictions, positive)

    def report(self) -> DataFrame:
        return class_report(self.predictions)

    def verification_scores(self, positive: int = 1) -> DataFrame | None:
        return None if self.verification is None else binary_scores(self.verification, positive)


def run_classifier(
    table: DataFrame,
    model: str,
    repeats: int = 1000,
    test_share: float = 0.2,
    verify: DataFrame | None = None,
    seed: int = 0,
    **parameters,
) -> Evaluation:
    """Fit on ``repeats`` random splits of (row_id, features, class) and pool the predictions.

    The splits are drawn in one job. Naive Bayes, discriminants, nearest neighbours, logistic
    regression of two classes and, up to TREE_ROWS rows, decision trees take all splits in the same
    jobs, however many there are. The other models take a Spark ML run per split, several at a time
    over one stored table.
    """
    name = canonical_name(model)
    rows = held_out(table, repeats, test_share, seed)
    others = None if verify is None else on_all(verify, repeats)
    if name == "NB" and not parameters:
        models = bayes_models(rows, repeats)
        return Evaluation(bayes_said(rows, models), None if others is None else bayes_said(others, models), None)
    if name in ("LDA", "QDA") and not parameters:
        return Evaluation(*discriminants_on_splits(rows, others, name == "LDA"), None)
    if name == "kNN" and set(parameters) <= {"k"}:
        return Evaluation(*neighbours_on_splits(rows, others, parameters.get("k", NearestNeighbours.k), test_share), None)
    if name == "DT" and set(parameters) <= {"max_depth"} and repeats > FITS:
        depth = tree_depth(parameters.get("max_depth", 5))
        if depth > 0 and 0 < rows.count() <= TREE_ROWS:
            models = tree_models(rows, repeats, depth)
            return Evaluation(tree_said(rows, models), None if others is None else tree_said(others, models), None)
    linear = name in ("LR", "RLR")
    if linear and set(parameters) <= {"c"} and (rows.agg(F.max("class")).first()[0] or 0) <= 1:
        models = logistic_models(rows, repeats, parameters.get("c", 0.9 if name == "RLR" else 1.0))
        coefs = [(split, 0, i, float(c)) for split, row in enumerate(models) for i, c in enumerate(row[1:])]
        coefficients = table.sparkSession.createDataFrame(coefs, COEFFICIENTS)
        return Evaluation(logistic_said(rows, models), None if others is None else logistic_said(others, models), coefficients)
    tested, checked, coefs = fitted_on_splits(rows, others, make_classifier(model, **parameters), repeats, linear)
    return Evaluation(tested, checked, table.sparkSession.createDataFrame(coefs, COEFFICIENTS) if linear else None)


def _pairs(predicted: DataFrame, split: int) -> DataFrame:
    return predicted.select(F.lit(split).alias("split"), "row_id", F.col("class").alias("actual"), "predicted")


def two_stage_regression(
    table: DataFrame,
    repeats: int = 1000,
    test_share: float = 0.2,
    top: int = 20,
    c: float = 0.9,
    verify: DataFrame | None = None,
    seed: int = 0,
) -> tuple[list[int], Evaluation]:
    """Logistic regression on all features, then again on those with the largest summed coefficients.

    Two classes have one row of coefficients. Of more classes, whose rows add up to nothing at
    each position, the first class's row ranks the features.
    """
    first = run_classifier(table, "RLR", repeats, test_share, seed=seed, c=c)
    best = top_coefficients(coefficient_sums(first.coefficients.where(F.col("class") == 0)), top).collect()
    positions = [row["position"] for row in best]
    second = run_classifier(
        pick_features(table, positions),
        "RLR",
        repeats,
        test_share,
        None if verify is None else pick_features(verify, positions),
        seed,
        c=c,
    )
    return positions, second


def compare_models(
    table: DataFrame,
    models: Sequence[str | tuple[str, dict]] = MODELS,
    test_share: float = 0.25,
    seed: int = 0,
    scale: bool = True,
    roles: Sequence[str] = ("train", "test"),
) -> DataFrame:
    """(model, role, actual, predicted, row_id): several models on one min-max scaled split.

    A model is a name, or a name and its parameters; ``roles`` are those whose rows are predicted.
    """
    split = cut_lineage(split_train_test(table.select("row_id", "features", "class"), test_share, seed=seed))
    train, test = (split.where(F.col("role") == r).drop("role") for r in ("train", "test"))
    if scale:
        train, test = min_max_scale(train, test, vec="features")
    out = None
    for model in models:
        name, parameters = (model, {}) if isinstance(model, str) else model
        fitted = make_classifier(name, **parameters).fit(train)
        for role in roles:
            part = fitted.transform({"train": train, "test": test}[role]).select(
                F.lit(name).alias("model"), F.lit(role).alias("role"), "row_id", F.col("class").alias("actual"), "predicted"
            )
            out = part if out is None else out.unionByName(part)
    return out


def accuracy_by_dimension(
    vectors: DataFrame,
    dims: Sequence[int] = PCA_SIZES,
    models: Sequence[str | tuple[str, dict]] = DIMENSION_MODELS,
    test_share: float = 0.25,
    seed: int = 0,
) -> DataFrame:
    """(dims, model, accuracy) on PCA-reduced (row_id, vec, class); one PCA serves all sizes.

    The tree has no depth limit of its own, five neighbours vote. Several sizes run at a time.
    """
    swept = cut_lineage(pca_sweep(vectors, dims))

    def scored(size: int) -> DataFrame:
        table = swept.where(F.col("dims") == size).select("row_id", F.col("vec").alias("features"), "class")
        said = compare_models(table, models, test_share, seed, roles=("test",))
        return cut_lineage(accuracy(said, ["model"]).select(F.lit(size).alias("dims"), "model", "accuracy"))

    return reduce(DataFrame.unionByName, fits(vectors.sparkSession, sorted(set(dims)), scored))


def leading_feature_sweep(
    table: DataFrame, sizes: Iterable[int], models: Sequence[str] = ("LR", "DT"), repeats: int = 1, seed: int = 0
) -> DataFrame:
    """(features, model, accuracy) using the first 1..n features for each n.

    All sizes share their splits. Decision trees and logistic regression of two classes take all
    sizes in the same jobs, each a split that looks at its leading columns only; of the other
    models several sizes run at a time.
    """
    table, sizes = cut_lineage(table.select("row_id", "features", "class")), list(sizes)
    n, top = table.agg(F.count("*"), F.max("class")).first()

    def together(name: str) -> bool:
        return n > 0 and (canonical_name(name) == "DT" or (canonical_name(name) in ("LR", "RLR") and top <= 1))

    def scored(task: tuple[int, str]) -> DataFrame:
        size, name = task
        said = run_classifier(leading_features(table, size), name, repeats, seed=seed).predictions
        return cut_lineage(accuracy(said).select(F.lit(size).alias("features"), F.lit(name).alias("model"), "accuracy"))

    out = []
    if sizes and any(together(name) for name in models):
        spread = F.transform(F.sequence(F.lit(0), F.lit(len(sizes) - 1)), lambda i: F.transform("tests", lambda t: i * repeats + t))
        rows = cut_lineage(held_out(table, repeats, 0.2, seed).withColumn("tests", F.flatten(spread)))
        columns, count = np.repeat(sizes, repeats), len(sizes) * repeats
        size = F.element_at(F.array(*[F.lit(s) for s in sizes]), F.floor(F.col("split") / repeats).cast("int") + 1)
        for name in filter(together, models):
            if canonical_name(name) == "DT":
                said = tree_said(rows, tree_models(rows, count, tree_depth(5), columns))
            else:
                said = logistic_said(rows, logistic_models(rows, count, 0.9 if canonical_name(name) == "RLR" else 1.0, columns))
            said = accuracy(said.withColumn("features", size), ["features"])
            out.append(cut_lineage(said.select("features", F.lit(name).alias("model"), "accuracy")))
    out += fits(table.sparkSession, [(size, name) for size in sizes for name in models if not together(name)], scored)
    return reduce(DataFrame.unionByName, out)


def fold_evaluation(table: DataFrame, folds: DataFrame, subject: str, model: str, n_folds: int, **parameters) -> DataFrame:
    """Predictions when each subject fold is tested on a model of the other folds."""
    rows = cut_lineage(table.join(folds, subject))
    estimator = make_classifier(model, **parameters)
    out = None
    for number in range(n_folds):
        fitted = estimator.fit(rows.where(F.col("fold") != number).select("row_id", "features", "class"))
        part = _pairs(fitted.transform(rows.where(F.col("fold") == number).select("row_id", "features", "class")), number)
        out = part if out is None else out.unionByName(part)
    return out


def score_row(spark, **values) -> DataFrame:
    """One row of the scores table."""
    return spark.createDataFrame([tuple(values.get(f.name) for f in SCORES.fields)], SCORES)
