"""Evaluation of predictions pooled over all splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion_matrix(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(actual, predicted, n, share): counts, and their share of the actual class."""
    counts = predictions.groupBy(*by, "actual", "predicted").agg(F.count("*").alias("n"))
    row = Window.partitionBy(*by, "actual")  # classes, not rows
    return counts.withColumn("share", F.col("n") / F.sum("n").over(row))


def accuracy(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    hit = F.when(F.col("actual") == F.col("predicted"), 1.0).otherwise(0.0)
    return predictions.groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))


def _rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(tp.cast("double"), tp + fp), zero)
    recall = F.coalesce(F.try_divide(tp.cast("double"), tp + fn), zero)
    f1 = F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), zero)
    return precision, recall, f1


def binary_scores(predictions: DataFrame, positive: object, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, f1, precision and recall of the positive class; 0 where undefined."""
    is_true, is_said = F.col("actual") == F.lit(positive), F.col("predicted") == F.lit(positive)
    counts = predictions.groupBy(*by).agg(
        F.count_if(is_true & is_said).alias("tp"),
        F.count_if(~is_true & is_said).alias("fp"),
        F.count_if(is_true & ~is_said).alias("fn"),
        F.avg(F.when(F.col("actual") == F.col("predicted"), 1.0).otherwise(0.0)).alias("accuracy"),
    )
    precision, recall, f1 = _rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(*by, "accuracy", f1.alias("f1"), precision.alias("precision"), recall.alias("recall"))


def class_report(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class precision, recall, f1 and support; class ``macro avg`` is their plain mean."""
    cells = predictions.groupBy(*by, "actual", "predicted").agg(F.count("*").alias("n"))
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    truth = cells.select(*by, F.col("actual").cast("string").alias("class"), F.col("n").alias("t"), hit.alias("h"), zero.alias("p"))
    said = cells.select(*by, F.col("predicted").cast("string").alias("class"), zero.alias("t"), zero.alias("h"), F.col("n").alias("p"))
    sums = truth.unionByName(said).groupBy(*by, "class").agg(
        F.sum("h").alias("h"), F.sum("t").alias("support"), F.sum("p").alias("p")
    )
    precision, recall, f1 = _rates(F.col("h"), F.col("p") - F.col("h"), F.col("support") - F.col("h"))
    report = sums.select(
        *by, "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support"
    )
    means = report.groupBy(*by).agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support")
    )
    return report.unionByName(means.select(*by, F.lit("macro avg").alias("class"), "precision", "recall", "f1", "support"))


#: Columns a pivot may have.
MOST_METRICS = 1000


def coefficient_sums(coefficients: DataFrame) -> DataFrame:
    """Coefficients (split, position, coef) added up over the splits."""
    return coefficients.groupBy("position").agg(F.sum("coef").alias("coef"))


def top_coefficients(summed: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` positions with the largest absolute coefficient; ties to the lower position."""
    return summed.orderBy(F.abs("coef").desc(), "position").limit(n)


def score_pivot(scores: DataFrame, method: str, metric: str, value: str, metrics: Sequence[str] | None = None) -> DataFrame:
    """Methods by metrics, mean value in each cell.

    Without a list, the columns are the metrics that occur; more than MOST_METRICS raise ValueError.
    """
    if metrics is None:
        found = scores.where(F.col(metric).isNotNull()).select(metric).distinct().orderBy(metric).limit(MOST_METRICS + 1).collect()
        if len(found) > MOST_METRICS:
            raise ValueError(f"more than {MOST_METRICS} different values of {metric!r}")
        metrics = [r[0] for r in found]
    return scores.groupBy(method).pivot(metric, list(metrics)).agg(F.avg(value))
