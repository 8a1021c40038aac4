"""Labels: lookup, class numbers, class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from junctura.schemas import SchemaMismatch, require_columns


def add_labels(
    table: DataFrame,
    dictionary: DataFrame,
    observation: str = "SUBJECT",
    label: str = "labels",
    table_observation: str = "SUBJECT",
    on_missing: str = "error",
    order: str | None = None,
) -> DataFrame:
    """Add ``labels`` by looking up each observation in a dictionary.

    A key listed twice takes its last entry by ``order``; without ``order`` the entries
    must agree. A missing key raises, or drops the row with ``on_missing="drop"``.
    """
    if on_missing not in ("error", "drop"):
        raise ValueError("on_missing must be 'error' or 'drop'")
    require_columns(dictionary, observation, label)
    require_columns(table, table_observation)
    keyed = dictionary.where(F.col(observation).isNotNull()).groupBy(F.col(observation).alias("_key"))
    if order:
        entries = keyed.agg(F.max_by(label, order).alias("labels"))
    else:
        entries = keyed.agg(F.max(label).alias("labels"), F.min(label).alias("_other"))
        if not entries.where(F.col("labels") != F.col("_other")).isEmpty():
            raise SchemaMismatch("an observation has several labels; name the column that orders them")
        entries = entries.drop("_other")
    joined = table.join(entries, F.col(table_observation) == F.col("_key"), "left")
    if on_missing == "drop":
        return joined.where(F.col("_key").isNotNull()).drop("_key")
    missing = joined.where(F.col("_key").isNull()).select(table_observation).distinct()
    examples = [row[0] for row in missing.limit(5).collect()]
    if examples:
        raise SchemaMismatch(f"no label for observation(s) such as {examples}")
    return joined.drop("_key")


def subject_labels(data: DataFrame, subject: str, label: str) -> DataFrame:
    """One label per subject; raises if a subject has several."""
    pairs = data.groupBy(subject).agg(F.min(label).alias(label), F.max(label).alias("_other"))
    if not pairs.where(F.col(label) != F.col("_other")).isEmpty():
        raise SchemaMismatch(f"some {subject} has more than one {label}")
    return pairs.drop("_other")


def class_numbers(df: DataFrame, label: str) -> DataFrame:
    """(label, class): label values in sorted order numbered from 0."""
    return (
        df.where(F.col(label).isNotNull())
        .select(label)
        .distinct()
        .withColumn("class", (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))
    )


def number_classes(df: DataFrame, label: str, out: str = "class") -> DataFrame:
    """Add the class number of each row's label; rows without a label get NULL."""
    return df.join(class_numbers(df, label).withColumnRenamed("class", out), label, "left")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): n / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes")).first()
    return counts.select(label, (F.lit(float(totals["rows"])) / (F.lit(totals["classes"]) * F.col("n"))).alias("weight"))


def keep_classes(df: DataFrame, label: str, values: list[str]) -> DataFrame:
    return df.where(F.col(label).isin(values))


def drop_class(df: DataFrame, label: str, value: str) -> DataFrame:
    return df.where(F.col(label) != value)
