"""Exact ranks and running totals without sending everything through one task.

A window without PARTITION BY, or with one hot partition, runs in a single task. Here the
order is first cut into buckets. Only the totals of the buckets (a bounded number per
group) meet in one place; rows are sorted bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_DIGITS = 3  # 16**3 buckets per group
RANGE_BUCKETS = 512


def shuffle_key(row_id: str | Column, seed: Column | int | str = 0) -> Column:
    """A fixed pseudo-random order: hexadecimal md5 of "seed:id"."""
    key = F.col(row_id) if isinstance(row_id, str) else row_id
    prefix = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(prefix.cast("string"), F.lit(":"), key.cast("string")))


def shuffled_rank(
    df: DataFrame,
    row_id: str,
    by: Sequence[str] = (),
    seed: Column | int | str = 0,
    rank: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Number the rows 1..n in the order of ``shuffle_key``, within each ``by`` group.

    Rows whose group is NULL belong to no group and are left out.
    ``total`` names an extra column with the group's row count. Both are BIGINT.
    """
    by = list(by)
    keyed = df.withColumn("_key", shuffle_key(row_id, seed)).withColumn(
        "_bucket", F.substring("_key", 1, HASH_DIGITS)
    )
    ahead = _rows_ahead(keyed, by, total)
    inside = Window.partitionBy(*by, "_bucket").orderBy("_key", row_id)
    out = keyed.join(ahead, [*by, "_bucket"]).withColumn(
        rank, F.col("_ahead") + F.row_number().over(inside)
    )
    return out.drop("_key", "_bucket", "_ahead")


def first_shuffled(
    df: DataFrame, row_id: str, n: int | Column, by: Sequence[str] = (), seed: Column | int | str = 0
) -> DataFrame:
    """The first ``n`` rows of each group in shuffled order.

    Buckets wholly beyond the n-th row are dropped before anything is sorted.
    """
    limit = n if isinstance(n, Column) else F.lit(n)
    by = list(by)
    keyed = df.withColumn("_key", shuffle_key(row_id, seed)).withColumn(
        "_bucket", F.substring("_key", 1, HASH_DIGITS)
    )
    ahead = _rows_ahead(keyed, by, None)
    inside = Window.partitionBy(*by, "_bucket").orderBy("_key", row_id)
    return (
        keyed.join(ahead, [*by, "_bucket"])
        .where(F.col("_ahead") < limit)
        .withColumn("_rank", F.col("_ahead") + F.row_number().over(inside))
        .where(F.col("_rank") <= limit)
        .drop("_key", "_bucket", "_ahead", "_rank")
    )


def _rows_ahead(keyed: DataFrame, by: list[str], total: str | None) -> DataFrame:
    counts = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    out = counts.withColumn("_ahead", F.coalesce(F.sum("_rows").over(before), F.lit(0).cast("long")))
    if total:
        out = out.withColumn(total, F.sum("_rows").over(Window.partitionBy(*by)))
    return out.drop("_rows")


def running_totals(
    df: DataFrame, order: str, measures: dict[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Sums of ``measures`` over the distinct values of ``order`` up to and including each.

    ``order`` is numeric. Returns one row per (by, order) with, for each measure m, ``m``
    (the value's own sum), ``cum_m`` and ``all_m`` (the group's sum). Rows of one value are
    added up before anything is sorted, so a hot value is a single row; the order is cut
    into ranges so a hot group is many tasks.
    """
    by = list(by)
    df = df.where(F.col(order).isNotNull())
    base = df.groupBy(*by, order).agg(*[m.alias(name) for name, m in measures.items()])
    cuts = sorted(
        set(
            df.approxQuantile(
                order, [i / RANGE_BUCKETS for i in range(1, RANGE_BUCKETS)], 1.0 / (4 * RANGE_BUCKETS)
            )
        )
    )
    edges = [-float("inf"), *cuts, float("inf")]
    base = Bucketizer(splits=edges, inputCol=order, outputCol="_bucket").transform(base)
    sums = base.groupBy(*by, "_bucket").agg(*[F.sum(name).alias(name) for name in measures])
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    for name in measures:
        sums = sums.withColumn(f"_ahead_{name}", F.coalesce(F.sum(name).over(before), F.lit(0))).withColumn(
            f"all_{name}", F.sum(name).over(whole)
        )
    sums = sums.drop(*measures)
    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = base.join(sums, [*by, "_bucket"])
    for name in measures:
        out = out.withColumn(f"cum_{name}", F.col(f"_ahead_{name}") + F.sum(name).over(inside))
    return out.drop("_bucket", *[f"_ahead_{name}" for name in measures])
