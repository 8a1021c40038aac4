"""Scaling and principal components, fitted by Spark ML and applied in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# fixed values: the sizes compared in a sweep
PCA_SIZES = (2, 5, 10, 15, 20, 30, 50, 75, 90, 100)


@dataclass(frozen=True)
class Reduction:
    """A fitted standardise-then-PCA chain."""

    model: PipelineModel
    explained: list[float]

    def explained_table(self, spark: SparkSession) -> DataFrame:
        """(component, share, cumulative): how much of the variance each component explains, from 0."""
        so_far = accumulate(self.explained)
        return spark.createDataFrame(list(zip(range(len(self.explained)), self.explained, so_far, strict=True)), "component int, share double, cumulative double")

    def transform(self, vectors: DataFrame, dims: int | None = None, vec: str = "vec") -> DataFrame:
        """Replace ``vec`` by its components; ``dims`` keeps the leading ones only."""
        out = self.model.transform(vectors.withColumn("_raw", array_to_vector(vec)))
        reduced = vector_to_array("_reduced")
        if dims is not None:
            reduced = F.slice(reduced, 1, dims)
        return out.withColumn(vec, reduced).drop("_raw", "_scaled", "_unit", "_reduced")


def fit_pca(vectors: DataFrame, components: int = 2, vec: str = "vec") -> Reduction:
    """Standardise with the population deviation, then PCA.

    Spark's scaler divides by the sample deviation; the product step makes up for it.
    """
    rows = vectors.select(array_to_vector(vec).alias("_raw"))
    shape = vectors.agg(F.count(vec).alias("n"), F.max(F.size(vec)).alias("d")).first()
    n, d = shape["n"], shape["d"]
    if n < 2:
        raise ValueError("standardising needs at least two rows")
    stages = [
        StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="_scaled"),
        ElementwiseProduct(
            scalingVec=Vectors.dense([math.sqrt(n / (n - 1))] * d), inputCol="_scaled", outputCol="_unit"
        ),
        PCA(k=components, inputCol="_unit", outputCol="_reduced"),
    ]
    model = Pipeline(stages=stages).fit(rows)
    return Reduction(model, [float(x) for x in model.stages[-1].explainedVariance])


def reduce_dimensions(vectors: DataFrame, components: int = 2, method: str = "PCA", vec: str = "vec") -> DataFrame:
    """Reduced vectors. The only built method is PCA; other 2-D coordinates come in as input."""
    if method != "PCA":
        raise ValueError(f"unknown reduction {method!r}; supported: PCA")
    return fit_pca(vectors, components, vec).transform(vectors, vec=vec)


def pca_sweep(
    vectors: DataFrame, dims: Sequence[int] = PCA_SIZES, vec: str = "vec"
) -> DataFrame:
    """Reduced vectors for many sizes from one fit: leading components do not depend on k.

    Raises ValueError for a size beyond the width of the vectors.
    """
    width = vectors.agg(F.max(F.size(vec))).first()[0] or 0
    sizes = list(dims)
    if max(sizes) > width:
        raise ValueError(f"{max(sizes)} components of vectors with {width} values")
    reduced = fit_pca(vectors, max(sizes), vec).transform(vectors, vec=vec)
    return reduced.withColumn("dims", F.explode(F.array(*[F.lit(d) for d in sizes]))).withColumn(
        vec, F.slice(vec, F.lit(1), F.col("dims"))
    )


def standardise(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Each position to mean 0 and population deviation 1; a constant position becomes 0."""
    shape = vectors.agg(F.count(vec).alias("n"), F.max(F.size(vec)).alias("d")).first()
    if shape["n"] < 2:
        raise ValueError("standardising needs at least two rows")
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="_scaled")
    rows = vectors.withColumn("_raw", array_to_vector(vec))
    scaled = scaler.fit(rows.select("_raw")).transform(rows)
    factor = F.lit(math.sqrt(shape["n"] / (shape["n"] - 1)))
    return scaled.withColumn(vec, F.transform(vector_to_array("_scaled"), lambda x: x * factor)).drop("_raw", "_scaled")


def min_max_scale(train: DataFrame, *others: DataFrame, vec: str = "vec") -> list[DataFrame]:
    """Scale to 0..1 with the range of ``train``; further tables use the same range.

    A position that is constant in ``train`` is only shifted: it becomes 0 there.
    """
    raw = array_to_vector(vec)
    ends = train.agg(vector_to_array(Summarizer.min(raw)).alias("lo"), vector_to_array(Summarizer.max(raw)).alias("hi")).first()
    low, high = ends["lo"] or [], ends["hi"] or []
    lows = F.array(*[F.lit(float(x)) for x in low])
    widths = F.array(*[F.lit(float(y - x) or 1.0) for x, y in zip(low, high, strict=True)])
    scaled = F.zip_with(F.zip_with(vec, lows, lambda x, lo: x - lo), widths, lambda x, w: x / w)
    return [t.withColumn(vec, scaled) for t in (train, *others)]


def percent_scale(df: DataFrame, value: str, out: str = "scaled") -> DataFrame:
    """One property stretched to 0..100 over the whole table."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    low, high = ends["lo"], ends["hi"]
    return df.withColumn(out, F.try_divide((F.col(value) - F.lit(low)) * 100.0, F.lit(high) - F.lit(low)))
