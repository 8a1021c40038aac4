"""Classifiers under their usual names and aliases.

Every estimator has ``fit(train) -> model`` and ``model.transform(df)``; tables have
``features`` (array<double>) and ``class`` (0, 1, ...), and ``transform`` adds
``predicted`` (int). Spark ML does the work where it has the model.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.functions.vectors import rough_squared_distances, stack
from junctura.operators.labels import balanced_weights
from junctura.operators.neighbors import knn_join
from junctura.session import cut_lineage


@dataclass
class SparkModel:
    model: object
    predicted: str = "_prediction"

    def transform(self, df: DataFrame) -> DataFrame:
        rows = df.withColumn("_v", array_to_vector("features"))
        out = self.model.transform(rows)
        return out.select(*df.columns, F.col(self.predicted).cast("int").alias("predicted"))

    @property
    def coefficients(self) -> np.ndarray:
        """Rows of coefficients: one for two classes, else one per class."""
        return self.model.coefficientMatrix.toArray()


@dataclass
class SparkEstimator:
    """A Spark ML classifier built for the shape of its training table."""

    build: Callable[[int, int, int], object]  # rows, features, classes
    weighted: bool = False

    def fit(self, train: DataFrame) -> SparkModel:
        rows, features, classes = _shape(train)
        data = train.select(array_to_vector("features").alias("_v"), F.col("class").cast("double").alias("_y"), "class")
        estimator = self.build(rows, features, classes)
        if self.weighted and classes > 2:
            data = data.join(F.broadcast(balanced_weights(data, "class")), "class")  # one row per class
            estimator = estimator.setWeightCol("weight")
        return SparkModel(estimator.fit(data.drop("class")))


def _shape(train: DataFrame) -> tuple[int, int, int]:
    shape = train.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d"), F.max("class").alias("c")).first()
    return shape["n"], shape["d"] or 0, int(shape["c"] or 0) + 1


#: The depth of the deepest tree Spark grows.
DEEPEST = 30
COLUMNS = {"featuresCol": "_v", "labelCol": "_y", "predictionCol": "_prediction"}


def logistic_regression(c: float = 1.0) -> SparkEstimator:
    """L2 with strength 1/(C n); for more than two classes multinomial with balanced weights."""

    def build(rows: int, features: int, classes: int):
        family = "binomial" if classes <= 2 else "multinomial"
        return LogisticRegression(
            family=family, regParam=1.0 / (c * max(rows, 1)), elasticNetParam=0.0, standardization=False, maxIter=100, **COLUMNS
        )

    return SparkEstimator(build, weighted=True)


def tree_depth(max_depth: int | None) -> int:
    """The depth as Spark takes it. None stands for no limit of one's own: Spark's own is DEEPEST."""
    if max_depth is None:
        return DEEPEST
    if max_depth > DEEPEST:
        raise ValueError(f"a tree of depth {max_depth}; at most {DEEPEST}, or None for as deep as can be")
    return max_depth


def decision_tree(max_depth: int | None = 5) -> object:
    """A tree without a limit of its own has about as many nodes as rows, too many for Spark ML's passes."""
    if max_depth is None:
        from junctura.operators.trees import DeepTree  # built on the splits, which are built on this module

        return DeepTree(tree_depth(None))
    return SparkEstimator(lambda n, d, k: DecisionTreeClassifier(maxDepth=tree_depth(max_depth), seed=0, **COLUMNS))


def random_forest(trees: int = 10, max_depth: int = 5, subset: str = "1") -> SparkEstimator:
    return SparkEstimator(
        lambda n, d, k: RandomForestClassifier(
            numTrees=trees, maxDepth=max_depth, featureSubsetStrategy=subset, seed=0, **COLUMNS
        )
    )


def linear_svm(c: float = 0.025, iterations: int = 1000) -> SparkEstimator:
    """For more than two classes one model per class against the rest, the highest margin winning."""

    def build(rows: int, features: int, classes: int):
        one = LinearSVC(regParam=1.0 / (c * max(rows, 1)), standardization=False, maxIter=iterations, **COLUMNS)
        return one if classes <= 2 else OneVsRest(classifier=one, parallelism=4, **COLUMNS)

    return SparkEstimator(build)


def neural_net(hidden: int = 100, iterations: int = 1000) -> SparkEstimator:
    """One hidden layer. Spark's network has no L2 term."""
    return SparkEstimator(
        lambda n, d, k: MultilayerPerceptronClassifier(layers=[d, hidden, max(k, 2)], maxIter=iterations, seed=0, **COLUMNS)
    )


def naive_bayes() -> SparkEstimator:
    return SparkEstimator(lambda n, d, k: NaiveBayes(modelType="gaussian", **COLUMNS))


@dataclass
class RegressionTree:
    """A regression tree on 0/1 classes, its output rounded to a class."""

    max_depth: int | None = None

    def fit(self, train: DataFrame) -> RegressionTreeModel:
        data = train.select(array_to_vector("features").alias("_v"), F.col("class").cast("double").alias("_y"))
        return RegressionTreeModel(DecisionTreeRegressor(maxDepth=tree_depth(self.max_depth), seed=0, **COLUMNS).fit(data))


@dataclass
class RegressionTreeModel:
    model: object

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df.withColumn("_v", array_to_vector("features")))
        return out.select(*df.columns, F.round("_prediction").cast("int").alias("predicted"))


@dataclass
class NearestNeighbours:
    """Majority of the k nearest training rows; a tie goes to the smallest class."""

    k: int = 3

    def fit(self, train: DataFrame) -> NearestNeighboursModel:
        return NearestNeighboursModel(train.select("row_id", "features", "class"), self.k)


@dataclass
class NearestNeighboursModel:
    train: DataFrame
    k: int

    def transform(self, df: DataFrame) -> DataFrame:
        near = knn_join(df.select("row_id", "features"), self.train.select("row_id", "features"), self.k, vec="features")
        classes = self.train.select(F.col("row_id").alias("neighbor"), F.col("class").alias("_class"))
        return df.join(majority_vote(near.join(classes, "neighbor"), "_class"), "row_id")


def majority_vote(votes: DataFrame, value: str) -> DataFrame:
    """(row_id, predicted): the most frequent value of each row, ties to the smallest."""
    counts = votes.groupBy("row_id", value).agg(F.count("*").alias("n"))
    return counts.groupBy("row_id").agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).cast("int").alias("predicted"))


@dataclass
class Discriminant:
    """Gaussian classes with full covariance: one per class (QDA) or one pooled (LDA).

    Covariances come from sums of outer products that each task adds up for itself, so
    only (classes x features squared) numbers per task are shuffled.
    """

    pooled: bool = False
    ridge: float = 1e-9

    def fit(self, train: DataFrame) -> DiscriminantModel:
        classes, counts, means, scatter = class_moments(train)
        return DiscriminantModel(classes, *discriminant_rule(counts, scatter, self.pooled, self.ridge), means)


def discriminant_rule(counts: np.ndarray, scatter: np.ndarray, pooled: bool, ridge: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(constant, precision) of each class from its row count and centred scatter matrix."""
    d = scatter.shape[1]
    if pooled:
        shared = scatter.sum(axis=0) / max(counts.sum() - len(counts), 1)
        covariance = np.broadcast_to(shared, scatter.shape)
    else:
        covariance = scatter / np.maximum(counts - 1, 1)[:, None, None]
    scale = np.trace(covariance, axis1=1, axis2=2) / d
    covariance = covariance + (ridge * np.maximum(scale, 1e-300))[:, None, None] * np.eye(d)
    logdet = np.array([np.linalg.slogdet(c)[1] for c in covariance])
    # a class with fewer rows than features has no full covariance: use the pseudo-inverse
    precision = np.array([np.linalg.pinv(c, hermitian=True) for c in covariance])
    return np.log(counts / counts.sum()) - 0.5 * logdet, precision


#: The driver holds a matrix of moments per class, of at most so many bytes together.
MOMENT_BYTES = 512 * 1024 * 1024


def total_moments(train: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, the overall mean, and per class [rows, sums, sums of outer products] of the rows less that mean.

    More than MOMENT_BYTES of them raise ValueError.
    """
    mean = train.agg(vector_to_array(Summarizer.mean(array_to_vector("features"))).alias("m")).first()["m"]
    shift = np.array(mean)
    d = len(shift)
    kinds = train.select("class").distinct().count()
    if 8 * kinds * d * d > MOMENT_BYTES:
        raise ValueError(f"{kinds} classes of {d} features: more than {MOMENT_BYTES} bytes of moments")

    def moments(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for label, part in batch.groupby("class"):
                x = stack(part["features"]) - shift
                n, s, o = sums.get(label, (0, np.zeros(d), np.zeros((d, d))))
                sums[label] = (n + len(x), s + x.sum(axis=0), o + x.T @ x)
        rows = [(int(label), np.concatenate([[n], s, o.ravel()])) for label, (n, s, o) in sums.items()]
        if rows:
            yield pd.DataFrame(rows, columns=["class", "sums"])

    partial = train.select("class", "features").mapInPandas(moments, "class int, sums array<double>")
    rows = (
        partial.groupBy("class")
        .agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
        .orderBy("class")
        .collect()
    )
    return np.array([r["class"] for r in rows]), shift, np.array([r["sums"] for r in rows])


def class_moments(train: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes, row counts, means and centred scatter matrices; rows are first shifted by the overall mean."""
    classes, shift, sums = total_moments(train)
    d = len(shift)
    counts, totals = sums[:, 0], sums[:, 1 : 1 + d]
    means = totals / counts[:, None]
    scatter = sums[:, 1 + d :].reshape(len(classes), d, d) - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    return classes, counts, means + shift, scatter


@dataclass
class DiscriminantModel:
    classes: np.ndarray
    constant: np.ndarray
    precision: np.ndarray
    means: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.classes, self.constant, self.means, self.precision))

        @F.pandas_udf("int")
        def best(features: pd.Series) -> pd.Series:
            classes, constant, means, precision = shared.value
            x = stack(features)
            score = np.stack(
                [c - 0.5 * np.einsum("ij,jk,ik->i", x - m, p, x - m) for c, m, p in zip(constant, means, precision)], axis=1
            )
            return pd.Series(classes[score.argmax(axis=1)].astype(np.int32))

        return df.withColumn("predicted", best("features"))


@dataclass
class AdaBoost:
    """SAMME boosting of depth-1 trees; sample weights live in the training table."""

    rounds: int = 50
    depth: int = 1
    cut_every: int = 10

    def fit(self, train: DataFrame) -> AdaBoostModel:
        rows, _, classes = _shape(train)
        data = cut_lineage(
            train.select(
                array_to_vector("features").alias("_v"),
                F.col("class").cast("double").alias("_y"),
                F.lit(1.0 / max(rows, 1)).alias("_w"),
            )
        )
        stumps, alphas = [], []
        for number in range(self.rounds):
            stump = DecisionTreeClassifier(maxDepth=self.depth, weightCol="_w", seed=number, **COLUMNS).fit(data)
            missed = F.col("_prediction") != F.col("_y")
            scored = stump.transform(data)
            sums = scored.agg(F.sum("_w").alias("w"), F.sum(F.when(missed, F.col("_w")).otherwise(0.0)).alias("e")).first()
            error = sums["e"] / sums["w"]
            if error >= 1 - 1 / classes:
                break
            alpha = math.log((1 - error) / error) + math.log(classes - 1) if error > 0 else 1.0
            stumps.append(stump)
            alphas.append(alpha)
            if error <= 0:
                break
            grown = F.col("_w") * F.when(missed, F.lit(math.exp(alpha))).otherwise(F.lit(1.0))
            data = scored.select("_v", "_y", (grown / F.lit(sums["w"])).alias("_w"))
            if (number + 1) % self.cut_every == 0:
                data = cut_lineage(data)
        return AdaBoostModel(stumps, alphas, classes)


@dataclass
class AdaBoostModel:
    stumps: list
    alphas: list[float]
    classes: int

    def transform(self, df: DataFrame) -> DataFrame:
        rows = df.withColumn("_v", array_to_vector("features")).withColumn(
            "_votes", F.array(*[F.lit(0.0)] * self.classes)
        )
        for stump, alpha in zip(self.stumps, self.alphas):
            rows = stump.transform(rows)
            said = F.col("_prediction").cast("int")
            rows = rows.withColumn(
                "_votes", F.transform("_votes", lambda v, i: F.when(i == said, v + F.lit(alpha)).otherwise(v))
            ).drop("rawPrediction", "probability", "_prediction")
        best = F.array_position("_votes", F.array_max("_votes")) - 1
        return rows.withColumn("predicted", best.cast("int")).select(*df.columns, "predicted")


#: Rows on whose pairs the error of an approximated kernel is measured, the first by a hash of their id.
KERNEL_ROWS = 256
MOST_FEATURES = 1 << 14
#: Mapped features that a task holds and sends at once.
LIFTED_BYTES = 8 * 1024 * 1024


@dataclass
class RandomFourierSVM:
    """RBF-kernel SVM, approximated: random Fourier features, then a linear SVM.

    The features are cosines and sines of projections on random directions that are orthogonal
    in blocks. Their number starts at ``components`` and is doubled until the kernel's mean error
    on all pairs of a sample of KERNEL_ROWS rows is at most ``max_error``; more than
    MOST_FEATURES raise ValueError.
    """

    gamma: float = 2.0
    c: float = 1.0
    components: int = 200
    seed: int = 0
    max_error: float = 0.03
    _linear: SparkEstimator = field(init=False)

    def __post_init__(self) -> None:
        self._linear = linear_svm(self.c)

    def directions(self, d: int, components: int) -> np.ndarray:
        """(d, components / 2): orthogonal in blocks of d, each as long as a random normal vector."""
        rng = np.random.default_rng(self.seed)
        blocks = [np.linalg.qr(rng.normal(size=(d, d)))[0] * np.sqrt(rng.chisquare(d, size=d)) for _ in range(-(-components // (2 * d)))]
        return np.concatenate(blocks, axis=1)[:, : components // 2] * math.sqrt(2 * self.gamma)

    def mapped(self, x: np.ndarray, directions: np.ndarray) -> np.ndarray:
        turn = x @ directions
        return np.concatenate([np.cos(turn), np.sin(turn)], axis=1) / math.sqrt(directions.shape[1])

    def kernel_error(self, sample: np.ndarray, components: int) -> float:
        """The mean absolute error of the kernel over all pairs of different rows of ``sample``."""
        z = self.mapped(sample, self.directions(sample.shape[1], components))
        squared = rough_squared_distances(sample, sample)[0]
        off = np.abs(z @ z.T - np.exp(-self.gamma * squared))
        np.fill_diagonal(off, 0)
        return float(off.sum() / max(len(sample) * (len(sample) - 1), 1))

    def chosen(self, train: DataFrame) -> tuple[int, float, int]:
        """(components, error, rows of the sample)."""
        rows = train.orderBy(F.xxhash64("row_id"), "row_id").limit(KERNEL_ROWS).select("features").collect()
        sample = np.array([r["features"] for r in rows], dtype=np.float64)
        components = self.components + self.components % 2
        while len(sample) and (error := self.kernel_error(sample, components)) > self.max_error:
            components *= 2
            if components > MOST_FEATURES:
                raise ValueError(f"the kernel's error is {error:.3f} with {components // 2} features")
        return components, error if len(sample) else 0.0, len(sample)

    def lift(self, df: DataFrame, d: int, components: int) -> DataFrame:
        """``df`` with the features mapped, LIFTED_BYTES of them at a time."""
        directions = self.directions(d, components)
        low = max(1, LIFTED_BYTES // (8 * components))

        def waves(batches):
            for batch in batches:
                for at in range(0, len(batch), low):
                    part = batch.iloc[at : at + low]
                    yield part.assign(features=list(self.mapped(stack(part["features"]), directions)))

        wide = [F.col(c).cast("array<double>").alias(c) if c == "features" else F.col(c) for c in df.columns]
        rows = df.select(*wide)
        return rows.mapInPandas(waves, rows.schema)

    def fit(self, train: DataFrame) -> RandomFourierModel:
        d, components = _shape(train)[1], self.chosen(train)[0]
        return RandomFourierModel(self, d, components, self._linear.fit(cut_lineage(self.lift(train, d, components))))


@dataclass
class RandomFourierModel:
    kernel: RandomFourierSVM
    d: int
    components: int
    model: SparkModel

    def transform(self, df: DataFrame) -> DataFrame:
        raw = df.withColumn("_features", F.col("features"))
        out = self.model.transform(self.kernel.lift(raw, self.d, self.components))
        return out.withColumn("features", F.col("_features")).drop("_features")


# Accepted names of each classifier.
ALIASES = {
    "LR": ("logistic_regression", "LR"),
    "RLR": ("regulized_logistic_regression", "RLR"),
    "DT": ("decision_tree", "DT"),
    "kNN": ("kNN", "k-NN", "knn"),
    "LSVM": ("linear_svm", "LSVM"),
    "RBF_SVM": ("rbf_svm", "RBF_SVM"),
    "RF": ("RF", "Random_forest", "Random_Forest", "random_forest"),
    "MLP": ("MLP", "Neural_net"),
    "ADA": ("ADA", "Ada", "Adaboost", "Ada_boost"),
    "NB": ("NB", "naive_bayes", "Naive_Bayes", "Naive_bayes"),
    "QDA": ("QDA", "qda"),
    "LDA": ("LDA", "lda"),
    "RT": ("regression_tree", "RT"),
}

FACTORIES: dict[str, Callable[..., object]] = {
    "LR": logistic_regression,
    "RLR": lambda c=0.9: logistic_regression(c),
    "DT": decision_tree,
    "kNN": NearestNeighbours,
    "LSVM": linear_svm,
    "RBF_SVM": RandomFourierSVM,
    "RF": random_forest,
    "MLP": neural_net,
    "ADA": AdaBoost,
    "NB": naive_bayes,
    "QDA": Discriminant,
    "LDA": lambda **kw: Discriminant(pooled=True, **kw),
    "RT": RegressionTree,
}


def canonical_name(name: str) -> str:
    for key, names in ALIASES.items():
        if name in names:
            return key
    raise ValueError(f"unknown classifier {name!r}; known: {sorted(n for names in ALIASES.values() for n in names)}")


def make_classifier(name: str, **parameters):
    """The estimator of a name or alias, with its default parameters."""
    return FACTORIES[canonical_name(name)](**parameters)
