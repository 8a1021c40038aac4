import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.operators import cluster as C
from junctura.operators import composition as P
from junctura.operators import reduce as R
from junctura.operators import spatial as S
from junctura.operators.neighborhoods import subject_frequencies
from junctura.sources.writers import wide_feature_table


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_id long, vec array<double>")


@pytest.fixture(scope="module")
def counts(spark):
    data = spark.createDataFrame([("A",), ("B",), ("C",)], "subject string")
    cells = spark.createDataFrame([("A", 1, 3), ("A", 2, 1), ("B", 1, 1)], "subject string, feature int, n long")
    return subject_frequencies(cells, data, "subject")


def test_frequencies_and_empty_subject(counts):
    got = {(r.subject, r.feature): r.freq for r in counts.collect()}
    assert got == {("A", 1): 0.75, ("A", 2): 0.25, ("B", 1): 1.0, ("C", None): None}


def test_diversity_is_strict(counts):
    top = {r.feature: r.top_percent for r in C.diversity_share(counts).collect()}
    assert math.isclose(top[1], 57.142857, abs_tol=1e-6) and top[2] == 100.0
    assert {r.feature for r in C.diversity_filter(counts, 98).collect()} == {1, None}
    assert {r.feature for r in C.diversity_filter(counts, 100).collect()} == {1, 2, None}


def test_wide_table(counts):
    rows = {r.subject: (r["1"], r["2"]) for r in wide_feature_table(counts, "subject").collect()}
    assert rows == {"A": (0.75, 0.25), "B": (1.0, 0.0), "C": (None, None)}


def blobs(seed=0):
    """Two far groups, each of three near groups, and a far group too small to split."""
    rng = np.random.default_rng(seed)
    far = [np.array([0.0, 0.0]), np.array([1000.0, 0.0])]
    near = [np.array([0.0, 0.0]), np.array([20.0, 0.0]), np.array([0.0, 20.0])]
    x = np.concatenate([f + m + rng.normal(size=(20, 2)) * 0.1 for f in far for m in near])
    return np.concatenate([x, rng.normal(size=(5, 2)) * 0.1 + [0.0, 5000.0]])


def test_two_levels(spark):
    rows = C.recursive_kmeans(vectors(spark, blobs()), 3, 2, seed=1, iterations=30)
    cluster = {r.row_id: r.cluster for r in rows.collect()}
    assert len(cluster) == 125
    assert len({cluster[i] for i in range(120, 125)}) == 1  # five rows are not split
    assert not {cluster[i] for i in range(120, 125)} & {cluster[i] for i in range(120)}
    assert not {cluster[i] for i in range(60)} & {cluster[i] for i in range(60, 120)}
    assert sorted(set(cluster.values())) == list(range(len(set(cluster.values()))))
    assert 5 <= len(set(cluster.values())) <= 7


def test_depth_one_and_three(spark):
    x = vectors(spark, blobs())
    assert C.recursive_kmeans(x, 3, 1, seed=1).select("cluster").distinct().count() == 3
    assert C.recursive_kmeans(x, 2, 3, seed=1).count() == 125
    with pytest.raises(ValueError):
        C.recursive_kmeans(x, 2, 0)


def test_cluster_features(spark):
    x = vectors(spark, blobs())
    labels = x.select("row_id", F.concat(F.lit("s"), (F.col("row_id") % 4).cast("string")).alias("who"))
    clustered, table = C.cluster_features(x.withColumn("junk", F.lit(1)), labels, "who", 3, 2, ignore=["junk"])
    assert clustered.columns == ["row_id", "cluster"]
    sums = {r.who: r.s for r in table.groupBy("who").agg(F.sum("freq").alias("s")).collect()}
    assert set(sums) == {"s0", "s1", "s2", "s3"} and all(math.isclose(v, 1.0) for v in sums.values())


def test_pca_against_numpy(spark):
    x = np.random.default_rng(0).normal(size=(60, 5)) @ np.diag([5, 3, 1, 1, 0.1]) + 7
    x[:, 4] = x[:, 0] * 2 + x[:, 4]
    z = (x - x.mean(0)) / x.std(0)
    values, axes = np.linalg.eigh(np.cov(z.T))
    order = values.argsort()[::-1]
    fitted = R.fit_pca(vectors(spark, x), 3)
    assert np.allclose(fitted.explained, (values / values.sum())[order][:3])
    got = np.array([r.vec for r in fitted.transform(vectors(spark, x)).orderBy("row_id").collect()])
    want = z @ axes[:, order[:3]]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    assert np.allclose(got[:, :2], np.array([r.vec for r in fitted.transform(vectors(spark, x), 2).orderBy("row_id").collect()]))


def test_pca_sweep_prefixes(spark):
    x = vectors(spark, np.random.default_rng(1).normal(size=(30, 6)))
    rows = R.pca_sweep(x, (2, 4)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.dims, {})[r.row_id] = r.vec
    assert set(by) == {2, 4} and all(by[4][i][:2] == by[2][i] for i in range(30))
    with pytest.raises(ValueError, match="50 components"):
        R.pca_sweep(x, (2, 4, 50))
    with pytest.raises(ValueError):
        R.reduce_dimensions(x, 2, "tSNE")


def test_min_max_of_a_constant(spark):
    x = vectors(spark, [[1, 5], [3, 5]])
    train, other = R.min_max_scale(x, vectors(spark, [[2, 7]]))
    assert [r.vec for r in train.orderBy("row_id").collect()] == [[0, 0], [1, 0]] and other.first().vec == [0.5, 2]
    with pytest.raises(ValueError):
        R.standardise(x.limit(1))


def test_scaling(spark):
    x = vectors(spark, [[1, 5], [3, 5], [8, 5]])
    got = np.array([r.vec for r in R.standardise(x).orderBy("row_id").collect()])
    first = np.array([1.0, 3, 8])
    assert np.allclose(got[:, 0], (first - first.mean()) / first.std()) and np.allclose(got[:, 1], 0)
    train, test = R.min_max_scale(x, vectors(spark, [[15, 5]]))
    assert [r.vec[0] for r in train.orderBy("row_id").collect()] == [0.0, 2 / 7, 1.0]
    assert test.first().vec[0] == 2.0
    assert [r.scaled for r in R.percent_scale(spark.createDataFrame([(1.0,), (3.0,)], "v double"), "v").orderBy("v").collect()] == [0.0, 100.0]


def test_pooled_variance(spark):
    rows = [("a", 1), ("a", 3), ("b", 2), ("b", 4), ("b", 6), ("c", 9)]
    got = S.variance_ratio(spark.createDataFrame(rows, "cluster string, v int"), "v").first()
    assert math.isclose(got.general, 8.566667, abs_tol=1e-6) and math.isclose(got.pooled, 10 / 3) and math.isclose(got.ratio, 2.57, abs_tol=1e-9)


def test_mean_distance(spark):
    rows = spark.createDataFrame([(0, "x", 1.0), (1, "x", 2.0), (2, "x", 4.0), (3, "y", 50.0)], "row_id long, cluster string, v double")
    got = [r.mean_distance for r in S.mean_distance(rows, "v", ["cluster"]).orderBy("row_id").collect()]
    assert np.allclose(got, [4 / 3, 1.0, 5 / 3, 0.0])
    values = np.array([1.0, 2, 4, 50])
    got = [r.mean_distance for r in S.mean_distance(rows, "v").orderBy("row_id").collect()]
    assert np.allclose(got, np.abs(values[:, None] - values).mean(1))


def test_composition(spark):
    table = spark.createDataFrame([(0, "AAC"), (0, "ACD"), (1, "WWW")], "cluster int, Ngram string")
    freq = {(r.cluster, r.letter): r.freq for r in P.composition(table).collect()}
    assert len(freq) == 40 and freq[0, "A"] == 1.5 and freq[0, "C"] == 1.0 and freq[0, "D"] == 0.5 and freq[1, "W"] == 3.0
    assert math.isclose(sum(v for (c, _), v in freq.items() if c == 0), 3.0)
    logo = {r.cluster: (r.length, r.logo) for r in P.letter_maps(table).collect()}
    assert logo[0] == (2, {"A": 3, "C": 2, "D": 1})


def test_pairs(spark):
    table = spark.createDataFrame([(3, 1.0), (1, 4.0), (2, 9.0)], "cluster int, v double")
    got = {(r.a, r.b): r.distance for r in P.property_distances(table, "cluster", "v").collect()}
    assert got == {(1, 2): 5.0, (1, 3): 3.0, (2, 3): 8.0}
    assert P.property_distances(table.limit(1), "cluster", "v").count() == 0


def brute_moran(xy, z, threshold):
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    w = ((d <= threshold) & ~np.eye(len(xy), dtype=bool)).astype(float)
    n = w.sum(1, keepdims=True)
    w = np.divide(w, n, out=np.zeros_like(w), where=n > 0)
    z = z - z.mean()
    return len(z) / w.sum() * (z @ w @ z) / (z @ z)


def test_moran_line(spark):
    table = spark.createDataFrame([(float(i), 0.0, i + 1) for i in range(4)], "x double, y double, v int")
    got = S.morans_i(table, ["v"], [1.0]).first()
    assert math.isclose(got.morans_i, 0.4) and math.isclose(got.expected, -1 / 3)


def test_moran_with_copies_and_islands(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 8)
    monkeypatch.setattr(S, "TILE_ROWS", 3)
    rng = np.random.default_rng(3)
    xy = np.round(rng.uniform(-4, 4, size=(150, 2)), 1)
    xy[:50] = xy[0]  # a third at one place
    xy[149] = [100, 100]
    a, b = rng.normal(size=150), xy[:, 0] + rng.normal(size=150) * 0.1
    rows = [(float(p[0]), float(p[1]), float(u), float(v)) for p, u, v in zip(xy, a, b)]
    table = spark.createDataFrame(rows, "x double, y double, a double, b double").repartition(6)
    got = {(r.threshold, r.property): r.morans_i for r in S.morans_i(table, ["a", "b"], [0.5, 2.0]).collect()}
    for t in (0.5, 2.0):
        assert math.isclose(got[t, "a"], brute_moran(xy, a, t), abs_tol=1e-9)
        assert math.isclose(got[t, "b"], brute_moran(xy, b, t), abs_tol=1e-9)


def test_counts(spark):
    clustered = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "row_id long, cluster int")
    data = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B")], "row_id long, s string")
    got = Counter({(r.s, r.feature): r.n for r in C.cluster_counts(clustered, data, "s").collect()})
    assert got == {("A", 1): 2, ("B", 2): 1}


def test_mean_distance_keeps_rows_without_value_or_group(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "a", None), (4, None, 2.0)], "row_id long, cluster string, v double")
    got = {r.row_id: r.mean_distance for r in S.mean_distance(rows, "v", ["cluster"]).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: None, 4: None}


def test_vectors_of_a_batch_by_parent():
    import pyarrow as pa

    whole = pa.record_batch({"parent": pa.array([9, 2, 0, 2, 1], pa.int32()), "vec": pa.array([[9.0, 9.0], [1.0, 2.0], [3.0, 4.0], [5.0, 6.0], [7.0, 8.0]])})
    found = [(p, at.tolist(), x.tolist()) for p, at, x in C._by_parent(whole.slice(1))]
    assert found == [(0, [1], [[3.0, 4.0]]), (1, [3], [[7.0, 8.0]]), (2, [0, 2], [[1.0, 2.0], [5.0, 6.0]])]
    assert not list(C._by_parent(whole.slice(0, 0)))
