"""Queries over vectors: neighbours, neighbourhoods, features, scaling."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import functions as F

from junctura.catalog import tables as t
from junctura.catalog.sampling import ranked
from junctura.functions.vectors import column_range
from junctura.operators.classify import make_classifier
from junctura.operators.embedding import mean_vectors
from junctura.operators.neighborhoods import (
    candidates,
    feature_owner,
    label_prevalence,
    label_share,
    multiple_hits,
    neighbour_lists,
    neighbourhood_stats,
    owner_feature_table,
    select_non_overlapping,
    subject_count_distribution,
    threshold_sweep,
)
from junctura.operators.neighbors import (
    distance_diagnostics,
    knn_approximate,
    knn_hashed,
    knn_join,
    knn_self,
    list_recall,
    nearest_center,
    neighbour_radius,
    radius_join,
)
from junctura.operators.reduce import PCA_SIZES, fit_pca, min_max_scale, pca_sweep, standardise
from junctura.operators.sampling import split_train_test
from junctura.plans.flows import fit_proximity, proximity_flow, proximity_folds
from junctura.session import cut_lineage
from junctura.sources.writers import neighbour_matrix

SETTINGS = {"k": t.K, "min_significance": 0.6, "min_subjects": 3}


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _cells(df, *keys, vec="vec"):
    return df.select(*keys, F.posexplode(vec).alias("pos", "value")).select(*keys, "pos", F.round("value", 6).alias("value"))


def _neighbours(spark, sf):
    return knn_self(t.vectors(spark, sf), t.K)


def knn_many_cells(spark, sf):
    """The same lists by cells of some thirty rows, so that many cells and blocks meet."""
    return _round(knn_self(t.vectors(spark, sf), t.K, cell_rows=32), "dist")


def _shares(spark, sf):
    return label_share(_neighbours(spark, sf), t.subjects(spark, sf), "HC")


def _fit(spark, sf):
    return fit_proximity(t.vectors(spark, sf), t.subjects(spark, sf), "HC", **SETTINGS)


def knn(spark, sf):
    return _round(_neighbours(spark, sf), "dist")


def knn_radius(spark, sf):
    return _round(neighbour_radius(_neighbours(spark, sf)), "max_distance")


def knn_matrix(spark, sf):
    return neighbour_matrix(_neighbours(spark, sf), "neighbor", t.K)


def knn_diagnostics(spark, sf):
    found = distance_diagnostics(_neighbours(spark, sf), F.floor(F.col("row_id") / 100))
    return _round(found, "max_distance")


def knn_near_cells(spark, sf):
    """Approximate neighbours from the 3 nearest of about 22 cells."""
    return _round(knn_approximate(t.vectors(spark, sf), t.K, probes=3), "dist")


def knn_all_cells(spark, sf):
    """The same with every cell probed, which is exact."""
    return _round(knn_approximate(t.vectors(spark, sf), t.K, cells=6, probes=6), "dist")


def knn_recall(spark, sf):
    """Hashed lists of the rows with an id divisible by 50 against all rows, held against exact lists.

    Per asked row the exact list's radius, and whether all hashed lists together have at least
    nine of ten exact neighbours.
    """
    rows = cut_lineage(t.vectors(spark, sf))
    asked = rows.where("row_id % 50 = 0")
    exact = cut_lineage(knn_join(asked, rows, t.K + 1).where(F.col("neighbor") != F.col("row_id")).withColumn("rank", F.col("rank") - 1))
    counted = cut_lineage(list_recall(knn_hashed(rows, t.K, asked=F.col("row_id") % 50 == 0), exact))
    reached = counted.agg((F.sum("hit") >= 0.9 * F.sum("wanted")).alias("recall_reached"))
    radius = exact.where(F.col("rank") <= t.K).groupBy("row_id").agg(F.round(F.max("dist"), 6).alias("radius"), F.count("*").alias("listed"))
    return radius.crossJoin(F.broadcast(reached))  # one row


def knn_vote(spark, sf):
    """Labels of a quarter of the vectors by the majority of their 3 nearest others."""
    rows = t.vectors(spark, sf).select("row_id", F.col("vec").alias("features"), F.col("label").alias("class"))
    split = cut_lineage(split_train_test(rows, 0.25))
    train, test = (split.where(F.col("role") == r).drop("role") for r in ("train", "test"))
    said = make_classifier("kNN").fit(train).transform(test)
    return said.select("row_id", F.col("class").alias("actual"), "predicted")


def neighborhood_stats(spark, sf):
    return _round(neighbourhood_stats(_neighbours(spark, sf), t.subjects(spark, sf)), "share")


def neighborhood_lists(spark, sf):
    found = neighbour_lists(_neighbours(spark, sf), t.subjects(spark, sf).select("row_id", "FILENAME"))
    return found.select("row_id", "FILENAME", F.concat(F.lit("["), F.array_join("neighbors", ", "), F.lit("]")).alias("neighbors"))


def share(spark, sf):
    return _round(_shares(spark, sf), "share")


def subject_counts(spark, sf):
    return _round(subject_count_distribution(_shares(spark, sf)), "mean_share")


def prevalence(spark, sf):
    return _round(label_prevalence(t.subjects(spark, sf), "labels", "HC"), "prevalence")


def feature_select(spark, sf):
    return _round(_fit(spark, sf).selected, "significance")


def feature_sweep(spark, sf):
    """Candidates and selected rows for thresholds 0.60, 0.605, ... 0.70."""
    near = cut_lineage(_neighbours(spark, sf))
    found = candidates(label_share(near, t.subjects(spark, sf), "HC"), 0.6, 3)
    chosen = select_non_overlapping(found, near)
    marks = [(600 + 5 * i) / 1000 for i in range(21)]
    return threshold_sweep(found, chosen, marks)


def features(spark, sf):
    found = _fit(spark, sf).features.withColumnRenamed("center", "vec")
    return _cells(_round(found, "max_distance"), "feature_index", "max_distance")


def owners(spark, sf):
    fitted = _fit(spark, sf)
    return feature_owner(fitted.selected, fitted.neighbours)


def owner_table(spark, sf):
    fitted = _fit(spark, sf)
    table = owner_feature_table(feature_owner(fitted.selected, fitted.neighbours), t.subjects(spark, sf))
    return _round(table, "freq")


def feature_table(spark, sf):
    return _round(proximity_flow(t.vectors(spark, sf), t.subjects(spark, sf), "HC", **SETTINGS), "freq")


def radius_hits(spark, sf):
    """Vectors inside the features' radius, by the way that shuffles both sides."""
    return _round(radius_join(t.vectors(spark, sf), _fit(spark, sf).features, broadcast_bytes=0), "dist")


def many_hits(spark, sf):
    return multiple_hits(radius_join(t.vectors(spark, sf), _fit(spark, sf).features))


def fold_features(spark, sf):
    """Features learned on the training subjects of each of five folds, counted for all subjects."""
    tables = proximity_folds(t.vectors(spark, sf), t.subjects(spark, sf), "HC", folds=5, **SETTINGS)
    return tables.groupBy("fold", "role", "FILENAME").agg(
        F.sum("n").alias("hits"), F.round(F.sum("freq"), 6).alias("total")
    )


def mean_vector(spark, sf):
    return _cells(mean_vectors(t.vectors(spark, sf), t.subjects(spark, sf), "FILENAME"), "FILENAME")


def standard_scale(spark, sf):
    return _cells(standardise(t.vectors(spark, sf).select("row_id", "vec")), "row_id")


def minmax_scale(spark, sf):
    """All rows scaled by the range of one condition's rows: fitted on one part, applied to both.

    A position that is constant in the first part is added at the end.
    """
    rows = t.vectors(spark, sf).join(t.subjects(spark, sf), "row_id")
    rows = rows.withColumn("vec", F.concat("vec", F.array(F.when(F.col("labels") == "HC", 2.0).otherwise(5.0))))
    train, test = (rows.where(F.col("labels") == c).select("row_id", "vec") for c in ("HC", "CD"))
    scaled = min_max_scale(train, test)
    return _cells(scaled[0].unionByName(scaled[1]), "row_id")


def columns_range(spark, sf):
    return _cells(t.vectors(spark, sf).select("row_id", column_range(F.col("vec"), 2, 5).alias("vec")), "row_id")


def centroid(spark, sf):
    rows = t.vectors(spark, sf)
    means = mean_vectors(rows.select("row_id", "vec"), rows.select("row_id", "label"), "label")
    found = nearest_center(rows, means.select(F.col("label").alias("center_id"), F.col("vec").alias("center")))
    return _round(found, "dist").withColumn("center_id", F.col("center_id").cast("int"))


def pca(spark, sf):
    """Variance of each of five components, which PCA orders; signs of components are free."""
    rows = t.vectors(spark, sf).select("row_id", "vec")
    reduced = fit_pca(rows, 5).transform(rows)
    return (
        reduced.select(F.posexplode("vec").alias("component", "value"))
        .groupBy("component")
        .agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_pop("value"), 6).alias("variance"))
    )


def pca_rules(spark, sf):
    """Whether all 64 components are what they are called, held against a correlation matrix of another path.

    ``trace`` and ``squares`` are the sums of the eigenvalues, from the explained shares, and of
    their squares; the matrix has the same.
    """
    rows = t.vectors(spark, sf).select("row_id", "vec")
    fitted = fit_pca(rows, 64)
    shares, axes = np.array(fitted.explained), fitted.model.stages[-1].pc.toArray()
    matrix = Correlation.corr(rows.select(array_to_vector("vec").alias("v")), "v").first()[0].toArray()
    values = shares * len(matrix)
    off = np.abs(matrix @ axes - axes * values).max()
    found = (float(values.sum()), float((values**2).sum()), bool(off < 1e-6), bool(np.abs(axes.T @ axes - np.eye(len(axes))).max() < 1e-9), bool((np.diff(values) <= 1e-9).all()))
    out = spark.createDataFrame([found], "trace double, squares double, eigenvectors boolean, orthonormal boolean, falling boolean")
    return _round(out, "trace", "squares")


def pca_explained(spark, sf):
    """The share of the variance that each of 64 components explains, and of all so far."""
    return _round(fit_pca(t.vectors(spark, sf).select("row_id", "vec"), 64).explained_table(spark), "share", "cumulative")


def pca_norm(spark, sf):
    """Length of every row over all components: a rotation keeps that of the standardised row."""
    rows = t.vectors(spark, sf).select("row_id", "vec")
    full = fit_pca(rows, 64).transform(rows)
    squares = F.aggregate(F.transform("vec", lambda x: x * x), F.lit(0.0), lambda total, x: total + x)
    return full.select("row_id", F.round(F.sqrt(squares), 6).alias("norm"))


def pca_dims(spark, sf):
    """For every size that the vectors have: rows, widths, and whether the first components' variances fall."""
    swept = pca_sweep(t.vectors(spark, sf).select("row_id", "vec"), [d for d in PCA_SIZES if d <= 64])
    first, second = (F.var_pop(F.get("vec", F.lit(k))) for k in (0, 1))
    return swept.groupBy("dims").agg(F.count("*").alias("n"), F.max(F.size("vec")).cast("long").alias("width"), (first >= second).alias("ordered"))


NN = (t.VECTORS, t.SUBJECTS, t.knn_sql())
SEEN = """seen AS (SELECT DISTINCT nn.row_id, FILENAME, labels FROM nn JOIN subjects s ON s.row_id = nn.neighbor)"""
SHARES = """shares AS (
  SELECT row_id, count(*) AS how_many_subjects, count(*) FILTER (labels = 'HC') / count(*) AS share FROM seen GROUP BY row_id)"""
CANDIDATES = """cand AS (
  SELECT *, row_number() OVER (ORDER BY significance DESC, row_id) AS p
  FROM (SELECT row_id, how_many_subjects, greatest(share, 1 - share) AS significance FROM shares)
  WHERE significance > 0.6 AND how_many_subjects > 3)"""
WALK = """lists AS (SELECT row_id, list(neighbor) AS l FROM nn GROUP BY row_id),
ordered AS (SELECT c.*, l FROM cand c JOIN lists USING (row_id)),
walk AS (
  SELECT 0::BIGINT AS p, NULL::BIGINT AS row_id, false AS selected, []::BIGINT[] AS inside
  UNION ALL
  SELECT o.p, o.row_id, NOT list_contains(w.inside, o.row_id),
         CASE WHEN list_contains(w.inside, o.row_id) THEN w.inside ELSE list_concat(w.inside, o.l) END
  FROM walk w JOIN ordered o ON o.p = w.p + 1),
chosen AS (SELECT w.row_id, c.significance, c.p FROM walk w JOIN cand c USING (row_id) WHERE selected)"""
FEATURES = """feats AS (
  SELECT chosen.row_id AS feature, vec AS center, (SELECT max(dist) FROM nn WHERE nn.row_id = chosen.row_id) AS r
  FROM chosen JOIN vectors USING (row_id)),
hits AS (
  SELECT v.row_id, feature, list_distance(v.vec, center) AS dist FROM vectors v, feats WHERE list_distance(v.vec, center) <= r)"""
OWNERS = """own AS (
  SELECT neighbor AS row_id, max_by(nn.row_id, p) AS feature FROM nn JOIN chosen USING (row_id) GROUP BY neighbor)"""
CHAIN = (*NN, SEEN, SHARES, CANDIDATES)


def recursive(*parts: str, body: str) -> str:
    return t.with_ctes(*parts, body=body).replace("WITH ", "WITH RECURSIVE ", 1)


def frequencies(source: str) -> str:
    return f"""counts AS (SELECT FILENAME, feature, count(*) AS n FROM {source} JOIN subjects USING (row_id) GROUP BY 1, 2)"""


FREQUENCY_BODY = """SELECT s.FILENAME, feature, coalesce(n, 0) AS n, round(n / sum(n) OVER (PARTITION BY s.FILENAME), 6) AS freq
FROM (SELECT DISTINCT FILENAME FROM subjects) s LEFT JOIN counts USING (FILENAME)"""

POSITIONS = "SELECT {keys}, CAST(p AS INTEGER) AS pos, round(vec[p + 1], 6) AS value FROM {table}, range(64) q(p)"

QUERIES = {
    "knn": (knn, t.with_ctes(t.VECTORS, t.knn_sql(), body="SELECT row_id, rank, neighbor, round(dist, 6) AS dist FROM nn")),
    "knn_many_cells": (
        knn_many_cells,
        t.with_ctes(t.VECTORS, t.knn_sql(), body="SELECT row_id, rank, neighbor, round(dist, 6) AS dist FROM nn"),
    ),
    "knn_radius": (
        knn_radius,
        t.with_ctes(t.VECTORS, t.knn_sql(), body="SELECT row_id, round(max(dist), 6) AS max_distance FROM nn GROUP BY row_id"),
    ),
    "knn_matrix": (
        knn_matrix,
        t.with_ctes(
            t.VECTORS,
            t.knn_sql(),
            body="SELECT row_id, "
            + ", ".join(f'max(neighbor) FILTER (rank = {i}) AS "{i}"' for i in range(t.K + 1))
            + " FROM nn GROUP BY row_id",
        ),
    ),
    "knn_diagnostics": (
        knn_diagnostics,
        t.with_ctes(
            t.VECTORS,
            t.knn_sql(),
            body="SELECT row_id // 100 AS batch, round(max(dist), 6) AS max_distance, count(DISTINCT row_id) AS rows FROM nn GROUP BY 1",
        ),
    ),
    "knn_near_cells": (knn_near_cells, None),
    "knn_all_cells": (
        knn_all_cells,
        t.with_ctes(t.VECTORS, t.knn_sql(), body="SELECT row_id, rank, neighbor, round(dist, 6) AS dist FROM nn"),
    ),
    "knn_recall": (
        knn_recall,
        t.with_ctes(
            t.VECTORS,
            t.knn_sql(),
            body="SELECT row_id, round(max(dist), 6) AS radius, count(*) AS listed, true AS recall_reached FROM nn WHERE row_id % 50 = 0 AND rank > 0 GROUP BY row_id",
        ),
    ),
    "knn_vote": (
        knn_vote,
        t.with_ctes(
            t.VECTORS,
            ranked("vectors", "'0'"),
            "split AS (SELECT *, r <= ceil(0.25 * n) AS test FROM ranked)",
            """near AS (SELECT a.row_id, a.label AS actual, b.label,
  row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.vec, b.vec), b.row_id) AS k
  FROM split a, split b WHERE a.test AND NOT b.test)""",
            "votes AS (SELECT row_id, actual, label, count(*) AS n FROM near WHERE k <= 3 GROUP BY ALL)",
            body="""SELECT row_id, actual, label AS predicted FROM votes
QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, label) = 1""",
        ),
    ),
    "neighborhood_stats": (
        neighborhood_stats,
        t.with_ctes(
            *NN,
            SEEN,
            body="""SELECT row_id, CAST(sum(n) OVER (PARTITION BY row_id) AS BIGINT) AS how_many_subjects, labels AS label,
round(n / sum(n) OVER (PARTITION BY row_id), 6) AS share
FROM (SELECT row_id, labels, count(*) AS n FROM seen GROUP BY 1, 2)""",
        ),
    ),
    "neighborhood_lists": (
        neighborhood_lists,
        t.with_ctes(
            *NN,
            body="""SELECT s.row_id, FILENAME, '[' || string_agg(neighbor, ', ' ORDER BY rank) || ']' AS neighbors
FROM nn JOIN subjects s ON s.row_id = nn.row_id GROUP BY 1, 2""",
        ),
    ),
    "label_share": (
        share,
        t.with_ctes(*NN, SEEN, SHARES, body="SELECT row_id, how_many_subjects, round(share, 6) AS share FROM shares"),
    ),
    "subject_count_distribution": (
        subject_counts,
        t.with_ctes(
            *NN,
            SEEN,
            SHARES,
            body="SELECT how_many_subjects, count(*) AS n, round(avg(share), 6) AS mean_share FROM shares GROUP BY 1",
        ),
    ),
    "label_prevalence": (
        prevalence,
        t.with_ctes(t.SUBJECTS, body="SELECT round(avg(CASE WHEN labels = 'HC' THEN 1.0 ELSE 0.0 END), 6) AS prevalence FROM subjects"),
    ),
    "feature_select": (
        feature_select,
        recursive(*CHAIN, WALK, body="SELECT row_id, round(significance, 6) AS significance FROM chosen"),
    ),
    "feature_sweep": (
        feature_sweep,
        recursive(
            *CHAIN,
            WALK,
            "marks AS (SELECT (600 + 5 * i)::DOUBLE / 1000 AS threshold FROM range(21) q(i))",
            body="""SELECT threshold, (SELECT count(*) FROM cand WHERE significance > threshold) AS gross,
(SELECT count(*) FROM chosen WHERE significance > threshold) AS net FROM marks""",
        ),
    ),
    "feature_list": (
        features,
        recursive(
            *CHAIN,
            WALK,
            FEATURES,
            "cells AS (SELECT feature AS feature_index, round(r, 6) AS max_distance, center AS vec FROM feats)",
            body=POSITIONS.format(keys="feature_index, max_distance", table="cells"),
        ),
    ),
    "feature_owner": (owners, recursive(*CHAIN, WALK, OWNERS, body="SELECT row_id, feature FROM own")),
    "owner_feature_table": (
        owner_table,
        recursive(*CHAIN, WALK, OWNERS, frequencies("own"), body=FREQUENCY_BODY),
    ),
    "feature_table": (
        feature_table,
        recursive(*CHAIN, WALK, FEATURES, frequencies("hits"), body=FREQUENCY_BODY),
    ),
    "radius_hits": (
        radius_hits,
        recursive(*CHAIN, WALK, FEATURES, body="SELECT row_id, feature, round(dist, 6) AS dist FROM hits"),
    ),
    "multiple_hits": (
        many_hits,
        recursive(
            *CHAIN,
            WALK,
            FEATURES,
            body="""SELECT count(*) AS rows_hit, count(*) FILTER (n > 1) AS rows_hit_many
FROM (SELECT row_id, count(*) AS n FROM hits GROUP BY row_id)""",
        ),
    ),
    "fold_features": (fold_features, None),
    "subject_mean_vector": (
        mean_vector,
        t.with_ctes(
            t.VECTORS,
            t.SUBJECTS,
            body="""SELECT FILENAME, CAST(p AS INTEGER) AS pos, round(avg(vec[p + 1]), 6) AS value
FROM vectors JOIN subjects USING (row_id), range(64) q(p) GROUP BY 1, 2""",
        ),
    ),
    "standard_scale": (
        standard_scale,
        t.with_ctes(
            t.VECTORS,
            "cells AS (SELECT row_id, CAST(p AS INTEGER) AS pos, vec[p + 1] AS x FROM vectors, range(64) q(p))",
            body="SELECT row_id, pos, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 6) AS value FROM cells WINDOW w AS (PARTITION BY pos)",
        ),
    ),
    "minmax_scale": (
        minmax_scale,
        t.with_ctes(
            t.VECTORS,
            t.SUBJECTS,
            "wide AS (SELECT row_id, labels, list_append(vec, CASE WHEN labels = 'HC' THEN 2.0 ELSE 5.0 END) AS vec FROM vectors JOIN subjects USING (row_id))",
            "cells AS (SELECT row_id, labels, CAST(p AS INTEGER) AS pos, vec[p + 1] AS x FROM wide, range(65) q(p))",
            "ends AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM cells WHERE labels = 'HC' GROUP BY pos)",
            body="SELECT row_id, pos, round((x - lo) / coalesce(nullif(hi - lo, 0), 1), 6) AS value FROM cells JOIN ends USING (pos)",
        ),
    ),
    "column_range": (
        columns_range,
        t.with_ctes(
            t.VECTORS,
            body="SELECT row_id, CAST(p AS INTEGER) AS pos, round(vec[p + 2], 6) AS value FROM vectors, range(4) q(p)",
        ),
    ),
    "nearest_centroid": (
        centroid,
        t.with_ctes(
            t.VECTORS,
            "sums AS (SELECT label, p, avg(vec[p + 1]) AS m FROM vectors, range(64) q(p) GROUP BY 1, 2)",
            "centers AS (SELECT label, list(m ORDER BY p) AS c FROM sums GROUP BY label)",
            body="""SELECT v.row_id, c.label AS center_id, round(list_distance(v.vec, c.c), 6) AS dist FROM vectors v, centers c
QUALIFY row_number() OVER (PARTITION BY v.row_id ORDER BY list_distance(v.vec, c.c), c.label) = 1""",
        ),
    ),
    "pca": (pca, None),
    "pca_explained": (pca_explained, None),
    "pca_rules": (
        pca_rules,
        t.with_ctes(
            t.VECTORS,
            "cells AS (SELECT row_id, p, vec[p + 1] AS x FROM vectors, range(64) q(p))",
            "matrix AS (SELECT a.p AS i, b.p AS j, corr(a.x, b.x) AS r FROM cells a JOIN cells b USING (row_id) GROUP BY 1, 2)",
            body="""SELECT round(sum(r) FILTER (i = j), 6) AS trace, round(sum(r * r), 6) AS squares, true AS eigenvectors, true AS orthonormal, true AS falling
FROM matrix""",
        ),
    ),
    "pca_norm": (
        pca_norm,
        t.with_ctes(
            t.VECTORS,
            "cells AS (SELECT row_id, p, vec[p + 1] AS x FROM vectors, range(64) q(p))",
            "z AS (SELECT row_id, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z FROM cells WINDOW w AS (PARTITION BY p))",
            body="SELECT row_id, round(sqrt(sum(z * z)), 6) AS norm FROM z GROUP BY row_id",
        ),
    ),
    "pca_sweep": (
        pca_dims,
        "SELECT CAST(d AS INTEGER) AS dims, (SELECT count(*) FROM embeddings) AS n, CAST(d AS BIGINT) AS width, true AS ordered FROM (VALUES (2), (5), (10), (15), (20), (30), (50)) q(d)",
    ),
}
