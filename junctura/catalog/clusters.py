"""Queries over clusters: feature tables, composition, spatial statistics."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from junctura.catalog import tables as t
from junctura.functions.vectors import euclidean
from junctura.operators.cluster import (
    cluster_cost,
    cluster_counts,
    cluster_feature_table,
    diversity_share,
    recursive_kmeans,
)
from junctura.operators.composition import (
    all_pairs,
    cluster_centers,
    cluster_pairs,
    composition,
    letter_maps,
    property_distances,
    property_means,
)
from junctura.operators.neighborhoods import subject_frequencies
from junctura.operators.reduce import percent_scale
from junctura.operators.spatial import knn_weights, mean_distance, morans_i, variance_ratio
from junctura.session import cut_lineage
from junctura.sources.writers import wide_feature_table

PROPERTIES = ("GRAVY", "BULK")
LABELS = 10  # labels of the embeddings: 0 to 9


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _clustered(spark, sf):
    return t.vectors(spark, sf).select("row_id", F.col("label").alias("cluster"))


def _files(spark, sf):
    return t.subjects(spark, sf).withColumnRenamed("FILENAME", "subject")


def counts(spark, sf):
    return cluster_counts(_clustered(spark, sf), _files(spark, sf), "subject")


def features(spark, sf):
    return _round(cluster_feature_table(_clustered(spark, sf), _files(spark, sf), "subject"), "freq")


def diversity(spark, sf):
    data = _files(spark, sf)
    table = subject_frequencies(cluster_counts(_clustered(spark, sf), data, "subject"), data, "subject")
    return _round(diversity_share(table), "top_percent")


def diversity_filtered(spark, sf):
    return _round(cluster_feature_table(_clustered(spark, sf), _files(spark, sf), "subject", 12.5), "freq")


def wide_features(spark, sf):
    table = cluster_feature_table(_clustered(spark, sf), _files(spark, sf), "subject")
    wide = wide_feature_table(table, "subject")
    return _round(wide, *wide.columns[1:])


def two_level(spark, sf):
    """Sizes of the leaves of two levels of k-means."""
    rows = recursive_kmeans(t.vectors(spark, sf).select("row_id", "vec"), 20, 2)
    return rows.groupBy("cluster").agg(F.count("*").alias("n"))


def leaf_rules(spark, sf):
    """What must hold of two levels of k-means with ten starts, for every row.

    Leaves lie within one parent, a row's own leaf has the nearest mean of the parent's leaves,
    parents of at most ten rows are whole, and ten starts cost no more than the first of them.
    """
    rows = t.vectors(spark, sf).select("row_id", "vec")
    tops = cut_lineage(recursive_kmeans(rows, 20, 1).withColumnRenamed("cluster", "parent"))
    leaves = cut_lineage(recursive_kmeans(rows, 20, 2).join(tops.select("row_id", "parent"), "row_id"))
    means = leaves.groupBy("parent", "cluster").agg(vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("mean"))
    parents = leaves.groupBy("cluster").agg(F.countDistinct("parent").alias("parents"))
    kept = leaves.groupBy("parent").agg(F.count("*").alias("rows"), F.countDistinct("cluster").alias("leaves"))
    far = euclidean(F.col("vec"), F.col("mean"))
    near = leaves.join(means.withColumnRenamed("cluster", "_leaf"), "parent").groupBy("row_id").agg(
        F.min(far).alias("least"), F.min(F.when(F.col("_leaf") == F.col("cluster"), far)).alias("own"), F.first("cluster").alias("cluster"), F.first("parent").alias("parent")
    )
    whole = cluster_cost(tops.withColumnRenamed("parent", "cluster"))
    single = cluster_cost(recursive_kmeans(rows, 20, 1, starts=1))
    return near.join(parents, "cluster").join(kept, "parent").select(
        "row_id",
        (F.col("parents") == 1).alias("in_one_parent"),
        (F.col("own") <= F.col("least") + 1e-4).alias("nearest"),
        ((F.col("rows") > 10) | (F.col("leaves") == 1)).alias("small_whole"),
        F.lit(whole <= single * (1 + 1e-9)).alias("cheapest"),
    )


def leaf_spread(spark, sf):
    """Each row's cluster joined back to it: rows per (subject, leaf), as for a feature table."""
    rows = cut_lineage(recursive_kmeans(t.vectors(spark, sf).select("row_id", "vec"), 20, 2))
    return _round(cluster_feature_table(rows, _files(spark, sf), "subject"), "freq")


def centers(spark, sf):
    return _round(cluster_centers(t.points(spark, sf)), "center_x", "center_y")


def properties(spark, sf):
    return _round(property_means(t.points(spark, sf), PROPERTIES), *PROPERTIES)


def letters(spark, sf):
    return _round(composition(t.points(spark, sf)), "freq")


def letter_map(spark, sf):
    found = letter_maps(t.points(spark, sf))
    return found.select("cluster", "length", F.explode("logo").alias("letter", "n"))


def pairwise(spark, sf):
    table = property_means(t.points(spark, sf), PROPERTIES)
    return _round(property_distances(table, "cluster", "GRAVY"), "distance")


def pairwise_customers(spark, sf):
    """Pairs of segments with their mean balances on both sides."""
    table = t.table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("balance"))
    return _round(all_pairs(table, "c_mktsegment", ["balance"]), "balance_a", "balance_b")


def pairs(spark, sf):
    return _round(cluster_pairs(t.points(spark, sf), PROPERTIES), "CM", "logo", *PROPERTIES)


def variance(spark, sf):
    return _round(variance_ratio(t.points(spark, sf), "GRAVY"), "general", "pooled", "ratio")


def variance_orders(spark, sf):
    """Spread of order prices, in thousands, within customers and overall."""
    orders = t.table(spark, sf, "orders").select("o_custkey", (F.col("o_totalprice") / 1000).alias("price"))
    return _round(variance_ratio(orders, "price", "o_custkey"), "general", "pooled", "ratio")


def distance_all(spark, sf):
    return _round(mean_distance(t.points(spark, sf).select("row_id", "GRAVY"), "GRAVY"), "GRAVY", "mean_distance")


def distance_within(spark, sf):
    return _round(
        mean_distance(t.points(spark, sf).select("row_id", "cluster", "GRAVY"), "GRAVY", ["cluster"]), "GRAVY", "mean_distance"
    )


def distance_quantity(spark, sf):
    """Mean quantity difference of every line to all lines of its return flag; many equal values."""
    lines = t.table(spark, sf, "lineitem").select("l_returnflag", "l_quantity")
    found = mean_distance(lines, "l_quantity", ["l_returnflag"])
    return _round(found.groupBy("l_returnflag", "l_quantity", "mean_distance").agg(F.count("*").alias("n")), "mean_distance")


def scaled(spark, sf):
    return _round(percent_scale(t.points(spark, sf).select("row_id", "GRAVY"), "GRAVY"), "GRAVY", "scaled")


def moran(spark, sf):
    return _round(morans_i(t.points(spark, sf), PROPERTIES, (0.02, 0.1, 0.3), "dim1", "dim2"), "morans_i", "expected")


def moran_parts(spark, sf):
    """Parts in the plane of size and price: rows pile up on whole sizes."""
    parts = t.table(spark, sf, "part").select("p_size", (F.col("p_retailprice") / 10).alias("price"), F.length("p_name").alias("length"))
    return _round(morans_i(parts, ("length",), (1.0, 3.0), "p_size", "price"), "morans_i", "expected")


def weights(spark, sf):
    return knn_weights(t.points(spark, sf), 2, "dim1", "dim2")


COUNTS = """counts AS (SELECT FILENAME AS subject, label AS feature, count(*) AS n FROM vectors JOIN subjects USING (row_id) GROUP BY 1, 2),
freqs AS (SELECT *, n / sum(n) OVER (PARTITION BY subject) AS freq FROM counts),
top AS (SELECT feature, 100.0 * max(freq) / sum(freq) AS top_percent FROM freqs GROUP BY feature)"""
TABLE = (t.VECTORS, t.SUBJECTS, COUNTS)
FREQ = "SELECT subject, feature, n, round(freq, 6) AS freq FROM freqs"
PTS = (t.VECTORS, t.POINTS)
LOGO = f"""alphabet AS (SELECT unnest(string_split('LASGVERTDIKPNQFYMHCW', '')) AS letter),
sizes AS (SELECT cluster, count(*) AS length FROM points GROUP BY cluster),
spelled AS (SELECT cluster, unnest(string_split(Ngram, '')) AS letter FROM points),
tally AS (SELECT cluster, letter, count(*) AS n FROM spelled GROUP BY 1, 2),
logo AS (SELECT s.cluster, s.length, a.letter, coalesce(n, 0) / s.length AS freq
         FROM sizes s CROSS JOIN alphabet a LEFT JOIN tally t ON t.cluster = s.cluster AND t.letter = a.letter)"""
MEANS = "means AS (SELECT cluster, avg(dim1) AS x, avg(dim2) AS y, avg(GRAVY) AS GRAVY, avg(BULK) AS BULK FROM points GROUP BY cluster)"


def _variance_sql(source: str, value: str, group: str) -> str:
    return f"""WITH {source}
general AS (SELECT var_samp({value}) AS g FROM src),
inside AS (SELECT count(*) AS n, var_samp({value}) AS v FROM src GROUP BY {group} HAVING count(*) > 1),
pooled AS (SELECT sum((n - 1) * v) / sum(n - 1) AS p FROM inside)
SELECT round(g, 6) AS general, round(p, 6) AS pooled, round(g / p, 6) AS ratio FROM general, pooled"""


def _moran_sql(source: str, x: str, y: str, properties: tuple, thresholds: tuple) -> str:
    values = " UNION ALL ".join(
        f"SELECT i, x, y, '{p}' AS property, {p} - avg({p}) OVER () AS z FROM pts" for p in properties
    )
    marks = ", ".join(f"({h})" for h in thresholds)
    return f"""WITH {source}
pts AS (SELECT row_number() OVER () AS i, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, {", ".join(properties)} FROM src),
vals AS ({values}),
marks AS (SELECT CAST(h AS DOUBLE) AS threshold FROM (VALUES {marks}) q(h)),
lag AS (SELECT threshold, a.property, a.i, any_value(a.z) AS z, avg(b.z) AS m
        FROM marks, vals a JOIN vals b ON a.property = b.property AND a.i <> b.i
        WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= threshold
        GROUP BY 1, 2, 3),
square AS (SELECT property, sum(z * z) AS q, count(*) AS n FROM vals GROUP BY property)
SELECT threshold, lag.property, round(any_value(n) / count(*) * sum(z * m) / any_value(q), 6) AS morans_i,
       round(-1.0 / (any_value(n) - 1), 6) AS expected
FROM lag JOIN square USING (property) GROUP BY 1, 2"""


QUERIES = {
    "cluster_counts": (counts, t.with_ctes(*TABLE, body="SELECT subject, feature, n FROM counts")),
    "cluster_feature_table": (features, t.with_ctes(*TABLE, body=FREQ)),
    "diversity_share": (diversity, t.with_ctes(*TABLE, body="SELECT feature, round(top_percent, 6) AS top_percent FROM top")),
    "diversity_filter": (
        diversity_filtered,
        t.with_ctes(*TABLE, body=FREQ + " WHERE feature NOT IN (SELECT feature FROM top WHERE round(top_percent, 9) > 12.5)"),
    ),
    "wide_feature_table": (
        wide_features,
        t.with_ctes(
            *TABLE,
            "cells AS (SELECT s.subject, f.feature, coalesce(freq, 0.0) AS freq FROM (SELECT DISTINCT subject FROM freqs) s, "
            "(SELECT DISTINCT feature FROM freqs) f LEFT JOIN freqs ON freqs.subject = s.subject AND freqs.feature = f.feature)",
            body="SELECT subject, " + ", ".join(f"round(max(freq) FILTER (feature = {k}), 6) AS \"{k}\"" for k in range(LABELS)) + " FROM cells GROUP BY subject",
        ),
    ),
    "kmeans_two_level": (two_level, None),
    "kmeans_rules": (leaf_rules, "SELECT vec_id AS row_id, true AS in_one_parent, true AS nearest, true AS small_whole, true AS cheapest FROM embeddings"),
    "kmeans_feature_table": (leaf_spread, None),
    "cluster_centers": (
        centers,
        t.with_ctes(*PTS, body="SELECT cluster, count(*) AS length, round(avg(dim1), 6) AS center_x, round(avg(dim2), 6) AS center_y FROM points GROUP BY 1"),
    ),
    "cluster_props": (
        properties,
        t.with_ctes(*PTS, body="SELECT cluster, round(avg(GRAVY), 6) AS GRAVY, round(avg(BULK), 6) AS BULK FROM points GROUP BY 1"),
    ),
    "composition": (letters, t.with_ctes(*PTS, LOGO, body="SELECT cluster, length, letter, round(freq, 6) AS freq FROM logo")),
    "letter_map": (letter_map, t.with_ctes(*PTS, LOGO, body="SELECT cluster, length, letter, n FROM tally JOIN sizes USING (cluster)")),
    "pairwise_condensed": (
        pairwise,
        t.with_ctes(
            *PTS,
            MEANS,
            body="SELECT p.cluster AS a, q.cluster AS b, round(abs(p.GRAVY - q.GRAVY), 6) AS distance FROM means p JOIN means q ON p.cluster < q.cluster",
        ),
    ),
    "pairwise_segments": (
        pairwise_customers,
        """WITH m AS (SELECT c_mktsegment AS s, avg(c_acctbal) AS v FROM customer GROUP BY 1)
SELECT p.s AS a, q.s AS b, round(p.v, 6) AS balance_a, round(q.v, 6) AS balance_b FROM m p JOIN m q ON p.s < q.s""",
    ),
    "cluster_pairs": (
        pairs,
        t.with_ctes(
            *PTS,
            LOGO,
            MEANS,
            "spelling AS (SELECT cluster, list(freq ORDER BY letter) AS f FROM logo GROUP BY cluster)",
            "full_means AS (SELECT * FROM means JOIN spelling USING (cluster))",
            body="""SELECT p.cluster AS a, q.cluster AS b, round(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), 6) AS CM,
round(list_distance(p.f, q.f), 6) AS logo, round(abs(p.GRAVY - q.GRAVY), 6) AS GRAVY, round(abs(p.BULK - q.BULK), 6) AS BULK
FROM full_means p JOIN full_means q ON p.cluster < q.cluster""",
        ),
    ),
    "pooled_variance": (variance, _variance_sql(f"{t.VECTORS}, {t.POINTS}, src AS (SELECT * FROM points),", "GRAVY", "cluster")),
    "pooled_variance_orders": (variance_orders, _variance_sql("src AS (SELECT o_custkey, o_totalprice / 1000 AS price FROM orders),", "price", "o_custkey")),
    "mean_abs_diff": (
        distance_all,
        t.with_ctes(
            *PTS,
            body="SELECT a.row_id, round(a.GRAVY, 6) AS GRAVY, round(avg(abs(a.GRAVY - b.GRAVY)), 6) AS mean_distance FROM points a, points b GROUP BY a.row_id, a.GRAVY",
        ),
    ),
    "mean_abs_diff_cluster": (
        distance_within,
        t.with_ctes(
            *PTS,
            body="""SELECT a.row_id, a.cluster, round(a.GRAVY, 6) AS GRAVY, round(avg(abs(a.GRAVY - b.GRAVY)), 6) AS mean_distance
FROM points a JOIN points b ON a.cluster = b.cluster GROUP BY a.row_id, a.cluster, a.GRAVY""",
        ),
    ),
    "mean_abs_diff_lines": (
        distance_quantity,
        """WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT a.l_returnflag, a.l_quantity, round(sum(abs(a.l_quantity - b.l_quantity) * b.n) / sum(b.n), 6) AS mean_distance, a.n
FROM c a JOIN c b ON a.l_returnflag = b.l_returnflag GROUP BY 1, 2, a.n""",
    ),
    "percent_scale": (
        scaled,
        t.with_ctes(
            *PTS,
            body="""SELECT row_id, round(GRAVY, 6) AS GRAVY,
round((GRAVY - min(GRAVY) OVER ()) * 100.0 / (max(GRAVY) OVER () - min(GRAVY) OVER ()), 6) AS scaled FROM points""",
        ),
    ),
    "moran_band": (
        moran,
        _moran_sql(f"{t.VECTORS}, {t.POINTS}, src AS (SELECT * FROM points),", "dim1", "dim2", PROPERTIES, (0.02, 0.1, 0.3)),
    ),
    "moran_parts": (
        moran_parts,
        _moran_sql("src AS (SELECT p_size, p_retailprice / 10 AS price, length(p_name) AS length FROM part),", "p_size", "price", ("length",), (1.0, 3.0)),
    ),
    "knn_weights": (
        weights,
        t.with_ctes(
            *PTS,
            "placed AS (SELECT row_id, [dim1, dim2] AS p FROM points)",
            body="""SELECT a.row_id, b.row_id AS neighbor, 1.0::DOUBLE AS weight FROM placed a JOIN placed b ON a.row_id <> b.row_id
QUALIFY row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.p, b.p), b.row_id) <= 2""",
        ),
    ),
}
