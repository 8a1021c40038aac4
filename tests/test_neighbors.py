import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from junctura.operators import neighbors as N
from junctura.operators import neighborhoods as H


def table(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in v]) for i, v in enumerate(vectors)], "row_id long, vec array<double>")


def brute_self(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = {}
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], j))[:k]
        out[i] = [i, *order]
    return out, d


def lists(df):
    out = {}
    for r in df.orderBy("row_id", "rank").collect():
        out.setdefault(r.row_id, []).append(r.neighbor)
    return out


def test_four_points(spark):
    points = table(spark, [(0, 0, 0), (1, 0, 0), (0, 0, 1), (0.1, 0.1, 0.1)])
    got = N.knn_self(points, 2)
    assert lists(got) == {0: [0, 3, 1], 1: [1, 3, 0], 2: [2, 3, 0], 3: [3, 0, 1]}
    dist = {(r.row_id, r["rank"]): r.dist for r in got.collect()}
    assert dist[0, 0] == 0 and math.isclose(dist[0, 1], 0.173205, abs_tol=1e-6) and math.isclose(dist[1, 1], 0.911043, abs_tol=1e-6)


def test_fewer_rows_than_k(spark):
    got = lists(N.knn_self(table(spark, [(0, 0), (1, 0), (5, 0)]), 100))
    assert got == {0: [0, 1, 2], 1: [1, 0, 2], 2: [2, 1, 0]}


def test_no_rows(spark):
    empty = table(spark, [(0, 0)]).limit(0)
    assert N.knn_self(empty, 3).count() == 0
    assert N.knn_join(table(spark, [(0, 0)]), empty, 3).count() == 0


@pytest.fixture
def small_blocks(monkeypatch):
    """Many cells, many blocks, small tiles: every branch of the join on little data."""
    monkeypatch.setattr(N, "CELL_ROWS", 25)
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    monkeypatch.setattr(N, "TILE_ROWS", 7)
    monkeypatch.setattr(N, "TILE_BYTES", 4000)


def clustered(seed, n=260, d=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * 0.3 + rng.integers(0, 4, size=(n, 1)) * 3
    x[: n // 3] = x[0]  # a third of all rows are copies
    x[n // 3 : n // 3 + 20] = np.round(x[n // 3 : n // 3 + 20])  # ties
    return x


@pytest.mark.parametrize("seed", [0, 1])
def test_exact_in_many_cells_with_copies(spark, small_blocks, seed):
    x = clustered(seed)
    expected, _ = brute_self(x, 6)
    assert lists(N.knn_self(table(spark, x).repartition(5), 6)) == expected


def evenly(n=400, d=8):
    return np.random.default_rng(5).normal(size=(n, d))


def test_a_query_goes_once_to_a_block_of_cells(spark, monkeypatch):
    """On vectors that no pivot tells apart, a query is sent to fewer places than there are cells."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 150)
    sent, spread = [], N._compare
    monkeypatch.setattr(N, "_compare", lambda q, *rest, **kw: sent.append(q.count()) or spread(q, *rest, **kw))
    x = evenly()
    expected, _ = brute_self(x, 6)
    assert lists(N.knn_self(table(spark, x).repartition(5), 6, cell_rows=8)) == expected
    assert sent[0] == 400 and sent[1] <= 3 * 400  # by cells some fifty times


def test_rows_meet_the_pivots_a_tile_at_a_time(spark, monkeypatch):
    most, measured = N.TILE_BYTES // 8, N._pivot_distances

    def watched(a, b):
        assert len(a) * len(b) <= most
        return measured(a, b)

    monkeypatch.setattr(N, "_pivot_distances", watched)
    x = evenly(9000, 4)
    got = N._assign(table(spark, x).coalesce(1), x[:400]).select("row_id", "cell").toPandas().set_index("row_id").cell
    assert (got.sort_index().to_numpy() == ((x[:, None] - x[None, :400]) ** 2).sum(-1).argmin(1)).all()


def test_join_of_two_tables(spark, small_blocks):
    a, b = clustered(2, 60), clustered(3, 150)
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    expected = {i: sorted(range(150), key=lambda j: (d[i, j], j))[:4] for i in range(60)}
    got = lists(N.knn_join(table(spark, a), table(spark, b), 4))
    assert got == expected


def test_a_query_goes_only_where_its_own_bound_reaches(spark, small_blocks):
    """Of well separated groups nearly no pair across groups is compared, and the lists are exact."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 6)) + rng.integers(0, 8, size=(400, 1)) * 40
    rows = table(spark, x).selectExpr("row_id as gid", "vec", "array(row_id) as ids").cache()
    pairs = {}
    got = N._group_lists(rows, rows, 6, pairs=pairs).collect()
    expected, _ = brute_self(x, 5)
    assert {r.gid: [n.neighbor for n in r.near] for r in got} == expected
    assert pairs["own"] + pairs["other"] < 400 * 400 / 3


def test_rows_whose_own_cell_is_too_small(spark, small_blocks):
    """More neighbours than a cell has rows: every other cell is asked."""
    x = clustered(6, 90)
    expected, _ = brute_self(x, 70)
    assert lists(N.knn_self(table(spark, x), 70)) == expected


def test_hashed_lists(spark, small_blocks):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16)) * 0.4 + rng.normal(size=(30, 16))[rng.integers(0, 30, 300)] * 2
    x[:100] = x[0]  # a third of all rows in one bucket
    expected, d = brute_self(x, 5)
    got = N.knn_hashed(table(spark, x), 5)
    for r in got.collect():
        assert math.isclose(r.dist, d[r.row_id, r.neighbor], abs_tol=1e-9)
    exact = N.knn_self(table(spark, x), 5)
    counted = N.list_recall(got, exact).agg(F.sum("hit"), F.sum("wanted")).first()
    assert counted[0] >= 0.95 * counted[1] and counted[1] == 1500
    asked = N.knn_hashed(table(spark, x), 5, asked=F.col("row_id") % 50 == 0)
    assert {r.row_id for r in asked.collect()} == set(range(0, 300, 50))
    assert N.knn_hashed(table(spark, x).limit(0), 5).count() == 0


def test_approximate_lists(spark, small_blocks):
    x = clustered(5, 120)
    expected, d = brute_self(x, 5)
    assert lists(N.knn_approximate(table(spark, x), 5, cells=4, probes=4)) == expected
    some = N.knn_approximate(table(spark, x), 5, cells=8, probes=1).collect()
    for r in some:
        assert math.isclose(r.dist, d[r.row_id, r.neighbor], abs_tol=1e-9)
        assert r["rank"] > 0 or r.neighbor == r.row_id
    assert {r.row_id for r in some} == set(range(120))
    assert N.knn_approximate(table(spark, x).limit(0), 5).count() == 0


@pytest.mark.parametrize("limit", [N.BROADCAST_BYTES, 0])
def test_radius_join_is_inclusive_and_exact(spark, small_blocks, limit):
    x = clustered(4)
    near = N.knn_self(table(spark, x), 6)
    picks = [3, 100, 200, 259]
    features = N.neighbour_radius(near).where(F.col("row_id").isin(picks)).join(table(spark, x), "row_id").select(
        F.col("row_id").alias("feature_index"), "max_distance", F.col("vec").alias("center")
    )
    radius = {r.feature_index: r.max_distance for r in features.collect()}
    got = {(r.row_id, r.feature) for r in N.radius_join(table(spark, x), features, limit).collect()}
    for f in picks:
        inside = {i for i in range(len(x)) if math.sqrt(sum((a - b) ** 2 for a, b in zip(x[i], x[f]))) <= radius[f] + 1e-15}
        assert {i for i, g in got if g == f} == inside
        assert {j for r, j in [(f, n) for n in lists(near)[f]]} <= inside  # the farthest neighbour is inside


def test_radius_join_without_features(spark):
    x = table(spark, [(0, 0)])
    features = spark.createDataFrame([], "feature_index long, max_distance double, center array<double>")
    assert N.radius_join(x, features).count() == 0


def test_nearest_center(spark):
    centers = spark.createDataFrame([(7, [0.0, 0.0]), (3, [4.0, 0.0])], "center_id long, center array<double>")
    got = {r.row_id: r.center_id for r in N.nearest_center(table(spark, [(1, 0), (3, 0), (2, 0)]), centers).collect()}
    assert got == {0: 7, 1: 3, 2: 3}  # a tie goes to the lower id


def test_share_counts_subjects_not_rows(spark):
    near = spark.createDataFrame([(0, r, n, 0.0) for r, n in enumerate([0, 1, 2, 3])], "row_id long, rank int, neighbor long, dist double")
    data = spark.createDataFrame([(0, "s1", "HC"), (1, "s1", "HC"), (2, "s2", "CD"), (3, "s3", "HC")], "row_id long, FILENAME string, labels string")
    shares = {r.label: r.share for r in H.neighbourhood_stats(near, data).collect()}
    assert math.isclose(shares["HC"], 2 / 3) and math.isclose(shares["CD"], 1 / 3)
    row = H.label_share(near, data, "HC").first()
    assert row.how_many_subjects == 3 and math.isclose(row.share, 2 / 3)
    assert H.label_share(near, data, "none").first().share == 0.0
    assert H.neighbour_lists(near, data).first().neighbors == [0, 1, 2, 3]


def neighbour_table(spark, lists_):
    return spark.createDataFrame(
        [(r, i, n, float(i)) for r, ns in lists_.items() for i, n in enumerate(ns)], "row_id long, rank int, neighbor long, dist double"
    )


def test_greedy_example(spark):
    near = neighbour_table(spark, {0: [0, 1], 1: [1, 2], 2: [2, 3], 3: [3, 0], 4: [4, 0]})
    shares = spark.createDataFrame(
        [(0, 20, 0.90), (1, 20, 0.15), (2, 20, 0.80), (3, 20, 0.80), (4, 20, 0.55)], "row_id long, how_many_subjects long, share double"
    )
    found = H.candidates(shares, 0.6, 10)
    assert sorted(r.row_id for r in found.collect()) == [0, 1, 2, 3]
    chosen = H.select_non_overlapping(found, near)
    assert sorted(r.row_id for r in chosen.collect()) == [0, 2]
    owners = {r.row_id: r.feature for r in H.feature_owner(chosen, near).collect()}
    assert owners == {0: 0, 1: 0, 2: 2, 3: 2}
    sweep = {r.threshold: (r.gross, r.net) for r in H.threshold_sweep(found, chosen, [0.6, 0.82]).collect()}
    assert sweep == {0.6: (4, 2), 0.82: (2, 1)}


def test_candidate_limits_are_strict(spark):
    shares = spark.createDataFrame([(0, 10, 0.9), (1, 11, 0.6), (2, 11, 0.3)], "row_id long, how_many_subjects long, share double")
    assert [r.row_id for r in H.candidates(shares, 0.6, 10).collect()] == [2]


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_chain_takes_few_jobs(spark):
    """20,000 candidates of one significance, each listing the next: every other one is selected."""
    n = 20_000
    found = spark.range(n).selectExpr("id as row_id", "0.7D as significance")
    near = spark.range(n).selectExpr("id as row_id", "id + 1 as neighbor")
    chosen, count = jobs(spark, "chain", lambda: sorted(r.row_id for r in H.select_non_overlapping(found, near).collect()))
    assert chosen == list(range(0, n, 2)) and count <= 30


@pytest.mark.parametrize("walked", [H.WALKED, 40, 7])
@pytest.mark.parametrize("seed", range(2))
def test_greedy_equals_the_walk(spark, seed, walked):
    rng = np.random.default_rng(seed)
    n = 150
    significance = np.round(rng.uniform(0.6, 0.9, n), 2)  # many ties
    hub = 0  # listed by everybody
    near = {i: [i, hub, *map(int, rng.choice(n, 5))] for i in range(n)}
    owner, chosen = {}, set()
    for i in sorted(range(n), key=lambda i: (-significance[i], i)):
        if i not in owner:
            chosen.add(i)
            for j in near[i]:
                owner[j] = i
    found = spark.createDataFrame([(i, float(significance[i])) for i in range(n)], "row_id long, significance double")
    table_ = neighbour_table(spark, near).dropDuplicates(["row_id", "neighbor"])
    got = H.select_non_overlapping(found, table_, walked)
    assert {r.row_id for r in got.collect()} == chosen
    assert {r.row_id: r.feature for r in H.feature_owner(got, table_).collect()} == owner


def test_nothing_to_select(spark):
    found = spark.createDataFrame([], "row_id long, significance double")
    assert H.select_non_overlapping(found, neighbour_table(spark, {0: [0]})).count() == 0


def test_radius_feature_table_keeps_empty_subjects(spark):
    vectors = table(spark, [(0, 1), (2, 0), (3, 3)])
    data = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B")], "row_id long, FILENAME string")
    features = spark.createDataFrame([(9, 1.0, [0.0, 0.0])], "feature_index long, max_distance double, center array<double>")
    got = {r.FILENAME: (r.feature, r.n, r.freq) for r in H.radius_feature_table(vectors, data, features).collect()}
    assert got == {"A": (9, 1, 1.0), "B": (None, 0, None)}
    assert H.multiple_hits(N.radius_join(vectors, features)).first().asDict() == {"rows_hit": 1, "rows_hit_many": 0}


def test_lists_of_all_folds_come_from_one_search(spark, monkeypatch):
    """The lists are those of a search within each fold's training rows, also where a fold holds a row's whole surroundings."""
    rng = np.random.default_rng(11)
    points = np.vstack([rng.normal(size=(60, 3)), np.repeat(rng.normal(size=(4, 3)), 5, axis=0), 0.01 * rng.normal(size=(60, 3)) + 9])
    fold = [*rng.integers(0, 3, 80).tolist(), *[0] * 58, 1, 2]
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "row_id long, vec array<double>")
    folds = spark.createDataFrame(list(enumerate(fold)), "row_id long, fold int")
    searched = []
    monkeypatch.setattr(N, "knn_self", lambda rows, k, real=N.knn_self: searched.append(k) or real(rows, k))
    found = N.knn_folds(vectors, folds, 4, 3)
    assert len(searched) == 1 and len(found) == 3
    monkeypatch.undo()
    for number, lists in enumerate(found):
        train = vectors.join(folds.where(f"fold <> {number}"), "row_id", "left_semi")
        want = {(r.row_id, r.rank): (r.neighbor, round(r.dist, 9)) for r in N.knn_self(train, 4).collect()}
        assert {(r.row_id, r.rank): (r.neighbor, round(r.dist, 9)) for r in lists.collect()} == want


def _brute(a, b, k):
    dist = np.sqrt(((a[:, None, :] - b[None]) ** 2).sum(axis=2))
    return [[(j, dist[i, j]) for j in np.lexsort((np.arange(len(b)), dist[i]))[:k]] for i in range(len(a))]


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1.0, 1e4), (1e-18, 0.0), (1e20, 0.0), (1e150, 0.0)])
def test_rough_comparison_in_single_precision_loses_no_neighbour(monkeypatch, scale, offset):
    """Few pairs are measured exactly, and the lists are those of all pairs, ties by id included."""
    monkeypatch.setattr(N, "SLICE_ROWS", 64)
    rng = np.random.default_rng(5)
    b = rng.integers(-3, 4, (400, 6)) * scale + offset  # whole numbers: many ties
    a = b[:90]
    measured = []
    monkeypatch.setattr(N, "pair_distances", lambda x, y, run=N.pair_distances: measured.append(len(x)) or run(x, y))
    queries, data = pd.DataFrame({"gid": range(90), "vec": list(a)}), pd.DataFrame({"vec": list(b), "ids": [[i] for i in range(400)]})
    found = N._nearest_in_block(7)(queries, data).sort_values(["gid", "dist", "neighbor"])
    assert [g["neighbor"].tolist() for _, g in found.groupby("gid")] == [[j for j, _ in row] for row in _brute(a, b, 7)]
    assert sum(measured) < 90 * 400 / 2
    limit = np.array([row[4][1] for row in _brute(b, b, 5)])
    hits = pd.concat(N._hits(queries.rename(columns={"gid": "row_id"}), np.arange(400), b, limit, "row_id"))
    wanted = {(i, j) for i in range(90) for j in range(400) if N.pair_distances(a[i : i + 1], b[j : j + 1])[0] <= limit[j]}
    assert set(zip(hits["row_id"], hits["feature"])) == wanted and len(hits) == len(wanted)


def test_folds_take_radius_hits_from_the_lists_of_their_search(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.integers(0, 5, 3)]) for i in range(300)], "row_id long, vec array<double>")
    lists = N.knn_self(vectors, 40).cache()
    # some reach less far than their list, some to its end or beyond it
    features = N.neighbour_radius(lists.where("rank <= 6 + row_id % 40")).join(vectors, "row_id").selectExpr("row_id feature_index", "max_distance", "vec center")
    seen = vectors.where("row_id % 3 > 0")
    plain = N.radius_join(seen, features)
    met = []
    monkeypatch.setattr(N, "radius_join", lambda v, f, *x, run=N.radius_join, **y: met.append(f.count()) or run(v, f, *x, **y))
    found = N.radius_join(seen, features, lists=lists)
    assert found.exceptAll(plain).count() == plain.exceptAll(found).count() == 0
    assert met[0] == 300 and 0 < met[1] < 200
