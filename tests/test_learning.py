import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.operators import classify as K
from junctura.operators import evaluate as E
from junctura.operators import splits as S
from junctura.operators import labels as L
from junctura.operators import metrics as M
from junctura.operators.sampling import subject_folds
from junctura.schemas import SchemaMismatch


@pytest.fixture(scope="module")
def predictions(spark):
    return spark.createDataFrame(list(zip([0, 0, 1, 1, 1], [0, 1, 1, 1, 0])), "actual int, predicted int")


def test_confusion_and_scores(predictions):
    cells = {(r.actual, r.predicted): (r.n, r.share) for r in M.confusion_matrix(predictions).collect()}
    assert cells[0, 0] == (1, 0.5) and cells[0, 1] == (1, 0.5) and cells[1, 0][0] == 1 and cells[1, 1][0] == 2
    assert math.isclose(cells[1, 1][1], 2 / 3)
    s = M.binary_scores(predictions, 1).first()
    assert math.isclose(s.accuracy, 0.6) and all(math.isclose(v, 2 / 3) for v in (s.precision, s.recall, s.f1))
    report = {r["class"]: r for r in M.class_report(predictions).collect()}
    assert report["1"].support == 3 and math.isclose(report["0"].precision, 0.5) and report["macro avg"].support == 5
    assert math.isclose(report["macro avg"].f1, (0.5 + 2 / 3) / 2)


def test_scores_without_positives(spark):
    s = M.binary_scores(spark.createDataFrame([(0, 0)], "actual int, predicted int"), 1).first()
    assert (s.accuracy, s.f1, s.precision, s.recall) == (1.0, 0.0, 0.0, 0.0)


def test_coefficients(spark):
    rows = spark.createDataFrame([(0, 0, 1.0), (1, 0, -4.0), (0, 1, 2.0), (0, 2, -3.0)], "split int, position int, coef double")
    top = M.top_coefficients(M.coefficient_sums(rows), 2).collect()
    assert [(r.position, r.coef) for r in top] == [(0, -3.0), (2, -3.0)]


def test_label_lookup(spark):
    table = spark.createDataFrame([("CI1",), ("C2",)], "SUBJECT string")
    dictionary = spark.createDataFrame([("CI1", "CI"), ("C2", "C")], "observation string, label string")
    got = {r.SUBJECT: r.labels for r in L.add_labels(table, dictionary, "observation", "label").collect()}
    assert got == {"CI1": "CI", "C2": "C"}
    with pytest.raises(SchemaMismatch, match="no label"):
        L.add_labels(table, dictionary.limit(1), "observation", "label")
    assert L.add_labels(table, dictionary.limit(1), "observation", "label", on_missing="drop").count() == 1
    twice = spark.createDataFrame([(0, "CI1", "old"), (1, "CI1", "new"), (2, "C2", "C")], "i int, observation string, label string")
    with pytest.raises(SchemaMismatch, match="several"):
        L.add_labels(table, twice, "observation", "label")
    last = {r.SUBJECT: r.labels for r in L.add_labels(table, twice, "observation", "label", order="i").collect()}
    assert last["CI1"] == "new"
    with pytest.raises(SchemaMismatch, match="missing column"):
        L.add_labels(table, dictionary, "nothing", "label")


def test_subject_with_two_labels(spark):
    with pytest.raises(SchemaMismatch):
        L.subject_labels(spark.createDataFrame([("s", "a"), ("s", "b")], "s string, l string"), "s", "l")


def test_classes_and_weights(spark):
    table = spark.createDataFrame([("SC",), ("C",), ("CI",), ("C",), (None,)], "l string")
    assert {r.l: r["class"] for r in L.class_numbers(table, "l").collect()} == {"C": 0, "CI": 1, "SC": 2}
    assert L.number_classes(table, "l").where("class IS NULL").count() == 1
    weights = {r.l: r.weight for r in L.balanced_weights(table.where("l IS NOT NULL"), "l").collect()}
    assert math.isclose(weights["C"], 4 / 6) and math.isclose(weights["SC"], 4 / 3)
    assert L.drop_class(table, "l", "C").count() == 2


def blobs(spark, classes=2, n=40, d=4, seed=0, gap=2.5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n * classes):
        c = i % classes
        x = rng.normal(size=d)
        x[c % d] += gap
        rows.append((i, [float(v) for v in x], c))
    return spark.createDataFrame(rows, "row_id long, features array<double>, class int")


@pytest.fixture(scope="module")
def two(spark):
    return blobs(spark).cache()


@pytest.fixture(scope="module")
def three(spark):
    return blobs(spark, 3, gap=4.0).cache()


@pytest.mark.parametrize("name", ["LR", "RLR", "DT", "kNN", "LSVM", "RF", "MLP", "NB", "QDA", "LDA", "RT"])
def test_classifier_learns_two_classes(two, name):
    said = K.make_classifier(name).fit(two).transform(two)
    assert set(said.columns) == {"row_id", "features", "class", "predicted"}
    assert M.accuracy(said.withColumnRenamed("class", "actual")).first().accuracy > 0.8


@pytest.mark.parametrize("name, parameters", [("LR", {}), ("kNN", {}), ("LDA", {}), ("QDA", {}), ("NB", {})])
def test_classifier_learns_three_classes(three, name, parameters):
    said = K.make_classifier(name, **parameters).fit(three).transform(three)
    assert M.accuracy(said.withColumnRenamed("class", "actual")).first().accuracy > 0.85


def test_boosting_beats_a_stump(two):
    def score(name, **p):
        said = K.make_classifier(name, **p).fit(two).transform(two)
        return M.accuracy(said.withColumnRenamed("class", "actual")).first().accuracy

    assert score("Adaboost", rounds=8, cut_every=3) > score("DT", max_depth=1)


def test_rbf_svm_separates_a_ring(spark):
    rng = np.random.default_rng(1)
    angle = rng.uniform(0, 2 * math.pi, 160)
    radius = np.where(np.arange(160) % 2 == 0, 0.4, 1.6)
    rows = [(i, [float(radius[i] * math.cos(angle[i])), float(radius[i] * math.sin(angle[i]))], i % 2) for i in range(160)]
    table = spark.createDataFrame(rows, "row_id long, features array<double>, class int")
    said = K.make_classifier("RBF_SVM").fit(table).transform(table)
    assert M.accuracy(said.withColumnRenamed("class", "actual")).first().accuracy > 0.95


@pytest.mark.parametrize("pooled", [False, True])
def test_discriminants_against_numpy(three, pooled):
    rows = three.orderBy("row_id").collect()
    x, y = np.array([r.features for r in rows]), np.array([r["class"] for r in rows])
    means = [x[y == c].mean(0) for c in range(3)]
    covs = [np.cov(x[y == c].T) for c in range(3)]
    if pooled:
        shared = sum(c * (sum(y == i) - 1) for i, c in enumerate(covs)) / (len(y) - 3)
        covs = [shared] * 3
    score = np.stack(
        [
            math.log((y == c).mean()) - 0.5 * np.linalg.slogdet(covs[c])[1]
            - 0.5 * np.einsum("ij,jk,ik->i", x - means[c], np.linalg.inv(covs[c]), x - means[c])
            for c in range(3)
        ],
        axis=1,
    )
    said = K.Discriminant(pooled=pooled).fit(three.repartition(5)).transform(three).orderBy("row_id").collect()
    assert [r.predicted for r in said] == score.argmax(1).tolist()


def test_knn_vote_tie_goes_to_the_smaller_class(spark):
    train = spark.createDataFrame([(0, [0.0], 2), (1, [1.0], 1)], "row_id long, features array<double>, class int")
    test = spark.createDataFrame([(9, [0.1])], "row_id long, features array<double>")
    assert K.NearestNeighbours(k=2).fit(train).transform(test).first().predicted == 1


def test_names():
    assert K.canonical_name("Naive_bayes") == "NB" and K.canonical_name("k-NN") == "kNN"
    with pytest.raises(ValueError, match="unknown classifier"):
        K.make_classifier("Gaussian")
    assert set(K.ALIASES) == set(K.FACTORIES)


def test_feature_matrix(spark):
    table = spark.createDataFrame([("A", 5, 0.25), ("A", 9, 0.75), ("B", 9, 1.0), ("C", None, None)], "s string, feature long, freq double")
    matrix, order = E.feature_matrix(table, "s")
    assert order == [5, 9]
    assert {r.s: r.features for r in matrix.collect()} == {"A": [0.25, 0.75], "B": [0.0, 1.0], "C": [0.0, 0.0]}
    other, _ = E.feature_matrix(table.where("s = 'B'"), "s", [9, 5, 7])
    assert other.first().features == [1.0, 0.0, 0.0]
    numbered, classes = E.labelled_matrix(matrix.withColumn("labels", F.when(F.col("s") == "A", "HC").otherwise("CD")))
    got = {r.s: r["class"] for r in numbered.collect()}
    assert classes == ["CD", "HC"] and got == {"A": 1, "B": 0, "C": 0}
    ids = {r.s: r.row_id for r in numbered.repartition(3).collect()}
    assert sorted(ids.values()) == [0, 1, 2] and ids == {r.s: r.row_id for r in numbered.collect()}


def test_repeated_evaluation(two):
    train, verify = two.where("row_id < 60"), two.where("row_id >= 60")
    found = E.run_classifier(train, "LR", 3, 0.2, verify=verify)
    assert found.predictions.count() == 36 and found.verification.count() == 60
    assert found.scores().first().accuracy > 0.7 and found.verification_scores().first().accuracy > 0.7
    assert M.coefficient_sums(found.coefficients).count() == 4
    assert E.run_classifier(train, "NB", 1).verification is None
    assert E.run_classifier(train, "NB", 18).predictions.count() == 18 * 12


def told(found):
    return {(r.split, r.row_id): (r.actual, r.predicted) for r in found.collect()}


def one_by_one(table, model, repeats, verify=None, **parameters):
    """A fit per split of its training rows, the definition that the grouped paths are held against."""
    rows = S.held_out(table, repeats, 0.2, 0)
    others = None if verify is None else S.on_all(verify, repeats)
    return S.fitted_on_splits(rows, others, K.make_classifier(model, **parameters), repeats, model in ("LR", "RLR"))


@pytest.mark.parametrize("curvature", [1 << 26, 600])
def test_regression_on_splits_is_sparks(two, monkeypatch, curvature):
    monkeypatch.setattr(S, "CURVATURE_BYTES", curvature)  # 600: two splits at a time
    train, verify = two.where("row_id < 60"), two.where("row_id >= 60")
    grouped = E.run_classifier(train, "RLR", 4, verify=verify)
    tested, checked, coefs = one_by_one(train, "RLR", 4, verify)
    assert told(grouped.predictions) == told(tested) and told(grouped.verification) == told(checked)
    mine = {(r.split, r["class"], r.position): r.coef for r in grouped.coefficients.collect()}
    assert mine.keys() == {c[:3] for c in coefs} and all(abs(mine[c[:3]] - c[3]) < 1e-3 for c in coefs)


def three_classes(spark, n=90):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 3)) + 1.2 * np.eye(3)[y]
    return spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y))], "row_id long, features array<double>, class int")


@pytest.mark.parametrize("part_rows", [65_536, 5])
@pytest.mark.parametrize("model", ["LDA", "QDA"])
def test_discriminants_on_splits(spark, monkeypatch, model, part_rows):
    monkeypatch.setattr(S, "PART_ROWS", part_rows)
    table = three_classes(spark)
    train, verify = table.where("row_id < 70"), table.where("row_id >= 70")
    grouped = E.run_classifier(train, model, 3, verify=verify)
    tested, checked, _ = one_by_one(train, model, 3, verify)
    assert told(grouped.predictions) == told(tested) and told(grouped.verification) == told(checked)


def test_a_class_that_a_split_tests_whole(spark):
    """Two rows of class 2: a split that tests both trains without it."""
    rows = [(i, [float(i % 7), float(i % 5), float(i % 2 * 3)], i % 2) for i in range(28)] + [(28, [9.0, 9.5, 1.0], 2), (29, [8.0, 9.0, 2.0], 2)]
    table = spark.createDataFrame(rows, "row_id long, features array<double>, class int")
    found = E.run_classifier(table, "LDA", 40).predictions
    whole = found.groupBy("split").agg(F.count_if(F.col("actual") == 2).alias("n"), F.count_if(F.col("predicted") == 2).alias("said"))
    assert whole.where("n = 2").count() > 0 and whole.where("n = 2 and said > 0").count() == 0


def test_neighbours_on_splits(spark, monkeypatch):
    table = three_classes(spark)
    train, verify = table.where("row_id < 70"), table.where("row_id >= 70")
    tested, checked, _ = one_by_one(train, "kNN", 3, verify, k=5)
    grouped = E.run_classifier(train, "kNN", 3, verify=verify, k=5)
    assert told(grouped.predictions) == told(tested) and told(grouped.verification) == told(checked)
    # lists that are too short at first give the same votes
    short = S._voted(S.held_out(train, 3, 0.2, 0), S.held_out(train, 3, 0.2, 0), 5, 3, 70, True)
    assert told(short) == told(tested)


def test_a_list_of_neighbours_is_not_repeated_for_each_split(spark, monkeypatch):
    rows = S.held_out(three_classes(spark), 3, 0.2, 0)
    plans, cut = [], S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut(df))
    monkeypatch.setattr(S, "SAID_ROWS", 7)
    assert S._voted(rows, rows, 5, 90, 90, True).count() == 3 * 18
    assert plans and not any("explode(tests" in plan for plan in plans)


def test_mapped_features_are_made_a_few_rows_at_a_time(spark, monkeypatch):
    kernel = K.RandomFourierSVM()
    x = np.random.default_rng(1).normal(size=(50, 3))
    table = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "row_id long, features array<double>, class int").coalesce(1)
    monkeypatch.setattr(K, "LIFTED_BYTES", 8 * 200 * 7)
    mapped = kernel.mapped

    def watched(rows, directions):
        assert len(rows) <= 7
        return mapped(rows, directions)

    monkeypatch.setattr(kernel, "mapped", watched, raising=False)
    got = {r.row_id: r.features for r in kernel.lift(table, 3, 200).collect()}
    assert np.allclose([got[i] for i in range(50)], mapped(x, kernel.directions(3, 200)))


def test_bayes_on_splits_stores_no_copy_of_a_row(spark, monkeypatch):
    table = three_classes(spark)
    train, verify = table.where("row_id < 70"), table.where("row_id >= 70")
    tested, checked, _ = one_by_one(train, "NB", 3, verify)
    stored = []
    monkeypatch.setattr(S, "CURVATURE_BYTES", 300)
    monkeypatch.setattr(S, "SAID_ROWS", 5)
    for module in (S, E):
        monkeypatch.setattr(module, "cut_lineage", lambda df: stored.append(df.count()) or df)
    grouped = E.run_classifier(train, "NB", 3, verify=verify)
    assert told(grouped.predictions) == told(tested) and told(grouped.verification) == told(checked)
    assert max(stored) == 70


@pytest.mark.parametrize("model", ["LDA", "kNN", "LR"])
def test_jobs_do_not_grow_with_the_splits(spark, two, model):
    def jobs(repeats):
        group = f"{model}-{repeats}"
        spark.sparkContext.setJobGroup(group, group)
        E.run_classifier(two, model, repeats).predictions.count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, many = jobs(2), jobs(60)
    assert many <= few * (1.5 if model == "LR" else 1.0) + 6  # the slowest of more regressions may take some steps more


def test_a_thousand_splits_without_a_run_for_each(two, monkeypatch):
    monkeypatch.setattr(E, "make_classifier", None)
    _, found = E.two_stage_regression(two, top=2)
    assert found.predictions.select("split").distinct().count() == 1000 and found.predictions.count() == 16_000


def test_trees_run_split_by_split(two):
    found = E.run_classifier(two, "DT", 18).predictions
    assert found.count() == 18 * 16 and M.binary_scores(found, 1).first().accuracy > 0.7


@pytest.mark.parametrize("curvature, depth", [(1 << 26, 5), (9_000, 2)])
def test_trees_on_splits_are_sparks(spark, monkeypatch, curvature, depth):
    """Ties, values that only some splits train with, three classes; more values than bins in the second column."""
    monkeypatch.setattr(S, "CURVATURE_BYTES", curvature)
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 110)
    x = np.column_stack([rng.integers(0, 9, 110) + 2.0 * y, rng.normal(size=110) + y, np.zeros(110), rng.integers(0, 4, 110) / 3])
    table = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y))], "row_id long, features array<double>, class int")
    train, verify = table.where("row_id < 80"), table.where("row_id >= 80")
    tested, checked, _ = one_by_one(train, "DT", 10, verify, max_depth=depth)
    monkeypatch.setattr(E, "make_classifier", None)
    grouped = E.run_classifier(train, "DT", 10, verify=verify, max_depth=depth)
    assert told(grouped.predictions) == told(tested) and told(grouped.verification) == told(checked)


@pytest.mark.parametrize("model", ["DT", "RLR"])
def test_few_rows_of_many_columns_on_splits(spark, monkeypatch, model):
    rng = np.random.default_rng(3)
    x = np.where(rng.random((20, 60)) < 0.4, rng.random((20, 60)), 0.0)
    table = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "row_id long, features array<double>, class int").cache()
    tested, _, coefs = one_by_one(table, model, 12)
    widths = []
    newton = S._newton
    monkeypatch.setattr(S, "_newton", lambda rows, width, *rest: widths.append(width) or newton(rows, width, *rest))
    grouped = E.run_classifier(table, model, 12)
    assert told(grouped.predictions) == told(tested)
    if model == "RLR":
        assert widths == [21]
        mine = {(r.split, r["class"], r.position): r.coef for r in grouped.coefficients.collect()}
        assert mine.keys() == {c[:3] for c in coefs} and all(abs(mine[c[:3]] - c[3]) < 1e-3 for c in coefs)


def test_two_stage(two):
    positions, found = E.two_stage_regression(two, repeats=2, top=2)
    assert sorted(positions) == [0, 1]  # the two informative ones
    assert found.scores().first().accuracy > 0.8


def test_comparison_and_folds(two):
    said = E.compare_models(two, ("NB", "DT"))
    assert {(r.model, r.role): r.n for r in M.accuracy(said, ["model", "role"]).collect()} == {
        ("NB", "train"): 60, ("NB", "test"): 20, ("DT", "train"): 60, ("DT", "test"): 20,
    }
    table = two.withColumn("s", (F.col("row_id") % 8).cast("string"))
    folded = E.fold_evaluation(table, subject_folds(table, "s", 4), "s", "NB", 4)
    assert folded.count() == 80 and folded.select("row_id").distinct().count() == 80


def test_leading_features(two):
    got = {(r.features, r.model): r.accuracy for r in E.leading_feature_sweep(two, (1, 4), ("NB",)).collect()}
    assert set(got) == {(1, "NB"), (4, "NB")}


def test_leading_features_of_several_models(two):
    got = {(r.features, r.model): r.accuracy for r in E.leading_feature_sweep(two, (2, 4), ("LR", "DT", "NB")).collect()}
    assert len(got) == 6 and min(got.values()) > 0.5


def test_leading_features_take_all_sizes_at_once(spark, monkeypatch):
    """The accuracies of a run per size and model, without one; thresholds of a table beyond TREE_ROWS too."""
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 60)
    x = rng.normal(size=(60, 4)) + 0.6 * y[:, None]
    table = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y))], "row_id long, features array<double>, class int").cache()
    want = {
        (size, name): M.accuracy(one_by_one(E.leading_features(table, size), name, 2)[0]).first().accuracy
        for size in (1, 3) for name in ("LR", "DT")
    }
    monkeypatch.setattr(E, "run_classifier", None)
    got = {(r.features, r.model): r.accuracy for r in E.leading_feature_sweep(table, (1, 3), ("LR", "DT"), repeats=2).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    monkeypatch.setattr(S, "TREE_ROWS", 30)
    assert all(r.accuracy > 0.4 for r in E.leading_feature_sweep(table, (1, 3), ("DT",), repeats=2).collect())


def test_registered_embedding_is_trained_whole(monkeypatch):
    from junctura.catalog import learning

    seen = {}
    monkeypatch.setattr(learning, "build_corpus", lambda *a, **k: None)
    monkeypatch.setattr(learning.t, "proteins", lambda *a: None)
    monkeypatch.setattr(learning, "train_embedding", lambda corpus, **k: seen.update(k))
    learning._model(None, "")
    assert seen.get("iterations", 5) == 5


def test_kernel_features_are_added_until_they_are_close(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 5)) * 0.5
    table = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "row_id long, features array<double>, class int")
    loose, tight = K.RandomFourierSVM(max_error=1.0), K.RandomFourierSVM(max_error=0.01)
    assert loose.chosen(table)[0] == 200
    components, error, rows = tight.chosen(table)
    assert components > 200 and error <= 0.01 and rows == 120
    z = tight.mapped(x, tight.directions(5, components))
    true = np.exp(-2.0 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - true).mean() < 0.011


@pytest.mark.parametrize("local", [16_384, 60])
def test_deep_tree_is_sparks_own(spark, monkeypatch, local):
    """Ten noisy classes, a copied value in one column: nearly a node per row, grown in few jobs."""
    from pyspark.ml.classification import DecisionTreeClassifier

    from junctura.operators import trees

    monkeypatch.setattr(trees, "LOCAL_ROWS", local)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 4))
    x[:, 0] = np.round(x[:, 0])
    rows = [(i, [float(v) for v in x[i]], int(rng.integers(0, 10) * (rng.random() < 0.7))) for i in range(900)]
    table = spark.createDataFrame(rows, "row_id long, features array<double>, class int").cache()
    train = table.where("row_id % 4 > 0")
    deep = K.make_classifier("DT", max_depth=None).fit(train)
    own = K.SparkEstimator(lambda n, d, k: DecisionTreeClassifier(maxDepth=K.DEEPEST, seed=0, **K.COLUMNS)).fit(train)
    assert len(deep.feature) == own.model.numNodes > 500
    said = [{r.row_id: r.predicted for r in m.transform(table).collect()} for m in (deep, own)]
    assert said[0] == said[1] and deep.transform(table.limit(0)).count() == 0


def test_dimensions_predict_test_rows_only(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(E, "compare_models", lambda *x, run=E.compare_models, **y: asked.append(y.get("roles")) or run(*x, **y))
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=3)], i % 2) for i in range(60)], "row_id long, vec array<double>, class int")
    found = {(r.dims, r.model) for r in E.accuracy_by_dimension(rows, (2, 3)).collect()}
    assert found == {(d, m) for d in (2, 3) for m in ("DT", "kNN")} and asked == [("test",)] * 2
