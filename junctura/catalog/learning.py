"""Queries over labels, classifiers and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from junctura.catalog import tables as t
from junctura.catalog.sampling import ranked
from junctura.operators.classify import RandomFourierSVM, make_classifier
from junctura.operators.corpus import build_corpus
from junctura.operators.embedding import embedding_table, sequence_vectors, train_embedding
from junctura.operators.evaluate import (
    accuracy_by_dimension,
    compare_models,
    fold_evaluation,
    leading_feature_sweep,
    run_classifier,
    two_stage_regression,
)
from junctura.operators.labels import balanced_weights, class_numbers, keep_classes, number_classes, subject_labels
from junctura.operators.metrics import (
    accuracy,
    binary_scores,
    class_report,
    coefficient_sums,
    confusion_matrix,
    score_pivot,
    top_coefficients,
)
from junctura.operators.reduce import PCA_SIZES
from junctura.operators.sampling import split_train_test, subject_folds
from junctura.plans.flows import classify_mean_vectors, experiment_grid
from junctura.session import cut_lineage

#: The sizes of a sweep that vectors of 64 values have.
SIZES = tuple(d for d in PCA_SIZES if d <= 64)
RATES = ("precision", "recall", "f1")


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _flags(spark, sf):
    """Two judgements of each document, one taken as truth and one as prediction."""
    return t.table(spark, sf, "labels").select(F.col("quality").alias("actual"), F.col("toxic").alias("predicted"))


def confusion(spark, sf):
    return _round(confusion_matrix(_flags(spark, sf)), "share")


def binary(spark, sf):
    return _round(binary_scores(_flags(spark, sf), 1), "accuracy", *RATES)


def report(spark, sf):
    return _round(class_report(_flags(spark, sf)), *RATES)


def report_orders(spark, sf):
    """Many classes: line status of each line against its return flag, as words."""
    lines = t.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("actual"), F.col("l_linestatus").alias("predicted"))
    return _round(class_report(lines), *RATES)


def accuracies(spark, sf):
    found = t.table(spark, sf, "documents").join(t.table(spark, sf, "labels"), "doc_id")
    said = found.select("lang", F.col("quality").alias("actual"), F.col("toxic").alias("predicted"))
    return _round(accuracy(said, ["lang"]), "accuracy")


def pivot(spark, sf):
    docs = t.table(spark, sf, "documents").select("source", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    found = score_pivot(docs, "source", "lang", "n_chars")
    return _round(found, *found.columns[1:])


def weights(spark, sf):
    return _round(balanced_weights(t.table(spark, sf, "documents"), "lang"), "weight")


def numbers(spark, sf):
    return class_numbers(t.table(spark, sf, "documents"), "lang")


def numbered(spark, sf):
    docs = number_classes(keep_classes(t.table(spark, sf, "documents"), "lang", ["en", "fr", "de"]), "lang")
    return docs.select("doc_id", "class")


def per_subject(spark, sf):
    return subject_labels(t.subjects(spark, sf), "FILENAME", "labels")


def top_positions(spark, sf):
    """Positions of the vectors taken as coefficients, added up over all rows; the 20 largest."""
    rows = t.vectors(spark, sf).select(F.posexplode("vec").alias("position", "coef"))
    return _round(top_coefficients(coefficient_sums(rows), 20), "coef")


def binary_table(spark, sf):
    """(row_id, features, class, FILENAME): vectors with their subject's condition."""
    rows = t.vectors(spark, sf).join(t.subjects(spark, sf), "row_id")
    number = F.when(F.col("labels") == "HC", 1).otherwise(0).cast("int")
    return rows.select("row_id", F.col("vec").alias("features"), number.alias("class"), "FILENAME")


def labelled_table(spark, sf):
    return t.vectors(spark, sf).select("row_id", F.col("vec").alias("features"), F.col("label").alias("class"))


def _predict(name, table, **parameters):
    def run(spark, sf):
        split = cut_lineage(split_train_test(table(spark, sf).select("row_id", "features", "class"), 0.25))
        train, test = (split.where(F.col("role") == r).drop("role") for r in ("train", "test"))
        said = make_classifier(name, **parameters).fit(train).transform(test)
        return said.select("row_id", F.col("class").alias("actual"), "predicted")

    run.__doc__ = f"Predictions of {name} for a quarter of the rows."
    return run


def verified(spark, sf):
    """Naive Bayes on repeated splits of 70 % of the rows, each model also checked on the other 30 %."""
    table = cut_lineage(split_train_test(binary_table(spark, sf), 0.3, seed=9))
    used, unused = (table.where(F.col("role") == r) for r in ("train", "test"))
    found = run_classifier(used, "NB", 1000, verify=unused)
    test = found.scores().select(F.lit("test").alias("role"), "*")
    return _round(test.unionByName(found.verification_scores().select(F.lit("verify").alias("role"), "*")), "accuracy", *RATES)


def _verified(model, width=None):
    def run(spark, sf):
        table = binary_table(spark, sf)
        if width:
            table = table.withColumn("features", F.slice("features", 1, width))
        table = cut_lineage(split_train_test(table, 0.3, seed=9))
        used, unused = (table.where(F.col("role") == r) for r in ("train", "test"))
        found = run_classifier(used, model, 1000, verify=unused)
        test = found.scores().select(F.lit("test").alias("role"), "*")
        return _round(test.unionByName(found.verification_scores().select(F.lit("verify").alias("role"), "*")), "accuracy", *RATES)

    run.__doc__ = f"{model} on the same thousand splits as ``verified``."
    return run


def kernel_error(spark, sf):
    """Whether the features of the RBF machine give its kernel to three hundredths on average, and on how many pairs."""
    components, error, rows = RandomFourierSVM().chosen(binary_table(spark, sf))
    return spark.createDataFrame([(rows * (rows - 1), components >= 200, error <= 0.03)], "pairs long, features boolean, close boolean")


def two_stage(spark, sf):
    positions, found = two_stage_regression(binary_table(spark, sf), top=20)
    kept = F.lit(len(positions)).alias("features")
    return _round(found.scores().select(kept, "*"), "accuracy", *RATES)


def compared(spark, sf):
    said = compare_models(binary_table(spark, sf))
    return _round(accuracy(said, ["model", "role"]), "accuracy")


def by_dimension(spark, sf):
    rows = t.vectors(spark, sf).withColumnRenamed("label", "class")
    return _round(accuracy_by_dimension(rows, SIZES), "accuracy")


def leading(spark, sf):
    """Accuracy with the first n positions, for every n from 2 to the vectors' width."""
    table = cut_lineage(binary_table(spark, sf))
    width = table.agg(F.max(F.size("features"))).first()[0] or 0
    return _round(leading_feature_sweep(table, range(2, width + 1), ("LR", "DT")), "accuracy")


def by_fold(spark, sf):
    table = binary_table(spark, sf)
    said = fold_evaluation(table, subject_folds(table, "FILENAME", 4), "FILENAME", "NB", 4)
    return said.select(F.col("split").alias("fold"), "row_id", "actual", "predicted")


def _dictionary(spark, sf):
    people = t.subjects(spark, sf).select("FILENAME", "labels").distinct()
    return people.select(F.col("FILENAME").alias("observation"), F.col("labels").alias("label"))


def grid(spark, sf):
    vectors = t.vectors(spark, sf).select("row_id", "vec")
    scores = experiment_grid(
        vectors, t.subjects(spark, sf), _dictionary(spark, sf), "FILENAME", source="embeddings"
    )
    return _round(scores, "score")


def mean_classifier(spark, sf):
    found = classify_mean_vectors(
        t.vectors(spark, sf), t.subjects(spark, sf), _dictionary(spark, sf), "DT", "FILENAME"
    )
    return _round(found.scores(), "accuracy", *RATES)


def _model(spark, sf):
    corpus = build_corpus(t.proteins(spark, sf), 3, text="JUNC_AA")
    return train_embedding(corpus, size=100, window=25, min_count=2)


def word2vec(spark, sf):
    """The words a trained model knows, and the size of their vectors."""
    return embedding_table(_model(spark, sf)).select("word", F.size("vector").alias("size"))


def word2vec_vectors(spark, sf):
    """Which documents a trained model can embed."""
    vectors = sequence_vectors(t.proteins(spark, sf), embedding_table(_model(spark, sf)))
    return vectors.select("row_id", F.size("vec").alias("size"))


FLAGS = "flags AS (SELECT quality AS actual, toxic AS predicted FROM labels)"
CELLS = """cells AS (SELECT actual, predicted, count(*) AS n FROM flags GROUP BY 1, 2),
classes AS (SELECT actual AS c FROM cells UNION SELECT predicted FROM cells),
parts AS (SELECT c, coalesce(sum(n) FILTER (actual = c AND predicted = c), 0) AS tp,
                 coalesce(sum(n) FILTER (actual <> c AND predicted = c), 0) AS fp,
                 coalesce(sum(n) FILTER (actual = c AND predicted <> c), 0) AS fn FROM classes, cells GROUP BY c),
rates AS (SELECT CAST(c AS VARCHAR) AS class, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
                 coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
                 CAST(tp + fn AS BIGINT) AS support FROM parts)"""
REPORT = """SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rates
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM rates"""

SPLIT = (
    t.VECTORS,
    t.SUBJECTS,
    "rows AS (SELECT row_id, vec, CASE WHEN labels = 'HC' THEN 1 ELSE 0 END AS class FROM vectors JOIN subjects USING (row_id))",
    ranked("rows", "'0'"),
    "split AS (SELECT row_id, vec, class, r <= ceil(0.25 * n) AS test FROM ranked)",
    "cells AS (SELECT row_id, class, test, p, vec[p + 1] AS x FROM split, range(64) q(p))",
)
NAIVE_BAYES = (
    "overall AS (SELECT p, var_pop(x) AS v FROM cells WHERE NOT test GROUP BY p)",
    "moments AS (SELECT class, p, avg(x) AS m, var_pop(x) + 1e-9 * (SELECT max(v) FROM overall) AS v FROM cells WHERE NOT test GROUP BY 1, 2)",
    "priors AS (SELECT class, ln(count(*) / sum(count(*)) OVER ()) AS l FROM split WHERE NOT test GROUP BY class)",
    """scores AS (
  SELECT c.row_id, c.class AS actual, m.class AS predicted, any_value(l) - 0.5 * sum(ln(v) + (x - m) * (x - m) / v) AS s
  FROM cells c JOIN moments m USING (p) JOIN priors ON priors.class = m.class WHERE c.test GROUP BY 1, 2, 3)""",
)


def bayes_sql(by: str) -> tuple[str, ...]:
    """CTEs from cells (by, row_id, class, role, p, x) to the class said for each tested row of each ``by``."""
    return (
        f"overall AS (SELECT {by}, max(v) AS v FROM (SELECT {by}, p, var_pop(x) AS v FROM cells WHERE role = 'train' GROUP BY 1, 2) GROUP BY 1)",
        f"""moments AS (SELECT {by}, class, p, avg(x) AS m, var_pop(x) + 1e-9 * any_value(overall.v) AS v
  FROM cells JOIN overall USING ({by}) WHERE role = 'train' GROUP BY 1, 2, 3)""",
        f"priors AS (SELECT {by}, class, ln(count(*) / sum(count(*)) OVER (PARTITION BY {by})) AS l FROM cells WHERE role = 'train' AND p = 0 GROUP BY 1, 2)",
        f"""scores AS (SELECT c.{by}, c.role, c.row_id, c.class AS actual, m.class AS predicted, any_value(l) - 0.5 * sum(ln(v) + (x - m) * (x - m) / v) AS s
  FROM cells c JOIN moments m ON m.{by} = c.{by} AND m.p = c.p JOIN priors ON priors.{by} = c.{by} AND priors.class = m.class
  WHERE c.role <> 'train' GROUP BY 1, 2, 3, 4, 5)""",
        f"said AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY {by}, row_id ORDER BY s DESC, predicted) = 1)",
    )


BINARY_ROWS = "rows AS (SELECT row_id, vec, CASE WHEN labels = 'HC' THEN 1 ELSE 0 END AS class, FILENAME FROM vectors JOIN subjects USING (row_id))"
FOLD_CELLS = """own AS (SELECT FILENAME, CAST(ntile(4) OVER (ORDER BY md5('0:' || FILENAME), FILENAME) - 1 AS INTEGER) AS fold
  FROM (SELECT DISTINCT FILENAME FROM rows)),
cells AS (SELECT CAST(f AS INTEGER) AS fold, row_id, class, CASE WHEN f = own.fold THEN 'test' ELSE 'train' END AS role, p, vec[p + 1] AS x
  FROM rows JOIN own USING (FILENAME), range(4) q(f), range(64) z(p))"""
SPLIT_CELLS = (
    ranked("rows", "'9'", name="parted"),
    "used AS (SELECT row_id, vec, class FROM parted WHERE r > ceil(0.3 * n))",
    "unused AS (SELECT row_id, vec, class FROM parted WHERE r <= ceil(0.3 * n))",
    "copies AS (SELECT row_id, vec, class, CAST(s AS INTEGER) AS split FROM used, range(1000) q(s))",
    ranked("copies", "('0:' || split)", "split", name="drawn"),
    """cells AS (
  SELECT split, row_id, class, CASE WHEN r <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS role, p, vec[p + 1] AS x FROM drawn, range(64) z(p)
  UNION ALL SELECT CAST(s AS INTEGER), row_id, class, 'verify', p, vec[p + 1] FROM unused, range(1000) q(s), range(64) z(p))""",
)
ROLE_SCORES = """SELECT role, round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(coalesce(sum(CAST(actual = 1 AND predicted = 1 AS INT)) / nullif(sum(predicted), 0), 0), 6) AS precision,
  round(coalesce(sum(CAST(actual = 1 AND predicted = 1 AS INT)) / nullif(sum(actual), 0), 0), 6) AS recall,
  round(coalesce(2 * sum(CAST(actual = 1 AND predicted = 1 AS INT)) / nullif(sum(predicted) + sum(actual), 0), 0), 6) AS f1
FROM said GROUP BY role"""

#: (split, role, row_id, class, vec) of the thousand splits and of the rows that none of them trains with.
SPLIT_ROWS = (
    *SPLIT_CELLS[:-1],
    """placed AS (
  SELECT split, row_id, class, vec, CASE WHEN r <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS role FROM drawn
  UNION ALL SELECT CAST(s AS INTEGER), row_id, class, vec, 'verify' FROM unused, range(1000) q(s))""",
)
NEIGHBOUR_VOTE = (
    "far AS (SELECT a.row_id, b.row_id AS neighbor, list_distance(a.vec, b.vec) AS dist FROM rows a JOIN rows b ON a.row_id <> b.row_id)",
    """near AS (SELECT a.split, a.role, a.row_id, a.class AS actual, b.class AS vote FROM placed a JOIN placed b ON b.split = a.split AND b.role = 'train'
  JOIN far ON far.row_id = a.row_id AND far.neighbor = b.row_id WHERE a.role <> 'train'
  QUALIFY row_number() OVER (PARTITION BY a.split, a.role, a.row_id ORDER BY dist, neighbor) <= 3)""",
    "said AS (SELECT split, role, row_id, any_value(actual) AS actual, CASE WHEN sum(vote) >= 2 THEN 1 ELSE 0 END AS predicted FROM near GROUP BY 1, 2, 3)",
)


def discriminant_sql(pooled: bool) -> tuple[str, ...]:
    """CTEs to the class said by a discriminant of the first two numbers, its 2 x 2 matrices inverted by hand."""
    own = "sum((n - 1) * {0}) OVER w / (sum(n) OVER w - count(*) OVER w)" if pooled else "{0}"
    return (
        "flat AS (SELECT split, role, row_id, class, vec[1] AS x, vec[2] AS y FROM placed)",
        """moments AS (SELECT split, class, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy
  FROM flat WHERE role = 'train' GROUP BY 1, 2)""",
        f"""spread AS (SELECT split, class, mx, my, ln(n / sum(n) OVER w) AS prior, {own.format('xx')} AS xx, {own.format('yy')} AS yy, {own.format('xy')} AS xy
  FROM moments WINDOW w AS (PARTITION BY split))""",
        "ridged AS (SELECT * REPLACE (xx + 1e-9 * (xx + yy) / 2 AS xx, yy + 1e-9 * (xx + yy) / 2 AS yy) FROM spread)",
        """scores AS (SELECT f.split, f.role, f.row_id, f.class AS actual, m.class AS predicted, prior - 0.5 * ln(xx * yy - xy * xy)
    - 0.5 * (yy * (x - mx) * (x - mx) - 2 * xy * (x - mx) * (y - my) + xx * (y - my) * (y - my)) / (xx * yy - xy * xy) AS s
  FROM flat f JOIN ridged m USING (split) WHERE f.role <> 'train')""",
        "said AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY split, role, row_id ORDER BY s DESC, predicted) = 1)",
    )


VOCABULARY = (t.PROTEINS, t.FRAMES, t.WORDS, "known AS (SELECT word FROM words GROUP BY word HAVING count(*) >= 2)")

QUERIES = {
    "confusion": (
        confusion,
        t.with_ctes(
            FLAGS,
            body="""SELECT actual, predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY actual), 6) AS share
FROM flags GROUP BY actual, predicted""",
        ),
    ),
    "binary_scores": (
        binary,
        t.with_ctes(
            FLAGS,
            CELLS,
            body="""SELECT (SELECT round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 6) FROM flags) AS accuracy,
round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM rates WHERE class = '1'""",
        ),
    ),
    "class_report": (report, t.with_ctes(FLAGS, CELLS, body=REPORT)),
    "class_report_lines": (
        report_orders,
        t.with_ctes("flags AS (SELECT l_returnflag AS actual, l_linestatus AS predicted FROM lineitem)", CELLS, body=REPORT),
    ),
    "accuracy_by_language": (
        accuracies,
        """SELECT lang, count(*) AS n, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
    ),
    "score_pivot": (
        pivot,
        "SELECT source, " + ", ".join(f"round(avg(n_chars) FILTER (lang = '{k}'), 6) AS {k}" for k in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source",
    ),
    "balanced_weights": (
        weights,
        """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT lang, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c""",
    ),
    "class_numbers": (
        numbers,
        "SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS class FROM (SELECT DISTINCT lang FROM documents)",
    ),
    "numbered_classes": (
        numbered,
        "SELECT doc_id, CAST(CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 2 END AS INTEGER) AS class FROM documents WHERE lang IN ('de', 'en', 'fr')",
    ),
    "subject_labels": (per_subject, t.with_ctes(t.SUBJECTS, body="SELECT DISTINCT FILENAME, labels FROM subjects")),
    "top_coefficients": (
        top_positions,
        t.with_ctes(
            t.VECTORS,
            "s AS (SELECT CAST(p AS INTEGER) AS position, sum(vec[p + 1]) AS coef FROM vectors, range(64) q(p) GROUP BY 1)",
            body="SELECT position, round(coef, 6) AS coef FROM s ORDER BY abs(s.coef) DESC, position LIMIT 20",
        ),
    ),
    "ml_naive_bayes": (
        _predict("NB", binary_table),
        t.with_ctes(
            *SPLIT,
            *NAIVE_BAYES,
            body="SELECT row_id, actual, predicted FROM scores QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY s DESC) = 1",
        ),
    ),
    "ml_logistic_regression": (_predict("LR", binary_table), None),
    "ml_logistic_multinomial": (_predict("LR", labelled_table), None),
    "ml_decision_tree": (_predict("DT", binary_table), None),
    "ml_regression_tree": (_predict("RT", binary_table), None),
    "ml_random_forest": (_predict("RF", binary_table), None),
    "ml_linear_svm": (_predict("LSVM", binary_table), None),
    "ml_rbf_svm": (_predict("RBF_SVM", binary_table), None),
    "rbf_kernel_error": (
        kernel_error,
        "WITH n AS (SELECT least(256, count(*)) AS k FROM embeddings) SELECT CAST(k * (k - 1) AS BIGINT) AS pairs, true AS features, true AS close FROM n",
    ),
    "ml_neural_net": (_predict("MLP", binary_table), None),
    "ml_adaboost": (_predict("ADA", binary_table), None),
    "ml_qda": (_predict("QDA", binary_table), None),
    "ml_lda": (_predict("LDA", labelled_table), None),
    "verified_scores": (verified, t.with_ctes(t.VECTORS, t.SUBJECTS, BINARY_ROWS, *SPLIT_CELLS, *bayes_sql("split"), body=ROLE_SCORES)),
    "verified_neighbours": (_verified("kNN"), t.with_ctes(t.VECTORS, t.SUBJECTS, BINARY_ROWS, *SPLIT_ROWS, *NEIGHBOUR_VOTE, body=ROLE_SCORES)),
    "verified_lda": (_verified("LDA", 2), t.with_ctes(t.VECTORS, t.SUBJECTS, BINARY_ROWS, *SPLIT_ROWS, *discriminant_sql(True), body=ROLE_SCORES)),
    "verified_qda": (_verified("QDA", 2), t.with_ctes(t.VECTORS, t.SUBJECTS, BINARY_ROWS, *SPLIT_ROWS, *discriminant_sql(False), body=ROLE_SCORES)),
    "two_stage_regression": (two_stage, None),
    "model_comparison": (compared, None),
    "accuracy_by_dimension": (by_dimension, None),
    "leading_features": (leading, None),
    "fold_evaluation": (
        by_fold,
        t.with_ctes(t.VECTORS, t.SUBJECTS, BINARY_ROWS, FOLD_CELLS, *bayes_sql("fold"), body="SELECT fold, row_id, actual, predicted FROM said"),
    ),
    "experiment_grid": (grid, None),
    "mean_vector_classifier": (mean_classifier, None),
    "word2vec": (
        word2vec,
        t.with_ctes(*VOCABULARY, body="SELECT word, CAST(100 AS INTEGER) AS size FROM known"),
    ),
    "word2vec_vectors": (
        word2vec_vectors,
        t.with_ctes(
            *VOCABULARY,
            body="""SELECT p.row_id, CAST(100 AS INTEGER) AS size FROM proteins p
JOIN (SELECT row_id FROM words LEFT JOIN known USING (word) WHERE frame = 1
      GROUP BY row_id HAVING bool_and(known.word IS NOT NULL)) f ON f.row_id = p.row_id""",
        ),
    ),
}
