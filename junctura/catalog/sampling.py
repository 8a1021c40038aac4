"""Queries over samples, splits and folds. Draws follow the md5 of "seed:id", so SQL can follow them."""

from __future__ import annotations

from pyspark.sql import functions as F

from junctura.catalog import tables as t
from junctura.operators.embedding import drop_unembedded
from junctura.operators.families import add_family, family_sample, unambiguous
from junctura.operators.sampling import (
    fold_tables,
    keep_groups,
    repeated_splits,
    sample_per_group,
    sample_rows,
    sample_small_groups,
    sample_with_replacement,
    split_train_test,
    subject_folds,
)


def _lines(spark, sf):
    return t.table(spark, sf, "events").select(F.col("event_id").alias("row_id"), "user_id", "event_type", "value")


def n_per_group(spark, sf):
    return sample_per_group(_lines(spark, sf), "user_id", 5, seed=7).select("row_id", "user_id")


def small_groups(spark, sf):
    return sample_small_groups(_lines(spark, sf), "user_id", 65).select("row_id", "user_id")


def large_groups(spark, sf):
    return keep_groups(_lines(spark, sf), "user_id", at_least=65).select("row_id", "user_id")


def n_rows(spark, sf):
    return sample_rows(_lines(spark, sf), 500, seed=3).select("row_id", "user_id")


def with_replacement(spark, sf):
    return sample_with_replacement(_lines(spark, sf), 1000, seed=0).select("draw", "row_id", "user_id")


def stratified(spark, sf):
    """Ten of each family. The smallest tables have families of fewer than twenty unambiguous reads, which raise."""
    found = unambiguous(add_family(t.reads(spark, sf)))
    return family_sample(found, ("IGHV1", "IGHV3", "IGHV4"), 10).select("row_id", "V_FAMILY", "family_number")


def train_test(spark, sf):
    return split_train_test(_lines(spark, sf), 0.25, seed=0).select("row_id", "role")


def folds(spark, sf):
    return subject_folds(_lines(spark, sf), "user_id", 7, seed=1)


def fold_rows(spark, sf):
    return fold_tables(_lines(spark, sf), "user_id", 5, seed=1).select("row_id", "fold", "role")


def repeats(spark, sf):
    people = _lines(spark, sf).select(F.col("user_id").alias("row_id")).distinct()
    return repeated_splits(people, 1000, 0.2, seed=5).select("split", "row_id", "role")


def labelled_rows(spark, sf):
    """Semi join: documents that have a label, as rows that have a vector are kept."""
    marked = t.table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"))
    return drop_unembedded(t.proteins(spark, sf).select("row_id", "FILENAME"), marked)


def ranked(source: str, seed: str, by: str = "", name: str = "ranked", id: str = "row_id") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return (
        f"{name} AS (SELECT *, row_number() OVER ({part} ORDER BY md5({seed} || ':' || {id}), {id}) AS r, "
        f"count(*) OVER ({part}) AS n FROM {source})"
    )


LINES = "lines AS (SELECT event_id AS row_id, user_id, event_type, value FROM events)"
PEOPLE = "people AS (SELECT DISTINCT user_id AS row_id FROM events)"


def folds_sql(k: int, id: str) -> str:
    """Cut ranks 1..n into k folds whose sizes differ by at most one, larger ones first."""
    return f"SELECT {id}, CAST(ntile({k}) OVER (ORDER BY md5('1:' || {id}), {id}) - 1 AS INTEGER) AS fold FROM (SELECT DISTINCT user_id FROM events)"


QUERIES = {
    "sample_n_per_group": (
        n_per_group,
        t.with_ctes(LINES, ranked("lines", "'7'", "user_id"), body="SELECT row_id, user_id FROM ranked WHERE n >= 5 AND r <= 5"),
    ),
    "keep_small_groups": (
        small_groups,
        "SELECT event_id AS row_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) < 65)",
    ),
    "keep_large_groups": (
        large_groups,
        "SELECT event_id AS row_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 65)",
    ),
    "sample_rows": (
        n_rows,
        t.with_ctes(LINES, ranked("lines", "'3'"), body="SELECT row_id, user_id FROM ranked WHERE r <= 500"),
    ),
    "sample_with_replacement": (
        with_replacement,
        t.with_ctes(
            LINES,
            ranked("lines", "'0'"),
            "draws AS (SELECT d, ('0x' || substr(md5('0:draw:' || d), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM range(1000) q(d))",
            body="SELECT d AS draw, row_id, user_id FROM draws JOIN ranked ON r = CAST(floor(u * n) AS BIGINT) + 1",
        ),
    ),
    "stratified_sample": (
        stratified,
        t.with_ctes(
            t.READS,
            "called AS (SELECT row_id, list_distinct(regexp_extract_all(V_CALL, 'IGHV[0-9]+')) AS f FROM reads)",
            "single AS (SELECT row_id, f[1] AS V_FAMILY FROM called WHERE len(f) = 1 AND f[1] IN ('IGHV1', 'IGHV3', 'IGHV4'))",
            ranked("single", "'0'", "V_FAMILY"),
            body="SELECT row_id, V_FAMILY, CAST(right(V_FAMILY, 1) AS INTEGER) AS family_number FROM ranked WHERE r <= 10",
        ),
    ),
    "train_test_split": (
        train_test,
        t.with_ctes(
            LINES,
            ranked("lines", "'0'"),
            body="SELECT row_id, CASE WHEN r <= ceil(0.25 * n) THEN 'test' ELSE 'train' END AS role FROM ranked",
        ),
    ),
    "group_folds": (folds, folds_sql(7, "user_id")),
    "fold_rows": (
        fold_rows,
        f"""WITH own AS ({folds_sql(5, "user_id")})
SELECT event_id AS row_id, CAST(f AS INTEGER) AS fold, CASE WHEN f = own.fold THEN 'test' ELSE 'train' END AS role
FROM events JOIN own ON own.user_id = events.user_id, range(5) q(f)""",
    ),
    "repeated_splits": (
        repeats,
        t.with_ctes(
            PEOPLE,
            "copies AS (SELECT row_id, CAST(s AS INTEGER) AS split FROM people, range(1000) q(s))",
            ranked("copies", "('5:' || split)", "split"),
            body="SELECT split, row_id, CASE WHEN r <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS role FROM ranked",
        ),
    ),
    "rows_with_vector": (
        labelled_rows,
        "SELECT doc_id AS row_id, source AS FILENAME FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    ),
}
