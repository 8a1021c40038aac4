"""Every registered query on the smallest tables, against its SQL twin in DuckDB where it has one."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from junctura.catalog import all_queries, all_sql

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries(), all_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def tidy(table: pd.DataFrame) -> pd.DataFrame:
    table = table[sorted(table.columns)].copy()
    for name in table.columns:
        if pd.api.types.is_float_dtype(table[name]):
            table[name] = table[name].round(5) + 0.0
    return table.sort_values(list(table.columns)).reset_index(drop=True)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 100
    assert set(QUERIES) <= set(entry_module.queries()) and set(SQL) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = tidy(QUERIES[name](spark, FOLDER).toPandas()), tidy(duck.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6)


@pytest.mark.parametrize("name", ["pca", "kmeans_two_level", "fold_features", "ml_qda", "ml_random_forest"])
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_read_filters_reach_the_scan(spark):
    """The language filter is pushed down, and the stripped text is worked out once a row."""
    plan = QUERIES["reads_filter"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters: [") :].split("]")[0]
    assert "lang" in pushed and plan.count("regexp_replace(text") == 1


def test_entry(spark):
    result = entry_module.entry(spark)
    assert result.columns == ["FILENAME", "feature", "n", "freq"] and result.count() > 0


def test_learning_settings_are_whole(spark):
    sizes = {r.features for r in QUERIES["leading_features"](spark, FOLDER).select("features").distinct().collect()}
    folds = {r.fold for r in QUERIES["fold_features"](spark, FOLDER).select("fold").distinct().collect()}
    assert sizes == set(range(2, 65)) and folds == set(range(5))
