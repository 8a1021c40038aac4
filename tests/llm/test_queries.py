"""The registered queries on the smallest tables, and the pipeline against its parts."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from junctura.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def tidy(table: pd.DataFrame) -> pd.DataFrame:
    table = table[sorted(table.columns)]
    return table.sort_values(list(table.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query_equals_sql(spark, duck, name):
    got, want = tidy(QUERIES[name][0](spark, FOLDER).toPandas()), tidy(duck.execute(QUERIES[name][1]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) > 0
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_all_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_stages(spark):
    """Each stage keeps the columns and only rows of its input; the last one packs all of its input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER).cache()
        assert out.columns == columns and out.count() > 0, name
        assert out.join(docs, "doc_id", "left_anti").count() == 0, name
        if name != "mix_sources":
            assert out.count() == out.select("doc_id").distinct().count() < docs.count(), name
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).cache()
    assert packed.selectExpr("explode(pieces) as p").where("p.start = 0").count() == docs.count()
    assert packed.selectExpr("max(tokens)", "min(tokens)").first()[0] == 2048


def text(rng, n):
    return " ".join(f"w{k}" for k in rng.integers(0, 5000, n))


def test_pipeline_on_hard_rows(spark, tmp_path):
    """run() on NULLs in every column, empty and very long texts, copies, repeated rows and further columns."""
    rng = np.random.default_rng(1)
    plain = [text(rng, 80) for _ in range(40)]
    rows = [(k, t, "en", f"s{k % 3}", len(t), 1.0) for k, t in enumerate(plain)]
    rows += [(100, plain[3].upper(), None, "s1", None, None), (101, plain[4] + " more", "en", "s2", 5, 2.0), (102, None, None, None, None, None), (103, "", "en", "s0", 0, 0.0)]
    rows += [(104, text(rng, 120_000), "en", None, 1, 1.0), (None, text(rng, 50), "en", "s1", 1, 1.0), rows[7], rows[7], (105, "w1 " * 500, "en", "s0", 1, 1.0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size double").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {p.doc_id for r in got for p in r.pieces}
    assert sum(r.tokens for r in got) == sum(p.length for r in got for p in r.pieces) and len(got) == max(r.sequence_id for r in got) + 1
    assert 100 in kept and 3 not in kept  # of exact copies the largest id stays
    assert 4 in kept and 101 not in kept  # of near copies the least
    assert not kept & {102, 103, 105} and 104 in kept and None in kept  # too short, or one repeated word


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
