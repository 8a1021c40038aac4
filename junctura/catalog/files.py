"""Round trips: a given table written in a format to the shared folder, and read back from there.

Every result is the table itself, so its SQL twin reads the given one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from junctura.catalog import tables as t
from junctura.operators.cluster import cluster_feature_table
from junctura.operators.corpus import build_corpus
from junctura.operators.embedding import embedding_table, train_embedding
from junctura.operators.sampling import fold_tables
from junctura.schemas import SCORES, unmatched_keys
from junctura.session import cut_lineage, shared_path
from junctura.sources import readers as R
from junctura.sources import writers as W

NATION = T.StructType([T.StructField("n_nationkey", T.LongType()), T.StructField("n_name", T.StringType()), T.StructField("n_regionkey", T.LongType())])
CUSTOMER = T.StructType(
    [T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_mktsegment", T.StringType()), T.StructField("c_acctbal", T.DoubleType())]
)
WIDTH = 64  # numbers of an embedding


def csv_table(spark, sf):
    """Comma-separated text with a header, with types by name."""
    path = shared_path(spark, "nation-csv")
    W.write_csv(t.table(spark, sf, "nation").select(*NATION.names), path)
    return R.read_table(spark, path, NATION)


def csv_delimiter(spark, sf):
    """Names that hold the delimiter, quotes and blanks survive a chosen delimiter."""
    path = shared_path(spark, "customer-bar")
    rows = t.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit('a|"b" '), "c_name").alias("c_name"), "c_mktsegment", "c_acctbal")
    W.write_csv(rows.repartition(3), path, sep="|")
    return R.read_table(spark, path, CUSTOMER, sep="|")


def tsv_table(spark, sf):
    path = shared_path(spark, "supplier-tsv")
    schema = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()), T.StructField("s_acctbal", T.DoubleType())])
    W.write_tsv(t.table(spark, sf, "supplier").select(*schema.names), path)
    return R.read_tsv(spark, path, schema)


def csv_subset(spark, sf):
    """Two columns of a wider file, in another order; only they are parsed."""
    path = shared_path(spark, "customer-wide")
    W.write_csv(t.table(spark, sf, "customer"), path)
    return R.read_table(spark, path, T.StructType([T.StructField("c_acctbal", T.DoubleType()), T.StructField("c_custkey", T.LongType())]))


def indexed_table(spark, sf):
    """An index column without a name in the header, beside numeric columns."""
    path = shared_path(spark, "parts-indexed")
    lines = t.table(spark, sf, "part").select(F.concat_ws(",", "p_partkey", "p_size", "p_retailprice").alias("value"), F.pmod("p_partkey", F.lit(4)).alias("file"))
    head = spark.range(4).select(F.lit(",p_size,p_retailprice").alias("value"), F.col("id").alias("file"))
    # four files, each with its header line first
    both = head.withColumn("at", F.lit(0)).unionByName(lines.withColumn("at", F.lit(1))).repartition(4, "file").sortWithinPartitions("file", "at")
    both.select("value", "file").write.partitionBy("file").text(path)
    return R.read_keyed(spark, f"{path}/file=*", "p_partkey", "long")


def reads_folder(spark, sf):
    """Annotated reads, a file per source with the suffix; files of another suffix are left out."""
    folder = shared_path(spark, "makedb")
    reads = _annotated(spark, sf)
    W.write_grouped_tsv(reads, folder, "FILENAME")
    W.write_grouped_tsv(reads.limit(5).withColumn("FILENAME", F.lit("other")), folder, "FILENAME", "_raw.tab")
    found = R.read_annotated_reads(spark, folder).withColumn("FILENAME", F.regexp_replace("FILENAME", r"(\.\d+)?_collapsed$", ""))
    per_file = found.groupBy("FILENAME").agg(F.count("*").alias("reads"), F.sum("JUNCTION_LENGTH").alias("length"), F.max(F.md5("JUNCTION")).alias("last"))
    numbered = found.agg((F.countDistinct("row_id") == F.count("*")).alias("numbered"))  # one row
    return per_file.crossJoin(F.broadcast(numbered))


def _annotated(spark, sf) -> DataFrame:
    rows = t.reads(spark, sf).withColumns({"DUPCOUNT": F.lit(1), "D_CALL": F.lit("D1"), "J_CALL": F.lit("J1")})
    return rows.select("SEQUENCE_ID", "FUNCTIONAL", "JUNCTION_LENGTH", "JUNCTION", "DUPCOUNT", "CONSCOUNT", "V_CALL", "D_CALL", "J_CALL", "FILENAME")


def matrix_table(spark, sf):
    """Vectors as a wide numeric matrix and back."""
    path = shared_path(spark, "matrix")
    W.write_vectors(t.vectors(spark, sf), path, WIDTH)
    return R.read_matrix(spark, path, "row_id").select("row_id", F.posexplode("vec").alias("pos", "value")).withColumn("value", F.round("value", 6))


def positional_table(spark, sf):
    """Rows without a key, meant by their position: sorted when written, numbered when read."""
    path = shared_path(spark, "positional")
    W.write_csv(t.table(spark, sf, "part").select("p_partkey", "p_size").orderBy("p_partkey"), path)
    schema = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_size", T.LongType())])
    return R.read_positional(spark, path, schema)


def dictionary_table(spark, sf):
    path = shared_path(spark, "dictionary")
    people = t.subjects(spark, sf).select(F.col("FILENAME").alias("observation"), F.col("labels").alias("label")).distinct()
    W.write_csv(people, path)
    return R.read_label_dictionary(spark, path)


def embedding_file(spark, sf):
    path = shared_path(spark, "embedding")
    W.write_embedding(t.vectors(spark, sf).select(F.concat(F.lit("w"), "row_id").alias("word"), F.col("vec").alias("vector")), path)
    return R.read_embedding(spark, path).select("word", F.posexplode("vector").alias("pos", "value")).withColumn("value", F.round("value", 6))


def model_file(spark, sf):
    """A trained model saved and loaded: the same words, each with the vector it had."""
    path = shared_path(spark, "model")
    model = train_embedding(build_corpus(t.proteins(spark, sf), 3, text="JUNC_AA"), size=4, window=2, min_count=2, iterations=1)
    W.save_model(model, path)
    loaded = R.read_embedding(spark, path, "word2vec").withColumnRenamed("vector", "_loaded")
    return embedding_table(model).join(loaded, "word", "full").select("word", F.col("vector").eqNullSafe(F.col("_loaded")).alias("same"))


def clusters_file(spark, sf):
    """Cluster numbers in a file of their own, and appended to the data under a new path."""
    rows = t.vectors(spark, sf)
    marked = rows.select("row_id", F.col("label").alias("cluster"))
    alone, beside = shared_path(spark, "clusters"), shared_path(spark, "clustered")
    W.write_clusters(marked, alone)
    W.append_clusters(rows.drop("label"), R.read_parquet(spark, alone), beside)
    return R.read_parquet(spark, beside, ["row_id", "cluster"])


def scores_file(spark, sf):
    """Score rows of two runs, the second added to the first's file."""
    path = shared_path(spark, "scores")
    docs = t.documents(spark, sf, "lang", "n_chars").groupBy("lang").agg(F.round(F.avg("n_chars"), 6).alias("score"))
    for name in ("first", "second"):
        known = {"Inputfile": F.col("lang"), "model_name": F.lit(name), "score": F.col("score")}
        W.append_scores(docs.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCORES.fields]), path)
    return R.read_parquet(spark, path, ["Inputfile", "model_name", "score"])


def union_files(spark, sf):
    """One read of several folders, a part of the customers in each."""
    base = shared_path(spark, "customers")
    rows = cut_lineage(t.table(spark, sf, "customer").select(*CUSTOMER.names))
    paths = [f"{base}/{k}" for k in range(3)]
    for k, path in enumerate(paths):
        W.write_csv(rows.where(F.pmod("c_custkey", F.lit(3)) == k), path)
    return R.read_table(spark, paths, CUSTOMER)


def feature_file(spark, sf):
    """A feature table under its source's name, its rows in the order of the subjects, read back by position."""
    folder = shared_path(spark, "features")
    files = t.subjects(spark, sf).withColumnRenamed("FILENAME", "subject")
    table = cluster_feature_table(t.vectors(spark, sf).select("row_id", F.col("label").alias("cluster")), files, "subject")
    path = W.write_feature_table(table, "a/vectors.csv", folder, "subject")
    back = R.read_positional(spark, path).select("row_id", "subject", F.round(F.col("0").cast("double"), 6).alias("first"))
    return back.withColumn("named", F.lit(path.endswith("/vectors_feature_table.csv")))


def labelled_file(spark, sf):
    """A labelled table beside its source, with columns that are then dropped by name."""
    folder = shared_path(spark, "labelled")
    rows = t.subjects(spark, sf).select("row_id", "FILENAME", "labels")
    path = W.write_labelled(rows, f"{folder}/people.csv")
    return R.read_table(spark, path).drop("FILENAME").select(F.col("row_id").cast("long").alias("row_id"), "labels")


def folds_file(spark, sf):
    """Every row once per fold and role, by partition folders."""
    path = shared_path(spark, "folds")
    W.write_folds(fold_tables(t.subjects(spark, sf), "FILENAME", 5), path)
    return R.read_parquet(spark, path).groupBy("row_id").agg(F.count_if(F.col("role") == "test").alias("tested"), F.count_if(F.col("role") == "train").alias("trained"))


def key_check(spark, sf):
    """Documents without a label and labels without a document, by key; keys that stand twice too."""
    docs, labels = t.documents(spark, sf, "doc_id"), t.table(spark, sf, "labels").select("doc_id")
    return unmatched_keys(docs, labels, "doc_id")


def _cells(key: str, name: str) -> str:
    return f"SELECT {key}, CAST(p AS INTEGER) AS pos, round(vec[p + 1], 6) AS {name} FROM vectors, range({WIDTH}) q(p)"


QUERIES = {
    "csv_table": (csv_table, "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "csv_delimiter": (csv_delimiter, "SELECT c_custkey, 'a|\"b\" ' || c_name AS c_name, c_mktsegment, c_acctbal FROM customer"),
    "tsv_table": (tsv_table, "SELECT s_suppkey, s_name, s_acctbal FROM supplier"),
    "csv_subset": (csv_subset, "SELECT c_acctbal, c_custkey FROM customer"),
    "indexed_table": (indexed_table, "SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part"),
    "reads_folder": (
        reads_folder,
        t.with_ctes(
            t.READS,
            body="SELECT FILENAME, count(*) AS reads, CAST(sum(JUNCTION_LENGTH) AS BIGINT) AS length, max(md5(nullif(JUNCTION, ''))) AS last, true AS numbered FROM reads GROUP BY FILENAME",
        ),
    ),
    "matrix_table": (matrix_table, t.with_ctes(t.VECTORS, body=_cells("row_id", "value"))),
    "positional_table": (positional_table, "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_id, p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part"),
    "dictionary_table": (dictionary_table, t.with_ctes(t.SUBJECTS, body="SELECT DISTINCT FILENAME AS observation, labels AS label FROM subjects")),
    "embedding_file": (embedding_file, t.with_ctes(t.VECTORS, body=_cells("'w' || row_id AS word", "value"))),
    "model_file": (
        model_file,
        t.with_ctes(t.PROTEINS, t.FRAMES, t.WORDS, body="SELECT word, true AS same FROM words GROUP BY word HAVING count(*) >= 2"),
    ),
    "clusters_file": (clusters_file, t.with_ctes(t.VECTORS, body="SELECT row_id, label AS cluster FROM vectors")),
    "scores_file": (
        scores_file,
        "SELECT lang AS Inputfile, name AS model_name, round(avg(n_chars), 6) AS score FROM documents, (VALUES ('first'), ('second')) q(name) GROUP BY 1, 2",
    ),
    "union_files": (union_files, "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer"),
    "feature_file": (
        feature_file,
        t.with_ctes(
            t.VECTORS,
            t.SUBJECTS,
            "c AS (SELECT FILENAME AS subject, count(*) FILTER (label = 0) / count(*) AS f FROM vectors JOIN subjects USING (row_id) GROUP BY 1)",
            body="SELECT row_number() OVER (ORDER BY subject) - 1 AS row_id, subject, round(f, 6) AS first, true AS named FROM c",
        ),
    ),
    "labelled_file": (labelled_file, t.with_ctes(t.SUBJECTS, body="SELECT row_id, labels FROM subjects")),
    "folds_file": (folds_file, "SELECT vec_id AS row_id, CAST(1 AS BIGINT) AS tested, CAST(4 AS BIGINT) AS trained FROM embeddings"),
    "key_check": (
        key_check,
        """SELECT doc_id, count(d) AS left_rows, count(l) AS right_rows FROM (
  SELECT doc_id, 1 AS d, NULL AS l FROM documents UNION ALL SELECT doc_id, NULL, 1 FROM labels) GROUP BY doc_id HAVING count(d) <> 1 OR count(l) <> 1""",
    ),
}
