import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from junctura.operators import corpus as C
from junctura.operators import embedding as M
from junctura.operators import reads
from junctura.operators.labels import add_labels
from junctura.operators.sampling import fold_tables
from junctura.plans import flows
from junctura.schemas import MAKEDB_READS, SCORES, SchemaMismatch, require_same_keys
from junctura.operators.evaluate import score_row
from junctura.sources import readers as R
from junctura.sources import writers as W

HEADER = ["EXTRA", *MAKEDB_READS.names]


def write_reads(folder, name, rows, header=HEADER):
    text = "\n".join(["\t".join(header), *["\t".join(map(str, r)) for r in rows]]) + "\n"
    (folder / name).write_text(text)


def test_annotated_reads(spark, tmp_path):
    good = ("x", "id1", "T", 15, "TGTGCGAGAGATTAA", 1, 2, "IGHV1-2*01", "D", "J")
    write_reads(tmp_path, "p1_collapsed.tab", [good, good])
    write_reads(tmp_path, "p2_collapsed.tab", [good])
    write_reads(tmp_path, "other.tab", [good])
    table = R.read_annotated_reads(spark, str(tmp_path))
    assert [(r.row_id, r.FILENAME) for r in table.orderBy("row_id").collect()] == [(0, "p1_collapsed"), (1, "p1_collapsed"), (2, "p2_collapsed")]
    assert table.schema["JUNCTION_LENGTH"].dataType.simpleString() == "int"
    assert [r.JUNC_AA for r in reads.preprocess_reads(table, (1, 1), 0).collect()] == ["ARD"] * 3
    assert R.read_annotated_reads(spark, str(tmp_path), row_ids=False).count() == 3


def test_missing_columns(spark, tmp_path):
    write_reads(tmp_path, "a_collapsed.tab", [("1",)], ["SEQUENCE_ID"])
    with pytest.raises(SchemaMismatch):
        R.read_annotated_reads(spark, str(tmp_path))


def test_delimited_tables(spark, tmp_path):
    (tmp_path / "d.csv").write_text("extra,label,observation\n1,CI,CI16\n2,C,C1\n")
    table = R.read_label_dictionary(spark, str(tmp_path / "d.csv"))
    assert [tuple(r) for r in table.orderBy("observation").collect()] == [("C1", "C"), ("CI16", "CI")]
    (tmp_path / "t.csv").write_text(",5,9\nA,0.25,0.75\nB,,1\n")
    keyed = R.read_keyed(spark, str(tmp_path / "t.csv"), "FILENAME")
    assert [tuple(r) for r in keyed.orderBy("FILENAME").collect()] == [("A", 0.25, 0.75), ("B", None, 1.0)]
    (tmp_path / "s.csv").write_text("a;b\n1;x\n")
    assert R.read_table(spark, str(tmp_path / "s.csv"), sep=";").first().b == "x"


def test_matrix_by_position_and_by_key(spark, tmp_path):
    (tmp_path / "m.csv").write_text("0, 1\n" + "".join(f"{i}, {i * 2.5}\n" for i in range(50)))
    rows = R.read_matrix(spark, str(tmp_path / "m.csv")).orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(50)) and rows[3].vec == [3.0, 7.5]
    (tmp_path / "k.csv").write_text("row_id,0,1\n7,1,2\n")
    assert R.read_matrix(spark, str(tmp_path / "k.csv"), "row_id").first().vec == [1.0, 2.0]


def test_positions_over_many_blocks(spark, tmp_path):
    (tmp_path / "big.csv").write_text("v\n" + "".join(f"{i:08d}\n" for i in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        table = R.read_positional(spark, str(tmp_path / "big.csv"))
        assert table.where(F.col("v").cast("long") != F.col("row_id")).count() == 0
        assert table.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fasta(spark, tmp_path):
    (tmp_path / "f.fasta").write_text(">a first read\nACGT\nTT\n>b\nGG\r\nCC\n\n>c\n")
    got = {r.id: r.seq for r in R.read_fasta(spark, str(tmp_path / "f.fasta")).collect()}
    assert got == {"a": "ACGTTT", "b": "GGCC", "c": ""}
    table = spark.createDataFrame([("x", "ACG"), ("y", "TT")], "id string, seq string")
    W.write_fasta(table, str(tmp_path / "out"))
    again = {r.id: r.seq for r in R.read_fasta(spark, str(tmp_path / "out")).collect()}
    assert again == {"x": "ACG", "y": "TT"}


def test_corpus_and_model_files(spark, tmp_path):
    table = spark.createDataFrame([(i, "AGAMQSASM") for i in range(5)], "row_id long, seq string")
    corpus = C.build_corpus(table, 3)
    W.write_corpus(corpus, str(tmp_path / "corpus"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "corpus")).collect()]
    assert sorted(set(lines)) == ["AGA MQS ASM", "AMQ SAS", "GAM QSA"] and len(lines) == 15
    model = M.train_embedding(corpus, size=4, min_count=2)
    W.save_model(model, str(tmp_path / "model"))
    W.write_embedding(M.embedding_table(model), str(tmp_path / "table"))
    a = {r.word: r.vector for r in R.read_embedding(spark, str(tmp_path / "model"), "word2vec").collect()}
    assert a == {r.word: r.vector for r in R.read_embedding(spark, str(tmp_path / "table")).collect()} and len(a) == 7


def test_other_sinks(spark, tmp_path):
    near = spark.createDataFrame([(0, 0, 0, 0.0), (0, 1, 4, 1.5), (4, 0, 4, 0.0)], "row_id long, rank int, neighbor long, dist double")
    W.write_neighbours(near, str(tmp_path / "nn"), 1)
    rows = R.read_table(spark, str(tmp_path / "nn" / "NN")).orderBy("row_id").collect()
    assert [tuple(r) for r in rows] == [("0", "0", "4"), ("4", "4", None)]
    assert R.read_table(spark, str(tmp_path / "nn" / "distances")).count() == 2
    data = spark.createDataFrame([(i, f"s{i % 4}") for i in range(8)], "row_id long, s string")
    W.write_folds(fold_tables(data, "s", 2), str(tmp_path / "folds"))
    back = spark.read.parquet(str(tmp_path / "folds"))
    assert back.where("role = 'test'").count() == 8 and set(back.columns) == {"row_id", "s", "fold", "role"}
    W.append_clusters(data, data.select("row_id", F.lit(1).alias("cluster")), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).where("cluster = 1").count() == 8
    W.write_clusters(data.select("row_id", F.lit(1).alias("cluster")), str(tmp_path / "cc"))
    for _ in range(2):
        W.append_scores(score_row(spark, Inputfile="x", score=0.5), str(tmp_path / "scores"))
    assert spark.read.parquet(str(tmp_path / "scores")).schema.names == SCORES.names
    assert spark.read.parquet(str(tmp_path / "scores")).count() == 2
    table = spark.createDataFrame([("A", 1, 1.0)], "SUBJECT string, feature int, freq double")
    path = W.write_feature_table(table, "/in/reads.v1.csv", str(tmp_path), "SUBJECT")
    assert path.endswith("/reads_feature_table.csv") and R.read_table(spark, path).first()["1"] == "1.0"
    assert W.labelled_path("/a/x_feature_table.csv") == "/a/x_feature_table_with_labels.csv" and W.labelled_path("x.csv") == "x_with_labels.csv"
    W.write_vectors(spark.createDataFrame([(1, [0.5, 2.0])], "row_id long, vec array<double>"), str(tmp_path / "v"), 2)
    assert R.read_matrix(spark, str(tmp_path / "v"), "row_id").first().vec == [0.5, 2.0]
    W.write_tsv(data, str(tmp_path / "tsv"))
    assert R.read_tsv(spark, str(tmp_path / "tsv")).count() == 8


def test_neighbourhood_file(spark, tmp_path):
    (tmp_path / "n.csv").write_text('neighbors,how_many_subjects,HC\n"[0, 2]",2,0.5\n"[1, 0]",1,1.0\n')
    rows = R.read_neighbourhoods(spark, str(tmp_path / "n.csv"), ["HC"]).orderBy("row_id").collect()
    assert rows[1].neighbors == [1, 0] and rows[0].HC == 0.5


def test_same_keys(spark):
    a, b = spark.range(3).toDF("row_id"), spark.range(2).toDF("row_id")
    require_same_keys(a, a, "row_id")
    with pytest.raises(SchemaMismatch):
        require_same_keys(a, b, "row_id")


VOCABULARY = [("AGA", [1.0, 0.0]), ("MQS", [0.0, 2.0]), ("ASM", [1.0, 1.0])]


@pytest.mark.parametrize("limit", [M.VOCABULARY_BYTES, 0])
def test_sequence_vectors(spark, limit):
    table = spark.createDataFrame([(0, "AGAMQSASM"), (1, "AGAXXX"), (2, "AG"), (3, "AGAAGAMQ"), (4, None)], "row_id long, JUNC_AA string")
    vocabulary = spark.createDataFrame(VOCABULARY, "word string, vector array<double>")
    got = {r.row_id: r.vec for r in M.sequence_vectors(table, vocabulary, broadcast_bytes=limit).collect()}
    assert got == {0: [2.0, 3.0], 3: [2.0, 0.0]}
    zero = {r.row_id: r.vec for r in M.sequence_vectors(table, vocabulary, on_unknown="zero", broadcast_bytes=limit).collect()}
    assert zero == {**got, 1: [0.0, 0.0], 2: [0.0, 0.0], 4: [0.0, 0.0]}
    lost = spark.createDataFrame(VOCABULARY[:1], "word string, vector array<double>")
    assert 0 not in {r.row_id for r in M.sequence_vectors(table, lost, broadcast_bytes=limit).collect()}


def test_unembedded_share(spark):
    data, vectors = spark.range(4).toDF("row_id"), spark.range(3).toDF("row_id")
    row = M.unembedded_share(data, vectors).first()
    assert (row.total, row.dropped, row.percent_dropped) == (4, 1, 25.0)
    assert M.drop_unembedded(data, vectors).count() == 3


def test_train_models(spark):
    table = spark.createDataFrame([(i, "AGAMQSASMRDSRGPD") for i in range(4)], "row_id long, seq string")
    models = M.train_models(table, (3, 4, (3, 5)), size=3, iterations=1)
    assert set(models) == {"n3", "n4", "n3-5"}


def repertoire(spark, subjects=8, per=60, seed=0):
    """Reads whose vectors lean to a subject's condition in one region."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(subjects * per):
        s = i % subjects
        center = np.array([3.0, 0, 0]) if (s % 2 == 0 and i % 3 == 0) else np.zeros(3)
        rows.append((i, [float(v) for v in rng.normal(size=3) * 0.5 + center], f"s{s}", "HC" if s % 2 == 0 else "CD"))
    table = spark.createDataFrame(rows, "row_id long, vec array<double>, FILENAME string, labels string").cache()
    return table.select("row_id", "vec"), table.select("row_id", "FILENAME", "labels")


def dictionary(data):
    return data.select(F.col("FILENAME").alias("observation"), F.col("labels").alias("label")).distinct()


def test_proximity_flow(spark):
    vectors, data = repertoire(spark)
    fitted = flows.fit_proximity(vectors, data, "HC", k=12, min_significance=0.6, min_subjects=2)
    assert fitted.features.count() == fitted.selected.count() > 0
    own = {(r.row_id, r.neighbor) for r in fitted.neighbours.select("row_id", "neighbor").collect()}
    order = fitted.selected.orderBy(F.desc("significance"), "row_id").collect()
    for i, late in enumerate(order):
        assert not any((early.row_id, late.row_id) in own for early in order[:i])
    table = flows.radius_feature_table(vectors, data, fitted.features)
    sums = {r.FILENAME: r.s for r in table.groupBy("FILENAME").agg(F.sum("freq").alias("s")).collect()}
    assert set(sums) == {f"s{i}" for i in range(8)}
    assert all(v is None or abs(v - 1) < 1e-9 for v in sums.values())


def test_partitions_do_not_matter(spark):
    vectors, data = repertoire(spark, per=30)
    settings = {"k": 12, "min_significance": 0.6, "min_subjects": 2}

    def run(n):
        rows = flows.proximity_flow(vectors.repartition(n), data.repartition(n + 1), "HC", **settings).collect()
        return sorted((r.FILENAME, r.feature or -1, r.n, r.freq or -1.0) for r in rows)

    assert run(2) == run(9)


def test_proximity_folds(spark):
    vectors, data = repertoire(spark, per=30)
    tables = flows.proximity_folds(vectors, data, "HC", 2, k=8, min_significance=0.6, min_subjects=1)
    roles = {(r.fold, r.FILENAME): r.role for r in tables.select("fold", "role", "FILENAME").distinct().collect()}
    assert len(roles) == 16 and sum(v == "test" for v in roles.values()) == 8


def test_kmeans_flow_and_grid(spark):
    vectors, data = repertoire(spark, per=20)
    table, matrix, classes = flows.kmeans_flow(vectors, data, dictionary(data), "FILENAME", 2, 3, 2)
    assert classes == ["CD", "HC"] and matrix.count() == 8
    assert len(matrix.first().features) == table.select("feature").distinct().count()
    scores = flows.experiment_grid(vectors, data, dictionary(data), "FILENAME", (2, None), (3,), ("NB",), depth=1, repeats=1)
    assert scores.schema.names == SCORES.names and scores.count() == 2
    assert {r.number_of_dimensions for r in scores.collect()} == {2, None}


def test_mean_vector_classifier(spark):
    vectors, data = repertoire(spark, subjects=20, per=12)
    found = flows.classify_mean_vectors(vectors, data, dictionary(data), "NB", "FILENAME", repeats=3)
    assert found.predictions.count() == 12 and found.scores().first().accuracy > 0.7


def test_reads_to_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [
        (i, f"r{i}", "T", 30, "TGT" + "".join(rng.choice(list("ACG"), 24)) + "TGG", 2, "f")
        for i in range(120)
    ]
    table = spark.createDataFrame(
        rows, "row_id long, SEQUENCE_ID string, FUNCTIONAL string, JUNCTION_LENGTH int, JUNCTION string, CONSCOUNT int, FILENAME string"
    )
    clean, embedding, vectors = flows.reads_to_vectors(table, min_rows=10, size=5, iterations=1, min_count=1)
    assert clean.count() == vectors.count() == 120 and len(vectors.first().vec) == 5
    known = {r.word: np.array(r.vector) for r in embedding.collect()}
    one = clean.join(vectors, "row_id").first()
    words = [one.JUNC_AA[i : i + 3] for i in range(0, len(one.JUNC_AA) - 2, 3)]
    assert np.allclose(one.vec, sum(known[w] for w in words))


def test_row_operators_accept_a_stream(spark, tmp_path):
    """Filters, translation and stream-static lookups need no state, so a stream can pass through."""
    rows = [(0, "T", 15, 2, "TGTGCGAGAGATTAA", "s1"), (1, "F", 15, 2, "TGTGCGAGAGATTAA", "s2")]
    schema = "row_id long, FUNCTIONAL string, JUNCTION_LENGTH int, CONSCOUNT int, JUNCTION string, SUBJECT string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    labels = spark.createDataFrame([("s1", "HC"), ("s2", "CD")], "observation string, label string")
    out = add_labels(reads.translate_reads(reads.filter_reads(stream), (1, 1)), labels, "observation", "label", on_missing="drop")
    query = out.writeStream.format("memory").queryName("translated").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "state")
    ).start()
    query.awaitTermination(120)
    assert [(r.JUNC_AA, r.labels) for r in spark.table("translated").collect()] == [("ARD", "HC")]


def test_malformed_cells_raise_or_become_null(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a,b\n1,x\nzwei,y\n,z\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    with pytest.raises(Exception, match="can't hold zwei"):
        R.read_table(spark, str(tmp_path / "m.csv"), schema).collect()
    got = R.read_table(spark, str(tmp_path / "m.csv"), schema, malformed="null").collect()
    assert [r.a for r in got] == [1, None, None]
