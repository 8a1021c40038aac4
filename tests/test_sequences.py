import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from junctura.functions import sequences as S
from junctura.operators import corpus as C
from junctura.operators import embedding, families, reads
from junctura.operators.embedding import ngram_table, sequence_vectors


def one(spark, text, expression, name="s"):
    return spark.createDataFrame([(text,)], f"{name} string").select(expression).first()[0]


@pytest.mark.parametrize(
    "text, n, frames",
    [
        ("AGAMQSASM", 3, [["AGA", "MQS", "ASM"], ["GAM", "QSA"], ["AMQ", "SAS"]]),
        ("acccgtgtctgg", 3, [["acc", "cgt", "gtc", "tgg"], ["ccc", "gtg", "tct"], ["ccg", "tgt", "ctg"]]),
        ("AGAMQSASM", 4, [["AGAM", "QSAS"], ["GAMQ", "SASM"], ["AMQS"]]),
        ("AG", 3, [[], [], []]),
        ("", 3, [[], [], []]),
    ],
)
def test_three_frames_whatever_n(spark, text, n, frames):
    assert one(spark, text, S.ngram_frames(F.col("s"), n)) == frames
    for i, frame in enumerate(frames):
        assert one(spark, text, S.ngrams(F.col("s"), n, i + 1)) == frame


def test_unknown_frame_raises():
    with pytest.raises(ValueError):
        S.ngrams(F.lit("A"), 3, 4)


@pytest.mark.parametrize(
    "dna, protein",
    [
        ("TGTGCGAGAGATTAA", "CARD*"),
        ("TGTGCGAGAGATTA", "CARD"),
        ("TGTNCG", "CX"),
        ("", ""),
        ("ATGTGGTGA", "MW*"),
        ("tgt", "X"),
    ],
)
def test_translate(spark, dna, protein):
    assert one(spark, dna, S.amino_acids(F.col("s"))) == protein


def test_translate_all_codons(spark):
    """Every codon, against the code written out as amino acid -> codons."""
    code = {
        "F": "TTT TTC", "L": "TTA TTG CTT CTC CTA CTG", "I": "ATT ATC ATA", "M": "ATG", "V": "GTT GTC GTA GTG",
        "S": "TCT TCC TCA TCG AGT AGC", "P": "CCT CCC CCA CCG", "T": "ACT ACC ACA ACG", "A": "GCT GCC GCA GCG",
        "Y": "TAT TAC", "*": "TAA TAG TGA", "H": "CAT CAC", "Q": "CAA CAG", "N": "AAT AAC", "K": "AAA AAG",
        "D": "GAT GAC", "E": "GAA GAG", "C": "TGT TGC", "W": "TGG", "R": "CGT CGC CGA CGG AGA AGG", "G": "GGT GGC GGA GGG",
    }
    codons = [(codon, acid) for acid, many in code.items() for codon in many.split()]
    assert len(codons) == 64
    dna, protein = "".join(c for c, _ in codons), "".join(a for _, a in codons)
    assert one(spark, dna, S.amino_acids(F.col("s"))) == protein


@pytest.mark.parametrize("a, b, out", [(1, 1, "ARD"), (1, 0, "ARD*"), (0, 0, "CARD*"), (3, 2, ""), (9, 9, "")])
def test_trim(spark, a, b, out):
    assert one(spark, "CARD*", S.trim_ends(F.col("s"), a, b)) == out


def test_random_pieces_of_a_batch_are_places_in_its_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ACDEäß€\U0001f600\n") for _ in range(rng.choice([0, 2, 9, 4000]))) for _ in range(300)]
    texts[7] = texts[20] = None

    def one(key, value):
        if value is None:
            return None
        draw = random.Random(f"1:{key}")
        out, at, size = [], 0, draw.randint(3, 8)
        while len(value) - at - 3 > size:
            out.append(value[at : at + size])
            at += size
            size = draw.randint(3, 8)
        return [*out, value[at:]]

    batch = pa.array(texts)
    want = [one(k, v) for k, v in enumerate(texts)]
    tracemalloc.start()
    got = S.cut_texts(pa.array(range(300)), batch, 3, 8, 1)
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == want and used < 5 * batch.nbytes
    assert S.cut_texts(pa.array(range(200))[5:30], batch[5:30], 3, 8, 1).to_pylist() == want[5:30]
    assert S.cut_texts(pa.array([0, 1]), pa.array(["", None]), 3, 8).to_pylist() == [[""], None]


def test_random_ngrams(spark):
    rows = spark.createDataFrame([(i, "AGAMQSASMRDSRGPDPVSRATHNWFDP") for i in range(40)], "id long, s string")
    cut = [r[0] for r in rows.select(S.random_ngrams(F.col("s"), 3, 8, F.col("id"), 1)).collect()]
    assert all("".join(c) == "AGAMQSASMRDSRGPDPVSRATHNWFDP" for c in cut)
    assert all(3 <= len(p) <= 8 for c in cut for p in c[:-1])
    assert len({tuple(c) for c in cut}) > 5
    again = [r[0] for r in rows.repartition(7).orderBy("id").select(S.random_ngrams(F.col("s"), 3, 8, F.col("id"), 1)).collect()]
    assert cut == again
    fixed = spark.createDataFrame([(0, "AGAMQSASMR")], "id long, s string")
    assert fixed.select(S.random_ngrams(F.col("s"), 3, 3, F.col("id"))).first()[0] == ["AGA", "MQS", "ASMR"]


def test_names(spark):
    assert one(spark, "IGHV1-2*01,IGHV3-23*01,IGHV1-8*01", S.gene_families(F.col("s"))) == "IGHV1,IGHV3"
    assert one(spark, "CI16", S.label_prefix(F.col("s"))) == "CI"
    assert one(spark, "IGHV3", S.trailing_number(F.col("s"))) == 3
    assert one(spark, "IGHVx", S.trailing_number(F.col("s"))) is None
    for path, stem in [("/a/b/x_collapsed.tab", "x_collapsed"), ("c:\\d\\y.v2.csv", "y.v2"), ("plain", "plain"), (".hidden", ".hidden")]:
        assert one(spark, path, S.file_stem(F.col("s"))) == stem


def test_all_ngrams(spark):
    assert S.all_ngrams(spark, 3).distinct().count() == 8000


READS = [
    ("a", "T", 15, 2, "TGTGCGAGAGATTAA"),
    ("b", "F", 15, 2, "TGTGCGAGAGATTAA"),
    ("c", "T", 12, 2, "TGTGCGAGAGAT"),
    ("d", "T", 16, 2, "TGTGCGAGAGATTAAA"),
    ("e", "T", 15, 1, "TGTGCGAGAGATTAA"),
    ("f", "T", 15, 2, "TGTGCGAGNGATTAA"),
]


def reads_table(spark, file="x"):
    rows = [(i, *r, file) for i, r in enumerate(READS)]
    return spark.createDataFrame(
        rows, "row_id long, SEQUENCE_ID string, FUNCTIONAL string, JUNCTION_LENGTH int, CONSCOUNT int, JUNCTION string, FILENAME string"
    )


def test_read_filter_and_funnel(spark):
    table = reads_table(spark)
    assert [r.SEQUENCE_ID for r in reads.filter_reads(table).collect()] == ["a"]
    per_file = {r.FILENAME: r.asDict() for r in reads.reads_funnel(table, min_rows=0).collect()}
    steps = {"total": 6, "functional": 5, "length": 3, "conscount": 2, "clean": 1, "kept_files": 1}
    for name in ("x", "ALL"):
        assert {k: per_file[name][k] for k in steps} == steps
    dropped = {r.FILENAME: r for r in reads.reads_funnel(table, min_rows=1).collect()}
    assert dropped["ALL"].kept_files == 0 and dropped["ALL"].clean == 1


def test_preprocess_drops_small_files(spark):
    table = reads_table(spark)
    assert reads.preprocess_reads(table, (1, 1), min_rows=0).first().JUNC_AA == "ARD"
    assert reads.preprocess_reads(table, (1, 1), min_rows=1).count() == 0  # strictly more


def test_unique_reads(spark):
    rows = [(3, "f1", "AAA", "late"), (0, "f1", "AAA", "first"), (1, "f1", "BBB", "b"), (2, "f2", "AAA", "c")]
    table = spark.createDataFrame(rows, "row_id long, FILENAME string, JUNC_AA string, note string")
    got = {(r.FILENAME, r.JUNC_AA): (r.UNIQCOUNT, r.note) for r in reads.unique_reads(table.repartition(5)).collect()}
    assert got == {("f1", "AAA"): (2, "first"), ("f1", "BBB"): (1, "b"), ("f2", "AAA"): (1, "c")}


def test_corpus_forms(spark):
    table = spark.createDataFrame([(0, "AGAMQSASM")], "row_id long, seq string")
    assert C.build_corpus(table, 3).count() == 3
    single = C.build_corpus(table, 3, frame=2).first()
    assert (single.frame, single.words) == (2, ["GAM", "QSA"])
    assert C.corpus_lines(C.build_corpus(table, 3, frame=1, trim=(1, 1))).first().line == "GAM QSA"
    assert C.build_corpus(table, (3, 8)).count() == 1
    assert {r.word: r.n for r in C.vocabulary(C.build_corpus(table, 3), 1).collect()}["AGA"] == 1
    assert C.vocabulary(C.build_corpus(table, 3), 2).count() == 0


def test_families(spark):
    table = spark.createDataFrame(
        [(i, c) for i, c in enumerate(["IGHV1-2*01", "IGHV1-2*01,IGHV3-1*01", "none", "IGHV4-1*01,IGHV4-2*01"])], "row_id long, V_CALL string"
    )
    kept = families.unambiguous(families.add_family(table))
    assert sorted(r.V_FAMILY for r in kept.collect()) == ["IGHV1", "IGHV4"]
    sample = families.family_sample(kept, ("IGHV1", "IGHV4"), 1)
    assert sorted(r.family_number for r in sample.collect()) == [1, 4]
    with pytest.raises(ValueError, match="IGHV3"):
        families.family_sample(kept, ("IGHV1", "IGHV3", "IGHV4"), 1)


def test_same_bits_and_rows_on_both_paths(spark):
    rng = np.random.default_rng(3)
    letters = "ACD"
    words = [a + b + c for a in letters for b in letters for c in letters]
    table = spark.createDataFrame([(w, [float(x) for x in rng.normal(size=5) * 10.0 ** rng.integers(-8, 8, 5)]) for w in words[:-2]], "word string, vector array<double>")
    texts = ["".join(rng.choice(list(letters), int(n))) for n in rng.integers(0, 60, 80)] + [None, ""]
    rows = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)] + [(0, texts[0]), (0, texts[0])], "row_id long, JUNC_AA string")
    for unknown in ("drop", "zero"):
        sent, joined = (sequence_vectors(rows, table, on_unknown=unknown, broadcast_bytes=b) for b in (1 << 20, 0))
        assert sent.count() == joined.count() == (rows.count() if unknown == "zero" else sent.count())
        assert sent.exceptAll(joined).count() == 0


def test_repeated_ngrams(spark):
    table = spark.createDataFrame([("ACD", [1.0, 2.0])], "word string, vector array<double>")
    properties = spark.createDataFrame([("ACD", 1), ("ACD", 2), ("CCC", 3)], "Ngram string, n int")
    got = sorted((r.n, r.vec) for r in ngram_table(properties, table).collect())
    assert got == [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [0.0, 0.0])]


def test_blocks_of_sequences_ask_for_each_word_once(spark, monkeypatch):
    table = spark.createDataFrame([("ACD", [0.5, 3.0]), ("CCC", [2.0, 0.25])], "word string, vector array<double>")
    rows = spark.createDataFrame([(None, "ACDCCC" * 30)] + [(k, "ACD" * (k % 5)) for k in range(60)], "row_id long, JUNC_AA string")
    expected = {r.row_id: r.vec for r in sequence_vectors(rows, table, on_unknown="zero").collect()}
    monkeypatch.setattr(embedding, "BLOCK_BYTES", 2048)
    found = sequence_vectors(rows, table, on_unknown="zero", broadcast_bytes=0)
    assert {r.row_id: r.vec for r in found.collect()} == expected
    # no n-gram carries its sequence's key, or a digest of it, through a shuffle
    assert "sha2" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_models_leave_no_shuffle_files(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
        return {f for f in found if "shuffle_" in f}

    table = spark.createDataFrame([("ACD", [1.0])] * 1, "word string, vector array<double>")
    rows = spark.createDataFrame([(k, "ACD" * 3) for k in range(20)], "row_id long, JUNC_AA string").repartition(3, "row_id")
    before = files()
    found = embedding.embed_with_models(rows, (("m%d" % k, 3, table) for k in range(2)))
    for _ in range(50):
        left = {f for f in files() - before if f.endswith(".data")}
        if not left:
            break
        time.sleep(0.1)
    assert not left and found.count() == 40


def test_vocabulary_is_counted_once_and_never_python_rows(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    table = spark.createDataFrame([("ACD", [1.0, 2.0]), ("CCC", [0.5, 4.0])], "word string, vector array<double>").mapInArrow(told, "word string, vector array<double>")
    rows = spark.createDataFrame([(1, "ACDCCC"), (2, "ACDAAA")], "row_id long, JUNC_AA string")
    collected = []
    monkeypatch.setattr(type(table), "collect", lambda self, run=type(table).collect: collected.append(self.columns) or run(self))
    found = embedding.embed_with_models(rows, [("m", 3, table)])
    assert seen.value == 2 and ["word", "vector"] not in collected
    assert [(r.model_id, r.row_id, r.vec) for r in found.collect()] == [("m", 1, [1.5, 6.0])]
