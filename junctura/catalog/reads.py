"""Queries over reads, sequences and n-grams."""

from __future__ import annotations

from pyspark.sql import functions as F

from junctura.catalog import tables as t
from junctura.functions.sequences import all_ngrams, file_stem, label_prefix, letters, trailing_number
from junctura.operators.corpus import build_corpus, corpus_lines, vocabulary
from junctura.operators.embedding import embed_with_models, mean_vectors, ngram_table, sequence_vectors, unembedded_share
from junctura.operators.families import add_family, unambiguous
from junctura.operators.labels import add_labels
from junctura.operators.reads import (
    exact_length,
    filter_reads,
    group_sizes,
    length_histogram,
    preprocess_reads,
    reads_funnel,
    translate_reads,
    unique_reads,
)
from junctura.session import cut_lineage, shuffles_removed
from junctura.sources.readers import parse_fasta, parse_list
from junctura.sources.writers import fasta_records


def reads_filter(spark, sf):
    return filter_reads(t.reads(spark, sf)).select("SEQUENCE_ID", "FILENAME", "JUNCTION_LENGTH", "CONSCOUNT", "JUNCTION")


def funnel(spark, sf):
    return reads_funnel(t.reads(spark, sf), min_rows=5)


def translate_trim(spark, sf):
    return translate_reads(filter_reads(t.reads(spark, sf)), (1, 2)).select("SEQUENCE_ID", "JUNC_AA")


def preprocess(spark, sf):
    return preprocess_reads(t.reads(spark, sf), (3, 4), min_rows=5).select("SEQUENCE_ID", "FILENAME", "JUNC_AA")


def unique(spark, sf):
    return unique_reads(t.proteins(spark, sf).drop("lang")).select("FILENAME", "JUNC_AA", "row_id", "UNIQCOUNT")


def sizes(spark, sf):
    return group_sizes(t.reads(spark, sf), "FILENAME")


def lengths(spark, sf):
    return length_histogram(t.proteins(spark, sf), "JUNC_AA").withColumn("length", F.col("length").cast("long"))


def length_bins(spark, sf):
    return length_histogram(t.proteins(spark, sf), "JUNC_AA", 35).select("bin", F.round("left", 6).alias("left"), "n")


def length_filter(spark, sf):
    return exact_length(t.table(spark, sf, "part"), "p_name", 8).select("p_partkey", "p_name")


def ngrams_frames(spark, sf):
    return corpus_lines(build_corpus(t.proteins(spark, sf), 3, text="JUNC_AA"))


def ngrams_frames_4(spark, sf):
    return corpus_lines(build_corpus(t.proteins(spark, sf), 4, text="JUNC_AA"))


def ngrams_single(spark, sf):
    return corpus_lines(build_corpus(t.proteins(spark, sf), 3, frame=2, trim=(2, 1), text="JUNC_AA"))


def ngrams_random(spark, sf):
    """The pieces put together again give the text; their lengths are random."""
    corpus = build_corpus(t.proteins(spark, sf), (3, 8), text="JUNC_AA", seed=1)
    short = F.exists(F.slice("words", 1, F.size("words") - 1), lambda w: (F.length(w) < 3) | (F.length(w) > 8))
    return corpus.select("row_id", F.array_join("words", "").alias("joined"), short.alias("bad_length"))


def vocab_counts(spark, sf):
    return vocabulary(build_corpus(t.proteins(spark, sf), 3, text="JUNC_AA"), 2)


def ngram_coverage(spark, sf):
    """How often each of the 400 possible 2-grams occurs."""
    seen = vocabulary(build_corpus(t.proteins(spark, sf), 2, text="JUNC_AA"), 1).withColumnRenamed("word", "Ngram")
    return all_ngrams(spark, 2).join(seen, "Ngram", "left").select("Ngram", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def given_embedding(spark, sf, min_count, n=3):
    corpus = build_corpus(t.proteins(spark, sf), n, text="JUNC_AA")
    with shuffles_removed(spark):
        return cut_lineage(t.vocabulary_numbers(vocabulary(corpus, min_count)))


def _position_rows(df, *keys):
    return df.select(*keys, F.posexplode("vec").alias("pos", "value")).select(*keys, "pos", F.round("value", 6).alias("value"))


def seq_vectors_given_vocab(spark, sf):
    return _position_rows(sequence_vectors(t.proteins(spark, sf), given_embedding(spark, sf, 20)), "row_id")


def fasta_parse(spark, sf):
    """Two records from a FASTA text of each document: one on two lines, one with carriage returns."""
    seq, row = F.col("JUNC_AA"), F.col("row_id").cast("string")
    one = F.concat(F.lit(">d"), row, F.lit(" more words\n"), F.substring(seq, 1, 60), F.lit("\n"), F.expr("substring(JUNC_AA, 61)"), F.lit("\n"))
    text = F.concat(one, F.lit("\n >e"), row, F.lit("\r\n"), F.expr("substring(JUNC_AA, 3)"), F.lit("\r\n"))
    return t.proteins(spark, sf).select(F.inline(parse_fasta(text)))


def seq_vectors_both_paths(spark, sf):
    """Both ways to meet a vocabulary, over rows that each share their key with a second one: rows, keys, and rows only one way has."""
    rows = t.proteins(spark, sf)
    twice = rows.unionByName(rows)
    sent, joined = (sequence_vectors(twice, given_embedding(spark, sf, 20), broadcast_bytes=b) for b in (1 << 26, 0))
    found = sent.select("row_id", "vec", F.lit(1).alias("way")).unionByName(joined.select("row_id", "vec", F.lit(-1).alias("way")))
    per = found.groupBy("row_id", "vec").agg(F.count("*").alias("n"), F.sum("way").alias("odd"))
    return per.agg(F.sum("n").alias("n"), F.countDistinct("row_id").alias("keys"), F.sum(F.abs("odd")).alias("odd"))


def seq_vectors_zero(spark, sf):
    """The zero-vector rule, and the join path for a vocabulary too large to send around."""
    found = sequence_vectors(
        t.proteins(spark, sf), given_embedding(spark, sf, 20), frame=3, on_unknown="zero", broadcast_bytes=0
    )
    return _position_rows(found, "row_id")


def ngram_embedding(spark, sf):
    """Every n-gram of the corpus with its count and its vector; a rare one gets zeros."""
    counts = vocabulary(build_corpus(t.proteins(spark, sf), 3, text="JUNC_AA"), 1)
    properties = counts.withColumnRenamed("word", "Ngram")
    joined = ngram_table(properties, given_embedding(spark, sf, 20), 3)
    return _position_rows(joined, "Ngram", "n")


LENGTHS = range(3, 9)


def embed_many(spark, sf):
    """One table under a model for each n-gram length from 3 to 8."""
    # made one by one: a vocabulary is counted when its turn comes
    models = ((f"n{n}", n, given_embedding(spark, sf, 2, n)) for n in LENGTHS)
    found = embed_with_models(t.proteins(spark, sf), models)
    return found.groupBy("model_id").agg(F.count("*").alias("n"), F.sum(F.col("vec")[0]).alias("first"))


def unembedded(spark, sf):
    data = t.proteins(spark, sf)
    found = sequence_vectors(data, given_embedding(spark, sf, 20))
    return unembedded_share(data, found).select("total", "dropped", F.round("percent_dropped", 6).alias("percent_dropped"))


def subject_mean_sequences(spark, sf):
    """Mean sequence vector of each file."""
    data = t.proteins(spark, sf)
    means = mean_vectors(sequence_vectors(data, given_embedding(spark, sf, 1)), data, "FILENAME")
    return _position_rows(means, "FILENAME")


def family_extract(spark, sf):
    return add_family(t.reads(spark, sf)).select("SEQUENCE_ID", "V_CALL", "V_FAMILY")


def family_counts(spark, sf):
    found = unambiguous(add_family(t.reads(spark, sf)))
    return group_sizes(found, "V_FAMILY").withColumn("family_number", trailing_number(F.col("V_FAMILY")))


def label_from_name(spark, sf):
    named = t.reads(spark, sf).select("SEQUENCE_ID", label_prefix(F.col("SEQUENCE_ID")).alias("CONDITION"), "FILENAME")
    return named.select("SEQUENCE_ID", "CONDITION", label_prefix(F.col("FILENAME")).alias("file_condition"))


def label_lookup(spark, sf):
    """Quality label of each labelled document; documents without one are dropped."""
    dictionary = t.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    found = add_labels(t.proteins(spark, sf), dictionary, "doc_id", "label", "row_id", on_missing="drop")
    return found.select("row_id", "FILENAME", "labels")


def stems(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", file_stem(F.regexp_extract("url", "^([^?#]*)", 1)).alias("stem"))


def letter_totals(spark, sf):
    rows = t.proteins(spark, sf).select("FILENAME", F.explode(letters(F.col("JUNC_AA"))).alias("letter"))
    return rows.groupBy("FILENAME", "letter").agg(F.count("*").alias("n"))


def fasta_text(spark, sf):
    return fasta_records(t.proteins(spark, sf), "row_id", "JUNC_AA").withColumnRenamed("value", "record")


def list_column(spark, sf):
    """Numbers of each document, written as a list in text and parsed back."""
    digits = F.regexp_extract_all(F.col("text"), F.lit("[1-9][0-9]{0,8}"), F.lit(0))
    text = F.concat(F.lit("["), F.array_join(digits, ", "), F.lit("]"))
    return (
        t.documents(spark, sf, "doc_id", "text")
        .select("doc_id", F.posexplode(parse_list(text)).alias("pos", "number"))
        .select("doc_id", "pos", "number")
    )


NEWLINE = "chr(10)"
CODED = """given AS (
  SELECT word, [a, b, c, a * c] AS vector, n FROM (
    SELECT word, n, CAST(ascii(substr(word, 1, 1)) - 64 AS DOUBLE) AS a, CAST(ascii(substr(word, 2, 1)) - 64 AS DOUBLE) AS b,
           CAST(ascii(substr(word, 3, 1)) - 64 AS DOUBLE) AS c
    FROM (SELECT word, count(*) AS n FROM words GROUP BY word)))"""


def _vector_sql(frame: int, min_count: int, zero: bool = False) -> str:
    """Sequence vectors as (row_id, pos, value), from single n-grams."""
    known = "bool_and(g.word IS NOT NULL)"
    keep = "" if zero else f"HAVING {known} AND count(w.word) > 0"
    total = lambda i: f"CASE WHEN {known} AND count(w.word) > 0 THEN sum(g.vector[{i}]) ELSE 0 END"
    parts = ", ".join(f"{total(i)} AS v{i}" for i in (1, 2, 3, 4))
    return f"""summed AS (
  SELECT p.row_id, {parts}
  FROM proteins p LEFT JOIN (SELECT * FROM words WHERE frame = {frame}) w ON w.row_id = p.row_id
  LEFT JOIN (SELECT * FROM given WHERE n >= {min_count}) g ON g.word = w.word
  GROUP BY p.row_id {keep})"""


UNPIVOT = "SELECT {keys}, pos, round([v1, v2, v3, v4][pos + 1], 6) AS value FROM {table}, (VALUES (0), (1), (2), (3)) AS q(pos)"
BASE = (t.PROTEINS, t.FRAMES, t.WORDS)

QUERIES = {
    "reads_filter": (
        reads_filter,
        t.with_ctes(t.READS, t.CLEAN, body="SELECT SEQUENCE_ID, FILENAME, JUNCTION_LENGTH, CONSCOUNT, JUNCTION FROM clean"),
    ),
    "reads_funnel": (
        funnel,
        t.with_ctes(
            t.READS,
            """per_file AS (
  SELECT FILENAME, count(*) AS total, count(*) FILTER (FUNCTIONAL = 'T') AS functional,
         count(*) FILTER (FUNCTIONAL = 'T' AND JUNCTION_LENGTH > 12 AND JUNCTION_LENGTH % 3 = 0) AS length,
         count(*) FILTER (FUNCTIONAL = 'T' AND JUNCTION_LENGTH > 12 AND JUNCTION_LENGTH % 3 = 0 AND CONSCOUNT > 1) AS conscount,
         count(*) FILTER (FUNCTIONAL = 'T' AND JUNCTION_LENGTH > 12 AND JUNCTION_LENGTH % 3 = 0 AND CONSCOUNT > 1
                          AND NOT regexp_matches(JUNCTION, '[N-]')) AS clean
  FROM reads GROUP BY FILENAME),
counted AS (SELECT *, CAST(clean > 5 AS BIGINT) AS kept_files FROM per_file)""",
            body="""SELECT * FROM counted UNION ALL
SELECT 'ALL', CAST(sum(total) AS BIGINT), CAST(sum(functional) AS BIGINT), CAST(sum(length) AS BIGINT),
       CAST(sum(conscount) AS BIGINT), CAST(sum(clean) AS BIGINT), CAST(sum(kept_files) AS BIGINT) FROM counted""",
        ),
    ),
    "translate_trim": (
        translate_trim,
        t.with_ctes(
            t.READS,
            t.CLEAN,
            t.TRANSLATED,
            body="SELECT SEQUENCE_ID, substr(protein, 2, greatest(length(protein) - 3, 0)) AS JUNC_AA FROM translated",
        ),
    ),
    "reads_preprocess": (
        preprocess,
        t.with_ctes(
            t.READS,
            t.CLEAN,
            t.TRANSLATED,
            body="""SELECT SEQUENCE_ID, FILENAME, substr(protein, 4, greatest(length(protein) - 7, 0)) AS JUNC_AA FROM translated
WHERE FILENAME IN (SELECT FILENAME FROM clean GROUP BY FILENAME HAVING count(*) > 5)""",
        ),
    ),
    "unique_reads": (
        unique,
        t.with_ctes(
            t.PROTEINS,
            body="SELECT FILENAME, JUNC_AA, min(row_id) AS row_id, count(*) AS UNIQCOUNT FROM proteins GROUP BY FILENAME, JUNC_AA",
        ),
    ),
    "group_sizes": (sizes, "SELECT source AS FILENAME, count(*) AS n FROM documents GROUP BY source"),
    "length_hist": (
        lengths,
        t.with_ctes(t.PROTEINS, body="SELECT length(JUNC_AA) AS length, count(*) AS n FROM proteins GROUP BY 1"),
    ),
    "length_hist_bins": (
        length_bins,
        t.with_ctes(
            t.PROTEINS,
            "ends AS (SELECT min(length(JUNC_AA)) AS lo, max(length(JUNC_AA)) AS hi FROM proteins)",
            "placed AS (SELECT CAST(least(floor((length(JUNC_AA) - lo) / ((hi - lo) / 35)), 34) AS INTEGER) AS bin, lo, hi FROM proteins, ends)",
            body='SELECT bin, round(lo + bin * ((hi - lo) / 35), 6) AS "left", count(*) AS n FROM placed GROUP BY bin, lo, hi',
        ),
    ),
    "length_filter": (length_filter, "SELECT p_partkey, p_name FROM part WHERE length(p_name) = 8"),
    "ngrams_frames": (
        ngrams_frames,
        t.with_ctes(t.PROTEINS, t.FRAMES, body="SELECT row_id, frame, array_to_string(words, ' ') AS line FROM frames"),
    ),
    "ngrams_frames_4": (
        ngrams_frames_4,
        t.with_ctes(
            t.PROTEINS,
            t.FRAMES.replace("'...'", "'....'"),
            body="SELECT row_id, frame, array_to_string(words, ' ') AS line FROM frames",
        ),
    ),
    "ngrams_single": (
        ngrams_single,
        t.with_ctes(
            t.PROTEINS,
            "cut AS (SELECT row_id, substr(JUNC_AA, 3, greatest(length(JUNC_AA) - 3, 0)) AS s FROM proteins)",
            body="SELECT row_id, CAST(2 AS INTEGER) AS frame, array_to_string(regexp_extract_all(substr(s, 2), '...'), ' ') AS line FROM cut",
        ),
    ),
    "ngrams_random": (
        ngrams_random,
        t.with_ctes(t.PROTEINS, body="SELECT row_id, JUNC_AA AS joined, false AS bad_length FROM proteins"),
    ),
    "vocab_counts": (
        vocab_counts,
        t.with_ctes(*BASE, body="SELECT word, count(*) AS n FROM words GROUP BY word HAVING count(*) >= 2"),
    ),
    "ngram_coverage": (
        ngram_coverage,
        t.with_ctes(
            t.PROTEINS,
            t.FRAMES.replace("'...'", "'..'"),
            t.WORDS,
            f"letters AS (SELECT unnest(string_split('{t.ACIDS}', '')) AS l)",
            body="""SELECT a.l || b.l AS Ngram, count(w.word) AS n FROM letters a CROSS JOIN letters b
LEFT JOIN words w ON w.word = a.l || b.l GROUP BY 1""",
        ),
    ),
    "seq_vectors_given_vocab": (
        seq_vectors_given_vocab,
        t.with_ctes(*BASE, CODED, _vector_sql(1, 20), body=UNPIVOT.format(keys="row_id", table="summed")),
    ),
    "fasta_parse": (
        fasta_parse,
        t.with_ctes(t.PROTEINS, body="SELECT 'd' || row_id AS id, JUNC_AA AS seq FROM proteins UNION ALL SELECT 'e' || row_id, substr(JUNC_AA, 3) FROM proteins"),
    ),
    "seq_vectors_both_paths": (
        seq_vectors_both_paths,
        t.with_ctes(*BASE, CODED, _vector_sql(1, 20), body="SELECT CAST(4 * count(*) AS BIGINT) AS n, count(DISTINCT row_id) AS keys, CAST(0 AS BIGINT) AS odd FROM summed"),
    ),
    "seq_vectors_zero": (
        seq_vectors_zero,
        t.with_ctes(*BASE, CODED, _vector_sql(3, 20, zero=True), body=UNPIVOT.format(keys="row_id", table="summed")),
    ),
    "ngram_embedding": (
        ngram_embedding,
        t.with_ctes(
            *BASE,
            CODED,
            "zeroed AS (SELECT word AS Ngram, n, CASE WHEN n >= 20 THEN vector ELSE [0.0, 0.0, 0.0, 0.0]::DOUBLE[] END AS v FROM given)",
            body="SELECT Ngram, n, pos, round(v[pos + 1], 6) AS value FROM zeroed, (VALUES (0), (1), (2), (3)) AS q(pos)",
        ),
    ),
    "embed_many_models": (
        embed_many,
        t.with_ctes(
            t.PROTEINS,
            "lengths AS (SELECT CAST(unnest(range(3, 9)) AS INTEGER) AS size)",
            "pieces AS (SELECT size, row_id, f AS frame, "
            "unnest(range(f, length(JUNC_AA) - size + 2, size)) AS start, JUNC_AA FROM proteins, lengths, (VALUES (1), (2), (3)) v(f))",
            "grams AS (SELECT size, row_id, frame, substr(JUNC_AA, start, size) AS word FROM pieces)",
            "common AS (SELECT size, word FROM grams GROUP BY size, word HAVING count(*) >= 2)",
            """whole AS (SELECT g.size, row_id, sum(ascii(g.word) - 64) AS v1 FROM grams g LEFT JOIN common c ON c.size = g.size AND c.word = g.word
  WHERE frame = 1 GROUP BY g.size, row_id HAVING count(c.word) = count(*))""",
            body="SELECT 'n' || size AS model_id, count(*) AS n, CAST(sum(v1) AS DOUBLE) AS first FROM whole GROUP BY size",
        ),
    ),
    "unembedded_share": (
        unembedded,
        t.with_ctes(
            *BASE,
            CODED,
            _vector_sql(1, 20),
            body="""SELECT count(*) AS total, count(*) FILTER (s.row_id IS NULL) AS dropped,
round(100.0 * count(*) FILTER (s.row_id IS NULL) / count(*), 6) AS percent_dropped
FROM proteins p LEFT JOIN summed s ON s.row_id = p.row_id""",
        ),
    ),
    "subject_mean_sequences": (
        subject_mean_sequences,
        t.with_ctes(
            *BASE,
            CODED,
            _vector_sql(1, 1),
            """means AS (SELECT FILENAME, avg(v1) AS v1, avg(v2) AS v2, avg(v3) AS v3, avg(v4) AS v4
  FROM summed s JOIN proteins p ON p.row_id = s.row_id GROUP BY FILENAME)""",
            body=UNPIVOT.format(keys="FILENAME", table="means"),
        ),
    ),
    "family_extract": (
        family_extract,
        t.with_ctes(
            t.READS,
            "found AS (SELECT SEQUENCE_ID, V_CALL, regexp_extract_all(V_CALL, 'IGHV[0-9]+') AS f FROM reads)",
            body="""SELECT SEQUENCE_ID, V_CALL, array_to_string(
  list_filter(f, lambda x, i: list_position(f, x) = i), ',') AS V_FAMILY FROM found""",
        ),
    ),
    "family_counts": (
        family_counts,
        t.with_ctes(
            t.READS,
            "found AS (SELECT unnest(list_distinct(regexp_extract_all(V_CALL, 'IGHV[0-9]+'))) AS V_FAMILY, len(list_distinct(regexp_extract_all(V_CALL, 'IGHV[0-9]+'))) AS k FROM reads)",
            body="SELECT V_FAMILY, count(*) AS n, CAST(right(V_FAMILY, 1) AS INTEGER) AS family_number FROM found WHERE k = 1 GROUP BY V_FAMILY",
        ),
    ),
    "label_prefix": (
        label_from_name,
        "SELECT 'read' || doc_id AS SEQUENCE_ID, 'read' AS CONDITION, regexp_extract(source, '^[^0-9]*') AS file_condition FROM documents",
    ),
    "label_lookup": (
        label_lookup,
        "SELECT d.doc_id AS row_id, source AS FILENAME, CAST(quality AS VARCHAR) AS labels FROM documents d JOIN labels l ON l.doc_id = d.doc_id",
    ),
    "file_stem": (
        stems,
        "SELECT page_id, regexp_replace(regexp_extract(regexp_extract(url, '^[^?#]*'), '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem FROM pages",
    ),
    "letter_totals": (
        letter_totals,
        t.with_ctes(
            t.PROTEINS,
            "l AS (SELECT FILENAME, unnest(string_split(JUNC_AA, '')) AS letter FROM proteins)",
            body="SELECT FILENAME, letter, count(*) AS n FROM l WHERE letter <> '' GROUP BY 1, 2",
        ),
    ),
    "fasta_records": (
        fasta_text,
        t.with_ctes(t.PROTEINS, body=f"SELECT '>' || row_id || {NEWLINE} || JUNC_AA AS record FROM proteins"),
    ),
    "list_column": (
        list_column,
        """WITH n AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[1-9][0-9]{0,8}'), lambda x: CAST(x AS BIGINT)) AS l FROM documents)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, number FROM (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS number FROM n)""",
    ),
}
