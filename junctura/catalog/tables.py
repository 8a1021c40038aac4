"""The given tables in the roles the operators expect, in Spark and as SQL common table expressions.

documents play annotated reads: the file is ``source``, the junction is the text with its
letters mapped to bases and its digits to gaps, support is the number of line breaks.
embeddings play read vectors, with twenty subjects of one condition each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
BASES_FOR = "ACGTTGCAACGTCATGGTACTCAGAC----------"
ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "documents").select(*columns)


def reads(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "doc_id", "text", "lang", "source", "n_chars")
    # the stripped text is worked out once a row: an expression would be repeated in every filter that uses it
    docs = docs.select("*", F.explode_outer(F.array(F.regexp_replace("text", "[^A-Za-z0-9]", ""))).alias("plain"))
    plain = F.col("plain")
    number = lambda c, m: F.pmod(F.col(c), F.lit(m)).cast("string")
    first = F.concat(F.lit("IGHV"), number("n_chars", 7), F.lit("-"), number("n_chars", 50), F.lit("*01"))
    second = F.concat(F.lit(",IGHV"), number("doc_id", 7), F.lit("-2*03"))
    return (
        docs.withColumn("JUNCTION", F.translate(F.lower(plain), LETTERS, BASES_FOR))
        .select(
            F.col("doc_id").alias("row_id"),
            F.concat(F.lit("read"), F.col("doc_id").cast("string")).alias("SEQUENCE_ID"),
            # a comparison without NULL, so that a filter on it reaches the scan as one on lang
            F.when(F.col("lang").eqNullSafe("en"), "T").otherwise("F").alias("FUNCTIONAL"),
            F.length(plain).cast("int").alias("JUNCTION_LENGTH"),
            "JUNCTION",
            (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).cast("int").alias("CONSCOUNT"),
            F.concat(first, F.when(F.col("lang") != "en", second).otherwise("")).alias("V_CALL"),
            F.col("source").alias("FILENAME"),
        )
    )


READS = f"""reads AS (
  SELECT doc_id AS row_id, 'read' || doc_id AS SEQUENCE_ID,
         CASE WHEN lang = 'en' THEN 'T' ELSE 'F' END AS FUNCTIONAL,
         CAST(length(j) AS INTEGER) AS JUNCTION_LENGTH, j AS JUNCTION,
         CAST(length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS CONSCOUNT,
         'IGHV' || (n_chars % 7) || '-' || (n_chars % 50) || '*01'
           || CASE WHEN lang <> 'en' THEN ',IGHV' || (doc_id % 7) || '-2*03' ELSE '' END AS V_CALL,
         source AS FILENAME
  FROM (SELECT *, translate(lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')), '{LETTERS}', '{BASES_FOR}') AS j
        FROM documents))"""

CLEAN = """clean AS (
  SELECT * FROM reads
  WHERE FUNCTIONAL = 'T' AND JUNCTION_LENGTH > 12 AND JUNCTION_LENGTH % 3 = 0 AND CONSCOUNT > 1
    AND NOT regexp_matches(JUNCTION, '[N-]'))"""


def translated(codons: str) -> str:
    """SQL for the amino acids of a list of codons (one letter each, X where unknown)."""
    acids = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
    at = lambda i: f"strpos('TCAG', substr(c, {i}, 1))"
    return (
        f"array_to_string(list_transform({codons}, lambda c: CASE WHEN {at(1)} > 0 AND {at(2)} > 0 AND {at(3)} > 0 "
        f"THEN substr('{acids}', CAST(16 * ({at(1)} - 1) + 4 * ({at(2)} - 1) + {at(3)} AS INTEGER), 1) ELSE 'X' END), '')"
    )


TRANSLATED = f"""translated AS (
  SELECT *, {translated("regexp_extract_all(JUNCTION, '...')")} AS protein FROM clean)"""


def proteins(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, FILENAME, JUNC_AA): every document's amino-acid letters."""
    return documents(spark, sf, "doc_id", "text", "lang", "source").select(
        F.col("doc_id").alias("row_id"),
        F.col("source").alias("FILENAME"),
        "lang",
        F.upper(F.regexp_replace("text", f"[^{ACIDS}{ACIDS.lower()}]", "")).alias("JUNC_AA"),
    )


PROTEINS = f"""proteins AS (
  SELECT doc_id AS row_id, source AS FILENAME, lang,
         regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^{ACIDS}]', '', 'g') AS JUNC_AA
  FROM documents)"""

FRAMES = """frames AS (
  SELECT row_id, f AS frame, regexp_extract_all(substr(JUNC_AA, f), '...') AS words
  FROM proteins, (VALUES (1), (2), (3)) AS v(f))"""

WORDS = "words AS (SELECT row_id, frame, unnest(words) AS word FROM frames)"


def vocabulary_numbers(vocabulary: DataFrame) -> DataFrame:
    """A given embedding: four whole numbers per n-gram, from its letters."""
    code = lambda i: (F.ascii(F.substring("word", i, 1)) - 64).cast("double")
    return vocabulary.select("word", F.array(code(1), code(2), code(3), code(1) * code(3)).alias("vector"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, vec, label) of the embeddings."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, FILENAME, labels): each embedding's subject and its condition."""
    number = F.pmod(F.col("vec_id"), F.lit(20))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.concat(F.lit("s"), number.cast("string")).alias("FILENAME"),
        F.when(F.pmod(number, F.lit(2)) == 0, "HC").otherwise("CD").alias("labels"),
    )


VECTORS = """vectors AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"""

SUBJECTS = """subjects AS (
  SELECT vec_id AS row_id, 's' || (vec_id % 20) AS FILENAME,
         CASE WHEN (vec_id % 20) % 2 = 0 THEN 'HC' ELSE 'CD' END AS labels
  FROM embeddings)"""

K = 10


def knn_sql(k: int = K) -> str:
    """Neighbours of every vector: itself as rank 0, then the k nearest others."""
    return f"""nn AS (
  SELECT row_id, CAST(r - 1 AS INTEGER) AS rank, neighbor, dist FROM (
    SELECT a.row_id, b.row_id AS neighbor, list_distance(a.vec, b.vec) AS dist,
           row_number() OVER (PARTITION BY a.row_id
             ORDER BY CASE WHEN a.row_id = b.row_id THEN 0 ELSE 1 END, list_distance(a.vec, b.vec), b.row_id) AS r
    FROM vectors a, vectors b)
  WHERE r <= {k + 1})"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, Ngram, dim1, dim2, cluster, GRAVY, BULK): embeddings as n-grams in the plane.

    The n-gram is spelled from the row id, the properties are two more coordinates.
    """
    letter = lambda n: F.substring(F.lit(ACIDS), (F.pmod(F.floor(F.col("row_id") / F.lit(n)), F.lit(20)) + 1).cast("int"), F.lit(1))
    return vectors(spark, sf).select(
        "row_id",
        F.concat(letter(400), letter(20), letter(1)).alias("Ngram"),
        F.col("vec")[0].alias("dim1"),
        F.col("vec")[1].alias("dim2"),
        F.col("label").alias("cluster"),
        F.col("vec")[2].alias("GRAVY"),
        F.col("vec")[3].alias("BULK"),
    )


POINTS = f"""points AS (
  SELECT row_id,
         substr('{ACIDS}', CAST(row_id // 400 % 20 + 1 AS INTEGER), 1)
           || substr('{ACIDS}', CAST(row_id // 20 % 20 + 1 AS INTEGER), 1)
           || substr('{ACIDS}', CAST(row_id % 20 + 1 AS INTEGER), 1) AS Ngram,
         vec[1] AS dim1, vec[2] AS dim2, label AS cluster, vec[3] AS GRAVY, vec[4] AS BULK
  FROM vectors)"""


def with_ctes(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


def rounded(*names: str) -> list:
    return [F.round(name, 6).alias(name) for name in names]


def rounded_sql(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)
