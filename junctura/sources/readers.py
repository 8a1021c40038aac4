"""Readers. Schemas are fixed or all-text, never inferred from the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Word2VecModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from junctura.functions.sequences import file_stem
from junctura.operators.embedding import embedding_table
from junctura.schemas import EMBEDDING, LABEL_DICTIONARY, MAKEDB_READS, require_columns


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | None = None,
    sep: str = ",",
    malformed: str = "raise",
    **options,
) -> DataFrame:
    """Delimited text with a header.

    Columns are found by their name in the header; those of ``schema`` are kept and cast,
    in its order, and files may have others. Without ``schema`` all columns are text.
    Files whose header differs from the first one's raise. A cell that its column's type can't
    hold raises when it is read; ``malformed="null"`` makes it NULL instead.
    """
    text = spark.read.options(**{"header": True, "sep": sep, "enforceSchema": False, **options}).csv(path)
    if schema is None:
        return text
    require_columns(text, *schema.names)
    return text.select(*[typed(f.name, f.dataType, malformed).alias(f.name) for f in schema.fields])


def typed(name: str, kind: T.DataType | str, malformed: str = "raise") -> Column:
    """A text column as ``kind``; an empty cell is NULL, another one that doesn't fit raises or is NULL."""
    if malformed not in ("raise", "null"):
        raise ValueError("malformed must be 'raise' or 'null'")
    cell = F.col(f"`{name}`")
    value = cell.try_cast(kind)
    if malformed == "null":
        return value
    wrong = F.raise_error(F.concat(F.lit(f"column {name!r} can't hold "), cell)).cast(kind)
    return F.when(value.isNull() & (F.trim(cell) != ""), wrong).otherwise(value)


def read_tsv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None, **options) -> DataFrame:
    return read_table(spark, path, schema, sep="\t", **options)


def read_keyed(
    spark: SparkSession,
    path: str,
    key: str,
    key_type: str = "string",
    value_type: str = "double",
    sep: str = ",",
    malformed: str = "raise",
) -> DataFrame:
    """A table with an index column: ``key``, and every other column as ``value_type``.

    The index may have no header name, as a data frame's index often has; a stray unnamed
    index column beside the key is dropped.
    """
    # an unnamed index column cannot be compared with the header
    table = read_table(spark, path, sep=sep, enforceSchema=True)
    first = table.columns[0]
    if key not in table.columns:
        table = table.withColumnRenamed(first, key)
    stray = [c for c in table.columns if c.startswith(("_c0", "Unnamed: 0")) and c != key]
    table = table.drop(*stray)
    return table.select(
        F.col(f"`{key}`").cast(key_type).alias(key),
        *[typed(c, value_type, malformed).alias(c) for c in table.columns if c != key],
    )


def read_annotated_reads(
    spark: SparkSession, folder: str, suffix: str = "_collapsed.tab", row_ids: bool = True, malformed: str = "raise"
) -> DataFrame:
    """All annotated-read files of a folder, with FILENAME (the stem) and, by default, row_id."""
    options = {"header": True, "sep": "\t", "enforceSchema": False, "pathGlobFilter": f"*{suffix}"}
    text = spark.read.options(**options).csv(folder)
    require_columns(text, *MAKEDB_READS.names)
    reads = text.select(
        *[typed(f.name, f.dataType, malformed).alias(f.name) for f in MAKEDB_READS.fields],
        file_stem(F.col("_metadata.file_name")).alias("FILENAME"),
        *_position(),
    )
    return with_positions(reads) if row_ids else reads.drop("_file", "_block", "_seen")


def _position() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seen"),
    ]


def with_positions(rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Number rows 0, 1, ... in file order, from the columns of ``_position``.

    Rows are sorted within one file block only; the blocks' row counts are a small table.
    """
    blocks = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    ahead = blocks.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_file", "_block").orderBy("_seen")
    return (
        rows.join(ahead, ["_file", "_block"])
        .withColumn(row_id, F.col("_ahead") + F.row_number().over(inside) - 1)
        .drop("_file", "_block", "_seen", "_ahead")
        .select(row_id, *[c for c in rows.columns if c not in ("_file", "_block", "_seen")])
    )


def read_positional(
    spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",", malformed: str = "raise"
) -> DataFrame:
    """A table without a key whose rows are meant by position: adds row_id 0, 1, ..."""
    text = spark.read.options(header=True, sep=sep, enforceSchema=False).csv(path)
    names = schema.names if schema else text.columns
    require_columns(text, *names)
    types = {f.name: f.dataType for f in schema.fields} if schema else {}
    columns = [typed(c, types[c], malformed).alias(c) if c in types else F.col(f"`{c}`") for c in names]
    return with_positions(text.select(*columns, *_position()))


def read_matrix(spark: SparkSession, path: str, row_id: str | None = None, sep: str = ",") -> DataFrame:
    """A numeric matrix with a header as (row_id, vec); row_id is a column or the position."""
    if row_id:
        table = read_table(spark, path, sep=sep)
        return table.select(
            F.col(f"`{row_id}`").cast("long").alias("row_id"), _as_array(c for c in table.columns if c != row_id)
        )
    table = read_positional(spark, path, sep=sep)
    return table.select("row_id", _as_array(c for c in table.columns if c != "row_id"))


def _as_array(columns) -> Column:
    return F.array(*[F.trim(F.col(f"`{c}`")).cast("double") for c in columns]).alias("vec")


def parse_fasta(text: Column) -> Column:
    """The (id, seq) records of FASTA text: of any number of lines; the id ends at the first blank."""
    parts = F.split(F.regexp_replace(text, "\r", ""), "(?:^|\n)\\s*>")
    return F.filter(F.transform(parts, fasta_record), lambda r: (r["id"] != "") | (r["seq"] != ""))


def fasta_record(record: Column) -> Column:
    """(id, seq) of one record, with or without its leading sign."""
    clean = F.regexp_replace(F.regexp_replace(record, "\r", ""), "^[\\s]*>?", "")
    body = F.regexp_extract(clean, "(?s)^[^\n]*\n?(.*)$", 1)
    return F.struct(F.regexp_extract(clean, "^([^\\s]*)", 1).alias("id"), F.regexp_replace(body, "\\s", "").alias("seq"))


def read_fasta(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(id, seq) of FASTA files, read record by record."""
    records = spark.read.option("lineSep", "\n>").text(path).select(fasta_record(F.col("value")).alias("r"))
    return records.select("r.id", "r.seq").where((F.col("id") != "") | (F.col("seq") != ""))


def read_label_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, LABEL_DICTIONARY)


def read_embedding(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """(word, vector) from a saved table (parquet) or a saved Spark model (word2vec)."""
    if format == "word2vec":
        return embedding_table(Word2VecModel.load(path))
    table = spark.read.format(format).load(path)
    require_columns(table, *EMBEDDING.names)
    return table.select(F.col("word"), F.col("vector").cast("array<double>").alias("vector"))


def parse_list(text: Column) -> Column:
    """A list written as text, "[1, 2]", as array<bigint>."""
    return F.from_json(text, "array<bigint>")


def read_neighbourhoods(spark: SparkSession, path: str, labels: Sequence[str]) -> DataFrame:
    """A neighbourhood analysis with its neighbour lists as text and a share column per label."""
    table = read_positional(spark, path)
    return table.select(
        "row_id",
        parse_list(F.col("neighbors")).alias("neighbors"),
        F.col("how_many_subjects").cast("long").alias("how_many_subjects"),
        *[F.col(f"`{c}`").cast("double").alias(c) for c in labels],
    )


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table
