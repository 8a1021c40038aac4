"""The corpus pipeline: quality rules, exact and near deduplication, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from junctura.llm.bagminhash import near_filter
from junctura.llm.exact import exact_filter
from junctura.llm.mixing import mixed_documents
from junctura.llm.packing import CHUNKS_AT_ONCE, packed_sequences
from junctura.llm.quality import quality_filter
from junctura.llm.scratch import rows_at_once, stored


# Every stage takes NULLs in any column, empty and very long texts, ties, repeated rows, empty tables
# and columns beyond those of documents, which the first four keep; names beginning with _ and a
# letter and _ are the stages' own.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the rules and whose host does; NULL and empty texts fail, a NULL source is a host."""
    return quality_filter(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each different text, the one with the largest doc_id; NULL and empty texts are one text."""
    return exact_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each class's document of least doc_id; texts without words are classes of their own, rows without an id stay."""
    return near_filter(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows, each as often as the mix takes it; texts without words once, a NULL source is the last source."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(sequence_id, tokens, ids, pieces): sequences of 2048 ids and the documents in them; NULL texts are empty."""
    with rows_at_once(spark, CHUNKS_AT_ONCE):
        return stored(packed_sequences(docs), "sequences")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Signatures and Newton steps are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
