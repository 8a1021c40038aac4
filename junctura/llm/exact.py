"""Exact deduplication with keyed streaming state.

Arrivals (digest, identifier, content locator) stream into a state that never expires: one entry
per digest with the largest identifier, its locator and the number of arrivals. The state lies on
disk, in RocksDB with its snapshots in the shared folder, so that it may outgrow memory, outlives
an executor and can go on with later arrivals. Equal digests only name candidates: the text of
every document that hit an entry is fetched by its locator, the file and the row in it, and
compared in full with the text at the entry's locator; the documents of a digest under which
texts differ are grouped anew by their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.scratch import new_path, stored
from junctura.llm.words import ascii_lower

#: RocksDB would set aside 4 MB a partition for its logs, however small the state.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Copies compared with one copy of the kept text; larger groups get several copies of it.
PER_KEEPER = 1000


@contextmanager
def _state_settings(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


LOCATOR = "struct<path:string,row:bigint>"


def located(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``locator``: the file a row was read from and its place there.

    NULL where rows don't come straight from Parquet files, as after a join: such rows are found by
    their doc_id and digest.
    """
    try:
        found = docs.select("doc_id", "text", F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")).alias("locator"))
        found.schema  # names are resolved here
        return found
    except AnalysisException:
        return docs.select("doc_id", "text", F.lit(None).cast(LOCATOR).alias("locator"))


def arrivals(docs: DataFrame, digest=sha256) -> DataFrame:
    """(doc_id, digest, locator, rows) of each document; of repeated rows the last locator.

    Rows with the same doc_id and the same normalised text are one document.
    """
    found = located(docs).select("doc_id", digest(ascii_lower(F.col("text"))).alias("digest"), "locator")
    return found.groupBy("doc_id", "digest").agg(F.max("locator").alias("locator"), F.count(F.lit(1)).alias("rows"))


def keep_state(spark: SparkSession, folder: str, schema: str, checkpoint: str, per_batch: int) -> None:
    """Stream the arrival files of ``folder`` that the state in ``checkpoint`` has not seen into it."""
    with _state_settings(spark):
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", per_batch).parquet(folder)
        entry = F.struct("doc_id", "locator")
        state = stream.groupBy("digest").agg(F.max(entry).alias("keeper"), F.sum("rows").alias("size"), F.count(F.lit(1)).alias("documents"))
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(digest, keep_id, keep_locator, group_size, documents) as the state has them."""
    with _state_settings(spark):
        state = spark.read.format("statestore").load(checkpoint)
        keeper, size, documents = (F.col(f"value.`{x.name}`") for x in state.schema["value"].dataType.fields)
        return stored(state.select("key.digest", keeper["doc_id"].alias("keep_id"), keeper["locator"].alias("keep_locator"), size.alias("group_size"), documents.alias("documents")), "state")


def _compared(docs: DataFrame, verdicts: DataFrame, digest) -> DataFrame:
    """(doc_id, digest, body, same) of all documents in groups: whether their text is the kept one's."""
    own = ["doc_id", "locator", "digest", "keep_id", "keep_locator", "documents"]
    hits = verdicts.where("documents > 1").select(*[F.col(c).alias(f"_{c}") for c in own])
    texts = located(docs).select("doc_id", "locator", ascii_lower(F.col("text")).alias("body"))
    if _has_places(verdicts):
        # only rows that hit an entry are fetched, each from its place
        there = (F.col("locator.path") == F.col("_locator.path")) & (F.col("locator.row") == F.col("_locator.row"))
        found = texts.join(hits, there)
    else:  # an id may stand at several texts, so the digest decides
        found = texts.join(hits, F.col("doc_id").eqNullSafe(F.col("_doc_id"))).where(digest(F.col("body")) == F.col("_digest")).dropDuplicates(["_doc_id", "_digest"])
    found = stored(found.select("body", *[F.col(f"_{c}").alias(c) for c in own]), "hits")
    parts = F.ceil(F.col("documents") / PER_KEEPER).cast("int")
    keeper = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("locator").eqNullSafe(F.col("keep_locator"))
    kept = found.where(keeper).select("digest", F.col("body").alias("kept_body"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    rows = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts.cast("long")).cast("int"))
    return rows.join(kept, ["digest", "part"]).select("doc_id", "digest", "body", (F.col("body") == F.col("kept_body")).alias("same"))


def _has_places(verdicts: DataFrame) -> bool:
    return verdicts.where("locator IS NOT NULL").limit(1).count() > 0


def exact_groups(docs: DataFrame, digest=sha256, per_batch: int = 256 << 30) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; NULL counts as empty, and all empty
    texts are equal. Of equal texts the largest doc_id stays (a NULL id only where there is no
    other). ``group_size`` counts rows; rows repeated with id and text are one document,
    returned once. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    schema = f"doc_id long, digest string, locator {LOCATOR}, rows long"
    folder, checkpoint = new_path(spark, "arrivals"), new_path(spark, "state")
    arrivals(docs, digest).select(F.col("doc_id").cast("long"), F.col("digest").cast("string"), "locator", "rows").write.parquet(folder)
    keep_state(spark, folder, schema, checkpoint, per_batch)
    seen = spark.read.schema(schema).parquet(folder)
    state = read_state(spark, checkpoint).withColumnRenamed("digest", "_digest")
    verdicts = stored(seen.join(state, F.col("digest") == F.col("_digest")).drop("_digest"), "verdicts")
    compared = _compared(docs, verdicts, lambda text: digest(text).cast("string"))
    differing = stored(compared.where(~F.col("same")).select("digest").distinct(), "differing")
    result = verdicts.select("doc_id", "digest", "keep_id", "group_size")
    if differing.count():  # texts that share a digest: groups by the texts themselves
        texts = compared.join(differing, "digest", "left_semi").join(
            verdicts.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "rows"),
            F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")),
        )
        texts = stored(texts.select("doc_id", "digest", "rows", "body"), "texts")
        groups = texts.groupBy(F.col("body").alias("_body")).agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size"))
        anew = texts.join(groups, F.col("body") == F.col("_body")).select("doc_id", "digest", "keep_id", "group_size")
        result = result.join(differing, "digest", "left_anti").unionByName(anew)
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact(docs: DataFrame) -> DataFrame:
    """The groups of ``docs`` with the SHA-256 of the normalised text."""
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def exact_filter(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each different text, the one with the largest doc_id.

    NULL and empty texts are one text; of rows without a doc_id one stays if no other has their
    text; rows repeated with id and text stay once. All columns are kept, whatever their names,
    but names beginning with ``_x_`` or ``_metadata``. An empty table gives an empty result.
    """
    kept = stored(exact_groups(docs).where("kept"), "kept").select(F.col("doc_id").alias("_x_id"), F.col("digest").alias("_x_digest"), F.col("group_size").alias("_x_size"))
    own = docs.withColumn("_x_own", sha256(ascii_lower(F.col("text"))))
    rows = own.join(kept, F.col("doc_id").eqNullSafe(F.col("_x_id")) & (F.col("_x_own") == F.col("_x_digest")))
    return rows.dropDuplicates(["_x_id", "_x_digest"]).select(*docs.columns)
