"""Removing boilerplate lines by the number of distinct sites that have them.

The sites of each line are gathered in a HyperLogLog sketch per line hash, which merges in any
order and stays small however often a line occurs. Lines whose estimate is clearly above or below
the limit are decided by it; for those near the limit the distinct sites are counted exactly.
Lines of the former kind, and of the latter that reach the limit, leave all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm.scratch import stored
from junctura.llm.words import WORD

#: Distinct sites that make a line boilerplate.
SITES = 10
#: Registers of a sketch are 2^this; its estimates are off by 1.6 % (one standard error).
SKETCH_BITS = 12
#: Estimates within this share of the limit are counted exactly: six standard errors and one site.
NEAR = 0.1
#: Boilerplate lines up to this many (16 bytes each) are sent to every task.
SENT_LINES = 500_000


def site_lines(docs: DataFrame) -> DataFrame:
    """(line, site) of every line with a word: its MD5, and the site, NULL as a site of its own."""
    line = F.explode(F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(WORD)))
    site = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(site.alias("site"), line.alias("line")).select(F.unhex(F.md5("line")).alias("line"), "site")


def spread_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """(line) of the lines found on ``sites`` distinct sites or more, as MD5 digests."""
    sketches = site_lines(docs).groupBy("line").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"))
    slack = max(1.0, NEAR * sites)
    estimate = F.hll_sketch_estimate("sketch")
    likely = stored(sketches.select("line", estimate.alias("estimate")).where(F.col("estimate") >= sites - slack), "likely")
    near = likely.where(F.col("estimate") <= sites + slack).select("line")
    exact = site_lines(docs).join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites)
    return stored(likely.where(F.col("estimate") > sites + slack).select("line").unionByName(exact.select("line")), "spread")


def _rest(lines: Column, gone: Column) -> Column:
    """The text of ``lines`` without the positions in ``gone``."""
    return F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n")


def _removed_by_tasks(docs: DataFrame, spread: DataFrame) -> DataFrame:
    """With the digests of all boilerplate lines (few: the caller has checked) in every task."""
    digests = frozenset(bytes(r.line) for r in spread.collect())
    keep = docs.columns
    place = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, removed, total = [], [], []
            for value in batch.column(place):
                text = value.as_py()
                lines = (text or "").split("\n")
                left = [x for x in lines if hashlib.md5(x.encode(), usedforsecurity=False).digest() not in digests]
                out.append(None if text is None else "\n".join(left))
                removed.append(len(lines) - len(left))
                total.append(len(lines))
            columns = [*batch.columns, pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "_l_text", "_l_lines", "_l_removed"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, _l_text string, _l_lines long, _l_removed long")


def _removed_by_join(docs: DataFrame, spread: DataFrame) -> DataFrame:
    """With a shuffle of line digests; documents meet their positions by a digest of all their columns."""
    own = F.sha2(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}), 256)
    keyed = docs.withColumn("_l_key", own)
    at = F.posexplode(F.split(F.col("text"), "\n", -1)).alias("_l_at", "_l_line")
    found = keyed.select("_l_key", at).select("_l_key", "_l_at", F.unhex(F.md5("_l_line")).alias("line")).distinct().join(spread, "line", "left_semi")
    gone = found.groupBy("_l_key").agg(F.collect_set("_l_at").alias("_l_gone")).withColumnRenamed("_l_key", "_l_own")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    joined = keyed.join(gone, F.col("_l_key") == F.col("_l_own"), "left").withColumn("_l_gone", F.coalesce("_l_gone", F.array().cast("array<int>")))
    rest = F.when(F.col("text").isNotNull(), _rest(lines, F.col("_l_gone")))
    return joined.select(*docs.columns, rest.alias("_l_text"), F.size(lines).cast("long").alias("_l_lines"), F.size("_l_gone").cast("long").alias("_l_removed"))


def without_spread_lines(docs: DataFrame, sites: int = SITES, sent: int = SENT_LINES) -> DataFrame:
    """``docs`` with ``_l_text`` (the text without boilerplate lines), ``_l_lines`` and ``_l_removed``.

    A line is what stands between line feeds; lines without a word are never boilerplate and
    stay. NULL texts stay NULL and count as one line. Repeated rows are treated alike. An empty
    table gives an empty result.
    """
    spread = spread_lines(docs.select("source", "text"), sites)
    return _removed_by_tasks(docs, spread) if spread.count() <= sent else _removed_by_join(docs, spread)


def line_dedup(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, clean_chars and the SHA-256 of the clean text."""
    out = without_spread_lines(docs.select("doc_id", "source", "text"), sites)
    clean = F.coalesce("_l_text", F.lit(""))
    return out.select(
        "doc_id", F.col("_l_lines").alias("n_lines"), F.col("_l_removed").alias("n_removed"), F.length(clean).cast("long").alias("clean_chars"), F.sha2(clean, 256).alias("clean_sha256")
    )
