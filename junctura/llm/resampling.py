"""Resampling towards a target distribution by importance weights of hashed word features.

Words are cut by byte operations: a table of 256 bytes lower-cases A-Z and blanks all other ASCII
signs but digits, ``bytes.split`` yields the words, bytes of characters beyond ASCII stay. Runs of
words are hashed by crc32, a longer run from the shorter one's value as seed, into buckets. Each
task adds its buckets up in a Counter, so a task sends at most ``buckets`` counts. A bucket's gain
is the logarithm of its share in the target texts to its share in all documents; a document's
weight is the sum of its features' gains. Adding Gumbel noise and taking the highest scores draws
documents without replacement in proportion to exp(weight).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from junctura.llm.scratch import stored

BUCKETS = 10_000
#: Documents with fewer words are scored, but never drawn.
LEAST_WORDS = 20
SHARE, SEED = 10, 2024
#: The order of the scores is cut into ranges of about RANGE_ROWS documents, at least RANGES of them; only the
#: ranges' sizes meet in one place.
RANGES, RANGE_ROWS = 400, 1_000_000
#: Lower case for A-Z, a blank for every other ASCII byte that is not a letter or a digit.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Keys of the words hashed by a task that it keeps.
KEPT_WORDS = 200_000


class Features:
    """Counts of hashed features of texts; words already hashed in this task are looked up."""

    def __init__(self, grams: int, buckets: int) -> None:
        self.grams, self.buckets, self.known = grams, buckets, {}

    def of(self, text: str | None) -> tuple[int, int, Counter]:
        """(words, features, Counter of buckets) of a whole text."""
        words = text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []
        found: Counter = Counter()
        known, buckets = self.known, self.buckets
        if len(known) > KEPT_WORDS:
            known.clear()
        for word, n in Counter(words).items():
            bucket = known.get(word)
            if bucket is None:
                bucket = known[word] = zlib.crc32(word) % buckets
            found[bucket] += n
        if self.grams > 1:
            runs = [zlib.crc32(word) for word in words]
            spaced = [b" " + word for word in words]
            for n in range(1, self.grams):
                runs = [zlib.crc32(word, run) for run, word in zip(runs, spaced[n:], strict=False)]
                found.update(run % buckets for run in runs)
        return len(words), sum(max(len(words) - n, 0) for n in range(self.grams)), found


def bucket_counts(docs: DataFrame, grams: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of the column ``text``; one Counter a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(grams, buckets), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(features.of(text)[2])
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (total.keys(), total.values())], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, grams: int = 1, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket; two tables of at most ``buckets`` rows come to the driver."""
    source, aim = ({r.bucket: r.n for r in bucket_counts(t, grams, buckets).collect()} for t in (docs, target))
    s_all, t_all = sum(source.values()), sum(aim.values())
    share = lambda t, s: ((t + 1) * (s_all + buckets)) / ((s + 1) * (t_all + buckets))
    return [math.floor(1000 * math.log(share(aim.get(b, 0), source.get(b, 0)))) for b in range(buckets)]


def scored(docs: DataFrame, gains: list[int], grams: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) per row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        gain, features = shared.value, Features(grams, buckets)
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            ids = batch.column(0)
            for doc_id, text in zip(ids.to_pylist(), batch.column(1).to_pylist(), strict=True):
                n_words, n_features, found = features.of(text)
                weight = sum(gain[bucket] * n for bucket, n in found.items())
                drawn = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
                noise = math.floor(-1000 * math.log(-math.log((drawn + 0.5) / 4294967296)))
                for column, value in zip(out, (n_words, n_features, weight, weight + noise), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in out)], ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def _ranked(rows: DataFrame, share: int, least_words: int) -> DataFrame:
    """``rows`` with ``rank``: the place among the drawn, NULL for all others.

    The order is cut into ranges of about equal size by quantiles of the score. Equal scores are
    few, as each document has noise of its own, copies too.
    """
    able = F.col("n_words") >= least_words
    ranges = max(RANGES, rows.where(able).count() // RANGE_ROWS)
    cuts = rows.where(able).approxQuantile("score", [k / ranges for k in range(1, ranges)], 0.5 / ranges)
    # scores are whole numbers far below 2^53, so they are exact as doubles
    # Bucketizer asks for an inner edge; without a document to draw there is none
    edges = [-float("inf"), *sorted(set(cuts) or {0.0}), float("inf")]
    placed = rows.withColumn("able", able).withColumn("at", F.col("score").cast("double"))
    placed = Bucketizer(splits=edges, inputCol="at", outputCol="low").transform(placed)
    placed = stored(placed.withColumn("range", F.when(able, (len(edges) - F.col("low")).cast("int"))).drop("at", "low"), "placed")
    sizes = placed.where("able").groupBy("range").agg(F.count(F.lit(1)).alias("rows"))
    running = F.sum("rows").over(Window.orderBy("range"))
    every = F.sum("rows").over(Window.partitionBy())
    ahead = sizes.select(F.col("range").alias("_range"), (running - F.col("rows")).alias("ahead"), F.floor(every * share / 100).alias("drawn"))
    # a row per million documents, 400 at least
    near = placed.where("able").join(F.broadcast(ahead), F.col("range") == F.col("_range"))
    order = Window.partitionBy("range").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "n_words")
    place = F.col("ahead") + F.row_number().over(order)
    inside = near.where("ahead < drawn").withColumn("rank", F.when(place <= F.col("drawn"), place).cast("long"))
    beyond = near.where("ahead >= drawn").withColumn("rank", F.lit(None).cast("long"))
    unable = placed.where("not able").withColumn("rank", F.lit(None).cast("long"))
    names = ("doc_id", "n_features", "weight", "score", "rank")
    return inside.select(*names).unionByName(beyond.select(*names)).unionByName(unable.select(*names))


def resample(
    docs: DataFrame, target: DataFrame, grams: int = 1, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_features, weight, score, rank.

    ``rank`` numbers the drawn documents, ``share`` percent of those with ``least_words`` words,
    by falling score, ties by doc_id; it is NULL for the others. NULL and empty texts have no
    features and weight 0. Rows that repeat a doc_id share its noise and are ranked one by one; a
    NULL doc_id draws as an empty one and comes last in ties. Other columns are not read. An
    empty ``docs`` gives an empty result, an empty ``target`` equal target shares.
    """
    gains = bucket_gains(docs, target, grams, buckets)
    return _ranked(stored(scored(docs, gains, grams, buckets, seed), "scores"), share, least_words)
