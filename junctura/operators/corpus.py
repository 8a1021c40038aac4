"""n-gram corpus: one row per (sequence, frame)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.functions.sequences import ngram_frames, ngrams, random_ngrams, trim_ends


def build_corpus(
    sequences: DataFrame,
    n: int | tuple[int, int] = 3,
    frame: int | None = None,
    trim: tuple[int, int] | None = None,
    row_id: str = "row_id",
    text: str = "seq",
    seed: int = 0,
) -> DataFrame:
    """Sentences (row_id, frame, words).

    An integer ``n`` gives all three frames, or one of them if ``frame`` is set; a pair
    (lo, hi) gives pieces of random length, in one sentence.
    """
    seq = trim_ends(F.col(text), *trim) if trim else F.col(text)
    key = F.col(row_id).alias("row_id")
    if isinstance(n, tuple):
        words = random_ngrams(seq, n[0], n[1], F.col(row_id), seed)
        return sequences.select(key, F.lit(1).alias("frame"), words.alias("words"))
    if frame is not None:
        return sequences.select(key, F.lit(frame).alias("frame"), ngrams(seq, n, frame).alias("words"))
    return sequences.select(key, F.posexplode(ngram_frames(seq, n)).alias("frame", "words")).select(
        "row_id", (F.col("frame") + 1).alias("frame"), "words"
    )


def corpus_lines(corpus: DataFrame) -> DataFrame:
    """The corpus as text: words separated by blanks, a line per sentence."""
    return corpus.select("row_id", "frame", F.array_join("words", " ").alias("line"))


def vocabulary(corpus: DataFrame, min_count: int = 2) -> DataFrame:
    """Words seen at least ``min_count`` times."""
    return (
        corpus.select(F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_count)
    )
