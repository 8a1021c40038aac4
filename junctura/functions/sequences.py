"""Sequence functions as column expressions.

Texts are cut with ``regexp_extract_all`` rather than one ``substring`` per piece, so the
cost is linear in the length of the text.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Standard genetic code (NCBI translation table 1), bases in the order TCAG.
BASES = "TCAG"
CODON_AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

# Fixed value: the twenty amino acids, in the order used for composition columns.
AMINO_ACIDS = "LASGVERTDIKPNQFYMHCW"

# Fixed value: one gene family inside an allele call.
GENE_FAMILY = r"((?:IG[HLK]|TR[ABDG])[VDJ][0-9]+)"


def pieces(text: Column, n: int) -> Column:
    """Consecutive pieces of exactly ``n`` characters; an incomplete tail is dropped."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{n}}}"), F.lit(0))


def amino_acids(dna: Column) -> Column:
    """Translate a nucleotide text. A codon with any other letter gives X."""

    def one(codon: Column) -> Column:
        first, second, third = (
            F.instr(F.lit(BASES), codon.substr(i, 1)) for i in (1, 2, 3)
        )
        position = (first - 1) * 16 + (second - 1) * 4 + third
        known = (first > 0) & (second > 0) & (third > 0)
        return F.when(known, F.substring(F.lit(CODON_AMINO_ACIDS), position, F.lit(1))).otherwise("X")

    return F.array_join(F.transform(pieces(dna, 3), one), "")


def trim_ends(text: Column, head: int, tail: int) -> Column:
    """Drop ``head`` characters in front and ``tail`` behind; 0 trims nothing."""
    return F.substring(text, F.lit(head + 1), F.greatest(F.length(text) - F.lit(head + tail), F.lit(0)))


def ngrams(text: Column, n: int, frame: int = 1) -> Column:
    """Non-overlapping n-grams of reading frame 1, 2 or 3."""
    if frame not in (1, 2, 3):
        raise ValueError("frame must be 1, 2 or 3")
    return pieces(F.substring(text, F.lit(frame), F.length(text)), n)


def ngram_frames(text: Column, n: int) -> Column:
    """The three reading frames (offsets 0, 1, 2 for every n)."""
    return F.array(*[ngrams(text, n, frame) for frame in (1, 2, 3)])


def cut_texts(keys: pa.Array, values: pa.Array, lo: int, hi: int, seed: int = 0) -> pa.ListArray:
    """The pieces of each text of a batch. No piece becomes a Python text: they are places in the texts' own bytes."""

    def starts(key: int, length: int) -> list[int]:
        """Where each piece but the first starts, in characters."""
        rng = random.Random(f"{seed}:{key}")
        out, at, size = [], 0, rng.randint(lo, hi)
        while length - at - lo > size:
            at += size
            out.append(at)
            size = rng.randint(lo, hi)
        return out

    none = values.is_null().to_numpy(zero_copy_only=False)
    texts = pa.concat_arrays([values.fill_null("").cast(pa.large_string())])
    data = texts.buffers()[2] or pa.py_buffer(b"")
    places = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())]).astype(np.int64)
    first = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset] if len(texts) else 0
    letters = np.frombuffer(data, np.uint8) if data.size else np.empty(0, np.uint8)
    ends, counts = [np.zeros(1, np.int64)], np.zeros(len(texts), np.int64)
    for k, key in enumerate(keys.to_pylist()):
        if none[k]:
            continue
        body = letters[first + places[k] : first + places[k + 1]]
        head = np.flatnonzero((body & 0xC0) != 0x80)  # the first byte of each character
        ends.append(places[k] + np.append(head[starts(key, len(head))], len(body)))
        counts[k] = len(ends[-1])
    flat = first + np.concatenate(ends).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_string(), len(flat) - 1, [None, pa.py_buffer(flat), data])
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.append(none, False))
    return pa.ListArray.from_arrays(offsets, pieces.cast(pa.string()))


def random_ngrams(text: Column, lo: int, hi: int, row_id: Column, seed: int = 0) -> Column:
    """Cut a text into pieces of random length lo..hi; the last piece takes the rest.

    Each cut depends on what is left after the one before, so this runs as an Arrow
    function on whole batches; the generator is seeded by (seed, row_id), never by the partition.
    """

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, values in batches:
            yield cut_texts(keys, values, lo, hi, seed)

    return cut(row_id, text)


def gene_families(call: Column) -> Column:
    """All distinct gene families of an allele call, comma-separated, in order of mention."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(call, F.lit(GENE_FAMILY), F.lit(1))), ",")


def single_family(families: Column) -> Column:
    """The family, or NULL where the call is ambiguous or names none."""
    return F.when(families.contains(",") | (families == ""), F.lit(None)).otherwise(families)


def label_prefix(name: Column) -> Column:
    """Text in front of the first digit: CI16 gives CI."""
    return F.regexp_extract(name, "^([^0-9]*)", 1)


def trailing_number(name: Column) -> Column:
    """The last character as a number: IGHV3 gives 3, anything else NULL."""
    return F.right(name, F.lit(1)).try_cast("int")


def file_stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def letters(text: Column) -> Column:
    """The characters of a text as an array."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def all_ngrams(spark: SparkSession, n: int) -> DataFrame:
    """Every possible n-gram over the twenty amino acids, one per row (column Ngram)."""
    alphabet = F.array(*[F.lit(a) for a in sorted(AMINO_ACIDS)])
    table = spark.range(1).select(F.lit("").alias("Ngram"))
    for _ in range(n):
        table = table.select("Ngram", F.explode(alphabet).alias("letter")).select(
            F.concat("Ngram", "letter").alias("Ngram")
        )
    return table
