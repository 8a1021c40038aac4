"""Annotated reads: quality filter, audit, translation, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.functions.sequences import amino_acids, trim_ends
from junctura.operators.sampling import keep_groups

MIN_JUNCTION_LENGTH = 12  # a junction must be longer than this
MIN_FILE_ROWS = 3000  # a file must keep more rows than this


def read_steps() -> dict[str, Column]:
    """The filter's steps in order, each with its own condition."""
    length = F.col("JUNCTION_LENGTH")
    return {
        "functional": F.col("FUNCTIONAL") == "T",
        "length": (length > MIN_JUNCTION_LENGTH) & (F.pmod(length, F.lit(3)) == 0),
        "conscount": F.col("CONSCOUNT") > 1,
        "clean": ~F.col("JUNCTION").rlike("[N-]"),
    }


def filter_reads(reads: DataFrame) -> DataFrame:
    """Functional, in-frame, long enough, supported and unambiguous reads."""
    for condition in read_steps().values():
        reads = reads.where(condition)
    return reads


def reads_funnel(reads: DataFrame, min_rows: int = MIN_FILE_ROWS, file: str = "FILENAME") -> DataFrame:
    """Rows left after each step, per file and for all files (``ALL``), in one pass.

    ``kept`` says whether the file has more than ``min_rows`` clean rows; the ALL row's
    ``kept_files`` counts those files while its ``clean`` still includes the others.
    """
    passed, counts = F.lit(True), [F.count("*").alias("total")]
    for name, condition in read_steps().items():
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    per_file = reads.groupBy(file).agg(*counts).withColumn(
        "kept_files", (F.col("clean") > min_rows).cast("long")
    )
    steps = ["total", *read_steps(), "kept_files"]
    everything = per_file.agg(*[F.sum(s).cast("long").alias(s) for s in steps]).select(
        F.lit("ALL").alias(file), *steps
    )
    return per_file.select(file, *steps).unionByName(everything)


def translate_reads(reads: DataFrame, trim: tuple[int, int] | None = None) -> DataFrame:
    """Add JUNC_AA, the translated and optionally trimmed junction."""
    protein = amino_acids(F.col("JUNCTION"))
    return reads.withColumn("JUNC_AA", trim_ends(protein, *trim) if trim else protein)


def preprocess_reads(
    reads: DataFrame, trim: tuple[int, int] | None = None, min_rows: int = MIN_FILE_ROWS, file: str = "FILENAME"
) -> DataFrame:
    """Filter, translate and trim; keep files with more than ``min_rows`` filtered rows."""
    clean = filter_reads(reads)
    return translate_reads(keep_groups(clean, file, at_least=min_rows + 1), trim)


def unique_reads(
    reads: DataFrame, file: str = "FILENAME", sequence: str = "JUNC_AA", row_id: str = "row_id"
) -> DataFrame:
    """One row per (file, sequence), the one with the lowest row id, with UNIQCOUNT.

    Done as an aggregate, so copies are combined before the shuffle however many there are.
    """
    others = [c for c in reads.columns if c not in (file, sequence)]
    return (
        reads.groupBy(file, sequence)
        .agg(F.min_by(F.struct(*others), row_id).alias("_first"), F.count("*").alias("UNIQCOUNT"))
        .select(file, sequence, "_first.*", "UNIQCOUNT")
        .select(*reads.columns, "UNIQCOUNT")
    )


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"))


def length_histogram(df: DataFrame, text: str, bins: int | None = None) -> DataFrame:
    """How many sequences have each length, or fall in each of ``bins`` equal bins."""
    sized = df.where(F.col(text).isNotNull()).select(F.length(text).alias("length"))
    exact = sized.groupBy("length").agg(F.count("*").alias("n"))
    if bins is None:
        return exact
    # the range comes from the small per-length table, as one row attached to every length
    low, high = exact.agg(F.min("length"), F.max("length")).first()
    if low is None:
        return exact.select(F.lit(0).alias("bin"), F.lit(0.0).alias("left"), "n").limit(0)
    width = (high - low) / bins
    position = F.least(F.floor((F.col("length") - low) / F.lit(width or 1.0)), F.lit(bins - 1))
    return (
        exact.groupBy(position.cast("int").alias("bin"))
        .agg(F.sum("n").alias("n"))
        .select("bin", (F.lit(float(low)) + F.col("bin") * F.lit(float(width))).alias("left"), "n")
    )


def exact_length(df: DataFrame, text: str, length: int = 19) -> DataFrame:
    return df.where(F.length(text) == length)
