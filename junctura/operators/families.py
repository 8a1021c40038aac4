"""Gene families of reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.functions.sequences import gene_families, single_family, trailing_number
from junctura.operators.sampling import stratified_sample


def add_family(reads: DataFrame, call: str = "V_CALL", out: str = "V_FAMILY") -> DataFrame:
    """Add the comma-separated gene families of an allele call."""
    return reads.withColumn(out, gene_families(F.col(call)))


def unambiguous(reads: DataFrame, family: str = "V_FAMILY") -> DataFrame:
    """Reads with exactly one family."""
    return reads.withColumn(family, single_family(F.col(family))).where(F.col(family).isNotNull())


def family_sample(
    reads: DataFrame, families: Sequence[str] = ("IGHV1", "IGHV3", "IGHV4"), n: int = 100_000, family: str = "V_FAMILY", seed: int = 0
) -> DataFrame:
    """``n`` reads of each family, with ``family_number``, the number in its name."""
    picked = stratified_sample(reads.where(F.col(family).isNotNull()), family, families, n, seed=seed)
    return picked.withColumn("family_number", trailing_number(F.col(family)))
