"""Table schemas, and the checks that inputs follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAKEDB_READS = T.StructType(
    [
        T.StructField("SEQUENCE_ID", T.StringType()),
        T.StructField("FUNCTIONAL", T.StringType()),
        T.StructField("JUNCTION_LENGTH", T.IntegerType()),
        T.StructField("JUNCTION", T.StringType()),
        T.StructField("DUPCOUNT", T.IntegerType()),
        T.StructField("CONSCOUNT", T.IntegerType()),
        T.StructField("V_CALL", T.StringType()),
        T.StructField("D_CALL", T.StringType()),
        T.StructField("J_CALL", T.StringType()),
    ]
)

LABEL_DICTIONARY = T.StructType(
    [T.StructField("observation", T.StringType()), T.StructField("label", T.StringType())]
)

VECTORS = T.StructType(
    [T.StructField("row_id", T.LongType()), T.StructField("vec", T.ArrayType(T.DoubleType()))]
)

EMBEDDING = T.StructType(
    [T.StructField("word", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType()))]
)

NEIGHBOURS = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("neighbor", T.LongType()),
        T.StructField("dist", T.DoubleType()),
    ]
)

FEATURE_LIST = T.StructType(
    [
        T.StructField("feature_index", T.LongType()),
        T.StructField("max_distance", T.DoubleType()),
        T.StructField("center", T.ArrayType(T.DoubleType())),
    ]
)

# fixed values: the columns of a table of scores
SCORES = T.StructType(
    [
        T.StructField("Inputfile", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("dimension_reduction_method", T.StringType()),
        T.StructField("number_of_dimensions", T.IntegerType()),
        T.StructField("clustering_method", T.StringType()),
        T.StructField("number_of_clusters", T.IntegerType()),
        T.StructField("diversity_TH", T.DoubleType()),
        T.StructField("classification_method", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


class SchemaMismatch(ValueError):
    """An input table lacks something an operator needs."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Return ``df`` if it has all the named columns, else raise."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise SchemaMismatch(f"missing column(s) {missing}; the table has {df.columns}")
    return df


def unmatched_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, left_rows, right_rows) of the keys that don't stand exactly once on either side; NULL is a key."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    counted = sides.groupBy(key).agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"))
    return counted.where((F.col("left_rows") != 1) | (F.col("right_rows") != 1))


def require_same_keys(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raise unless both tables hold exactly the same keys (the 1:1 alignment check)."""
    off = unmatched_keys(left, right, key).count()
    if off:
        raise SchemaMismatch(f"{off} value(s) of {key!r} are not on both sides exactly once")
