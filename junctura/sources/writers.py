"""Writers. Each writes a folder of part files, one per task."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.ml.feature import Word2VecModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.operators.corpus import corpus_lines


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "error") -> None:
    df.write.mode(mode).options(header=True, sep=sep).csv(path)


def write_tsv(df: DataFrame, path: str, mode: str = "error") -> None:
    write_csv(df, path, sep="\t", mode=mode)


def write_parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def wide(df: DataFrame, keys: Sequence[str], vec: str, size: int, prefix: str = "") -> DataFrame:
    """An array column as ``size`` columns named 0, 1, ..."""
    return df.select(*keys, *[F.get(vec, F.lit(i)).alias(f"{prefix}{i}") for i in range(size)])


def write_vectors(vectors: DataFrame, path: str, size: int, mode: str = "error") -> None:
    """Vectors as CSV with one column per position, keyed by row_id."""
    write_csv(wide(vectors, ["row_id"], "vec", size), path, mode=mode)


def fasta_records(df: DataFrame, id: str = "id", seq: str = "seq") -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col(id).cast("string"), F.lit("\n"), F.col(seq)).alias("value"))


def write_fasta(df: DataFrame, path: str, id: str = "id", seq: str = "seq", mode: str = "error") -> None:
    fasta_records(df, id, seq).write.mode(mode).text(path)


def write_corpus(corpus: DataFrame, path: str, mode: str = "error") -> None:
    """The corpus as text, a line per sentence."""
    corpus_lines(corpus).select("line").write.mode(mode).text(path)


def neighbour_matrix(neighbours: DataFrame, value: str = "neighbor", k: int = 100) -> DataFrame:
    """Neighbours (or ``dist``) as row_id and columns 0..k; a missing neighbour is NULL."""
    lists = neighbours.groupBy("row_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", value))), lambda s: s[value]).alias("vec")
    )
    return wide(lists, ["row_id"], "vec", k + 1)


def write_neighbours(neighbours: DataFrame, path: str, k: int = 100, mode: str = "error") -> None:
    """Two matrices with a header, ``path``/NN and ``path``/distances."""
    write_csv(neighbour_matrix(neighbours, "neighbor", k), f"{path}/NN", mode=mode)
    write_csv(neighbour_matrix(neighbours, "dist", k), f"{path}/distances", mode=mode)


def save_model(model: Word2VecModel, path: str) -> None:
    model.write().overwrite().save(path)


def write_embedding(embedding: DataFrame, path: str, mode: str = "error") -> None:
    embedding.select("word", "vector").write.mode(mode).parquet(path)


def write_folds(folds: DataFrame, path: str, mode: str = "error") -> None:
    """Rows with ``fold`` and ``role`` as fold=i/role=train|test folders."""
    folds.write.mode(mode).partitionBy("fold", "role").parquet(path)


def feature_table_path(source: str, folder: str) -> str:
    """Where the feature table of a source file goes: <stem>_feature_table.csv."""
    return f"{folder.rstrip('/')}/{_stem(source)}_feature_table.csv"


def labelled_path(source: str) -> str:
    """Where a labelled feature table goes: beside it, <stem>_with_labels.csv."""
    folder, _, _ = source.rstrip("/").rpartition("/")
    return f"{folder + '/' if folder else ''}{_stem(source)}_with_labels.csv"


def _stem(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2].split(".")[0]


#: Columns a wide table may have.
MOST_COLUMNS = 10_000


def wide_feature_table(table: DataFrame, subject: str, features: Sequence | None = None) -> DataFrame:
    """One row per subject, one column per feature, 0 where a subject has none.

    A subject without any hit keeps NULLs, as its frequencies are undefined. More features than
    MOST_COLUMNS raise ValueError; such a table stays long.
    """
    if features is None:
        rows = table.where(F.col("feature").isNotNull()).select("feature").distinct().orderBy("feature").limit(MOST_COLUMNS + 1).collect()
        if len(rows) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} features")
        features = [r[0] for r in rows]
    pivoted = table.groupBy(subject).pivot("feature", list(features)).agg(F.first("freq"))
    undefined = table.groupBy(subject).agg((F.count("freq") == 0).alias("_undefined"))
    filled: list[Column] = [
        F.when(F.col("_undefined"), F.lit(None)).otherwise(F.coalesce(F.col(f"`{f}`"), F.lit(0.0))).alias(str(f))
        for f in features
    ]
    return pivoted.join(undefined, subject).select(subject, *filled)


def write_feature_table(table: DataFrame, source: str, folder: str, subject: str, mode: str = "error") -> str:
    """The wide table in the order of its subjects: part files, and the rows in them, are sorted."""
    path = feature_table_path(source, folder)
    write_csv(wide_feature_table(table, subject).orderBy(subject), path, mode=mode)
    return path


def write_grouped_tsv(df: DataFrame, folder: str, group: str, suffix: str = "_collapsed.tab", rows_per_file: int = 1_000_000) -> list[str]:
    """Tab-separated files named by group, <group><suffix>, or <group>.<k><suffix> where one file isn't enough.

    Spark writes part files under a folder per group; they are then renamed, which moves no data.
    Returns the groups written.
    """
    spark = df.sparkSession
    parts = f"{folder}/_parts"
    df.write.option("maxRecordsPerFile", rows_per_file).options(header=True, sep="\t").partitionBy(group).csv(parts)
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(parts)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    groups = []
    for place in files.listStatus(root):
        name = place.getPath().getName()
        if not place.isDirectory() or "=" not in name:
            continue
        value = unquote(name.partition("=")[2])
        found = sorted((f.getPath() for f in files.listStatus(place.getPath()) if f.getPath().getName().startswith("part-")), key=lambda path: path.getName())
        for k, path in enumerate(found):
            numbered = value if len(found) == 1 else f"{value}.{k}"
            files.rename(path, jvm.org.apache.hadoop.fs.Path(folder, numbered + suffix))
        groups.append(value)
    files.delete(root, True)
    return groups


def write_labelled(table: DataFrame, source: str, mode: str = "error") -> str:
    path = labelled_path(source)
    write_csv(table, path, mode=mode)
    return path


def append_clusters(data: DataFrame, clustered: DataFrame, path: str, mode: str = "error") -> None:
    """The data with its ``cluster`` column, written to a new path."""
    data.join(clustered.select("row_id", "cluster"), "row_id", "left").write.mode(mode).parquet(path)


def write_clusters(clustered: DataFrame, path: str, mode: str = "error") -> None:
    clustered.select("row_id", "cluster").write.mode(mode).parquet(path)


def append_scores(scores: DataFrame, path: str) -> None:
    """Add rows to the score log."""
    scores.write.mode("append").parquet(path)
