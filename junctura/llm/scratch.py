"""Tables that a job writes and reads again, in the folder that all executors share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets a temporary folder.

    On a cluster an unset folder is an error: a machine-local one would not survive the
    loss of an executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="junctura-shared-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs at most the tasks it was running.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Texts, or what is made of one, that Python workers get at once.
TEXTS = 500


@contextmanager
def rows_at_once(spark: SparkSession, rows: int = TEXTS) -> Iterator[None]:
    """Jobs inside read Parquet row by row and send their Python workers at most ``rows`` rows at once.

    Else a batch of either is 4,096 or 10,000 rows, of long ones tens of MB for each task. What they write has
    pages of 1 MB, or a row: else a page's size is looked at after 100 rows first, and so many of 1 MB are
    compressed, and later read, at once and outside the heap.
    """
    wanted = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
        "spark.sql.parquet.enableVectorizedReader": "false",
        "parquet.page.size.row.check.min": "1",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def give_back() -> None:
    """Return to the system what earlier tasks of this worker, which Spark uses again, have freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
