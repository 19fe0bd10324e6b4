"""Helpers shared by the training-data operators."""

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadspark.session import shared_folder


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage is cut, lost executors do no harm.

    The table replaces the shuffle files of its making, so these go when it is written. ``group_bytes``: size of the row groups,
    as a reader takes up to 4,096 rows of one at once, which is much if rows are large.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer if group_bytes is None else writer.option("parquet.block.size", group_bytes)).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def salt_of(column, folds: int, kept: int, inside: bool):
    """Rows on one side of a fold: crc32 of the id as text, modulo ``folds``, is (not) ``kept``; a null id counts as ''."""
    remainder = F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds
    return remainder == kept if inside else remainder != kept


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 texts of a batch, null as empty."""
    return [b"" if text is None else text.encode() for text in batch.column(column).to_pylist()]


def give_back() -> None:
    """Returns what a task has freed to the system: Spark goes on with the same Python worker in later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def packed(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser over an array of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64((seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))
