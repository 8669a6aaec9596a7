"""Helpers shared by the corpus operators: tables between jobs, Arrow batches, hash folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.session import shared_scratch

ROWS_PER_BATCH = 256
#: Lets shuffle files go when the execution that wrote them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Arrow batches are kept short, because texts may be long."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    What was shuffled for the table goes once it is written.
    """
    spark = df.sparkSession
    path, before = f"{shared_scratch(spark)}/{name}", spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once all that is made of them has been written; their frames can't be read again."""
    for t in tables:
        hadoop = t.sparkSession._jvm.org.apache.hadoop.fs
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = hadoop.Path(folder)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fold(key: str, folds: int) -> Column:
    """Remainder of the crc32 of a key written as text; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch in one array and the offsets of each text; null is empty."""
    array = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[str]:
    """Texts of a batch, null as empty text."""
    return [t or "" for t in column.to_pylist()]


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of the given columns in the schema's order and types."""
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``size`` bytes; a longer text comes alone.

    At the end Arrow's free memory goes back to the system: task processes live on between stages.
    """
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(lengths)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield b.slice(lo, hi - lo)
    pa.default_memory_pool().release_unused()
