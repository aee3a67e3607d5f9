"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewharf.session import scratch_dir

# For tables of large rows: row groups, and so the batches a task reads, stay small.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, purpose: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write to the shared scratch folder and read back: computed once, lineage cut.

    Lost executors cannot take the result with them, and every later use sees the
    same rows.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table of ``saved``, or what was made of one, once nothing reads it any more."""
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        delete(table.sparkSession, folder)


def delete(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of steps that nothing refers to any more.

    It does so when the driver collects its garbage, which a small driver heap alone puts off
    for longer than a job of many large steps can wait.
    """
    gc.collect()
    spark._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where ``body`` uses it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def raw_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """The texts of a string column in UTF-8, one by one, without decoding them."""
    for text in column.cast(pa.binary()):
        yield text.as_py()


def lean(function: Callable) -> Callable:
    """The function of a task, giving its memory back at the end.

    Spark keeps Python workers for later tasks; what they keep reserved adds up.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
            if trim is not None:
                trim(0)

    return run


def one_list(values: np.ndarray | pa.Array) -> pa.ListArray:
    """A list column of one row."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list column of ``len(counts)`` rows from their values one after another."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def list_values(column: pa.ListArray, row: int) -> np.ndarray:
    """The values of one row of a list column, without a copy."""
    start, end = column.offsets[row].as_py(), column.offsets[row + 1].as_py()
    return column.values[start:end].to_numpy(zero_copy_only=False)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] numbers), then the same of the next, and so on."""
    total = int(counts.sum())
    steps = np.ones(total, np.int64)
    full = counts > 0
    starts, counts = starts[full], counts[full]
    if not total:
        return np.zeros(0, np.int64)
    firsts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    steps[firsts[0]] = starts[0]
    steps[firsts[1:]] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(steps)
