"""Helpers shared by the corpus operators: text expressions, the CRC split, bounded batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut_lineage, made, remove, shared_dir  # noqa: F401  for the operators here

#: Fixed value: the white space that separates words in every operator here (space, \t \n \v \f \r).
WHITE = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression.
WHITE_RUN = r"[ \t-\r]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_RUN), "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Within, each job's shuffle files go when it is done: for steps that each write a table, and read written tables only."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


@lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release_memory() -> None:
    """Gives memory that is free in this process back to the machine: workers live on, from one stage to the next."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most limit bytes in the column, or of one row, so that a worker's memory stays bounded."""
    for batch in batches:
        values = batch.column(column)
        if pa.types.is_list(values.type):
            size = pc.multiply(pc.cast(pc.list_value_length(values), pa.int64()), values.type.value_type.bit_width // 8)
        else:
            size = pc.cast(pc.binary_length(values), pa.int64())
        ends, at = np.cumsum(pc.fill_null(size, 0).to_numpy()), 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
        release_memory()
