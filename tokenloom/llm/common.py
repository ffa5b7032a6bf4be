"""What the training-data operators share: table access, batch mapping, cutting lineage."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.sources.shared import forget_at_exit, new_path

#: sha256 of nothing, in hex.
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it back: lost executors cost no recomputation.

    While it runs, Python gets rows in batches of a thousand at most, as texts may be long.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path = new_path(spark, what)
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), 1000) if int(before) > 0 else 1000)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def trimmed() -> None:
    """Hands memory that Python no longer uses back to the system, as workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def slices(rb: pa.RecordBatch, text: int, most: int) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """(lo, hi, texts) of runs of rows with about `most` bytes of the binary column `text`, one row at least."""
    col = rb.column(text)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi, col.slice(lo, hi - lo).to_pylist()
        lo = hi


def crc_of(col: str) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def map_texts(
    df: DataFrame,
    fn: Callable[[list[bytes | None]], list],
    fields: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: dict[str, Column] | None = None,
    most: int = 2_000_000,
) -> DataFrame:
    """The id column (and the columns of keep) beside what fn makes of the texts.

    fn gets a list of texts as UTF-8 bytes (None: null) of about `most` bytes and
    returns one array per field of the DDL `fields`.  No row is dropped.
    """
    kept = [F.col(id_col), *(c.alias(k) for k, c in (keep or {}).items())]
    source = df.select(*kept, F.col(text_col).cast("binary").alias("__text__"))
    head = source.drop("__text__").schema
    tail = df.sparkSession.createDataFrame([], fields).schema
    schema = type(head)([*head.fields, *tail.fields])
    names, n = schema.fieldNames(), len(head.fields)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for lo, hi, texts in slices(rb, n, most):
                own = [x if isinstance(x, pa.Array) else pa.array(x) for x in fn(texts)]
                yield pa.RecordBatch.from_arrays([*(rb.column(k).slice(lo, hi - lo) for k in range(n)), *own], names)
        trimmed()

    return source.mapInArrow(run, schema)
