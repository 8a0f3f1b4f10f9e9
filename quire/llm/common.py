"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

from typing import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, ship_package


#: Bytes of rows that go to a Python worker at a time; texts have any length,
#: so a number of rows alone does not bound a worker's memory.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Make the package importable on the workers, the checkpoint folder known
    and the session's batches to Python workers no larger than ``BATCH_BYTES``."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without columns that clash with ``names`` (Spark resolves names
    without regard to case)."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def extended(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    """Schema of ``df`` followed by ``fields``."""
    return T.StructType(list(df.schema.fields) + fields)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def utf8_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the ``n + 1`` offsets of an Arrow string column (null: empty)."""
    import pyarrow as pa
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    width = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, width)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets * 0
    raw = np.frombuffer(data, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, limit: int, rows: int = 1 << 14) -> Iterator[tuple[int, int]]:
    """Runs of at most ``rows`` rows and ``limit`` bytes (a longer row alone)."""
    n = len(offsets) - 1
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, n)
        yield lo, hi
        lo = hi
