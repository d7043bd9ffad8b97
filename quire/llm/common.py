"""Table reads, scratch tables and Arrow output shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.session import scratch_path

from . import tokens

#: rows that go to a Python task at a time; texts and packed hashes are long
BATCH_ROWS = 512


def short_batches(spark: SparkSession) -> None:
    """Bound what a task holds of long rows, on both sides of the Arrow stream."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One whole table, projected to ``cols``; any path that Spark can read."""
    short_batches(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage (a lost executor re-reads files that every executor can
    reach) and gives the planner the true size of the table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trimmed(step):
    """The Arrow step; when a task of it ends, its worker, which Spark keeps for
    later tasks, gives the memory that is free back to the system, and with it the
    tables that long texts made."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        import pyarrow as pa

        try:
            yield from step(batches)
        finally:
            tokens.forget_long()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
            if trim is not None:
                trim(0)

    return run


def fill_nulls(arr: pa.Array, value) -> pa.Array:
    return arr.fill_null(value) if arr.null_count else arr


def text_blocks(batch: pa.RecordBatch, col: str, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole rows with about ``limit`` text bytes.

    Yields (first row, end row, bytes, offsets); null texts are empty.  A
    longer single text forms a block of its own, whole."""
    import pyarrow as pa

    arr = batch.column(batch.schema.get_field_index(col))
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if n == 0:
        return
    _, off_buf, data_buf = arr.buffers()
    off = np.frombuffer(off_buf, np.int64, n + 1 + arr.offset)[arr.offset:]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo]:off[hi]], (off[lo:hi + 1] - off[lo])
        lo = hi


def ids_of(batch: pa.RecordBatch, col: str) -> tuple[np.ndarray, np.ndarray]:
    """A long column as (values with 0 for null, is-null mask)."""
    import pyarrow as pa

    arr = batch.column(batch.schema.get_field_index(col)).cast(pa.int64())
    null = np.asarray(arr.is_null())
    return np.asarray(arr.fill_null(0)), null
