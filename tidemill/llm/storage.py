"""What the operators here add to the shared storage: bounded Arrow batches, and rows kept by their texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemill.sources.storage import new_path, save, shared_root

__all__ = ["new_path", "rows_where", "save", "shared_root", "short_scans", "small_batches"]


def small_batches(spark: SparkSession, rows: int = 256, size: int = 16 << 20) -> None:
    """Bounds the rows and bytes of an Arrow batch, as single texts may be very long.

    Values that the session's owner has set stay.
    """
    for name, default, value in (("maxRecordsPerBatch", "10000", rows), ("maxBytesPerBatch", "67108864b", size)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, str(value))


@contextmanager
def short_scans(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Has the jobs that are run within read so many rows of Parquet at a time.

    All texts of such a batch stand in one array on the heap, which is copied to one of
    twice the size when it is full. A value that the session's owner has set stays.
    """
    key, default = "spark.sql.parquet.columnarReaderBatchSize", "4096"
    ours = spark.conf.get(key, default) == default
    if ours:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if ours:
            spark.conf.set(key, default)


def rows_where(docs: DataFrame, text: str, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of docs whose text is to be kept, all columns as they are, in one pass and without a shuffle.

    The name is looked for as Spark does, without regard to case.
    """
    at = [c.lower() for c in docs.columns].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(keep(batch.column(at).cast(pa.string()).to_pylist()), pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
