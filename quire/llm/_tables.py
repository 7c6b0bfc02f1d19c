"""Shared steps of the operators: stage tables in the shared folder, input columns, sizes."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.session import ensure_checkpoint_dir


#: Session settings of a run. Python batches stay small; shuffle files go once their
#: stage table is written, so the disk holds one stage's shuffles and not all of them.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def prepared(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/quire-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends at files that
    outlive any executor, and everything derived from it reads them instead of recomputing."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_bytes(df: DataFrame) -> int:
    """The optimiser's size of a stored table in bytes: file sizes, no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, mb: float, least: int | None = None) -> int:
    """Shuffle partitions so that one holds about ``mb`` MB of a stored table."""
    base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(base if least is None else least, -(-file_bytes(df) // int(mb * 1e6)))


def tokenizer_path(name: str, path: str | None = None) -> str:
    """Place of a public tokenizer file: the parameter, else the installed package's."""
    if path:
        return path
    import public_tokenizers
    return os.fspath(public_tokenizers.path(name))


def release() -> None:
    """Give freed memory of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):                            # a C library without it
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, giving freed memory back at the end of a partition: workers are kept for later
    stages, and what one stage needed at its peak would otherwise stay with each of them."""
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()
    return inner
