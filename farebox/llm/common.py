"""Scratch tables, table access and digests that the operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from farebox.session import ensure_checkpoint_dir, ship_package


#: Bytes of an Arrow batch, so that memory doesn't grow with the length of texts.
BATCH_BYTES = "4m"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, and bound the session's Arrow batches
    by their bytes (rows alone don't bound texts)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    ship_package(spark)


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)       # glibc has it
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors; each task
    hands back the memory that it has freed."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(df: DataFrame, name: str, small_rows: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    With ``small_rows`` (a few numbers a row, written round after round) tasks
    write at most four files a core: each takes its partitions one after the other.

    Cuts the lineage: an executor that is lost later costs a re-read of files,
    not the steps before. The folder goes when the application ends.
    """
    spark = df.sparkSession
    if small_rows:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/farebox-llm/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True where crc32 of the id's text modulo ``parts`` is ``part``; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def bounded_sample_ids(ids: DataFrame, limit: int) -> list[int]:
    """Up to ``limit`` ids of ``ids(doc_id)``, the first by a fixed hash order."""
    rows = (ids.where(F.col("doc_id").isNotNull()).distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect())
    return sorted(r[0] for r in rows)
