"""Tables, scratch space and small expressions shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The 26 letters that contracts on words lower-case; every other character stays as it is.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share.

    It lies in ``spark.checkpoint.dir``; where a session has none, in the warehouse folder, which
    every session has and which a cluster shares as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a table once and read it back: later jobs, and retries after lost executors, start here.

    What the write has shuffled is not read again and goes at its end, not when the driver's garbage is collected.
    """
    path = scratch(df.sparkSession, name)
    with option(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def option(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """What is run inside has this option of the session."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """What is run inside sends workers at most so many rows at once: ten thousand whole texts are tens of
    megabytes, held several times by each worker and its task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    # 0 or less stands for no limit.
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def learnable(doc_id: Column) -> Column:
    """Rows that a model may learn from: crc32 of the id as text, modulo 4, is not 2.

    A null id is never learnt from.
    """
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def held_out(doc_id: Column) -> Column:
    """Rows kept for measuring a model; a null id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def values(batch: pa.Array, size: int = 256) -> Iterator:
    """The values of an Arrow array, turned into Python objects a few at a time."""
    for i in range(0, len(batch), size):
        yield from batch.slice(i, size).to_pylist()


def texts(batches: Iterator[pa.Array], size: int = 256) -> Iterator[tuple[int, Iterator[list]]]:
    """For each Arrow batch its length and its values in lists of at most ``size``."""
    for batch in batches:
        yield len(batch), (batch.slice(i, size).to_pylist() for i in range(0, len(batch), size))
