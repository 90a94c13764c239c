"""CSV and parquet in, parquet out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.sources import csv_blocks


def read_posts(
    spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = True
) -> DataFrame:
    """CSV with a header and free text in doubled quotes.

    Line breaks inside quotes are found by a pass over the text beforehand, so that large files are still
    read by many tasks (``csv_blocks``); with ``multi_line=False``, for texts without line breaks, Spark's
    own reader does without it.
    """
    if multi_line:
        return csv_blocks.read_records(spark, path, schema).drop(csv_blocks.POSITION)
    return (
        spark.read.schema(schema)
        .options(header=True, quote='"', escape='"')
        .csv(path)
    )


def write_posts(df: DataFrame, path: str) -> None:
    """CSV that ``read_posts`` reads back unchanged, leading blanks and empty texts included."""
    df.write.options(
        header=True,
        quote='"',
        escape='"',
        emptyValue='""',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_prepared(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, one directory per fold when folds are assigned: ``fold = f`` prunes the others."""
    writer = df.write.mode(mode)
    if "fold" in df.columns:
        writer = writer.partitionBy("fold")
    writer.parquet(path)


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append ``(config, fold, metric, value)`` rows; earlier runs stay."""
    metrics.select("config", "fold", "metric", "value").write.mode("append").parquet(path)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows by id."""
    return df.orderBy("doc_id").limit(n)


def fold_sizes(folds: DataFrame) -> DataFrame:
    """Rows trained on and validated on, per fold; one row per fold crosses the last shuffle."""
    sizes = folds.groupBy("fold").agg(F.count("*").alias("val"))
    total = sizes.agg(F.sum("val")).scalar()
    return sizes.select("fold", (total - F.col("val")).alias("train"), "val")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table that driver and executors share.

    It lies in ``spark.checkpoint.dir``; where a session has none, in the warehouse folder, which
    every session has and which a cluster shares as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/tamis-{name}-{uuid.uuid4().hex}"


def write_through(df: DataFrame, name: str, *partition_by: str, compression: str | None = None) -> DataFrame:
    """Write a table that several jobs read, and read it back.

    Cuts the lineage, survives lost executors, and gives later plans a measured size.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hash-partition an input that arrives in fewer splits than there are cores.

    A table of normal size has far more splits than cores and is returned as it is. Hashing by the
    id also lets later steps that regroup by ``doc_id`` skip their shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)
