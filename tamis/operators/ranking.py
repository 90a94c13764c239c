"""Row numbers and running sums over groups too large for one task.

A window over a hot group sorts all of it in one task. Here the group is cut into ordered buckets:
windows run inside a bucket, and only one total per bucket is summed across them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(
    df: DataFrame,
    amount: Column,
    out: str,
    by: Sequence[str],
    buckets: Sequence[str],
    bucket_order: Sequence[Column],
    order: Sequence[Column],
) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over all earlier rows of the group ``by``.

    ``buckets`` must not be null, and ``bucket_order`` followed by ``order`` must be the total order.
    The table of bucket totals is the only thing sorted per group; it has one row per bucket.
    """
    keys = [*by, *buckets]
    inside = (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    across = (
        Window.partitionBy(*by)
        .orderBy(*bucket_order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        df.groupBy(*keys)
        .agg(F.sum(amount).alias("_total"))
        .select(*keys, F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_start"))
    )
    return (
        df.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(starts, keys)
        .withColumn(out, F.col("_start") + F.col("_inside"))
        .drop("_start", "_inside")
    )


def row_number(
    df: DataFrame,
    out: str,
    by: Sequence[str],
    buckets: Sequence[str],
    bucket_order: Sequence[Column],
    order: Sequence[Column],
) -> DataFrame:
    """Add ``out``: 0-based position of the row in its group ``by``."""
    one = F.lit(1).cast("bigint")
    return running_total(df, one, out, by, buckets, bucket_order, order)
