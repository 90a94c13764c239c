"""Distributions of whole-number measures, computed from their frequency table.

``frequency_table`` folds the rows to ``(value, n)`` with map-side combining. Everything after it
works on distinct values, whose number is bounded by the largest value and not by the row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.operators.ranking import running_total

_VALUES_PER_BUCKET = 1024


def frequency_table(df: DataFrame, value: str, *by: str) -> DataFrame:
    """``(by..., value, n)``; rows without a value are not counted.

    They are left out by their count and not by a filter on ``value``: Catalyst would move that
    filter under the projection and compute the measure a second time there.
    """
    return (
        df.groupBy(*by, F.col(value).cast("bigint").alias("value"))
        .agg(F.count(value).alias("n"))
        .where(F.col("n") > 0)
    )


def _whole(name: str) -> Column:
    return F.col(name).cast("decimal(19,0)")


def describe(freq: DataFrame, *by: str) -> DataFrame:
    """Count, mean, sample std, min, linearly interpolated quartiles, max.

    Sums of values and squares are exact decimals, so the result does not depend on the order in
    which partitions are merged.
    """
    sums = freq.groupBy(*by).agg(
        F.sum("n").alias("count"),
        F.sum(_whole("value") * _whole("n")).alias("_s1"),
        F.sum(_whole("value") * _whole("value") * _whole("n")).alias("_s2"),
        F.min("value").alias("min"),
        F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("_q"),
        F.max("value").alias("max"),
    )
    count = F.col("count").cast("double")
    spread = (_whole("count") * F.col("_s2") - F.col("_s1") * F.col("_s1")).cast("double")
    return sums.select(
        *by,
        "count",
        (F.col("_s1").cast("double") / count).alias("mean"),
        F.when(F.col("count") > 1, F.sqrt(spread / (count * (count - 1)))).alias("std"),
        "min",
        F.col("_q")[0].alias("q25"),
        F.col("_q")[1].alias("q50"),
        F.col("_q")[2].alias("q75"),
        "max",
    )


def percentiles(freq: DataFrame, *points: float) -> DataFrame:
    """One row per point: ``(p, value)``, linear interpolation."""
    at = F.array(*[F.lit(p) for p in points])
    found = freq.agg(F.percentile("value", at, F.col("n")).alias("_v"))
    return found.select(F.posexplode("_v").alias("_i", "value")).select(
        F.get(at, F.col("_i")).alias("p"), "value"
    )


def ecdf(freq: DataFrame) -> DataFrame:
    """Empirical distribution ``i/n`` for ``i = 0..n-1`` in sorted order.

    One row per distinct value with the positions of its first and last row; the highest is
    ``(n-1)/n``.
    """
    total = freq.agg(F.sum("n")).scalar()
    # Never null, so that the join by bucket adds no filter on the measure either.
    bucket = F.coalesce(F.floor(F.col("value") / _VALUES_PER_BUCKET), F.lit(-1))
    bucketed = freq.withColumn("_bucket", bucket)
    placed = running_total(
        bucketed, F.col("n"), "_before", [], ["_bucket"], [F.col("_bucket")], [F.col("value")]
    )
    return placed.select(
        "value",
        "n",
        (F.col("_before") / total).alias("first"),
        ((F.col("_before") + F.col("n") - 1) / total).alias("last"),
    )


def histogram(freq: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed; empty bins are kept."""
    ends = freq.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi"))).scalar()
    flat = ends["lo"] == ends["hi"]
    low = F.when(flat, ends["lo"] - 0.5).otherwise(ends["lo"].cast("double"))
    width = F.when(flat, F.lit(1.0)).otherwise((ends["hi"] - ends["lo"]).cast("double"))
    slot = F.floor((F.col("value") - low) * bins / width)
    counted = freq.groupBy((F.least(slot, F.lit(bins - 1)) + 1).alias("bin")).agg(
        F.sum("n").alias("_n")
    )
    every = freq.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin",
        (low + (F.col("bin") - 1) * width / bins).alias("lower"),
        (low + F.col("bin") * width / bins).alias("upper"),
        F.coalesce("_n", F.lit(0)).alias("n"),
    )


def box_summary(freq: DataFrame) -> DataFrame:
    """Quartiles, whiskers at the outermost values within 1.5 interquartile ranges, outliers."""
    points = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    quartiles = freq.agg(F.percentile("value", points, F.col("n"))).scalar()
    q1, q2, q3 = quartiles[0], quartiles[1], quartiles[2]
    reach = (q3 - q1) * 1.5
    inside = F.col("value").between(q1 - reach, q3 + reach)
    return freq.agg(
        F.max(q1).alias("q25"),
        F.max(q2).alias("q50"),
        F.max(q3).alias("q75"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
    )
