"""Scores of any prediction table ``(config, fold, y_true, y_pred)``.

Rows are folded once to confusion counts; every score is arithmetic on those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.labels import as_classes, classes_of

_RUN = ("config", "fold")


def confusion_counts(
    predictions: DataFrame, classes: list[str] | None = None
) -> DataFrame:
    """``(config, fold, y_true, y_pred, n)`` for every pair of classes, zeros included.

    ``classes`` are there even without a prediction. Labels that occur besides them are classes as
    well: no prediction is left out. Nulls are an error, named when the row is computed.
    """
    known = classes_of(predictions, "y_true", "y_pred")
    if classes:
        known = F.sort_array(F.array_union(as_classes(classes), known))
    missing = F.raise_error(F.lit("a prediction without y_true or y_pred"))
    predictions = predictions.withColumn(
        "y_true", F.when(F.col("y_true").isNull() | F.col("y_pred").isNull(), missing).otherwise(F.col("y_true"))
    )
    counted = predictions.groupBy(*_RUN, "y_true", "y_pred").agg(F.count("*").alias("_n"))
    every = (
        counted.select(*_RUN)
        .distinct()
        .withColumn("y_true", F.explode(known))
        .withColumn("y_pred", F.explode(known))
    )
    joined = every.join(counted, [*_RUN, "y_true", "y_pred"], "left")
    return joined.select(*_RUN, "y_true", "y_pred", F.coalesce("_n", F.lit(0)).alias("n"))


def _ratio(above: Column, below: Column) -> Column:
    """0 where the score is undefined."""
    return F.when(below == 0, F.lit(0.0)).otherwise(above / below)


def class_report(confusion: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    share = F.explode(
        F.array(
            F.struct(
                F.col("y_true").alias("label"),
                F.col("n").alias("support"),
                F.lit(0).cast("bigint").alias("predicted"),
                F.when(F.col("y_true") == F.col("y_pred"), F.col("n"))
                .otherwise(F.lit(0).cast("bigint"))
                .alias("hits"),
            ),
            F.struct(
                F.col("y_pred").alias("label"),
                F.lit(0).cast("bigint").alias("support"),
                F.col("n").alias("predicted"),
                F.lit(0).cast("bigint").alias("hits"),
            ),
        )
    )
    sums = (
        confusion.select(*_RUN, share.alias("_s"))
        .groupBy(*_RUN, F.col("_s.label").alias("label"))
        .agg(
            F.sum("_s.support").alias("support"),
            F.sum("_s.predicted").alias("predicted"),
            F.sum("_s.hits").alias("hits"),
        )
    )
    hits = F.col("hits")
    return sums.select(
        *_RUN,
        "label",
        _ratio(hits, F.col("predicted")).alias("precision"),
        _ratio(hits, F.col("support")).alias("recall"),
        _ratio(2 * hits, F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "predicted",
        "hits",
    )


def report_averages(report: DataFrame) -> DataFrame:
    """Macro and weighted averages of the class report."""
    def weighted(name: str) -> Column:
        return F.sum(F.col(name) * F.col("support")) / F.sum("support")

    scores = ("precision", "recall", "f1")
    return report.groupBy(*_RUN).agg(
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[weighted(s).alias(f"weighted_{s}") for s in scores],
        F.sum("support").alias("support"),
    )


def fold_scores(confusion: DataFrame) -> DataFrame:
    """Accuracy, macro F1, weighted F1 and multiclass MCC of every run and fold."""
    support, predicted = F.col("support").cast("double"), F.col("predicted").cast("double")
    sums = class_report(confusion).groupBy(*_RUN).agg(
        F.sum("hits").cast("double").alias("_c"),
        F.sum(support).alias("_s"),
        F.sum(support * predicted).alias("_pt"),
        F.sum(predicted * predicted).alias("_pp"),
        F.sum(support * support).alias("_tt"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * support) / F.sum(support)).alias("weighted_f1"),
    )
    s, c = F.col("_s"), F.col("_c")
    norm = F.sqrt(s * s - F.col("_pp")) * F.sqrt(s * s - F.col("_tt"))
    return sums.select(
        *_RUN,
        _ratio(c, s).alias("accuracy"),
        "macro_f1",
        "weighted_f1",
        _ratio(c * s - F.col("_pt"), norm).alias("mcc"),
    )


def long_metrics(scores: DataFrame) -> DataFrame:
    """``(config, fold, metric, value)``."""
    names = [c for c in scores.columns if c not in _RUN]
    return scores.unpivot(list(_RUN), names, "metric", "value")


def evaluate(predictions: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """The metrics table of any model's predictions."""
    return long_metrics(fold_scores(confusion_counts(predictions, classes)))


def summarize(metrics: DataFrame) -> DataFrame:
    """Mean over folds with population and sample standard deviation, per config and metric."""
    return metrics.groupBy("config", "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.stddev_samp("value").alias("sd"),
    )


def mean_confusion(confusion: DataFrame) -> DataFrame:
    """Confusion counts averaged over folds."""
    return confusion.groupBy("config", "y_true", "y_pred").agg(F.avg("n").alias("mean_n"))


def confusion_matrix(confusion: DataFrame, classes: list[str]) -> DataFrame:
    """The wide view: one row per true class, one column per predicted class."""
    return confusion.groupBy(*_RUN, "y_true").pivot("y_pred", classes).agg(F.sum("n"))


def best_config(metrics: DataFrame, grid: list[str], metric: str = "macro_f1") -> DataFrame:
    """The configuration with the highest mean; it must exceed 0, the earliest in ``grid`` wins ties."""
    order = F.array_position(F.array(*[F.lit(g) for g in grid]), F.col("config"))
    means = (
        metrics.where(F.col("metric") == metric)
        .groupBy("config")
        .agg(F.avg("value").alias("mean"))
        .where(F.col("mean") > 0)
    )
    return means.orderBy(F.desc("mean"), order).limit(1)


def balanced_weights(docs: DataFrame) -> DataFrame:
    """``(model_fold, label, weight)``: ``n / (k * n_c)`` on the training rows of each fold.

    Training counts are totals minus the fold's own, so rows are counted once and not per fold.
    """
    per = docs.groupBy("fold", "label").agg(F.count("*").alias("_n"))
    folds = per.agg(F.array_sort(F.collect_set("fold"))).scalar()
    totals = per.groupBy("label").agg(
        F.sum("_n").alias("_all"),
        F.map_from_entries(F.collect_list(F.struct("fold", "_n"))).alias("_of"),
    )
    train = totals.select("label", "_all", "_of", F.explode(folds).alias("model_fold")).select(
        "model_fold",
        "label",
        (F.col("_all") - F.coalesce(F.try_element_at("_of", F.col("model_fold")), F.lit(0))).alias("_c"),
    )
    of_fold = Window.partitionBy("model_fold")
    present = train.where(F.col("_c") > 0)
    weight = F.sum("_c").over(of_fold) / (F.count("*").over(of_fold) * F.col("_c"))
    return present.select("model_fold", "label", weight.alias("weight"))
