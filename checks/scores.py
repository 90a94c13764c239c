"""Scores of prediction tables: toxicity read as a prediction of quality, and length thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import r6, stratified_sql, table
from tamis.functions.labels import classes_of, decode, encode
from tamis.functions.text import argmax
from tamis.operators import metrics, splits

THRESHOLDS = (200, 1000, 4000)


def agreement(spark, path):
    """``(config, fold, y_true, y_pred)`` from the two judgements of each document."""
    judged = table(spark, path, "labels").select(
        "doc_id",
        F.col("quality").cast("string").alias("label"),
        F.col("toxic").cast("string").alias("y_pred"),
    )
    folds = splits.stratified_folds(judged, 5).select("doc_id", "fold")
    return judged.join(folds, "doc_id").select(
        F.lit("toxic").alias("config"), "fold", F.col("label").alias("y_true"), "y_pred"
    )


def length_grid(spark, path):
    """Quality predicted from the length of the document, one configuration per threshold."""
    lengths = table(spark, path, "documents").select("doc_id", "n_chars")
    judged = table(spark, path, "labels").select(
        "doc_id", F.col("quality").cast("string").alias("label")
    )
    folds = splits.stratified_folds(judged, 5)
    limits = F.explode(F.array(*[F.lit(t) for t in THRESHOLDS]))
    return (
        folds.join(lengths, "doc_id")
        .withColumn("limit", limits)
        .select(
            F.concat(F.lit("chars>"), F.col("limit").cast("string")).alias("config"),
            "fold",
            F.col("label").alias("y_true"),
            F.when(F.col("n_chars") > F.col("limit"), "1").otherwise("0").alias("y_pred"),
        )
    )


def language_votes(spark, path):
    """A prediction with four classes: the most frequent language of the document's source."""
    docs = table(spark, path, "documents").select("doc_id", "source", F.col("lang").alias("label"))
    counts = docs.groupBy("source", "label").agg(F.count("*").alias("n"))
    # The second most frequent label, so that hits and misses both occur.
    ordered = counts.groupBy("source").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "label"))).alias("o")
    )
    voted = ordered.select("source", F.get("o", F.lit(1))["label"].alias("y_pred"))
    folds = splits.stratified_folds(docs, 3).select("doc_id", "fold")
    return (
        docs.join(voted, "source")
        .join(folds, "doc_id")
        .select(F.lit("votes").alias("config"), "fold", F.col("label").alias("y_true"), "y_pred")
    )


def _big(df):
    return df.withColumn("fold", F.col("fold").cast("bigint"))


def _rounded(df, *names):
    for name in names:
        df = df.withColumn(name, r6(F.col(name)))
    return df


_SCORES = ("accuracy", "macro_f1", "weighted_f1", "mcc")


def a18_confusion(spark, path):
    return _big(metrics.confusion_counts(language_votes(spark, path)))


def a18_confusion_matrix(spark, path):
    counts = metrics.confusion_counts(language_votes(spark, path))
    return _big(metrics.confusion_matrix(counts, ["de", "en", "es", "fr"]))


def a19_accuracy(spark, path):
    scores = metrics.fold_scores(metrics.confusion_counts(agreement(spark, path)))
    return _big(_rounded(scores.select("config", "fold", "accuracy"), "accuracy"))


def a20_class_report(spark, path):
    report = metrics.class_report(metrics.confusion_counts(language_votes(spark, path)))
    kept = report.select("config", "fold", "label", "precision", "recall", "f1", "support")
    return _big(_rounded(kept, "precision", "recall", "f1"))


def a20_report_averages(spark, path):
    report = metrics.class_report(metrics.confusion_counts(language_votes(spark, path)))
    averages = metrics.report_averages(report)
    return _big(_rounded(averages, *[c for c in averages.columns if "_" in c]))


def a21_f1(spark, path):
    scores = metrics.fold_scores(metrics.confusion_counts(language_votes(spark, path)))
    return _big(_rounded(scores.select("config", "fold", "macro_f1", "weighted_f1"), "macro_f1", "weighted_f1"))


def a22_mcc(spark, path):
    scores = metrics.fold_scores(metrics.confusion_counts(language_votes(spark, path)))
    return _big(_rounded(scores.select("config", "fold", "mcc"), "mcc"))


def a23_summary(spark, path):
    summary = metrics.summarize(metrics.evaluate(length_grid(spark, path)))
    return _rounded(summary.select("config", "metric", "mean", "std"), "mean", "std")


def a24_mean_confusion(spark, path):
    return _rounded(
        metrics.mean_confusion(metrics.confusion_counts(length_grid(spark, path))), "mean_n"
    )


def a25_metric_bars(spark, path):
    summary = metrics.summarize(metrics.evaluate(length_grid(spark, path)))
    return _rounded(summary.select("config", "metric", "mean", "sd"), "mean", "sd")


def k5_best_config(spark, path):
    best = metrics.best_config(
        metrics.evaluate(length_grid(spark, path)), [f"chars>{t}" for t in THRESHOLDS]
    )
    return _rounded(best, "mean")


def m6_evaluate(spark, path):
    return _big(_rounded(metrics.evaluate(agreement(spark, path)), "value"))


def t10_argmax(spark, path):
    return table(spark, path, "embeddings").select(
        "vec_id", argmax(F.col("embedding")).cast("bigint").alias("best")
    )


def t11_label_codes(spark, path):
    docs = table(spark, path, "documents")
    classes = classes_of(docs, "lang")
    coded = docs.select("doc_id", encode(F.col("lang"), classes).alias("code"))
    return coded.select(
        "doc_id", F.col("code").cast("bigint").alias("code"), decode(F.col("code"), classes).alias("label")
    )


QUERIES = {
    f.__name__: f
    for f in (
        a18_confusion,
        a18_confusion_matrix,
        a19_accuracy,
        a20_class_report,
        a20_report_averages,
        a21_f1,
        a22_mcc,
        a23_summary,
        a24_mean_confusion,
        a25_metric_bars,
        k5_best_config,
        m6_evaluate,
        t10_argmax,
        t11_label_codes,
    )
}

AGREEMENT_SQL = (
    "judged AS (SELECT doc_id, CAST(quality AS VARCHAR) AS label, CAST(toxic AS VARCHAR) AS y_pred FROM labels), "
    + stratified_sql("folded", "judged", 5)
    + ", pred AS (SELECT 'toxic' AS config, f.fold, j.label AS y_true, j.y_pred "
    "FROM judged j JOIN folded f USING (doc_id))"
)
GRID_SQL = (
    "judged AS (SELECT doc_id, CAST(quality AS VARCHAR) AS label FROM labels), "
    + stratified_sql("folded", "judged", 5)
    + ", pred AS (SELECT 'chars>' || CAST(t AS VARCHAR) AS config, f.fold, f.label AS y_true, "
    "CASE WHEN d.n_chars > t THEN '1' ELSE '0' END AS y_pred "
    "FROM folded f JOIN documents d USING (doc_id), (VALUES "
    + ", ".join(f"({t})" for t in THRESHOLDS)
    + ") AS g(t))"
)
VOTES_SQL = (
    "docs AS (SELECT doc_id, source, lang AS label FROM documents), "
    + stratified_sql("folded", "docs", 3)
    + ", ranked AS (SELECT source, label, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, label) AS r "
    "FROM docs GROUP BY source, label), "
    "pred AS (SELECT 'votes' AS config, f.fold, d.label AS y_true, v.label AS y_pred "
    "FROM docs d JOIN folded f USING (doc_id) JOIN ranked v ON v.source = d.source AND v.r = 2)"
)
CONFUSION_SQL = (
    "names AS (SELECT y_true AS c FROM pred UNION SELECT y_pred FROM pred), "
    "runs AS (SELECT DISTINCT config, fold FROM pred), "
    "cm AS (SELECT r.config, r.fold, a.c AS y_true, b.c AS y_pred, count(p.y_true) AS n "
    "FROM runs r CROSS JOIN names a CROSS JOIN names b LEFT JOIN pred p "
    "ON p.config = r.config AND p.fold = r.fold AND p.y_true = a.c AND p.y_pred = b.c "
    "GROUP BY r.config, r.fold, a.c, b.c)"
)
REPORT_SQL = (
    CONFUSION_SQL + ", sums AS (SELECT k.config, k.fold, k.c AS label, "
    "(SELECT sum(n) FROM cm WHERE cm.config = k.config AND cm.fold = k.fold AND y_true = k.c) AS t, "
    "(SELECT sum(n) FROM cm WHERE cm.config = k.config AND cm.fold = k.fold AND y_pred = k.c) AS p, "
    "(SELECT sum(n) FROM cm WHERE cm.config = k.config AND cm.fold = k.fold AND y_pred = k.c AND y_true = k.c) AS h "
    "FROM (SELECT config, fold, c FROM runs CROSS JOIN names) k), "
    "report AS (SELECT config, fold, label, t, p, h, "
    "CASE WHEN p = 0 THEN 0.0 ELSE CAST(h AS DOUBLE) / p END AS precision, "
    "CASE WHEN t = 0 THEN 0.0 ELSE CAST(h AS DOUBLE) / t END AS recall, "
    "CASE WHEN t + p = 0 THEN 0.0 ELSE 2.0 * h / CAST(t + p AS DOUBLE) END AS f1 FROM sums)"
)
FOLD_SCORES_SQL = (
    REPORT_SQL + ", scores AS (SELECT config, fold, CAST(sum(h) AS DOUBLE) / sum(t) AS accuracy, "
    "avg(f1) AS macro_f1, sum(f1 * t) / sum(t) AS weighted_f1, "
    "CASE WHEN (pow(sum(t), 2) - sum(p * p)) * (pow(sum(t), 2) - sum(t * t)) = 0 THEN 0.0 ELSE "
    "(CAST(sum(h) AS DOUBLE) * sum(t) - sum(p * t)) / sqrt(CAST((pow(sum(t), 2) - sum(p * p)) AS DOUBLE) "
    "* (pow(sum(t), 2) - sum(t * t))) END AS mcc FROM report GROUP BY config, fold)"
)
LONG_SCORES_SQL = "long AS (" + " UNION ALL ".join(
    f"SELECT config, fold, '{m}' AS metric, {m} AS value FROM scores" for m in _SCORES
) + ")"
_FOLD = "config, CAST(fold AS BIGINT) AS fold"
SQL = {
    "a18_confusion": f"WITH {VOTES_SQL}, {CONFUSION_SQL} SELECT {_FOLD}, y_true, y_pred, n FROM cm",
    "a18_confusion_matrix": f"WITH {VOTES_SQL}, {CONFUSION_SQL} SELECT {_FOLD}, y_true, "
    + ", ".join(
        f"CAST(sum(CASE WHEN y_pred = '{c}' THEN n ELSE 0 END) AS BIGINT) AS {c}"
        for c in ("de", "en", "es", "fr")
    )
    + " FROM cm GROUP BY config, fold, y_true",
    "a19_accuracy": f"WITH {AGREEMENT_SQL} SELECT {_FOLD}, "
    "round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pred GROUP BY config, fold",
    "a20_class_report": f"WITH {VOTES_SQL}, {REPORT_SQL} SELECT {_FOLD}, label, round(precision, 6) AS precision, "
    "round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(t AS BIGINT) AS support FROM report",
    "a20_report_averages": f"WITH {VOTES_SQL}, {REPORT_SQL} SELECT {_FOLD}, "
    + ", ".join(f"round(avg({s}), 6) AS macro_{s}" for s in ("precision", "recall", "f1"))
    + ", "
    + ", ".join(f"round(sum({s} * t) / sum(t), 6) AS weighted_{s}" for s in ("precision", "recall", "f1"))
    + ", CAST(sum(t) AS BIGINT) AS support FROM report GROUP BY config, fold",
    "a21_f1": f"WITH {VOTES_SQL}, {FOLD_SCORES_SQL} SELECT {_FOLD}, round(macro_f1, 6) AS macro_f1, "
    "round(weighted_f1, 6) AS weighted_f1 FROM scores",
    "a22_mcc": f"WITH {VOTES_SQL}, {FOLD_SCORES_SQL} SELECT {_FOLD}, round(mcc, 6) + 0.0 AS mcc FROM scores",
    "a23_summary": f"WITH {GRID_SQL}, {FOLD_SCORES_SQL}, {LONG_SCORES_SQL} SELECT config, metric, "
    "round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) AS std FROM long GROUP BY config, metric",
    "a24_mean_confusion": f"WITH {GRID_SQL}, {CONFUSION_SQL} SELECT config, y_true, y_pred, "
    "round(avg(n), 6) AS mean_n FROM cm GROUP BY config, y_true, y_pred",
    "a25_metric_bars": f"WITH {GRID_SQL}, {FOLD_SCORES_SQL}, {LONG_SCORES_SQL} SELECT config, metric, "
    "round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) AS sd FROM long GROUP BY config, metric",
    "k5_best_config": f"WITH {GRID_SQL}, {FOLD_SCORES_SQL} SELECT config, round(avg(macro_f1), 6) AS mean FROM scores "
    "GROUP BY config HAVING avg(macro_f1) > 0 ORDER BY avg(macro_f1) DESC, "
    "list_position([" + ", ".join(f"'chars>{t}'" for t in THRESHOLDS) + "], config) LIMIT 1",
    "m6_evaluate": f"WITH {AGREEMENT_SQL}, {FOLD_SCORES_SQL}, {LONG_SCORES_SQL} SELECT {_FOLD}, metric, "
    "round(value, 6) + 0.0 AS value FROM long",
    "t10_argmax": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS best "
    "FROM embeddings",
    "t11_label_codes": "SELECT doc_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS BIGINT) AS code, "
    "lang AS label FROM documents",
}
