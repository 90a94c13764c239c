"""Sources, column roles and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import DOCUMENT_ROLES, documents, r6, stratified_sql, table
from checks.scores import AGREEMENT_SQL, FOLD_SCORES_SQL, LONG_SCORES_SQL, agreement
from tamis.operators import metrics, splits
from tamis.sources import roles, store


def s1_csv_scan(spark, path):
    source = table(spark, path, "documents")
    target = store.scratch_path(spark, "csv")
    store.write_posts(source, target)
    return store.read_posts(spark, target, source.schema)


def s2_bind_roles(spark, path):
    return DOCUMENT_ROLES.bind(table(spark, path, "documents"))


def s3_checked_columns(spark, path):
    checked = roles.require_columns(table(spark, path, "documents"), ["doc_id", "lang", "source"])
    return checked.groupBy("lang", "source").agg(F.count("*").alias("n"))


def s4_prepared_round_trip(spark, path):
    docs = documents(spark, path)
    folds = splits.stratified_folds(docs, 5).select("doc_id", "fold")
    target = store.scratch_path(spark, "prepared")
    store.write_prepared(docs.join(folds, "doc_id"), target)
    back = store.read_prepared(spark, target)
    return back.select("doc_id", "author", "label", "text", F.col("fold").cast("bigint").alias("fold"))


def s5_metrics_sink(spark, path):
    scores = metrics.evaluate(agreement(spark, path))
    target = store.scratch_path(spark, "metrics")
    for run in ("first", "second"):
        store.append_metrics(scores.withColumn("config", F.lit(run)), target)
    back = spark.read.parquet(target)
    return back.select("config", F.col("fold").cast("bigint").alias("fold"), "metric", r6(F.col("value")).alias("value"))


def s6_preview(spark, path):
    return store.preview(documents(spark, path), 5)


def s6_fold_sizes(spark, path):
    sizes = store.fold_sizes(splits.stratified_folds(documents(spark, path), 5))
    return sizes.select(F.col("fold").cast("bigint").alias("fold"), "train", "val")


QUERIES = {
    f.__name__: f
    for f in (
        s1_csv_scan,
        s2_bind_roles,
        s3_checked_columns,
        s4_prepared_round_trip,
        s5_metrics_sink,
        s6_preview,
        s6_fold_sizes,
    )
}
_DOCS = "docs AS (SELECT doc_id, source AS author, lang AS label, text FROM documents)"
_FOLDED = f"WITH {_DOCS}, {stratified_sql('folded', 'docs', 5)} "
SQL = {
    "s1_csv_scan": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "s2_bind_roles": "SELECT doc_id, source AS author, lang AS label, text FROM documents",
    "s3_checked_columns": "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source",
    "s4_prepared_round_trip": _FOLDED
    + "SELECT d.doc_id, d.author, d.label, d.text, CAST(f.fold AS BIGINT) AS fold "
    "FROM docs d JOIN folded f USING (doc_id)",
    "s5_metrics_sink": f"WITH {AGREEMENT_SQL}, {FOLD_SCORES_SQL}, {LONG_SCORES_SQL} "
    "SELECT run AS config, CAST(fold AS BIGINT) AS fold, metric, round(value, 6) AS value "
    "FROM long, (VALUES ('first'), ('second')) AS r(run)",
    "s6_preview": "SELECT doc_id, source AS author, lang AS label, text FROM documents "
    "ORDER BY doc_id LIMIT 5",
    "s6_fold_sizes": _FOLDED
    + "SELECT CAST(fold AS BIGINT) AS fold, "
    "CAST(sum(count(*)) OVER () - count(*) AS BIGINT) AS train, count(*) AS val FROM folded GROUP BY fold",
}
