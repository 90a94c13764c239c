"""Caps, folds and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import TURNS, clicks, documents, r6, stratified_sql, turns
from tamis.operators import metrics, splits


def w1_cap_per_author(spark, path):
    return splits.cap_per_author(clicks(spark, path), 50)


def w1_cap_turns(spark, path):
    return splits.cap_per_author(turns(spark, path), 3)


def _fold(df):
    return df.withColumn("fold", F.col("fold").cast("bigint"))


def w3_stratified_folds(spark, path):
    return _fold(splits.stratified_folds(documents(spark, path), 5))


def w4_author_folds(spark, path):
    return _fold(splits.author_folds(turns(spark, path), 5))


def w4_balanced_folds(spark, path):
    """Each label's posts, the authors that have it, and whether its folds differ by no more than 5 % of them and
    two posts; every author is in one fold."""
    docs = turns(spark, path).drop("text")
    folds = splits.balanced_author_folds(docs, 5)
    counts = docs.join(folds, "author").groupBy("label", "fold").agg(F.count("*").alias("n")).groupBy("label")
    spread = counts.agg(F.sum("n").alias("posts"), (F.max("n") - F.min("n")).alias("_d"), F.count("*").alias("folds"))
    authors = docs.join(folds, "author").groupBy("label").agg(F.count_distinct("author").alias("authors"), F.count_distinct("author", "fold").alias("places"))
    return spread.join(authors, "label").select(
        "label", "posts", "folds", "authors", "places", (F.col("_d") <= 0.05 * F.col("posts") + 2).alias("is_even")
    )


def j4_author_fold_lookup(spark, path):
    docs = turns(spark, path).drop("text")
    return _fold(splits.with_author_folds(docs, splits.author_folds(docs, 5)))


def u2_train_and_validation(spark, path):
    docs = documents(spark, path)
    folded = docs.join(splits.stratified_folds(docs, 5).select("doc_id", "fold"), "doc_id")
    return folded.transform(splits.all_splits, 5).select(
        "doc_id", F.col("model_fold").cast("bigint").alias("model_fold"), "split"
    )


def a26_balanced_weights(spark, path):
    folded = splits.stratified_folds(documents(spark, path), 5)
    weights = metrics.balanced_weights(folded)
    return weights.select(
        F.col("model_fold").cast("bigint").alias("model_fold"), "label", r6(F.col("weight")).alias("weight")
    )


QUERIES = {
    f.__name__: f
    for f in (
        w1_cap_per_author,
        w1_cap_turns,
        w3_stratified_folds,
        w4_author_folds,
        w4_balanced_folds,
        j4_author_fold_lookup,
        u2_train_and_validation,
        a26_balanced_weights,
    )
}
_DOCS = "docs AS (SELECT doc_id, lang AS label FROM documents)"
_AUTHORS = (
    f"{TURNS}, rarity AS (SELECT label, count(*) AS corpus FROM turns GROUP BY label), "
    "strata AS (SELECT author, label, row_number() OVER (PARTITION BY author ORDER BY corpus, label) AS r "
    "FROM (SELECT DISTINCT author, label FROM turns) JOIN rarity USING (label)), "
    "sizes AS (SELECT author, count(*) AS size FROM turns GROUP BY author), "
    "placed AS (SELECT author, row_number() OVER (PARTITION BY label ORDER BY size DESC, "
    "md5('42:' || CAST(author AS VARCHAR))) - 1 AS place FROM strata JOIN sizes USING (author) WHERE r = 1), "
    "folds AS (SELECT author, CAST(CASE WHEN place % 10 < 5 THEN place % 10 ELSE 9 - place % 10 END AS BIGINT) AS fold FROM placed)"
)
SQL = {
    "w1_cap_per_author": "SELECT doc_id, author FROM (SELECT event_id AS doc_id, user_id AS author, "
    "row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 50",
    "w1_cap_turns": f"WITH {TURNS} SELECT doc_id, author, label, text FROM (SELECT *, "
    "row_number() OVER (PARTITION BY author ORDER BY doc_id) AS r FROM turns) WHERE r <= 3",
    "w3_stratified_folds": f"WITH {_DOCS}, {stratified_sql('folded', 'docs', 5)} "
    "SELECT doc_id, label, CAST(fold AS BIGINT) AS fold FROM folded",
    "w4_author_folds": f"WITH {_AUTHORS} SELECT author, fold FROM folds",
    "w4_balanced_folds": f"WITH {TURNS} SELECT label, count(*) AS posts, CAST(5 AS BIGINT) AS folds, count(DISTINCT author) AS authors, "
    "count(DISTINCT author) AS places, true AS is_even FROM turns GROUP BY label",
    "j4_author_fold_lookup": f"WITH {_AUTHORS} SELECT author, doc_id, label, fold FROM turns JOIN folds USING (author)",
    "u2_train_and_validation": f"WITH {_DOCS}, {stratified_sql('folded', 'docs', 5)} SELECT doc_id, m AS model_fold, "
    "CASE WHEN fold = m THEN 'val' ELSE 'train' END AS split FROM folded CROSS JOIN range(0, 5) AS r(m)",
    "a26_balanced_weights": f"WITH {_DOCS}, {stratified_sql('folded', 'docs', 5)}, "
    "c AS (SELECT m AS model_fold, label, count(*) AS n FROM folded JOIN range(0, 5) AS r(m) ON fold <> m GROUP BY m, label) "
    "SELECT model_fold, label, round(CAST(sum(n) OVER (PARTITION BY model_fold) AS DOUBLE) / "
    "(count(*) OVER (PARTITION BY model_fold) * n), 6) AS weight FROM c",
}
