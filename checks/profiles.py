"""Profiles of documents, conversations and event users."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import NOT_WS, clicks, documents, r6, turns
from tamis.operators import distribution, profile


def f1_rows_of_label(spark, path):
    return profile.of_label(documents(spark, path), "fr").select("doc_id", "text")


def a1_label_distribution(spark, path):
    return profile.label_distribution(documents(spark, path))


def a2_post_lengths(spark, path):
    return profile.post_lengths(documents(spark, path))


def _described(df):
    for name in ("mean", "std", "q25", "q50", "q75"):
        df = df.withColumn(name, r6(F.col(name)))
    return df


def a3_describe_lengths(spark, path):
    return _described(profile.describe_lengths(documents(spark, path)))


def a4_distinct_authors(spark, path):
    return profile.totals(clicks(spark, path)).select("authors")


def a5_total_posts(spark, path):
    return profile.totals(clicks(spark, path)).select("posts")


def a6_posts_per_author(spark, path):
    return profile.posts_per_author(clicks(spark, path))


def a7_describe_posts_per_author(spark, path):
    return _described(distribution.describe(profile.post_count_frequencies(turns(spark, path))))


def a8_post_count_percentiles(spark, path):
    found = distribution.percentiles(profile.post_count_frequencies(clicks(spark, path)), 0.9, 0.95, 0.99)
    return found.select("p", r6(F.col("value")).alias("value"))


def a9_post_count_histogram(spark, path):
    bins = distribution.histogram(profile.post_count_frequencies(clicks(spark, path)), 50)
    return bins.select("bin", r6(F.col("lower")).alias("lower"), r6(F.col("upper")).alias("upper"), "n")


def a10_post_count_box(spark, path):
    return distribution.box_summary(profile.post_count_frequencies(clicks(spark, path)))


def w2_word_count_ecdf(spark, path):
    steps = profile.word_count_ecdf(documents(spark, path))
    return steps.select("value", "n", r6(F.col("first")).alias("first"), r6(F.col("last")).alias("last"))


def k1_most_active_authors(spark, path):
    return profile.most_active_authors(clicks(spark, path), 10)


QUERIES = {
    f.__name__: f
    for f in (
        f1_rows_of_label,
        a1_label_distribution,
        a2_post_lengths,
        a3_describe_lengths,
        a4_distinct_authors,
        a5_total_posts,
        a6_posts_per_author,
        a7_describe_posts_per_author,
        a8_post_count_percentiles,
        a9_post_count_histogram,
        a10_post_count_box,
        w2_word_count_ecdf,
        k1_most_active_authors,
    )
}
_LENGTHS = (
    "lengths AS (SELECT doc_id, lang AS label, CAST(length(text) AS BIGINT) AS char_count, "
    f"CAST(len(regexp_extract_all(text, '{NOT_WS}+')) AS BIGINT) AS word_count FROM documents)"
)
_USERS = "per AS (SELECT user_id AS author, count(*) AS v FROM events GROUP BY user_id)"
_DESCRIBE = (
    "count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, "
    "round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, "
    "round(quantile_cont(v, 0.75), 6) AS q75, max(v) AS max"
)
SQL = {
    "f1_rows_of_label": "SELECT doc_id, text FROM documents WHERE lang = 'fr'",
    "a1_label_distribution": "SELECT lang AS label, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang",
    "a2_post_lengths": f"WITH {_LENGTHS} SELECT doc_id, label, char_count, word_count FROM lengths",
    "a3_describe_lengths": f"WITH {_LENGTHS}, m AS (SELECT label, 'char_count' AS measure, char_count AS v FROM lengths "
    "UNION ALL SELECT label, 'word_count', word_count FROM lengths) "
    f"SELECT label, measure, {_DESCRIBE} FROM m GROUP BY label, measure",
    "a4_distinct_authors": "SELECT count(DISTINCT user_id) AS authors FROM events",
    "a5_total_posts": "SELECT count(*) AS posts FROM events",
    "a6_posts_per_author": "SELECT user_id AS author, count(*) AS posts FROM events GROUP BY user_id",
    "a7_describe_posts_per_author": "WITH per AS (SELECT conv_id, count(*) AS v FROM conversations GROUP BY conv_id) "
    f"SELECT {_DESCRIBE} FROM per",
    "a8_post_count_percentiles": f"WITH {_USERS} "
    + " UNION ALL ".join(
        f"SELECT CAST({p} AS DOUBLE) AS p, round(quantile_cont(v, {p}), 6) AS value FROM per" for p in (0.9, 0.95, 0.99)
    ),
    "a9_post_count_histogram": f"WITH {_USERS}, e AS (SELECT CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) - min(v) AS DOUBLE) AS w FROM per), "
    "slots AS (SELECT least(floor((v - lo) * 50 / w), 49) + 1 AS bin FROM per, e), "
    "counted AS (SELECT bin, count(*) AS c FROM slots GROUP BY bin) "
    "SELECT i AS bin, round(lo + (i - 1) * w / 50, 6) AS lower, round(lo + i * w / 50, 6) AS upper, coalesce(c, 0) AS n "
    "FROM range(1, 51) AS r(i) CROSS JOIN e LEFT JOIN counted ON counted.bin = i",
    "a10_post_count_box": f"WITH {_USERS}, q AS (SELECT quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, "
    "quantile_cont(v, 0.75) AS q75 FROM per), "
    "f AS (SELECT v, q25, q50, q75, v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside FROM per, q) "
    "SELECT max(q25) AS q25, max(q50) AS q50, max(q75) AS q75, min(CASE WHEN inside THEN v END) AS whisker_low, "
    "max(CASE WHEN inside THEN v END) AS whisker_high, count(*) FILTER (WHERE NOT inside) AS outliers FROM f",
    "w2_word_count_ecdf": f"WITH {_LENGTHS}, per AS (SELECT word_count AS value, count(*) AS n FROM lengths GROUP BY word_count), "
    "run AS (SELECT value, n, sum(n) OVER (ORDER BY value) - n AS before, sum(n) OVER () AS total FROM per) "
    "SELECT value, n, round(CAST(before AS DOUBLE) / total, 6) AS first, "
    "round(CAST(before + n - 1 AS DOUBLE) / total, 6) AS last FROM run",
    "k1_most_active_authors": "SELECT user_id AS author, count(*) AS posts FROM events GROUP BY user_id "
    "ORDER BY posts DESC, author LIMIT 10",
}
