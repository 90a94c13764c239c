"""Profiles of a table of labelled posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import char_count, word_count
from tamis.operators.distribution import describe, ecdf, frequency_table


def of_label(docs: DataFrame, label: str) -> DataFrame:
    """Rows of one label; the filter reaches the scan."""
    return docs.where(F.col("label") == label)


def label_distribution(docs: DataFrame) -> DataFrame:
    """Posts per label, most frequent first; rows without a label are not counted."""
    return (
        docs.where(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "label")
    )


def post_lengths(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        "label",
        char_count(F.col("text")).alias("char_count"),
        word_count(F.col("text")).alias("word_count"),
    )


def describe_lengths(docs: DataFrame) -> DataFrame:
    """``describe`` of characters and words, per label and measure, from one scan."""
    long = post_lengths(docs).unpivot(
        ["doc_id", "label"], ["char_count", "word_count"], "measure", "length"
    )
    labelled = long.where(F.col("label").isNotNull())
    return describe(frequency_table(labelled, "length", "label", "measure"), "label", "measure")


def word_count_ecdf(docs: DataFrame) -> DataFrame:
    return ecdf(frequency_table(post_lengths(docs), "word_count"))


def totals(docs: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct authors and number of posts, in one row."""
    distinct = F.approx_count_distinct("author") if approximate else F.count_distinct("author")
    return docs.agg(distinct.alias("authors"), F.count("*").alias("posts"))


def posts_per_author(docs: DataFrame) -> DataFrame:
    return (
        docs.where(F.col("author").isNotNull()).groupBy("author").agg(F.count("*").alias("posts"))
    )


def post_count_frequencies(docs: DataFrame) -> DataFrame:
    """How many authors have 1, 2, 3 ... posts: the input of the author distributions."""
    return frequency_table(posts_per_author(docs), "posts")


def most_active_authors(docs: DataFrame, n: int = 10) -> DataFrame:
    return posts_per_author(docs).orderBy(F.desc("posts"), "author").limit(n)
