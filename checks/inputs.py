"""The given tables in the roles of posts, and the matching SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.text import profile_tokens
from tamis.functions.wordlists import STOP_WORDS
from tamis.sources.roles import ColumnRoles
from tamis.sources.store import spread

DOCUMENT_ROLES = ColumnRoles(text="text", label="lang", author="source", doc_id="doc_id")


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, author, label, text)``; the source site plays the author, the language the label."""
    return spread(DOCUMENT_ROLES.bind(table(spark, path, "documents")))


def turns(spark: SparkSession, path: str) -> DataFrame:
    """Conversation turns: the conversation plays the author, the role the label."""
    return table(spark, path, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
        F.col("conv_id").alias("author"),
        F.col("role").alias("label"),
        "text",
    )


def clicks(spark: SparkSession, path: str) -> DataFrame:
    """Events: users with many rows each."""
    return table(spark, path, "events").select(
        F.col("event_id").alias("doc_id"), F.col("user_id").alias("author")
    )


def tokenized(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, author, label, tokens)`` of the documents, word tokens as for profiles."""
    docs = documents(spark, path)
    return docs.select("doc_id", "author", "label", profile_tokens(F.col("text")).alias("tokens"))


def judged(spark: SparkSession, path: str) -> DataFrame:
    """The judged documents with their quality as label."""
    quality = table(spark, path, "labels").select(
        "doc_id", F.col("quality").cast("string").alias("quality")
    )
    docs = documents(spark, path).drop("label")
    return docs.join(quality, "doc_id").withColumnRenamed("quality", "label")


def r6(column: Column) -> Column:
    """Six digits, and never a negative zero."""
    return F.round(column, 6) + F.lit(0.0)


def joined(tokens: str = "tokens") -> Column:
    return F.array_join(tokens, " ").alias("tokens")


# SQL fragments

# White space as the engine's own classes do not cover it.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = "[^" + WS[1:]
WORD = r"[\pL\pN_]{2,}"


def quoted(words) -> str:
    return ",".join("'" + w.replace("'", "''") + "'" for w in words)


STOPS = quoted(STOP_WORDS)
TOK = (
    "tok AS (SELECT doc_id, source AS author, lang AS label, "
    f"regexp_extract_all(lower(text), '{WORD}') AS tokens FROM documents)"
)
OCC = (
    "occ AS (SELECT doc_id, label, unnest(tokens) AS token, "
    "generate_subscripts(tokens, 1) AS pos FROM tok)"
)
FREQ = "freq AS (SELECT token, count(*) AS n FROM occ GROUP BY token)"
TURNS = (
    "turns AS (SELECT conv_id * 1000 + turn AS doc_id, conv_id AS author, role AS label, text "
    "FROM conversations)"
)


def stratified_sql(name: str, source: str, k: int, seed: int = 42) -> str:
    return (
        f"{name} AS (SELECT doc_id, label, CAST((row_number() OVER (PARTITION BY label "
        f"ORDER BY md5('{seed}:' || CAST(doc_id AS VARCHAR))) - 1) % {k} AS INTEGER) AS fold "
        f"FROM {source})"
    )
