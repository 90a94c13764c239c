"""A corpus pipeline: language, quality, near duplicates, packing.

Every stage works on all rows that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import language, near, packing, quality
from tamis.llm.common import staged, table
from tamis.llm.queries import TOKENIZER

#: Documents whose language is found with less certainty go, as do those of no language.
LEAST_CERTAIN = 0.3
#: Documents of lower quality go.
LEAST_QUALITY = 0.7
#: Near duplicates have 80 % of their shingles of five words in common. Of pairs at that limit,
#: ``2 * (1 - 0.8**3)**14``, about 1 in 11,500, share no table.
NEAR = near.Scheme(width=5, percent=80, collections=14)
#: Chunks whose ids a worker remembers: workers live on from stage to stage, beside a heap that earlier ones filled.
REMEMBERED = 100_000


def _free_name(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that was learnt from these; null texts and those without a letter go."""
    found = _free_name(docs, "_language")
    marked = docs.withColumn(found, language.identify(F.col("text"), language.fit(docs)))
    known = (F.col(f"{found}.lang_pred") != language.UNDETERMINED) & (F.col(f"{found}.score") >= LEAST_CERTAIN)
    return marked.where(known).drop(found)


def qualities(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, as learnt from ``labels``."""
    found = _free_name(docs, "_quality")
    marked = docs.withColumn(found, quality.score(F.col("text"), quality.fit(docs, table(spark, sf_dir, "labels"))))
    return marked.where(F.col(found) >= LEAST_QUALITY).drop(found)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that with the smallest id; every text without words stays."""
    return near.near_duplicates(docs, NEAR, carry=True).where("first_row").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack(docs, TOKENIZER, remembered=REMEMBERED)


STAGES = [
    ("language", languages),
    ("quality", qualities),
    ("near_duplicates", near_duplicates),
    ("packing", packed),
]

#: Two stages are learnt, so SQL has no equal statement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
