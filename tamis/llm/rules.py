"""Quality rules: word statistics, and a likelihood ratio of hashed n-grams.

Words and word pairs are hashed into ``buckets``. Two multinomials with add-one smoothing count them
over all documents (raw) and over the trusted ones (target). A document's score is the mean of
``log target - log raw`` over its n-grams; a document is kept if no base rule fails and the score is
at least ``threshold``. Everything is column expressions; no row leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    least_words: int = 20
    most_repeated_percent: int = 30
    window: int = 8
    buckets: int = 16_384
    threshold: float = -0.15


def words(text: Column) -> Column:
    """Words between white space as ASCII knows it; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _pairs(values: Column, by: int) -> Column:
    """Hashes of each value with the one ``by`` places on."""
    return F.zip_with(
        F.slice(values, 1, F.greatest(F.size(values) - by, F.lit(0))), _shifted(values, by), lambda a, b: F.xxhash64(a, b)
    )


def hashes(listed: Column) -> Column:
    return F.transform(listed, lambda w: F.xxhash64(w))


def with_repeated_words(rows: DataFrame, window: int) -> DataFrame:
    """Add ``n_repeat_words``: words covered by windows whose hash occurs twice or more in the row.

    ``window`` is a power of two, over the pair hashes ``_p``. Every step is a column of its own, so
    that none is computed twice; rows without a repeated window stop at the first.
    """
    windows, by = F.col("_p"), 2
    while by < window:
        windows, by = _pairs(windows, by), by * 2
    placed = F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    beside = lambda x, i: F.coalesce(F.get("_placed", i)["h"] == x["h"], F.lit(False))
    again = F.filter("_placed", lambda x, i: beside(x, i - 1) | beside(x, i + 1))
    # A window covers what lies before the next one, at most its own width.
    covered = F.transform(
        "_starts", lambda s, i: F.least(F.lit(window), F.coalesce(F.get("_starts", i + 1) - s, F.lit(window)))
    )
    return (
        rows.withColumn("_win", windows)
        .withColumn("_placed", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), placed))
        .withColumn("_starts", F.sort_array(F.transform(again, lambda x: x["i"])))
        .withColumn("_covered", covered)
        .withColumn(
            "n_repeat_words",
            F.coalesce(F.aggregate("_covered", F.lit(0).cast("bigint"), lambda acc, x: acc + x), F.lit(0).cast("bigint")),
        )
        .drop("_win", "_placed", "_starts", "_covered")
    )


def _grams(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_w`` words, ``_h`` their hashes and ``_p`` the hashes of neighbouring pairs."""
    return docs.withColumn("_w", words(F.col("text"))).withColumn("_h", hashes(F.col("_w"))).withColumn("_p", _pairs(F.col("_h"), 1))


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int) -> list[float]:
    """``log target - log raw`` per bucket, from all of ``docs`` and those whose id is in ``trusted``.

    The table has ``buckets`` rows, whatever the size of the corpus; counts are summed per task
    before they are shuffled.
    """
    ids = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("_t", F.lit(1).cast("bigint"))
    # The ids grow with the corpus: they are never broadcast, and the plan is the same at every size.
    marked = docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left")
    grams = _grams(marked.select("text", F.coalesce("_t", F.lit(0)).alias("_t")))
    each = grams.select("_t", F.explode(F.concat("_h", "_p")).alias("_g"))
    each = each.groupBy(_bucket(F.col("_g"), buckets).alias("b")).agg(F.count("*").alias("raw"), F.sum("_t").alias("target"))
    counts = {r["b"]: (r["raw"], r["target"]) for r in each.collect()}
    raw = sum(c[0] for c in counts.values()) + buckets
    target = sum(c[1] for c in counts.values()) + buckets
    pairs = [counts.get(b, (0, 0)) for b in range(buckets)]
    return [log((t + 1) / target) - log((r + 1) / raw) for r, t in pairs]


def _table(values: list[float]) -> Column:
    """The numbers as one constant array (from text, which the planner folds once)."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def judge(docs: DataFrame, trusted: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr)``.

    One row per row of ``docs``. A null text has no words and fails; it scores 0. Equal n-grams count
    each time they stand in a text. With no trusted document all ratios come from smoothing alone.
    """
    ratios = _table(log_ratios(docs, trusted, rules.buckets))
    text = F.coalesce("text", F.lit(""))
    rows = with_repeated_words(_grams(docs.select("doc_id", text.alias("text"))), rules.window)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id",
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("bigint").alias("word_chars"),
        F.when(F.col("text").rlike(SYMBOL), F.size(F.split("text", SYMBOL, -1)) - 1).otherwise(0).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"),
        "n_repeat_words",
        F.concat("_h", "_p").alias("_g"),
    )
    ratio = lambda acc, g: acc + F.element_at(ratios, _bucket(g, rules.buckets) + 1)
    total = F.aggregate("_g", F.lit(0.0), ratio)
    rows = rows.withColumn("llr", F.when(F.size("_g") > 0, total / F.size("_g")).otherwise(F.lit(0.0)))
    failed = (F.col("n_words") < rules.least_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.most_repeated_percent
    )
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("llr") >= rules.threshold)).alias("kept"),
        "llr",
    )
