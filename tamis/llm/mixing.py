"""Mixing sources to target weights.

Sources share the words of the mix by weight; a source can give each of its documents so many times
only, and what it cannot give goes to the others by weight. Inside a source documents come in the order
of hash-random keys: key ranges, as many as the source has rows for, are sorted one by one, a prefix
sum over the ranges' word counts places each range in its source, and the mix ends at the exact word
of the budget. A budget larger than the source takes all its documents once or more before that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import staged
from tamis.operators.ranking import row_number

#: A word is a run of other characters than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys are whole numbers below this, spread evenly: 15 hexadecimal digits of a digest.
KEYS = 16**15


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in order of their names, a null name last. ``most``: how many
    times a document may be taken. ``share``: words of the mix as a part of all words.
    ``range_rows``: documents in a key range, about."""

    weights: tuple[float, ...] = (5, 2, 1)
    most: int = 3
    share: float = 1.0
    seed: int = 42
    range_rows: int = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _key(mix: Mix) -> Column:
    digest = F.md5(F.concat(F.lit(f"{mix.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``(unnamed, source, source_size, documents, target, budget)`` for
    ``sizes(unnamed, source, source_size, documents)``, one row per source.

    ``unnamed`` is 1 for the null source, whose ``source`` is empty. Targets are a level times the weight,
    but no more than ``most`` times the size; each round sets the level that gives out all words with the
    sources found full so far, until no other source is above its limit. Sources may be many: a round
    is one sum over them. The budget is the target in whole words.
    """
    bucketed = sizes.withColumn("_bucket", F.struct("unnamed", F.substring("source", 1, 2)))
    ranked = row_number(bucketed, "_at", [], ["_bucket"], [F.col("_bucket")], [F.col("unnamed"), F.col("source")])
    weight = F.get(F.array(*[F.lit(float(w)) for w in mix.weights]), F.col("_at") % len(mix.weights))
    most = F.col("source_size") * mix.most
    weighed = staged(ranked.select("unnamed", "source", "source_size", "documents", weight.alias("_w"), most.alias("_most")), "sources")
    (total,) = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()
    # A mix larger than all sources can give takes everything.
    total = total * mix.share
    left, weights, full = total, None, -1
    while True:
        above = F.lit(False) if weights is None else F.col("_w") * left / weights > F.col("_most")
        found = weighed.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("_most"))), F.lit(0)), F.sum(F.when(~above, F.col("_w")))
        ).first()
        if found[0] == full:
            break
        full, left, weights = found[0], total - found[1], found[2]
        if weights is None:  # every source is full
            break
    target = F.col("_most").cast("double") if weights is None else F.least(F.col("_w") * left / weights, F.col("_most").cast("double"))
    out = weighed.withColumn("target", target)
    return out.withColumn("budget", F.least(F.round("target").cast("bigint"), F.col("_most"))).drop("_w", "_most")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)``, one row per row of ``docs``.

    ``size`` is the document's words, ``taken`` those that the mix takes of it, repeats counted: all of
    them for every full pass over its source, and in the last pass all of them before the budget's
    cut, the first few at the cut, none behind it. A null text has no words. A null source is a source of
    its own, the last one. A null id has a key like others; rows that share an id share a key and come in
    order of their sizes. Equal tables give equal results, however they are partitioned. Other columns
    are not read.
    """
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"), _key(mix).alias("_key"))
    rows = rows.withColumn("unnamed", F.isnull("source").cast("int")).withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    rows = staged(rows, "sizes")
    sizes = rows.groupBy("unnamed", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    # Sources as they are: a table that is small is broadcast, another one joined with skew split.
    aims = staged(targets(staged(sizes, "source-sizes"), mix), "targets")
    ranges = F.ceil(F.col("documents") / mix.range_rows).cast("bigint")
    named = rows.join(aims, ["unnamed", "source"])
    named = named.withColumn("_range", F.floor(F.col("_key") / (F.lit(KEYS) / ranges)).cast("bigint"))
    group = ["unnamed", "source"]
    before_range = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = named.groupBy(*group, "_range").agg(F.sum("size").alias("_words"))
    starts = starts.select(*group, "_range", F.coalesce(F.sum("_words").over(before_range), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.join(starts, [*group, "_range"])
    placed = placed.withColumn("_before", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # A source without words has no passes.
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = F.col("budget") - passes * F.col("source_size")
    last = F.greatest(F.least(rest - F.col("_before"), F.col("size")), F.lit(0))
    source = F.when(F.col("unnamed") == 0, F.col("source"))
    return placed.select("doc_id", source.alias("source"), "size", "source_size", "target", (passes * F.col("size") + last).cast("bigint").alias("taken"))


def drawn(text: Column, size: Column, taken: Column) -> Column:
    """The texts that the mix takes of a document, one per pass: whole ones, and at the cut the first words
    with a space between them. Null where it takes none.
    """
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(0).cast("int")
    cut = (taken - whole * size).cast("int")
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, cut), " ")
    texts = F.concat(F.array_repeat(text, whole), F.when(cut > 0, F.array(first)).otherwise(F.array().cast("array<string>")))
    return F.when(taken > 0, texts)
