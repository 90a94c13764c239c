"""License notices in texts by diagonal voting.

Rolling hashes of ``k`` neighbouring words of every text are joined to the same of the templates. A
hit at word ``d`` of a text and word ``t`` of a template votes for the diagonal ``d - t``. A base
phrase stands where all its hits share a diagonal. For the other templates neighbouring diagonals
are merged (words put in or left out), and a span counts if enough of the template is covered.
Everything is column expressions; no row leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.llm.common import LOWER, UPPER

#: Phrases and labels that are always looked for.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Wordings of common notices.
NOTICES = (
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
#: What parts words: ASCII other than letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SENTINEL = 0


@dataclass(frozen=True)
class Vote:
    """Words in a hash for base phrases (2) and notices (3); widest step between merged diagonals;
    least share of a notice's words."""

    step: int = 2
    covered: float = 0.8


def words(text: Column) -> Column:
    """Words in their own case."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def _lowered(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def _grams(hashed: Column) -> Column:
    """Hashes of pairs, then of triples, of neighbouring word hashes."""
    n = F.size(hashed)
    cut = lambda x, start, gone: F.slice(x, start, F.greatest(n - gone, F.lit(0)))
    two = F.zip_with(cut(hashed, 1, 1), cut(hashed, 2, 1), lambda a, b: F.xxhash64(a, b))
    three = F.zip_with(cut(two, 1, 2), cut(hashed, 3, 2), lambda a, b: F.xxhash64(a, b))
    return F.concat(F.array(F.lit(_SENTINEL).cast("bigint")), two, three)


def _spelled(listed: Column) -> Column:
    """The words of each of ``_grams``."""
    n = F.size(listed)
    cut = lambda start, gone: F.slice(listed, start, F.greatest(n - gone, F.lit(0)))
    two = F.zip_with(cut(1, 1), cut(2, 1), lambda a, b: F.array(a, b))
    ends = F.zip_with(cut(1, 2), cut(2, 2), lambda a, b: F.array(a, b))
    three = F.zip_with(ends, cut(3, 2), lambda ab, c: F.array(ab[0], ab[1], c))
    return F.concat(F.array(F.array().cast("array<string>")), two, three)


def _hashed(listed: Column) -> Column:
    # Lower case beyond ASCII may only add hits, which the words themselves then refute.
    return F.transform(listed, lambda w: F.xxhash64(F.lower(w)))


def template_grams(spark: SparkSession, notices: tuple[tuple[str, str], ...]) -> DataFrame:
    """``(g, template, label, base, size, k, t, gram)``: as many rows as the templates have words, plus
    one that every text hits once."""
    rows = [
        (i, label, i < len(BASE), text.split(" "), 2 if i < len(BASE) else 3)
        for i, (label, text) in enumerate((*BASE, *notices))
    ]
    made = spark.createDataFrame(rows, "template int, label string, base boolean, w array<string>, k int")
    made = made.withColumn("_h", _hashed(F.col("w"))).select(
        "template", "label", "base", F.size("w").alias("size"), "k", "w", F.posexplode(_grams(F.col("_h"))).alias("i", "g")
    )
    pair = (F.col("k") == 2) & (F.col("i") > 0) & (F.col("i") < F.col("size"))
    triple = (F.col("k") == 3) & (F.col("i") >= F.col("size"))
    t = F.when(pair, F.col("i") - 1).otherwise(F.col("i") - F.col("size"))
    made = made.where(pair | triple).withColumn("t", t)
    made = made.select("g", "template", "label", "base", "size", "k", "t", F.expr("slice(w, t + 1, k)").alias("gram"))
    none = spark.range(1).select(
        F.lit(_SENTINEL).cast("bigint").alias("g"), F.lit(-1).alias("template"), F.lit("").alias("label"),
        F.lit(False).alias("base"), F.lit(1).alias("size"), F.lit(0).alias("k"), F.lit(0).alias("t"),
        F.array().cast("array<string>").alias("gram"),
    )
    return made.unionByName(none)


def hits(docs: DataFrame, notices: tuple[tuple[str, str], ...]) -> DataFrame:
    """Verified hits, and for every row of ``docs`` one of template -1."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), words(F.col("text")).alias("_w"))
    rows = rows.withColumn("_h", _hashed(F.col("_w"))).withColumn("_n", F.size("_w"))
    # Each gram carries its own words: a row with all words of the text beside every gram would take
    # the square of its length.
    grams = F.zip_with(_grams(F.col("_h")), _spelled(F.col("_w")), lambda g, w: F.struct(g.alias("g"), w.alias("words")))
    each = rows.select("doc_id", "_text", "_n", F.posexplode(grams).alias("_i", "_gram"))
    each = each.select("doc_id", "_text", "_n", "_i", F.col("_gram.g").alias("g"), F.col("_gram.words").alias("words"))
    # The templates are constants of this module or a parameter of a few hundred words.
    found = each.join(F.broadcast(template_grams(docs.sparkSession, notices)), "g")
    at = F.when(F.col("_i") < F.col("_n"), F.col("_i") - 1).otherwise(F.col("_i") - F.col("_n"))
    found = found.withColumn("_d", F.when(F.col("template") < 0, 0).otherwise(at))
    spelled = F.transform("words", _lowered)
    found = found.where((F.col("template") < 0) | (spelled == F.col("gram")))
    return found.select("doc_id", "_text", "_n", "template", "label", "base", "size", "k", "t", (F.col("_d") - F.col("t")).alias("diagonal"))


def spans(found: DataFrame, vote: Vote) -> DataFrame:
    """Merged diagonals of hits: ``(row, template, label, base, first_word, covered, whole, rows)``.

    ``covered`` is the share of the template's words, ``whole`` the number of diagonals that have all
    hits of the template, ``rows`` of template -1 how often the row stands in the table.
    """
    row = ["doc_id", "_text", "_n"]
    kind = [*row, "template", "label", "base", "size", "k"]
    voted = found.groupBy(*kind, "diagonal").agg(F.collect_set("t").alias("ts"), F.count("*").alias("rows"))
    order = Window.partitionBy(*row, "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > vote.step, F.lit(True)).cast("int")
    parts = voted.withColumn("_fresh", fresh).withColumn("_span", F.sum("_fresh").over(order))
    full = F.size("ts") == F.col("size") - F.col("k") + 1
    merged = parts.groupBy(*kind, "_span").agg(
        F.flatten(F.collect_list("ts")).alias("ts"),
        F.sum(full.cast("bigint")).alias("whole"),
        F.min(F.when(full, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(full, F.col("diagonal"))).alias("last_word"),
        F.sum("rows").alias("rows"),
    )
    touched = F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + F.col("k") - 1))))
    covered = F.when(F.col("template") < 0, 0.0).otherwise(F.size(touched) / F.col("size"))
    return merged.withColumn("covered", covered)


def scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, vote: Vote = Vote()) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, one row per row.

    Null and empty texts have no words and no labels. The score is the largest share of a template
    found. Rows with the same id are told apart by their texts; rows alike in both give equal rows,
    as many as there are. A notice shorter than three words is never found.
    """
    found = spans(hits(docs, notices), vote)
    own = (~F.col("base")) & (F.col("template") >= 0) & (F.col("covered") >= vote.covered)
    base = F.col("base") & (F.col("whole") > 0)
    labels = lambda condition: F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")
    whole = F.when(F.col("base"), F.col("whole")).otherwise(F.lit(0))
    each = found.groupBy("doc_id", "_text", "_n").agg(
        F.sum(whole).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("last_word"))).cast("bigint").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(base | own).alias("labels"),
        F.max("covered").alias("score"),
        F.sum(F.when(F.col("template") < 0, F.col("rows"))).alias("_rows"),
    )
    each = each.withColumn("_copy", F.explode(F.expr("sequence(1L, _rows)")))
    return each.select(
        "doc_id", F.col("_n").cast("bigint").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )
