"""Corpus statistics over token arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.text import adjacent_pairs
from tamis.functions.wordlists import NOUN_ENDINGS
from tamis.sources.store import write_through

# Tokens that make up at least 1/_HOT_SHARE of all occurrences: there can be no more than
# _HOT_SHARE of them, so a table of them may always be broadcast.
_HOT_SHARE = 20_000


def token_places(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, token)``.

    Here and elsewhere arrays are exploded in the outer form with a null filter behind it: for the
    plain form Catalyst adds a ``size(array) > 0`` filter below, which computes the array once more.
    """
    exploded = docs.select("doc_id", F.posexplode_outer("tokens").alias("pos", "token"))
    return exploded.where(F.col("token").isNotNull())


def token_sets(docs: DataFrame) -> DataFrame:
    """``(doc_id, token)``: each token of a document once, made inside the row."""
    exploded = docs.select("doc_id", F.explode_outer(F.array_distinct("tokens")).alias("token"))
    return exploded.where(F.col("token").isNotNull())


def with_table(
    rows: DataFrame, keyed: DataFrame, key: str, on: Column | None = None, how: str = "inner"
) -> DataFrame:
    """Join rows to a table with one row per key, so that no frequent key meets in one task.

    Keys that make up at least ``1 / _HOT_SHARE`` of the rows are looked up in a broadcast, of which
    there are at most ``_HOT_SHARE``; the shuffle sees the others only. ``how`` is ``inner``,
    ``left`` or ``left_semi``. ``key`` names the column in ``keyed`` and, unless ``on`` gives an
    expression, in ``rows``; the result has the columns of ``rows`` and the others of ``keyed``.
    The rows are read twice more for the counts: pass a written table or what is cheap to make.
    """
    marked = rows.withColumn("_key", F.col(key) if on is None else on)
    freq = marked.groupBy("_key").agg(F.count("*").alias("_n"))
    hot_from = freq.agg(F.sum("_n") / _HOT_SHARE).scalar()
    hot = freq.where((F.col("_n") >= hot_from) & F.col("_key").isNotNull()).select("_key", F.lit(True).alias("_hot"))
    split = marked.join(F.broadcast(hot), "_key", "left")
    table = keyed.withColumnRenamed(key, "_key")
    often = table.join(F.broadcast(hot.select("_key")), "_key", "left_semi")
    parts = (
        split.where(F.col("_hot")).join(F.broadcast(often), "_key", how),
        split.where(F.col("_hot").isNull()).join(table, "_key", how),
    )
    return parts[0].unionByName(parts[1]).drop("_hot", "_key")


def remove_tokens(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Delete the tokens listed in ``gone(doc_id, token)`` wherever they stand; emptied documents stay."""
    lists = gone.groupBy("doc_id").agg(F.collect_list("token").alias("_gone"))
    left = F.filter("tokens", lambda t: ~F.array_contains("_gone", t))
    return (
        docs.join(lists, "doc_id", "left")
        .withColumn("tokens", F.when(F.col("_gone").isNull(), F.col("tokens")).otherwise(left))
        .select(*docs.columns)
    )


def token_frequencies(docs: DataFrame) -> DataFrame:
    """``(token, n)`` over the corpus, combined before the shuffle."""
    return (
        docs.select(F.explode_outer("tokens").alias("token"))
        .where(F.col("token").isNotNull())
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )


def remove_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Delete the token positions listed in ``places(doc_id, pos)``; emptied documents stay."""
    gone = places.groupBy("doc_id").agg(F.collect_list("pos").alias("_gone"))
    # `array_except` over positions is a hash lookup, and keeps order and repeated tokens.
    every = F.transform("tokens", lambda t, i: i)
    left = F.transform(F.array_except(every, F.col("_gone")), lambda i: F.get("tokens", i))
    return (
        docs.join(gone, "doc_id", "left")
        .withColumn("tokens", F.when(F.col("_gone").isNull(), F.col("tokens")).otherwise(left))
        .select(*docs.columns)
    )


def frequency_cutoff(
    docs: DataFrame, min_freq: int = 5, counted_on: DataFrame | None = None
) -> DataFrame:
    """Drop tokens with fewer than ``min_freq`` occurrences in ``counted_on`` (default: ``docs``).

    Pass the training rows as ``counted_on`` to keep validation text out of the decision.

    Tokens that are certainly kept and frequent are sorted out by a broadcast of bounded size, so
    the join by token sees no hot key; what comes out of it, the rare tokens, has fewer than
    ``min_freq`` places per token. Documents are joined once by id and never taken apart.
    """
    freq = token_frequencies(docs if counted_on is None else counted_on)
    kept = freq.where(F.col("n") >= min_freq)
    hot_from = freq.agg(F.sum("n") / _HOT_SHARE).scalar()
    hot = kept.where(F.col("n") >= hot_from)
    rare = (
        token_places(docs)
        .join(F.broadcast(hot.select("token")), "token", "left_anti")
        .join(kept.select("token"), "token", "left_anti")
    )
    return remove_places(docs, rare)


def boundary_pairs(docs: DataFrame, order: str = "doc_id", ranges: int | None = None) -> DataFrame:
    """``(w1, w2)``: last token of each non-empty document and first token of the next one by ``order``.

    ``order`` may be any column that sorts: the corpus is cut at quantiles of its values, as Spark samples
    them, into ``ranges`` (by default as many as shuffles have). Each range is sorted by itself; its first
    token is handed to the range before it, so that one row per range crosses ranges.
    """
    both = F.struct(
        F.get("tokens", F.lit(0)).alias("_first"), F.try_element_at("tokens", F.lit(-1)).alias("_last")
    )
    # Exploded, though it is one row, because filters do not move below an explode.
    ends = (
        docs.select(F.col(order).alias("_at"), F.explode_outer(F.array(both)).alias("_ends"))
        .select("_at", "_ends.*")
        .where(F.col("_first").isNotNull())
    )
    # Written before: sampling for the cuts and the shuffle would make the tokens once each.
    ends = write_through(ends, "ends")
    cut = ends.repartitionByRange(*([ranges] if ranges else []), "_at")
    # Written, because the cuts are those of this one shuffle.
    ranged = write_through(cut.withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range").orderBy("_at")
    heads = (
        ranged.groupBy("_range")
        .agg(F.min(F.struct("_at", "_first"))["_first"].alias("_head"))
        .select("_range", F.lead("_head").over(Window.orderBy("_range")).alias("_next_head"))
    )
    followed = ranged.withColumn("_next", F.lead("_first").over(inside)).join(heads, "_range")
    return followed.select(
        F.col("_last").alias("w1"), F.coalesce("_next", "_next_head").alias("w2")
    ).where(F.col("w2").isNotNull())


def _neighbours(docs: DataFrame, tokens: Column) -> DataFrame:
    return (
        docs.select(adjacent_pairs(tokens).alias("_pairs"))
        .select(F.explode_outer("_pairs").alias("_pair"))
        .where(F.col("_pair").isNotNull())
        .select("_pair.w1", "_pair.w2")
    )


def pair_counts(docs: DataFrame, cross_document: bool = False, order: str = "doc_id") -> DataFrame:
    """``(w1, w2, n)`` for neighbouring tokens, within documents unless asked otherwise.

    Across documents the corpus is read in the order of the column ``order``.
    """
    pairs = _neighbours(docs, F.col("tokens"))
    if cross_document:
        pairs = pairs.unionByName(boundary_pairs(docs, order))
    return pairs.groupBy("w1", "w2").agg(F.count("*").alias("n"))


def pair_scores(docs: DataFrame, min_freq: int = 5, cross_document: bool = False) -> DataFrame:
    """Pointwise mutual information ``log2(n_xy * N / (n_x * n_y))`` of pairs seen often enough.

    The cut comes before the joins, so they see only the surviving pairs.
    """
    # Every token is first of one pair, the last of a document with null: one pass gives pairs and frequencies.
    ended = F.concat("tokens", F.array(F.lit(None).cast("string")))
    pairs = _neighbours(docs, ended).withColumn("_inside", F.lit(1))
    if cross_document:
        pairs = pairs.unionByName(boundary_pairs(docs).withColumn("_inside", F.lit(0)))
    pairs = pairs.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.sum("_inside").alias("_inside"))
    pairs = write_through(pairs, "all-pairs", compression="zstd")
    freq = pairs.where("w1 is not null").groupBy(F.col("w1").alias("token")).agg(F.sum("_inside").alias("n"))
    freq = write_through(freq, "frequencies")
    total = freq.agg(F.sum("n")).scalar()
    seen = (F.col("n") >= min_freq) & F.col("w2").isNotNull()
    pairs = write_through(pairs.where(seen).select("w1", "w2", "n"), "pairs")
    # Words of very many pairs are looked up, so that none meets in one task.
    first = freq.select(F.col("token").alias("w1"), F.col("n").alias("_n1"))
    second = freq.select(F.col("token").alias("w2"), F.col("n").alias("_n2"))
    scored = with_table(with_table(pairs, first, "w1"), second, "w2")
    # Doubles: the product of two counts of a large corpus exceeds 64 bits.
    ratio = F.col("n").cast("double") * total / (F.col("_n1").cast("double") * F.col("_n2"))
    return scored.select("w1", "w2", "n", F.log2(ratio).alias("pmi"))


def top_pairs(
    docs: DataFrame, n: int = 20, min_freq: int = 5, cross_document: bool = False
) -> DataFrame:
    """The best pairs by PMI, ties by the words."""
    scores = pair_scores(docs, min_freq, cross_document).withColumn("pmi", F.round("pmi", 6))
    return scores.orderBy(F.desc("pmi"), "w1", "w2").limit(n)


def _endings_off(word: Column, endings: Sequence[tuple[str, str]]) -> Column:
    """What a word turns into by each ending that it has."""
    return F.array_compact(F.array(*[
        F.when(word.endswith(ending), F.concat(F.substring(word, F.lit(1), F.length(word) - len(ending)), F.lit(new)))
        for ending, new in endings
    ]))


def lemma_table(
    vocabulary: DataFrame,
    nouns: DataFrame,
    exceptions: DataFrame | None = None,
    endings: Sequence[tuple[str, str]] = NOUN_ENDINGS,
    levels: int | None = None,
) -> DataFrame:
    """``(form, lemma)`` for the words of ``vocabulary(token)`` that have a noun lemma.

    Noun morphology over a lexicon ``nouns(noun)``: the word itself and what its endings turn into
    are looked up, the shortest hit wins, ties by name. While there is none, endings are taken off
    what they turned into, level by level (no more than ``levels``); the first level with a hit counts.
    All levels are made inside the row and looked up by one join. Forms listed in ``exceptions(form, lemma)`` use those
    candidates and no endings. Words without a hit are absent and stay as they are.
    """
    token = F.col("token")
    made = "struct<current: array<string>, found: array<struct<level: int, noun: string>>>"
    at = lambda level, names: F.transform(names, lambda n: F.struct(level.alias("level"), n.alias("noun")))

    def deeper(state: Column, level: Column) -> Column:
        ended = F.array_distinct(F.flatten(F.transform(state["current"], lambda w: _endings_off(w, endings))))
        following = F.struct(ended.alias("current"), F.concat(state["found"], at(level, ended)).alias("found")).cast(made)
        return F.when(F.size(state["current"]) > 0, following).otherwise(state)

    # A word can lose an ending no more often than it has letters. The word and level 1 count alike.
    start = F.struct(F.array(token).alias("current"), at(F.lit(1), F.array(token)).alias("found")).cast(made)
    most = F.greatest(F.length(token), F.lit(1))
    most = most if levels is None else F.least(most, F.lit(levels))
    by_rule = F.aggregate(F.sequence(F.lit(1), most), start, deeper)["found"]
    # Most words have no ending at all.
    ends = F.size(_endings_off(token, endings)) > 0
    by_rule = F.when(ends, by_rule).otherwise(at(F.lit(1), F.array(token)))
    words = vocabulary.select("token").distinct()
    if exceptions is not None:
        listed = exceptions.groupBy(F.col("form").alias("token")).agg(
            F.collect_set("lemma").alias("_listed")
        )
        words = words.join(listed, "token", "left")
        candidates = F.when(
            F.col("_listed").isNotNull(), at(F.lit(1), F.concat(F.array(token), F.col("_listed")))
        ).otherwise(by_rule)
    else:
        candidates = by_rule
    tried = words.select(token.alias("form"), F.explode(candidates).alias("_c")).select("form", "_c.level", "_c.noun")
    found = tried.join(nouns.select("noun").distinct(), "noun", "left_semi")
    return found.groupBy("form").agg(F.min(F.struct("level", F.length("noun"), "noun"))["noun"].alias("lemma"))


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    """``k * ln(p) + (n - k) * ln(1 - p)``, with nothing for what does not occur."""
    part = lambda count, share: F.when(count > 0, count * F.log(F.greatest(share, F.lit(1e-300)))).otherwise(0.0)
    return part(k, p) + part(n - k, 1 - p)


def abbreviations(docs: DataFrame, least: float = 0.3, min_count: int = 2) -> DataFrame:
    """``(word, score)``: words of ``docs(text)`` whose full stop belongs to them, found by counts alone.

    Words are stretches between blanks, lower-cased, with a letter and without marks around them. The score
    is the log-likelihood ratio of the stop following the word more often than the stop follows words
    in general, times the number of inner stops and one, less for longer words and by occurrences
    without the stop: ``ratio * stops * exp(-letters) * letters ** -without``. Counts are combined
    before the shuffle. Pass the words to ``text.word_tokens``.
    """
    stretch = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)[^\s\x1C-\x1F]+"), F.lit(0))).alias("_s")
    plain = F.regexp_replace("_s", r"""^[("'\[{“„«‘]+|[)"'\]},;:!?”»’]+$""", "")
    found = docs.select(stretch).select(plain.alias("_w")).where(F.col("_w").rlike(r"\p{L}") & ~F.col("_w").endswith(".."))
    ends = F.col("_w").endswith(".")
    word = F.when(ends, F.substring("_w", F.lit(1), F.length("_w") - 1)).otherwise(F.col("_w"))
    counts = write_through(
        found.groupBy(word.alias("word")).agg(F.count_if(ends).alias("with_stop"), F.count("*").alias("n")), "stops"
    )
    n = F.col("n").cast("double")
    k = F.col("with_stop").cast("double")
    share = counts.agg(F.sum("with_stop") / F.sum("n")).scalar()
    ratio = 2 * (_log_likelihood(k, n, k / n) - _log_likelihood(k, n, share))
    inner = F.length(F.regexp_replace("word", "[^.]", ""))
    letters = F.greatest(F.length("word") - inner, F.lit(1)).cast("double")
    # A word that the stop follows less often than others is none.
    score = F.when(k / n > share, ratio * (inner + 1) * F.exp(-letters) * F.pow(letters, -(n - k))).otherwise(0.0)
    return counts.where(F.col("with_stop") >= min_count).select("word", score.alias("score")).where(F.col("score") >= least)


def lemmatize(docs: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Replace tokens that have a lemma other than themselves; all others stay.

    Only the changed places travel, grouped per document.
    """
    changes = lemmas.where(F.col("form") != F.col("lemma"))
    changed = (
        with_table(token_places(docs), changes, "form", on=F.col("token"))
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "lemma"))).alias("_changes"))
    )
    # Cut the document at the changed places and put the lemmas between the pieces: linear in size.
    count = F.size("_changes")
    pieces = F.transform(
        "_changes",
        lambda c, i: F.concat(
            F.slice(
                "tokens",
                F.coalesce(F.get("_changes", i - 1)["pos"] + 2, F.lit(1)),
                c["pos"] - F.coalesce(F.get("_changes", i - 1)["pos"] + 1, F.lit(0)),
            ),
            F.array(c["lemma"]),
        ),
    )
    tail_from = F.element_at("_changes", count)["pos"] + 2
    tail = F.slice("tokens", tail_from, F.size("tokens") - tail_from + 1)
    rebuilt = F.concat(F.flatten(pieces), tail)
    return (
        docs.join(changed, "doc_id", "left")
        .withColumn("tokens", F.when(F.col("_changes").isNull(), F.col("tokens")).otherwise(rebuilt))
        .select(*docs.columns)
    )
