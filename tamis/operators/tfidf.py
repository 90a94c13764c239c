"""TF-IDF as long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.text import drop_words, ngrams, profile_tokens
from tamis.functions.wordlists import STOP_WORDS
from tamis.operators.corpus import with_table
from tamis.operators.ranking import row_number
from tamis.sources.store import write_through


def counted(docs: DataFrame, terms: str, *keep: str) -> DataFrame:
    """``(keep..., counts)`` with one row per document, ``counts`` its terms as ``(term, tf)``.

    Terms are counted inside the row, as runs of the sorted array, so counting needs no shuffle. What
    reads the counts several times should write them: sorting costs more than reading.
    """
    counts_sorted = docs.select(*keep, F.sort_array(terms).alias("_sorted"))
    starts = F.filter(
        F.transform(
            "_sorted", lambda t, i: F.when((i == 0) | (t != F.get("_sorted", i - 1)), i)
        ),
        lambda i: i.isNotNull(),
    )
    runs = F.transform(
        "_starts",
        lambda s, j: F.struct(
            F.get("_sorted", s).alias("term"),
            (F.coalesce(F.get("_starts", j + 1), F.size("_sorted")) - s).alias("tf"),
        ),
    )
    return counts_sorted.withColumn("_starts", starts).select(*keep, runs.alias("counts"))


def exploded(counts: DataFrame, *keep: str) -> DataFrame:
    """``(keep..., term, tf)`` with one row per document and term, from ``counted`` documents."""
    each = counts.select(*keep, F.explode_outer("counts").alias("_run"))
    return each.where(F.col("_run").isNotNull()).select(*keep, "_run.term", "_run.tf")


def term_counts(docs: DataFrame, terms: str, *keep: str) -> DataFrame:
    """``(keep..., term, tf)``: a term contributes at most one row per document from here on."""
    return exploded(counted(docs, terms, *keep), *keep)


def document_frequencies(counts: DataFrame) -> DataFrame:
    """``(term, df)`` from term counts, combined before the shuffle."""
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def smooth_idf(df: Column, n: Column) -> Column:
    return F.log((n + 1.0) / (df + 1.0)) + 1.0


def sublinear(tf: Column) -> Column:
    return F.log(tf) + 1.0


def unit_weights(weighted: DataFrame, *document: str) -> DataFrame:
    """Scale ``weight`` to unit length per document."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(*document)))
    return weighted.withColumn("weight", F.col("weight") / norm)


def profile_terms(
    docs: DataFrame, stop_words: Sequence[str] = STOP_WORDS, longest: int = 2
) -> DataFrame:
    """``(doc_id, label, terms)``: word tokens and n-grams, stop words gone before n-grams form."""
    words = docs.select(
        "doc_id", "label", drop_words(profile_tokens(F.col("text")), stop_words).alias("_words")
    )
    return words.select("doc_id", "label", ngrams(F.col("_words"), 1, longest).alias("terms"))


def corpus_tfidf(terms: DataFrame) -> DataFrame:
    """``(doc_id, label, term, weight)``: raw counts, smoothed idf, unit length; whole corpus.

    Terms of a single document are the bulk of any n-gram vocabulary and share one idf, so only
    terms of two documents or more are joined; for all others the idf follows from their absence.
    """
    held = write_through(counted(terms, "terms", "doc_id", "label"), "counts")
    counts = exploded(held, "doc_id", "label")
    n = held.agg(F.count("*")).scalar()
    shared = document_frequencies(counts).where(F.col("df") > 1)
    idf = smooth_idf(F.coalesce("df", F.lit(1)), n)
    weighted = counts.join(shared, "term", "left").select(
        "doc_id", "label", "term", (F.col("tf") * idf).alias("weight")
    )
    return unit_weights(weighted, "doc_id")


# Terms that make up at least 1/_FREQUENT of the rows of documents and shared terms: there can be no more than
# _FREQUENT of them, and in a vocabulary as texts have it there are some twentieths of that.
_FREQUENT = 1_000_000
# Such a bound for the terms that the least weight of a label's top is found by.
_SEEDS = 20_000


def _shared_terms(terms: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """The counts of the documents and the document frequencies of terms of two documents or more, both written,
    and the idf by a column ``df``, null for terms of a single document: those are the bulk of any n-gram
    vocabulary and share one."""
    held = write_through(counted(terms, "terms", "doc_id", "label"), "counts", compression="zstd")
    n = held.agg(F.count("*")).scalar()
    shared = write_through(document_frequencies(exploded(held)).where(F.col("df") > 1), "shared-terms")
    return held, shared, smooth_idf(F.coalesce("df", F.lit(1)), n)


def _most_frequent(shared: DataFrame, share: int) -> DataFrame:
    return shared.where(F.col("df") >= shared.agg(F.sum("df") / share).scalar())


def _lengths(held: DataFrame, shared: DataFrame, idf: Column) -> DataFrame:
    """``(doc_id, _norm)``: frequent terms' idfs are looked up in a bounded broadcast, the rows of the other terms
    meet theirs in a shuffle, and what leaves both are sums of squares."""
    split = exploded(held, "doc_id").join(F.broadcast(_most_frequent(shared, _FREQUENT)), "term", "left")
    rest = split.where(F.col("df").isNull()).drop("df").join(shared, "term", "left")
    square = F.pow(F.col("tf") * idf, F.lit(2)).alias("_square")
    squares = split.where(F.col("df").isNotNull()).select("doc_id", square).unionByName(rest.select("doc_id", square))
    return squares.groupBy("doc_id").agg(F.sqrt(F.sum("_square")).alias("_norm"))


def _posts(held: DataFrame) -> DataFrame:
    return held.groupBy("label").agg(F.count("*").alias("_posts"))


def mean_tfidf_per_label(terms: DataFrame) -> DataFrame:
    """``(label, term, weight)``: mean over all documents of the label, absent terms count as 0.

    A term's idf is one factor, so documents only need their lengths: those are sums of partial sums,
    with frequent terms' idfs looked up in a bounded broadcast and only the other terms shuffled.
    Documents, one row each, get their length, and what is shuffled then are sums per label and term.
    """
    held, shared, idf = _shared_terms(terms)
    posts = _posts(held)
    normed = held.join(_lengths(held, shared, idf), "doc_id")
    parts = exploded(normed, "label", "_norm").groupBy("label", "term")
    sums = parts.agg(F.sum(F.col("tf") / F.col("_norm")).alias("_sum"))
    return sums.join(shared, "term", "left").join(posts, sums["label"].eqNullSafe(posts["label"])).select(
        sums["label"], "term", (F.col("_sum") * idf / F.col("_posts")).alias("weight")
    )


def top_of_label(weights: DataFrame, n: int) -> DataFrame:
    """The ``n`` heaviest terms of each label with their rank, ties by term.

    The rank filter cuts each partition to ``n`` rows per label before the shuffle.
    """
    by_weight = Window.partitionBy("label").orderBy(F.desc("weight"), "term")
    return weights.withColumn("rank", F.row_number().over(by_weight)).where(F.col("rank") <= n)


def top_terms_per_label(
    docs: DataFrame, n: int = 50, stop_words: Sequence[str] = STOP_WORDS, longest: int = 2
) -> DataFrame:
    """Top TF-IDF words and bigrams of each label, by mean weights (``mean_tfidf_per_label``) of six digits.

    In no document a term's weight exceeds 1, so its mean is at most its document frequency by the posts
    of the label. What the most frequent terms weigh gives a least weight of each label's top, and
    only terms frequent enough for it are summed up: for most of the vocabulary document frequencies are all that is
    shuffled. Labels of which the frequent terms fill no top have all their terms summed up.
    """
    held, shared, idf = _shared_terms(profile_terms(docs, stop_words, longest))
    posts = _posts(held)
    lengths = write_through(_lengths(held, shared, idf), "lengths")

    def weights(rows: DataFrame) -> DataFrame:
        parts = rows.join(lengths, "doc_id").groupBy("label", "term")
        sums = parts.agg(F.sum(F.col("tf") / F.col("_norm")).alias("_sum"), F.max("df").alias("df"))
        return sums.join(posts, sums["label"].eqNullSafe(posts["label"])).select(
            sums["label"], "term", "_posts", F.round(F.col("_sum") * idf / F.col("_posts"), 6).alias("weight")
        )

    seeds = exploded(held, "doc_id", "label").join(F.broadcast(_most_frequent(shared, _SEEDS)), "term")
    tops = top_of_label(weights(seeds), n).groupBy("label")
    known = tops.agg(F.count("*").alias("_n"), F.min("weight").alias("_least"), F.first("_posts").alias("_posts"))
    # What is below by more than the rounding is below after it. Written, as candidates are: what is small is broadcast.
    needed = F.when(F.col("_n") >= n, (F.col("_least") - 1e-6) * F.col("_posts"))
    needs = write_through(known.select("label", needed.alias("_need")).where(F.col("_need") > 1), "needs")
    candidates = shared.where(F.col("df") >= needs.agg(F.min("_need")).scalar())
    candidates = write_through(candidates, "candidates")
    need = needs.withColumnRenamed("label", "_label")
    of_label = F.col("label").eqNullSafe(F.col("_label"))
    rows = exploded(held.join(need, of_label).drop("_label"), "doc_id", "label", "_need")
    rows = rows.join(candidates, "term").where(F.col("df") >= F.col("_need")).drop("_need")
    if not posts.join(need, of_label, "left_anti").isEmpty():
        others = held.join(need, of_label, "left_anti")
        rows = rows.unionByName(exploded(others, "doc_id", "label").join(shared, "term", "left"))
    return top_of_label(weights(rows).drop("_posts"), n)


def _fitted_terms(counts: DataFrame, docs: DataFrame, k: int, min_df: int, max_df: float) -> DataFrame:
    """``(term, _df, fits)`` of every term, see ``fold_vocabulary``; ``_df`` counts all documents."""
    sizes = docs.groupBy("fold").agg(F.count("*").alias("_n"))
    size_of = sizes.agg(F.map_from_entries(F.collect_list(F.struct("fold", "_n")))).scalar()
    total = sizes.agg(F.sum("_n")).scalar()
    per_fold = counts.groupBy("term").agg(
        F.count("*").alias("_df"), *[F.count_if(F.col("fold") == f).alias(f"_in{f}") for f in range(k)]
    )

    def fitted(f: int) -> Column:
        df = F.col("_df") - F.col(f"_in{f}")
        n = total - F.coalesce(F.try_element_at(size_of, F.lit(f)), F.lit(0))
        kept = (df >= min_df) & (df <= max_df * n)
        return F.when(kept, F.struct(df.alias("df"), smooth_idf(df, n).alias("idf")))

    return per_fold.select("term", "_df", F.array(*[fitted(f) for f in range(k)]).alias("fits"))


def _is_kept(fits: str) -> Column:
    return F.exists(fits, lambda fit: fit.isNotNull())


def fold_vocabulary(
    counts: DataFrame, docs: DataFrame, k: int, min_df: int = 2, max_df: float = 0.9
) -> DataFrame:
    """``(term, fits)``: document frequency and idf of each term on the training rows of every fold.

    ``fits`` has one entry ``(df, idf)`` per fold, null where the fold does not keep the term. One
    pass counts documents per term and fold; what a fold trains on is the total minus its own count.
    """
    return _fitted_terms(counts, docs, k, min_df, max_df).select("term", "fits").where(_is_kept("fits"))


def fold_weights(
    docs: DataFrame,
    k: int,
    min_df: int = 2,
    max_df: float = 0.9,
    longest: int = 1,
    vocabulary: DataFrame | None = None,
) -> DataFrame:
    """``(doc_id, fold, term, raw)``: one row per document and term, whatever the number of folds.

    ``raw`` holds, per fold, the sublinear count times the idf fitted on that fold's train rows, null
    where the fold does not keep the term. All idfs arrive with one join by term. Further columns of
    ``vocabulary`` are passed on.
    """
    grams = docs.select("doc_id", "fold", ngrams(F.col("tokens"), 1, longest).alias("terms"))
    counts = exploded(write_through(counted(grams, "terms", "doc_id", "fold"), "counts"), "doc_id", "fold")
    if vocabulary is None:
        vocabulary = fold_vocabulary(counts, docs, k, min_df, max_df)
    extra = [c for c in vocabulary.columns if c not in ("term", "fits")]
    raw = [sublinear(F.col("tf")) * F.get("fits", F.lit(f))["idf"] for f in range(k)]
    return with_table(counts, vocabulary, "term").select(
        "doc_id", "fold", "term", *extra, F.array(*raw).alias("raw")
    )


def fold_tfidf(
    docs: DataFrame, k: int, min_df: int = 2, max_df: float = 0.9, longest: int = 1
) -> DataFrame:
    """``(model_fold, split, doc_id, term, weight)``: unit length per fold and document.

    Rows of documents and terms are made twice from the written counts, for the lengths of all folds and for the
    weights, and frequent terms' idfs are looked up in a bounded broadcast: what is shuffled are documents, one row
    each, and the rows of the other terms. Rows multiply by ``k`` at the end.
    """
    grams = docs.select("doc_id", "fold", ngrams(F.col("tokens"), 1, longest).alias("terms"))
    held = write_through(counted(grams, "terms", "doc_id", "fold"), "counts", compression="zstd")
    terms = _fitted_terms(exploded(held, "fold"), docs, k, min_df, max_df).where(F.col("_df") >= min_df)
    idfs = F.transform("fits", lambda fit: fit["idf"]).alias("_idfs")
    terms = write_through(terms.select("term", F.col("_df").alias("df"), idfs), "fold-terms", compression="zstd")
    # Also those that are too frequent for every fold: else they would be shuffled, to no end.
    often = F.broadcast(_most_frequent(terms, _FREQUENT).drop("df"))
    kept = terms.where(_is_kept("_idfs")).drop("df")

    def weighted(rows: DataFrame) -> DataFrame:
        """With ``_raw``: per fold the sublinear count times the idf, null where the fold does not keep the term."""
        split = rows.join(often, "term", "left")
        rest = split.where(F.col("_idfs").isNull()).drop("_idfs").join(kept, "term")
        every = split.where(_is_kept("_idfs")).unionByName(rest)
        raw = F.array(*[sublinear(F.col("tf")) * F.get("_idfs", F.lit(f)) for f in range(k)])
        return every.withColumn("_raw", raw).drop("_idfs", "tf")

    entry = [F.get("_raw", F.lit(f)) for f in range(k)]
    squares = weighted(exploded(held, "doc_id")).select("doc_id", *[(e * e).alias(f"_s{f}") for f, e in enumerate(entry)])
    lengths = squares.groupBy(F.col("doc_id").alias("_doc")).agg(F.array(*[F.sqrt(F.sum(f"_s{f}")) for f in range(k)]).alias("_norms"))
    normed = held.join(lengths, F.col("doc_id").eqNullSafe(F.col("_doc"))).drop("_doc")
    each = weighted(exploded(normed, "doc_id", "fold", "_norms")).select(
        "doc_id", "fold", "term", "_norms", F.posexplode_outer("_raw").alias("model_fold", "_raw")
    ).where(F.col("_raw").isNotNull())
    return each.select(
        "model_fold",
        F.when(F.col("fold") == F.col("model_fold"), "val").otherwise("train").alias("split"),
        "doc_id",
        "term",
        (F.col("_raw") / F.get("_norms", F.col("model_fold"))).alias("weight"),
    )


def indexed_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """Number the terms 0, 1, 2 ... for vectors: by hash bucket, then by term, without a global sort.

    Vectors index by 32 bits: the cast fails, as the session's ANSI mode has it, beyond 2**31 terms.
    """
    bucketed = vocabulary.withColumn("_bucket", F.pmod(F.xxhash64("term"), F.lit(4096)))
    numbered = row_number(
        bucketed, "idx", [], ["_bucket"], [F.col("_bucket")], [F.col("term")]
    )
    return numbered.drop("_bucket").withColumn("idx", F.col("idx").cast("int"))
