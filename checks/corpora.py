"""Corpus statistics: frequencies, pairs, TF-IDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import FREQ, NOT_WS, OCC, STOPS, TOK, documents, joined, r6, stratified_sql, tokenized
from tamis.functions.text import adjacent_pairs
from tamis.operators import corpus, splits, tfidf
from tamis.sources.store import write_through

FOLDS = 3


def a11_token_frequencies(spark, path):
    return corpus.token_frequencies(tokenized(spark, path))


def j1_kept_tokens(spark, path):
    """Places of kept tokens per document: the count of each token looked up by key."""
    docs = tokenized(spark, path)
    freq = corpus.token_frequencies(docs).where(F.col("n") >= 5)
    counted = write_through(tfidf.counted(docs, "tokens", "doc_id"), "counts")
    counts = tfidf.exploded(counted, "doc_id").withColumnRenamed("term", "token")
    kept = corpus.with_table(counts, freq, "token")
    return kept.groupBy("doc_id").agg(
        F.sum("tf").alias("places"), F.sum(F.col("tf") * F.col("n")).alias("corpus_count")
    )


def f6_frequency_cutoff(spark, path):
    return corpus.frequency_cutoff(tokenized(spark, path), 5).select("doc_id", joined())


def f6_frequency_cutoff_train(spark, path):
    docs = tokenized(spark, path)
    folds = splits.stratified_folds(docs, 5).select("doc_id", "fold")
    train = splits.train_part(docs.join(folds, "doc_id"), 0)
    return corpus.frequency_cutoff(docs, 5, train).select("doc_id", joined())


def w5_adjacent_pairs(spark, path):
    pairs = tokenized(spark, path).select("doc_id", adjacent_pairs(F.col("tokens")).alias("p"))
    texts = F.transform("p", lambda p: F.concat_ws(" ", p["w1"], p["w2"]))
    return pairs.select("doc_id", F.size("p").cast("bigint").alias("n"), F.array_join(texts, "|").alias("pairs"))


def w5_pairs_across_documents(spark, path):
    return corpus.pair_counts(tokenized(spark, path), cross_document=True).where(F.col("n") >= 2)


def _scored(df):
    return df.withColumn("pmi", r6(F.col("pmi")))


def a12_pair_scores(spark, path):
    return _scored(corpus.pair_scores(tokenized(spark, path), 5))


def a12_pair_scores_across_documents(spark, path):
    return _scored(corpus.pair_scores(tokenized(spark, path), 2, cross_document=True))


def k3_top_pairs(spark, path):
    return corpus.top_pairs(tokenized(spark, path), 20, 5)


def _terms(spark, path):
    return tfidf.profile_terms(documents(spark, path), longest=1)


def _counts(spark, path):
    return tfidf.term_counts(_terms(spark, path), "terms", "doc_id", "label")


def a13_document_frequencies(spark, path):
    terms = _terms(spark, path)
    n = terms.agg(F.count("*")).scalar()
    df = tfidf.document_frequencies(_counts(spark, path))
    return df.where((F.col("df") >= 2) & (F.col("df") <= 0.9 * n))


def a14_term_frequencies(spark, path):
    sub = F.sum(tfidf.sublinear(F.col("tf")))
    return _counts(spark, path).groupBy("doc_id").agg(
        F.count("*").alias("terms"), F.sum("tf").alias("tf"), r6(sub).alias("sublinear")
    )


def a15_smooth_idf(spark, path):
    n = _terms(spark, path).agg(F.count("*")).scalar()
    df = tfidf.document_frequencies(_counts(spark, path))
    return df.select("term", r6(tfidf.smooth_idf(F.col("df"), n)).alias("idf"))


def a16_unit_weights(spark, path):
    weights = tfidf.corpus_tfidf(_terms(spark, path))
    return weights.groupBy("doc_id").agg(
        r6(F.sum("weight")).alias("total"), r6(F.max("weight")).alias("heaviest")
    )


def a17_mean_tfidf(spark, path):
    return tfidf.mean_tfidf_per_label(_terms(spark, path)).withColumn("weight", r6(F.col("weight")))


def w6_term_ranks(spark, path):
    means = a17_mean_tfidf(spark, path)
    return tfidf.top_of_label(means, 100).withColumn("rank", F.col("rank").cast("bigint"))


def k2_top_terms(spark, path):
    return tfidf.top_terms_per_label(documents(spark, path), 50).withColumn("rank", F.col("rank").cast("bigint"))


def _folded(spark, path):
    """Tokens with folds, written once: fitting and applying both read them."""
    docs = tokenized(spark, path)
    folds = splits.stratified_folds(documents(spark, path), FOLDS).select("doc_id", "fold")
    return write_through(docs.join(folds, "doc_id"), "folded")


def j3_fold_vocabulary(spark, path):
    docs = _folded(spark, path)
    counts = tfidf.term_counts(docs, "tokens", "doc_id", "fold")
    fitted = tfidf.fold_vocabulary(counts, docs, FOLDS)
    fits = fitted.select("term", F.posexplode_outer("fits").alias("fold", "f")).where(F.col("f").isNotNull())
    return fits.select(
        F.col("fold").cast("bigint").alias("fold"), "term", F.col("f.df").alias("df"), r6(F.col("f.idf")).alias("idf")
    )


def m1_fold_tfidf(spark, path):
    weights = tfidf.fold_tfidf(_folded(spark, path), FOLDS)
    return weights.groupBy(F.col("model_fold").cast("bigint").alias("fold"), "split", "doc_id").agg(
        F.count("*").alias("terms"), r6(F.sum("weight")).alias("total"), r6(F.max("weight")).alias("heaviest")
    )


def a14_term_rows(spark, path):
    """Every document and term."""
    return _counts(spark, path).select("doc_id", "term", F.col("tf").cast("bigint").alias("tf"), r6(tfidf.sublinear(F.col("tf"))).alias("sublinear"))


def a16_weight_rows(spark, path):
    """Every document and term, with the document's label."""
    return tfidf.corpus_tfidf(_terms(spark, path)).select("doc_id", "label", "term", r6(F.col("weight")).alias("weight"))


def m1_weight_rows(spark, path):
    """Every fold, document and term."""
    weights = tfidf.fold_tfidf(_folded(spark, path), FOLDS)
    return weights.select(F.col("model_fold").cast("bigint").alias("fold"), "split", "doc_id", "term", r6(F.col("weight")).alias("weight"))


def t3_abbreviations(spark, path):
    found = corpus.abbreviations(documents(spark, path), least=0.0, min_count=1)
    return found.select("word", r6(F.col("score")).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        a14_term_rows,
        a16_weight_rows,
        m1_weight_rows,
        t3_abbreviations,
        k2_top_terms,
        a11_token_frequencies,
        a12_pair_scores,
        a12_pair_scores_across_documents,
        a13_document_frequencies,
        a14_term_frequencies,
        a15_smooth_idf,
        a16_unit_weights,
        a17_mean_tfidf,
        f6_frequency_cutoff,
        f6_frequency_cutoff_train,
        j1_kept_tokens,
        j3_fold_vocabulary,
        k3_top_pairs,
        m1_fold_tfidf,
        w5_adjacent_pairs,
        w5_pairs_across_documents,
        w6_term_ranks,
    )
}

_CUT = (
    "kept AS (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS tokens FROM occ "
    "WHERE token IN (SELECT token FROM freq WHERE n >= 5) GROUP BY doc_id) "
    "SELECT tok.doc_id, coalesce(kept.tokens, '') AS tokens FROM tok LEFT JOIN kept USING (doc_id)"
)
_NEXT = (
    "adj AS (SELECT doc_id, pos, token AS w1, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM occ)"
)
_NEXT_ACROSS = "adj AS (SELECT doc_id, pos, token AS w1, lead(token) OVER (ORDER BY doc_id, pos) AS w2 FROM occ)"
_PAIRS = "pairs AS (SELECT w1, w2, count(*) AS n FROM adj WHERE w2 IS NOT NULL GROUP BY w1, w2)"
_PMI = (
    "scored AS (SELECT w1, w2, p.n, round(log2(CAST(p.n AS DOUBLE) * (SELECT sum(n) FROM freq) / "
    "(CAST(a.n AS DOUBLE) * b.n)), 6) + 0.0 AS pmi "
    "FROM pairs p JOIN freq a ON a.token = w1 JOIN freq b ON b.token = w2 WHERE p.n >= {0})"
)
_UNIGRAMS = (
    f"words AS (SELECT doc_id, label, list_filter(tokens, lambda t: t NOT IN ({STOPS})) AS tokens FROM tok), "
    "terms AS (SELECT doc_id, label, unnest(tokens) AS term FROM words)"
)
_BIGRAMS = (
    f"words AS (SELECT doc_id, label, list_filter(tokens, lambda t: t NOT IN ({STOPS})) AS tokens FROM tok), "
    "placed AS (SELECT doc_id, label, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos FROM words), "
    "terms AS (SELECT doc_id, label, term FROM placed UNION ALL SELECT doc_id, label, gram FROM (SELECT doc_id, label, "
    "term || ' ' || lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS gram FROM placed) WHERE gram IS NOT NULL)"
)
_WEIGHTS = (
    "tf AS (SELECT doc_id, label, term, count(*) AS tf FROM terms GROUP BY doc_id, label, term), "
    "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
    "idf AS (SELECT term, df, ln((1.0 + (SELECT count(*) FROM tok)) / (1.0 + df)) + 1 AS idf FROM df)"
)
_UNIT = (
    "raw AS (SELECT doc_id, label, term, tf * idf AS w FROM tf JOIN idf USING (term)), "
    "unit AS (SELECT doc_id, label, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw), "
    "size AS (SELECT label, count(*) AS docs FROM tok GROUP BY label), "
    "means AS (SELECT label, term, round(sum(w) / max(docs), 6) AS weight FROM unit JOIN size USING (label) GROUP BY label, term), "
    "ranked AS (SELECT label, term, weight, row_number() OVER (PARTITION BY label ORDER BY weight DESC, term) AS rank FROM means)"
)
_UNI = f"WITH {TOK}, {_UNIGRAMS}, {_WEIGHTS}"
_FOLDED = f"{TOK}, {stratified_sql('folded', 'tok', FOLDS)}"
_FITTED = (
    "counts AS (SELECT t.doc_id, f.fold, u.token AS term, count(*) AS tf FROM tok t JOIN folded f USING (doc_id), "
    "unnest(t.tokens) AS u(token) GROUP BY t.doc_id, f.fold, u.token), "
    f"models AS (SELECT i AS m FROM range(0, {FOLDS}) AS r(i)), "
    "n AS (SELECT m, count(*) AS n FROM models JOIN folded ON fold <> m GROUP BY m), "
    "fit AS (SELECT m, term, count(*) AS df, ln((1.0 + max(n)) / (1.0 + count(*))) + 1 AS idf, max(n) AS n "
    "FROM n JOIN counts ON fold <> m GROUP BY m, term HAVING count(*) >= 2 AND count(*) <= 0.9 * max(n))"
)
_WEIGHED_FOLDS = (
    f"WITH {_FOLDED}, {_FITTED}, w AS (SELECT fit.m, CASE WHEN c.fold = fit.m THEN 'val' ELSE 'train' END AS split, "
    "c.doc_id, term, (1 + ln(c.tf)) * fit.idf AS w FROM counts c JOIN fit USING (term)) "
    "SELECT m AS fold, split, doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY m, doc_id)), 6) AS weight FROM w"
)
_MARKS_BEFORE, _MARKS_BEHIND = r"""^[("''\[{“„«‘]+""", r"""[)"''\]},;:!?”»’]+$"""
_ABBREVIATIONS = (
    f"WITH stretches AS (SELECT unnest(regexp_extract_all(lower(text), '{NOT_WS}+')) AS s FROM documents), "
    f"plain AS (SELECT regexp_replace(regexp_replace(s, '{_MARKS_BEFORE}', ''), '{_MARKS_BEHIND}', '') AS w FROM stretches), "
    r"words AS (SELECT CASE WHEN ends_with(w, '.') THEN left(w, length(w) - 1) ELSE w END AS word, ends_with(w, '.') AS stop "
    r"FROM plain WHERE regexp_matches(w, '\pL') AND NOT ends_with(w, '..')), "
    "counts AS (SELECT word, CAST(count(*) FILTER (stop) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM words GROUP BY word), "
    "shares AS (SELECT *, (SELECT sum(k) / sum(n) FROM counts) AS p, length(word) - length(replace(word, '.', '')) AS inner_stops FROM counts), "
    "scored AS (SELECT word, k, n, p, inner_stops, CAST(greatest(length(word) - inner_stops, 1) AS DOUBLE) AS letters, "
    "2 * ((CASE WHEN k > 0 THEN k * ln(greatest(k / n, 1e-300)) ELSE 0 END + CASE WHEN n > k THEN (n - k) * ln(greatest(1 - k / n, 1e-300)) ELSE 0 END) "
    "- (CASE WHEN k > 0 THEN k * ln(greatest(p, 1e-300)) ELSE 0 END + CASE WHEN n > k THEN (n - k) * ln(greatest(1 - p, 1e-300)) ELSE 0 END)) AS ratio FROM shares) "
    "SELECT word, round(CASE WHEN k / n > p THEN ratio * (inner_stops + 1) * exp(-letters) * pow(letters, -(n - k)) ELSE 0 END, 6) + 0.0 AS score "
    "FROM scored WHERE k >= 1"
)
SQL = {
    "a14_term_rows": f"{_UNI} SELECT doc_id, term, tf, round(1 + ln(tf), 6) AS sublinear FROM tf",
    "a16_weight_rows": f"{_UNI}, {_UNIT} SELECT doc_id, label, term, round(w, 6) AS weight FROM unit",
    "m1_weight_rows": _WEIGHED_FOLDS,
    "t3_abbreviations": _ABBREVIATIONS,
    "k2_top_terms": f"WITH {TOK}, {_BIGRAMS}, {_WEIGHTS}, {_UNIT} SELECT label, term, weight, rank FROM ranked WHERE rank <= 50",
    "a11_token_frequencies": f"WITH {TOK}, {OCC}, {FREQ} SELECT token, n FROM freq",
    "a12_pair_scores": f"WITH {TOK}, {OCC}, {FREQ}, {_NEXT}, {_PAIRS}, {_PMI.format(5)} SELECT w1, w2, n, pmi FROM scored",
    "a12_pair_scores_across_documents": f"WITH {TOK}, {OCC}, {FREQ}, {_NEXT_ACROSS}, {_PAIRS}, {_PMI.format(2)} "
    "SELECT w1, w2, n, pmi FROM scored",
    "a13_document_frequencies": f"{_UNI} SELECT term, df FROM df WHERE df >= 2 AND df <= 0.9 * (SELECT count(*) FROM tok)",
    "a14_term_frequencies": f"{_UNI} SELECT doc_id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS tf, "
    "round(sum(1 + ln(tf)), 6) AS sublinear FROM tf GROUP BY doc_id",
    "a15_smooth_idf": f"{_UNI} SELECT term, round(idf, 6) AS idf FROM idf",
    "a16_unit_weights": f"{_UNI}, {_UNIT} SELECT doc_id, round(sum(w), 6) AS total, round(max(w), 6) AS heaviest FROM unit GROUP BY doc_id",
    "a17_mean_tfidf": f"{_UNI}, {_UNIT} SELECT label, term, weight FROM means",
    "f6_frequency_cutoff": f"WITH {TOK}, {OCC}, {FREQ}, {_CUT}",
    "f6_frequency_cutoff_train": f"WITH {TOK}, {stratified_sql('folded', 'tok', 5)}, {OCC}, "
    "freq AS (SELECT token, count(*) AS n FROM occ JOIN folded USING (doc_id) WHERE fold <> 0 GROUP BY token), " + _CUT,
    "j1_kept_tokens": f"WITH {TOK}, {OCC}, {FREQ} SELECT doc_id, count(*) AS places, CAST(sum(n) AS BIGINT) AS corpus_count "
    "FROM occ JOIN freq USING (token) WHERE n >= 5 GROUP BY doc_id",
    "j3_fold_vocabulary": f"WITH {_FOLDED}, {_FITTED} SELECT m AS fold, term, df, round(idf, 6) AS idf FROM fit",
    "k3_top_pairs": f"WITH {TOK}, {OCC}, {FREQ}, {_NEXT}, {_PAIRS}, {_PMI.format(5)} SELECT w1, w2, n, pmi FROM scored "
    "ORDER BY pmi DESC, w1, w2 LIMIT 20",
    "m1_fold_tfidf": f"WITH {_FOLDED}, {_FITTED}, w AS (SELECT fit.m, CASE WHEN c.fold = fit.m THEN 'val' ELSE 'train' END AS split, "
    "c.doc_id, (1 + ln(c.tf)) * fit.idf AS w FROM counts c JOIN fit USING (term)), "
    "u AS (SELECT m, split, doc_id, w / sqrt(sum(w * w) OVER (PARTITION BY m, doc_id)) AS w FROM w) "
    "SELECT m AS fold, split, doc_id, count(*) AS terms, round(sum(w), 6) AS total, round(max(w), 6) AS heaviest "
    "FROM u GROUP BY m, split, doc_id",
    "w5_adjacent_pairs": f"WITH {TOK}, {OCC}, {_NEXT}, a AS (SELECT doc_id, count(*) AS n, string_agg(w1 || ' ' || w2, '|' ORDER BY pos) AS pairs "
    "FROM adj WHERE w2 IS NOT NULL GROUP BY doc_id) "
    "SELECT tok.doc_id, coalesce(n, 0) AS n, coalesce(pairs, '') AS pairs FROM tok LEFT JOIN a USING (doc_id)",
    "w5_pairs_across_documents": f"WITH {TOK}, {OCC}, {_NEXT_ACROSS}, {_PAIRS} SELECT w1, w2, n FROM pairs WHERE n >= 2",
    "w6_term_ranks": f"{_UNI}, {_UNIT} SELECT label, term, weight, rank FROM ranked WHERE rank <= 100",
}
