"""The whole experiment: profile, prepare, mask, split, train, score."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.text import clean_tokens, model_text, text_pair
from tamis.functions.wordlists import CONTRACTIONS, STOP_WORDS
from tamis.operators import corpus, masking, metrics, models, profile, splits, tfidf
from tamis.operators.distribution import box_summary, describe, histogram, percentiles
from tamis.sources import csv_blocks, store
from tamis.sources.roles import ColumnRoles, check_options


@dataclass(frozen=True)
class Preparation:
    """Settings of the cleaning chain."""

    posts_per_author: int | None = 97
    min_freq: int = 5
    folds: int = 5
    seed: int = 42
    contractions: Sequence[tuple[str, str]] = tuple(CONTRACTIONS)
    stop_words: Sequence[str] | None = tuple(STOP_WORDS)
    mask_level: int = 0
    mask_rules: str = "strict"
    bigrams: bool = False
    abbreviations: Sequence[str] = ()


def profile_tables(docs: DataFrame, top_n: int | None = 50) -> dict[str, DataFrame]:
    """Every profile as a lazy table; only those that are read are computed."""
    freq = profile.post_count_frequencies(docs)
    tables = {
        "label_distribution": profile.label_distribution(docs),
        "length_statistics": profile.describe_lengths(docs),
        "word_count_ecdf": profile.word_count_ecdf(docs),
        "totals": profile.totals(docs),
        "post_count_statistics": describe(freq),
        "post_count_percentiles": percentiles(freq, 0.90, 0.95, 0.99),
        "post_count_histogram": histogram(freq),
        "post_count_box": box_summary(freq),
        "most_active_authors": profile.most_active_authors(docs),
    }
    if top_n is not None:
        tables["top_terms"] = tfidf.top_terms_per_label(docs, top_n)
    return tables


def clean(docs: DataFrame, settings: Preparation = Preparation()) -> DataFrame:
    """Cap and tokenise: ``(doc_id, author, label, tokens)``; one narrow projection over the text."""
    if settings.posts_per_author is not None:
        docs = splits.cap_per_author(docs, settings.posts_per_author)
    tokens = clean_tokens(F.col("text"), settings.contractions, settings.stop_words, settings.abbreviations)
    return docs.select("doc_id", "author", "label", tokens.alias("tokens"))


def prepare(
    docs: DataFrame,
    settings: Preparation = Preparation(),
    lemmas: DataFrame | None = None,
    places: DataFrame | None = None,
) -> DataFrame:
    """``(doc_id, author, label, tokens, fold)``: capped, cleaned, cut off, masked, folds assigned.

    The cleaned tokens are written once, because the cut-off reads them twice and cleaning is the
    dear part. Masks work token by token, so one pass before the folds serves all of them.
    """
    tokens = store.write_through(clean(docs, settings), "cleaned")
    if lemmas is not None:
        tokens = store.write_through(corpus.lemmatize(tokens, lemmas), "lemmatized")
    cut = corpus.frequency_cutoff(tokens, settings.min_freq)
    masked = masking.mask(cut, settings.mask_level, places, settings.mask_rules)
    folds = splits.balanced_author_folds(tokens, settings.folds, settings.seed)
    return splits.with_author_folds(masked, folds).select(
        "doc_id", "author", "label", "tokens", "fold"
    )


def prepare_model_inputs(
    df: DataFrame, folds: int = 5, seed: int = 42, pair_column: str | None = None
) -> DataFrame:
    """``(doc_id, label, input, fold)`` for an uncased model outside Spark, with stratified folds.

    ``input`` is a string, or a pair of strings when ``pair_column`` is given. Score what the model
    predicts with ``metrics.evaluate``.
    """
    cleaned = model_text(F.col("text"))
    made = text_pair(cleaned, model_text(F.col(pair_column))) if pair_column else cleaned
    assigned = splits.stratified_folds(df, folds, seed).select("doc_id", "fold")
    return df.select("doc_id", "label", made.alias("input")).join(assigned, "doc_id")


def classes_for_training(prepared: DataFrame) -> list[str]:
    """The labels in alphabetical order, one binary model each; rows without a label are an error."""
    found = [r.label for r in prepared.select("label").distinct().collect()]
    if None in found:
        raise ValueError("rows without a label cannot be trained on: drop them before")
    return sorted(found)


@dataclass(frozen=True)
class Results:
    predictions: DataFrame
    confusion: DataFrame
    report: DataFrame
    metrics: DataFrame
    summary: DataFrame
    mean_confusion: DataFrame
    best: DataFrame
    features: models.FoldFeatures
    fitted: dict
    top_features: DataFrame

    def projection(self) -> tuple[DataFrame, DataFrame]:
        """The two-dimensional view of the last fold's validation rows, and its share of variance."""
        return models.project_fold(self.features, self.features.folds - 1, own=True)


def train_and_score(
    prepared: DataFrame,
    grid: Sequence[float],
    classes: Sequence[str],
    max_iter: int = models.MAX_ITER,
    longest: int = 1,
    top_n: int = 15,
) -> Results:
    """Linear SVM for every ``C`` and fold, with all metric tables.

    ``longest`` is the longest n-gram among the features. Top features and the two-dimensional view
    are those of the last fold, the features for every ``C``.
    """
    folds = prepared.agg(F.max("fold")).first()[0] + 1
    features = models.fold_features(prepared, folds, longest=longest)
    predicted, fitted = models.grid_predictions(features, classes, grid, max_iter)
    predictions = store.write_through(predicted, "predictions")
    confusion = metrics.confusion_counts(predictions, list(classes))
    scores = metrics.long_metrics(metrics.fold_scores(confusion))
    return Results(
        predictions=predictions,
        confusion=confusion,
        report=metrics.class_report(confusion),
        metrics=scores,
        summary=metrics.summarize(scores),
        mean_confusion=metrics.mean_confusion(confusion),
        best=metrics.best_config(scores, [models.config_name(c) for c in grid]),
        features=features,
        fitted=fitted,
        top_features=reduce(
            DataFrame.unionByName,
            [
                models.top_features(features, fitted[name, folds - 1], top_n).select(F.lit(name).alias("config"), "*")
                for name in map(models.config_name, grid)
            ],
        ),
    )


def run(
    spark: SparkSession,
    options: Mapping,
    prepared_path: str | None = None,
    metrics_path: str | None = None,
    lemmas: DataFrame | None = None,
    places: DataFrame | None = None,
    max_iter: int = models.MAX_ITER,
    settings: Preparation | None = None,
    file_format: str | None = None,
    multi_line: bool = True,
    pair_column: str | None = None,
    longest: int = 1,
) -> dict:
    """Run an experiment from an options mapping (sections as in ``roles.REQUIRED_OPTIONS``).

    ``load_dataset`` reuses the table at ``prepared_path``; otherwise it is written there when given.
    Returns ``profile`` tables, the ``prepared`` table, and ``results`` when modelling is enabled
    (for model type BERT: ``model_inputs`` with stratified folds, to be trained elsewhere).

    ``settings`` has what the options do not name (cut-off, cap, stop words; ``bigrams`` adds the best pairs
    of words of the prepared corpus by PMI); folds and mask
    level come from the options. ``file_format`` is ``csv`` or ``parquet``, by default as the path
    says; ``multi_line=False`` spares a CSV without line breaks in its texts the pass that looks for them. ``pair_column``
    makes text pairs for BERT, ``longest`` n-gram features for the SVM.
    """
    check_options(options)
    if options["load_dataset"] and prepared_path is None:
        raise ValueError("load_dataset needs prepared_path")
    roles = ColumnRoles.from_options(options)
    described, modelling = options["descriptive_statistics"], options["modeling"]
    masked, folds = options["masking"], options["preprocessing"]["number_of_folds"]
    kind = modelling["model_type"]
    if kind not in ("SVM", "BERT"):
        raise ValueError(f"unknown model type: {kind}; choose SVM or BERT")

    columns = [c for c in (roles.doc_id, roles.author, roles.label, roles.text, pair_column) if c]
    path = options["data"]["file_path"]
    if (file_format or ("csv" if re.search(r"\.csv(\.\w+)?/?$", path) else "parquet")) == "csv":
        header = spark.read.options(header=True).csv(path).limit(0).columns
        schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
        numbered = roles.doc_id is None
        raw = csv_blocks.read_records(spark, path, schema) if numbered else store.read_posts(spark, path, schema, multi_line)
    elif roles.doc_id is None:
        raw = csv_blocks.parquet_with_positions(spark, path)
    else:
        raw = spark.read.parquet(path)
    columns.append(csv_blocks.POSITION)
    docs = roles.bind(raw.select(*[c for c in raw.columns if c in columns]), *([pair_column] if pair_column else []))
    if roles.doc_id is None:
        docs = store.write_through(docs, "posts")

    out: dict = {}
    if described["enabled"]:
        asked = profile_tables(docs, described["get_top_n_words_per_label"])
        shown = {
            "label_distribution": described["plot_label_distribution"],
            "length_statistics": described["word_count_per_label"],
            "word_count_ecdf": described["word_count_per_label"],
        }
        out["profile"] = {
            name: table
            for name, table in asked.items()
            if shown.get(name, name == "top_terms" or described["get_author_info"])
        }
    if kind == "BERT":
        out["model_inputs"] = prepare_model_inputs(docs, folds, pair_column=pair_column)
        return out

    level = masked["masking_strategy"] if masked["enabled"] else 0
    if options["load_dataset"]:
        prepared = store.read_prepared(spark, prepared_path)
    else:
        chosen = replace(settings or Preparation(), folds=folds, mask_level=level)
        prepared = prepare(docs, chosen, lemmas, places)
        if prepared_path is None:
            prepared = store.write_through(prepared, "prepared", "fold")
        else:
            store.write_prepared(prepared, prepared_path)
            prepared = store.read_prepared(spark, prepared_path)
    out["prepared"] = prepared
    if settings is not None and settings.bigrams:
        out["bigrams"] = corpus.top_pairs(prepared, 20, settings.min_freq, cross_document=True)
    if options["preprocessing"]["get_descriptive_statistics_after_preprocessing"]:
        words = prepared.withColumn("text", F.array_join("tokens", " "))
        out["profile_prepared"] = profile_tables(words, described["get_top_n_words_per_label"])

    if modelling["enabled"]:
        classes = classes_for_training(prepared)
        grid = modelling["hyperparameters"]["C"]
        out["results"] = train_and_score(prepared, grid, classes, max_iter, longest)
        if metrics_path is not None:
            store.append_metrics(out["results"].metrics, metrics_path)
    return out
