"""Literal and property tests of the table operators."""

import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tamis.functions.labels import classes_of, decode, encode
from tamis.operators import corpus, distribution, masking, metrics, profile, splits, tfidf
from tamis.operators.ranking import row_number


def docs_of(spark, tokens, **columns):
    rows = [(i, t) for i, t in enumerate(tokens)]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>")


def by_id(df):
    return {r.doc_id: r.tokens for r in df.collect()}


# distributions


def values(spark, numbers):
    return distribution.frequency_table(spark.createDataFrame([(n,) for n in numbers], "v int"), "v")


def test_describe(spark):
    got = distribution.describe(values(spark, [1, 2, 3, 10])).first()
    assert (got["count"], got["mean"], got["min"], got["max"]) == (4, 4.0, 1, 10)
    assert got["std"] == pytest.approx(4.0824829)
    assert (got["q25"], got["q50"], got["q75"]) == (1.75, 2.5, 4.75)
    assert distribution.percentiles(values(spark, [1, 2, 3, 10]), 0.9).first().value == pytest.approx(7.9)
    assert distribution.describe(values(spark, [5])).first()["std"] is None


def test_describe_of_large_values(spark):
    numbers = [10_000_000_000 + i for i in range(50)]
    freq = distribution.frequency_table(spark.createDataFrame([(n,) for n in numbers], "v long"), "v")
    assert distribution.describe(freq).first()["std"] == pytest.approx(statistics.stdev(range(50)))


def test_ecdf(spark):
    got = [(r.value, r.first, r.last) for r in distribution.ecdf(values(spark, [1, 1, 3])).orderBy("value").collect()]
    assert got == [(1, 0.0, pytest.approx(1 / 3)), (3, pytest.approx(2 / 3), pytest.approx(2 / 3))]


def test_ecdf_across_buckets(spark):
    rng = random.Random(1)
    numbers = [rng.randrange(0, 20_000) for _ in range(500)]
    ordered = sorted(numbers)
    for r in distribution.ecdf(values(spark, numbers)).collect():
        assert r.first == pytest.approx(ordered.index(r.value) / 500)
        assert r.last == pytest.approx((ordered.index(r.value) + r.n - 1) / 500)


def test_histogram_keeps_empty_bins_and_maximum(spark):
    got = {r.bin: r.n for r in distribution.histogram(values(spark, [0, 1, 99, 100, 100]), 50).collect()}
    assert len(got) == 50 and sum(got.values()) == 5
    assert got[1] == 2 and got[50] == 3
    flat = distribution.histogram(values(spark, [4, 4]), 50).where("n > 0").first()
    assert flat.n == 2 and flat.lower <= 4 < flat.upper


def test_box(spark):
    got = distribution.box_summary(values(spark, [1, 2, 3, 4, 100])).first()
    assert (got.q25, got.q50, got.q75) == (2.0, 3.0, 4.0)
    assert (got.whisker_low, got.whisker_high, got.outliers) == (1, 4, 1)


def test_profile_null_handling(spark):
    df = spark.createDataFrame(
        [(1, "a", "x", "one two"), (2, None, "x", None), (3, "a", None, "three")],
        "doc_id long, author string, label string, text string",
    )
    assert [(r.label, r.n) for r in profile.label_distribution(df).collect()] == [("x", 2)]
    assert profile.totals(df).first()[:] == (1, 3)
    assert [(r.author, r.posts) for r in profile.posts_per_author(df).collect()] == [("a", 2)]


# ranking and splits


def test_row_number_in_buckets_is_the_global_one(spark):
    df = spark.range(0, 1000).select(
        F.col("id"), (F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h")
    ).withColumn("b", F.substring("h", 1, 1))
    got = row_number(df, "n", ["g"], ["b"], [F.col("b")], [F.col("h")]).collect()
    for g in range(3):
        ordered = sorted((r.h, r.n) for r in got if r.g == g)
        assert [n for _, n in ordered] == list(range(len(ordered)))


def test_cap_keeps_the_first_posts(spark):
    rows = [(i, "hot" if i % 2 else f"a{i % 7}", f"t{i}") for i in range(400)] + [(1000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, author string, text string")
    want = []
    for author in {a for _, a, _ in rows if a}:
        want += sorted(i for i, a, _ in rows if a == author)[:3]
    for salts in (1, 4, 64):
        got = [r.doc_id for r in splits.cap_per_author(df, 3, salts=salts).collect()]
        assert sorted(got) == sorted(want)


def test_stratified_folds_are_even(spark):
    df = spark.range(0, 103).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, "a").otherwise("b").alias("label"))
    counts = Counter((r.label, r.fold) for r in splits.stratified_folds(df, 5).collect())
    for label in "ab":
        sizes = [counts[label, f] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    assert sum(counts.values()) == 103


def test_author_folds(spark):
    rng = random.Random(3)
    rows = []
    for author in range(60):
        for _ in range(rng.randint(1, 9)):
            rows.append((len(rows), f"a{author}", rng.choice("xxxxyyz")))
    df = spark.createDataFrame(rows, "doc_id long, author string, label string")
    folds = splits.author_folds(df, 5)
    assert folds.count() == folds.select("author").distinct().count() == 60
    joined = splits.with_author_folds(df, folds)
    assert joined.count() == len(rows)
    sizes = Counter(r.fold for r in folds.collect())
    assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 3
    again = {r.author: r.fold for r in splits.author_folds(df.repartition(5), 5).collect()}
    assert again == {r.author: r.fold for r in folds.collect()}


def test_splits_partition_the_rows(spark):
    df = spark.range(0, 20).select(F.col("id").alias("doc_id"), (F.col("id") % 4).cast("int").alias("fold"))
    for fold in range(4):
        train, val = splits.train_part(df, fold), splits.validation_part(df, fold)
        assert train.count() == 15 and val.count() == 5
        assert train.join(val, "doc_id").count() == 0
    assert splits.all_splits(df, 4).where("split = 'val'").count() == 20


# corpus


def test_cutoff(spark):
    df = docs_of(spark, [["a", "b", "a"], ["b"], [], ["a", "c", "a", "b", "b", "a"]])
    assert by_id(corpus.frequency_cutoff(df, 5)) == {0: ["a", "a"], 1: [], 2: [], 3: ["a", "a", "a"]}
    assert by_id(corpus.frequency_cutoff(df, 1)) == by_id(df)
    train = df.where("doc_id = 0")
    assert by_id(corpus.frequency_cutoff(df, 2, train)) == {0: ["a", "a"], 1: [], 2: [], 3: ["a", "a", "a"]}


def test_cutoff_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    tokens = [words[i : i + 20] for i in range(0, 4000, 20)]
    freq = Counter(words)
    want = {i: [t for t in doc if freq[t] >= 5] for i, doc in enumerate(tokens)}
    assert by_id(corpus.frequency_cutoff(docs_of(spark, tokens), 5)) == want


def pmi(pairs, words, n):
    return {
        (a, b): math.log2(c * n / (words[a] * words[b])) for (a, b), c in pairs.items()
    }


@pytest.mark.parametrize("cross", [False, True])
def test_pair_scores(spark, cross):
    rng = random.Random(7)
    tokens = [[rng.choice("abcde") for _ in range(rng.randint(0, 6))] for _ in range(80)]
    if cross:
        flat = [t for doc in tokens for t in doc]
        pairs = Counter(zip(flat, flat[1:]))
    else:
        pairs = Counter(p for doc in tokens for p in zip(doc, doc[1:]))
    words = Counter(t for doc in tokens for t in doc)
    want = pmi({p: c for p, c in pairs.items() if c >= 3}, words, sum(words.values()))
    got = {(r.w1, r.w2): r.pmi for r in corpus.pair_scores(docs_of(spark, tokens), 3, cross).collect()}
    assert got == {p: pytest.approx(v) for p, v in want.items()}


def test_boundary_pairs_with_few_ranges(spark):
    tokens = [[f"t{i}"] if i % 3 else [] for i in range(50)]
    flat = [t for doc in tokens for t in doc]
    got = {(r.w1, r.w2) for r in corpus.boundary_pairs(docs_of(spark, tokens), ranges=4).collect()}
    assert got == set(zip(flat, flat[1:]))


def test_lemmas(spark):
    df = docs_of(spark, [["dogs", "ran", "boxes"], [], ["women", "glass", "mice", "dogs"], ["x"]])
    nouns = spark.createDataFrame([("dog",), ("box",), ("woman",), ("glass",), ("mouse",)], "noun string")
    exceptions = spark.createDataFrame([("mice", "mouse")], "form string, lemma string")
    lemmas = corpus.lemma_table(corpus.token_frequencies(df), nouns, exceptions)
    assert {(r.form, r.lemma) for r in lemmas.collect()} == {
        ("dogs", "dog"), ("boxes", "box"), ("women", "woman"), ("glass", "glass"), ("mice", "mouse")
    }
    assert by_id(corpus.lemmatize(df, lemmas)) == {
        0: ["dog", "ran", "box"], 1: [], 2: ["woman", "glass", "mouse", "dog"], 3: ["x"]
    }


# masking


LEVELS = ["trump", "vote", "paris", "tree", "libs", "Liberal"]


def test_mask_levels(spark):
    df = docs_of(spark, [LEVELS])
    places = masking.gazetteer(spark.createDataFrame([("Paris",), ("New York",)], "n string"))
    want = [
        LEVELS,
        ["trump", "vote", "paris", "tree"],
        ["vote", "paris", "tree"],
        ["paris", "tree"],
        ["tree"],
    ]
    for level, tokens in enumerate(want):
        assert by_id(masking.mask(df, level, places))[0] == tokens


def test_mask_rule_sets(spark):
    words = ["conservative", "liberal", "libya", "democrat", "leftist", "republican", "dems", "left", "leftwing"]
    df = docs_of(spark, [words])
    assert by_id(masking.mask(df, 1))[0] == ["democrat", "leftist", "dems", "left"]
    assert by_id(masking.mask(df, 1, rule_set="intended"))[0] == ["left"]


def test_places(spark):
    df = docs_of(spark, [["new", "york", "Paris", "a", "paris", "a"], [], ["l'aquila", "a\\b"]])
    names = masking.gazetteer(spark.createDataFrame([("paris",), ("new york",), ("L'Aquila",), ("A\\B",)], "n string"))
    assert by_id(masking.mask_places(df, names)) == {0: ["new", "york", "a", "a"], 1: [], 2: []}
    # A null name matches nothing, and the column may have any name.
    other = spark.createDataFrame([("Paris",), (None,)], "place string")
    assert by_id(masking.mask_places(df, other))[0] == ["new", "york", "a", "a"]
    assert by_id(masking.mask_places(df, other.where("false")))[0] == ["new", "york", "Paris", "a", "paris", "a"]


def test_places_need_a_gazetteer(spark):
    df = docs_of(spark, [["a"]])
    for masked in (lambda: masking.mask(df, 4), lambda: masking.mask_texts(df.withColumn("text", F.lit("a")), 4)):
        with pytest.raises(ValueError, match="gazetteer"):
            masked()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_joins_with_hot_keys(spark, how, monkeypatch):
    """Whatever counts as hot, the rows are those of the plain join."""
    rows = spark.range(200).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 't' || id % 50 END AS token")
    rows = rows.unionByName(spark.createDataFrame([(999, None)], "doc_id bigint, token string"))
    table = spark.createDataFrame([("hot", 1), ("t7", 2), ("t8", 3)], "token string, v int")
    want = sorted(map(repr, rows.join(table, "token", how).select("doc_id", "token", *(["v"] if how != "left_semi" else [])).collect()))
    for share in (1, 5, 20_000):
        monkeypatch.setattr(corpus, "_HOT_SHARE", share)
        got = corpus.with_table(rows, table, "token", how=how)
        got = got.select("doc_id", "token", *(["v"] if how != "left_semi" else []))
        assert sorted(map(repr, got.collect())) == want


def test_unlisted_labels_count(spark):
    rows = [("c", 0, "a", "a"), ("c", 0, "b", "b"), ("c", 0, "a", "a"), ("c", 0, "z", "a"), ("c", 0, "a", "y")]
    df = spark.createDataFrame(rows, "config string, fold int, y_true string, y_pred string")
    got = {r["metric"]: r["value"] for r in metrics.evaluate(df, ["a", "b"]).collect()}
    assert got["accuracy"] == pytest.approx(0.6)
    with pytest.raises(Exception, match="without y_true or y_pred"):
        metrics.confusion_counts(spark.createDataFrame([("c", 0, None, "a")], df.schema), ["a"]).collect()


def test_folds_keep_posts_without_label_or_author(spark):
    rows = [(i, f"u{i % 7}" if i % 5 else None, None if i % 7 == 3 else "ab"[i % 2]) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, author string, label string")
    out = splits.with_author_folds(df, splits.author_folds(df, 3)).collect()
    assert len(out) == len(rows) and {r["fold"] for r in out} == {0, 1, 2}
    assert len({(r["author"], r["fold"]) for r in out if r["author"]}) == 7


def test_mask_text(spark):
    raw = "donald trump and the liberal vote in paris, gop! warm war paris"
    df = spark.createDataFrame([(1, raw)], "doc_id long, text string")
    names = masking.gazetteer(spark.createDataFrame([("Paris",)], "n string"))
    got = [masking.mask_texts(df, level, names).first().text for level in range(5)]
    assert got == [
        raw,
        "donald trump and the vote in paris, ! warm war paris",
        "and the vote in paris, ! warm war paris",
        "and the in paris, ! warm paris",
        "and the in paris, ! warm",
    ]


# metrics


def run_table(spark, cells, config="c", fold=0):
    rows = [(config, fold, a, b) for (a, b), n in cells.items() for _ in range(n)]
    return spark.createDataFrame(rows, "config string, fold int, y_true string, y_pred string")


GOLDEN = {
    ("center", "center"): 3750, ("center", "left"): 565, ("center", "right"): 725,
    ("left", "center"): 577, ("left", "left"): 2066, ("left", "right"): 273,
    ("right", "center"): 571, ("right", "left"): 273, ("right", "right"): 2647,
}


def test_golden_scores(spark):
    got = {r.metric: r.value for r in metrics.evaluate(run_table(spark, GOLDEN)).collect()}
    assert {k: round(v, 4) for k, v in got.items()} == {
        "macro_f1": 0.7355, "weighted_f1": 0.7394, "mcc": 0.5990, "accuracy": 0.7393
    }
    report = {r.label: r for r in metrics.class_report(metrics.confusion_counts(run_table(spark, GOLDEN))).collect()}
    assert [round(report["center"][c], 2) for c in ("precision", "recall", "f1")] == [0.77, 0.74, 0.75]
    assert report["right"].support == 3491
    averages = metrics.report_averages(metrics.class_report(metrics.confusion_counts(run_table(spark, GOLDEN)))).first()
    assert [round(averages[f"macro_{c}"], 2) for c in ("precision", "recall", "f1")] == [0.73, 0.74, 0.74]


def test_missing_class_is_zero_filled(spark):
    table = run_table(spark, {("a", "a"): 2, ("b", "a"): 1})
    confusion = metrics.confusion_counts(table, ["a", "b", "c"])
    assert confusion.count() == 9 and confusion.agg(F.sum("n")).first()[0] == 3
    wide = metrics.confusion_matrix(confusion, ["a", "b", "c"]).orderBy("y_true").collect()
    assert [tuple(r)[3:] for r in wide] == [(2, 0, 0), (1, 0, 0), (0, 0, 0)]
    report = {r.label: r for r in metrics.class_report(confusion).collect()}
    assert report["c"].f1 == 0.0 and report["b"].precision == 0.0
    one_sided = run_table(spark, {("a", "a"): 2, ("b", "a"): 1})
    assert {r.metric: r.value for r in metrics.evaluate(one_sided).collect()}["mcc"] == 0.0


def test_best_config_breaks_ties_by_grid(spark):
    rows = [("C=1", 0, "macro_f1", 0.5), ("C=0.1", 0, "macro_f1", 0.5), ("C=5", 0, "macro_f1", 0.4)]
    table = spark.createDataFrame(rows, "config string, fold int, metric string, value double")
    assert metrics.best_config(table, ["C=0.1", "C=1", "C=5"]).first().config == "C=0.1"
    assert metrics.best_config(table.withColumn("value", F.lit(0.0)), ["C=1"]).count() == 0


def test_balanced_weights(spark):
    rows = [(i, "a" if i % 4 else "b", i % 3) for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, label string, fold int")
    got = {(r.model_fold, r.label): r.weight for r in metrics.balanced_weights(df).collect()}
    for fold in range(3):
        train = [label for _, label, f in rows if f != fold]
        for label, n in Counter(train).items():
            assert got[fold, label] == pytest.approx(len(train) / (2 * n))


def test_label_codes(spark):
    df = spark.createDataFrame([("right",), ("left",), ("center",)], "label string")
    classes = classes_of(df, "label")
    coded = df.select("label", encode(F.col("label"), classes).alias("code"))
    assert {r.label: r.code for r in coded.collect()} == {"center": 0, "left": 1, "right": 2}
    assert {r.label for r in coded.select(decode(F.col("code"), classes).alias("label")).collect()} == {"left", "right", "center"}
    with pytest.raises(Exception, match="unknown label"):
        df.select(encode(F.lit("up"), classes)).collect()


# tf-idf


def brute_idf(docs, train):
    n = len(train)
    df = Counter(t for d in train for t in set(docs[d]))
    return {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}, df, n


def test_corpus_tfidf(spark):
    rng = random.Random(11)
    docs = {i: [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 9))] for i in range(30)}
    terms = spark.createDataFrame([(i, "xy"[i % 2], d) for i, d in docs.items()], "doc_id long, label string, terms array<string>")
    idf, _, _ = brute_idf(docs, list(docs))
    want = {}
    for i, d in docs.items():
        w = {t: c * idf[t] for t, c in Counter(d).items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        want.update({(i, t): v / norm for t, v in w.items()})
    got = {(r.doc_id, r.term): r.weight for r in tfidf.corpus_tfidf(terms).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    means = {(r.label, r.term): r.weight for r in tfidf.mean_tfidf_per_label(terms).collect()}
    assert means["x", "a"] == pytest.approx(sum(v for (i, t), v in want.items() if t == "a" and i % 2 == 0) / 15)


def test_fold_tfidf_is_fitted_on_train_rows(spark):
    rng = random.Random(13)
    docs = {i: [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 9))] for i in range(30)}
    docs[0].append("onlyhere")
    docs[3].append("onlyhere")
    df = spark.createDataFrame([(i, d, i % 3) for i, d in docs.items()], "doc_id long, tokens array<string>, fold int")
    got = {(r.model_fold, r.doc_id, r.term): (r.split, r.weight) for r in tfidf.fold_tfidf(df, 3).collect()}
    want = {}
    for fold in range(3):
        idf, freq, n = brute_idf(docs, [i for i in docs if i % 3 != fold])
        kept = {t for t, c in freq.items() if 2 <= c <= 0.9 * n}
        for i, d in docs.items():
            w = {t: (1 + math.log(c)) * idf[t] for t, c in Counter(d).items() if t in kept}
            norm = math.sqrt(sum(v * v for v in w.values()))
            for t, v in w.items():
                want[fold, i, t] = ("val" if i % 3 == fold else "train", pytest.approx(v / norm))
    assert got == want
    assert not [k for k in got if k[0] == 0 and k[2] == "onlyhere"]


def test_indexed_vocabulary_is_dense(spark):
    vocabulary = spark.createDataFrame([(f"t{i}",) for i in range(300)], "term string")
    assert sorted(r.idx for r in tfidf.indexed_vocabulary(vocabulary).collect()) == list(range(300))


def test_weights_read_counts_that_were_made_once(spark):
    docs = spark.createDataFrame([(1, "x", ["a", "b", "a"]), (2, "y", ["b"]), (3, None, None), (None, "x", [])], "doc_id long, label string, terms array<string>")
    for weights in (tfidf.corpus_tfidf(docs), tfidf.mean_tfidf_per_label(docs)):
        assert "sort_array" not in weights._jdf.queryExecution().executedPlan().toString()
    got = {(r["doc_id"], r["term"]): r["tf"] for r in tfidf.term_counts(docs, "terms", "doc_id").collect()}
    assert got == {(1, "a"): 2, (1, "b"): 1, (2, "b"): 1}


def test_fold_weights_shuffle_no_row_of_a_frequent_term(spark):
    """Lengths are sums, so no window gathers the rows of a document; rows of documents whose id is null or comes twice stay."""
    docs = {i: [f"t{i % 5}", f"u{i % 2}", "all"] for i in range(30)}
    rows = [(i, d, i % 3) for i, d in docs.items()] + [(3, ["t1", "t1", "t2"], 0), (None, ["t1", "u1"], 1), (None, ["t2"], 2)]
    weights = tfidf.fold_tfidf(spark.createDataFrame(rows, "doc_id long, tokens array<string>, fold int"), 3)
    assert "Window" not in weights._jdf.queryExecution().executedPlan().toString()
    got = weights.groupBy("model_fold", "doc_id").agg(F.sum(F.pow("weight", F.lit(2))).alias("length"), F.count("*").alias("n")).collect()
    assert {r["doc_id"] for r in got} == {*docs, None}
    assert all(r["length"] == pytest.approx(1) for r in got)
    assert {r["n"] for r in got if r["doc_id"] is None} == {3} and {r["n"] for r in got if r["doc_id"] == 3} == {4}
    assert {r["term"] for r in weights.collect()} == {f"t{i}" for i in range(5)} | {"u0", "u1"}
