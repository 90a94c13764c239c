"""Balanced folds, document borders, lemmas, abbreviations and plans of hot terms."""

import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamis.functions import text as t
from tamis.functions.text import adjacent_pairs, collapse_blanks
from tamis.functions.wordlists import NOUN_ENDINGS
from tamis.operators import corpus, masking, splits, tfidf


def posts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, author string, label string")


def spread(rows, folds, k):
    """Per label the largest and smallest share of a fold, in posts."""
    counts = Counter((label, folds[author]) for _, author, label in rows if author is not None)
    return {label: [counts[label, f] for f in range(k)] for label in {r[2] for r in rows}}


def many_authors(seed, authors=400):
    rng = random.Random(seed)
    rows = []
    for a in range(authors):
        shares = rng.choice([(8, 1, 1), (1, 8, 1), (1, 1, 8), (5, 5, 0)])
        for _ in range(min(int(rng.paretovariate(1.1)), 60)):
            rows.append((len(rows), f"a{a}", rng.choices(["l", "r", "c"], shares)[0]))
    return rows


def test_balanced_folds_spread_every_label(spark):
    rows = many_authors(2)
    df = posts(spark, rows)
    folds = {r["author"]: r["fold"] for r in splits.balanced_author_folds(df, 5).collect()}
    assert set(folds) == {r[1] for r in rows} and set(folds.values()) == set(range(5))
    sizes = spread(rows, folds, 5)
    rarest_only = {r["author"]: r["fold"] for r in splits.author_folds(df, 5).collect()}
    for label, counts in sizes.items():
        assert max(counts) - min(counts) <= 0.02 * sum(counts) + 2, label
    worst = lambda s: max((max(c) - min(c)) / sum(c) for c in s.values())
    assert worst(sizes) <= worst(spread(rows, rarest_only, 5))
    again = splits.balanced_author_folds(df.repartition(7), 5).collect()
    assert {r["author"]: r["fold"] for r in again} == folds
    assert {r["author"]: r["fold"] for r in splits.balanced_author_folds(df, 5, seed=1).collect()} != folds


def test_equal_authors_are_dealt_evenly(spark):
    rows = [(i * 2 + j, f"a{i}", "xy"[j]) for i in range(103) for j in range(2)]
    folds = Counter(r["fold"] for r in splits.balanced_author_folds(posts(spark, rows), 5).collect())
    assert sorted(folds.values()) == [20, 20, 21, 21, 21]


def plain_greedy(classes, totals, k):
    """One author at a time, every spread computed from all labels."""
    held = [[0.0] * len(totals) for _ in range(k)]
    out = []
    for counts, rest in classes:
        placed = []
        for _ in range(rest):
            def after(fold):
                shares = [[(held[f][x] + (counts.get(x, 0) if f == fold else 0)) / totals[x] for f in range(k)] for x in range(len(totals))]
                return sum(math.sqrt(sum((s - sum(c) / k) ** 2 for s in c) / k) for c in shares)

            best = min(range(k), key=lambda f: (round(after(f), 9), sum(held[f]), f))
            for x, n in counts.items():
                held[best][x] += n
            placed.append(best)
        out.append(placed)
    return out


def test_the_greedy_is_the_plain_one():
    import numpy as np

    rng = random.Random(4)
    classes = [({x: rng.randint(1, 9) for x in rng.sample(range(3), rng.randint(1, 3))}, rng.randint(0, 4)) for _ in range(40)]
    totals = [sum(c.get(x, 0) * (n + 5) for c, n in classes) for x in range(3)]
    assert splits._deal_rest(classes, np.array(totals, float), 5) == plain_greedy(classes, totals, 5)


@pytest.mark.parametrize("classes", [30, 0])
def test_many_classes_are_merged(spark, monkeypatch, classes):
    monkeypatch.setattr(splits, "_MOST_CLASSES", classes)
    rows = many_authors(5) + [(10**6, None, "l"), (10**6 + 1, "a0", None)]
    folds = {r["author"]: r["fold"] for r in splits.balanced_author_folds(posts(spark, rows), 5).collect()}
    assert len(folds) == 400
    for label, counts in spread([r for r in rows if r[2]], folds, 5).items():
        assert max(counts) - min(counts) <= 0.25 * sum(counts) + 2, label


def test_folds_of_nothing(spark):
    assert splits.balanced_author_folds(posts(spark, []), 5).count() == 0


def in_order(spark, rows, kind):
    return spark.createDataFrame(rows, f"doc_id {kind}, tokens array<string>")


@pytest.mark.parametrize("far", [2**62, -(2**62)])
def test_one_far_id_leaves_ranges_even(spark, far):
    rows = [(i, [f"t{i}"]) for i in range(2000)] + [(far, ["far"])]
    random.Random(1).shuffle(rows)
    flat = [x for _, tokens in sorted(rows) for x in tokens]
    got = corpus.boundary_pairs(in_order(spark, rows, "long"), ranges=16)
    assert {tuple(r) for r in got.collect()} == set(zip(flat, flat[1:]))


def test_ranges_of_a_far_id_have_like_sizes(spark, monkeypatch):
    kept = []
    write = corpus.write_through

    def keep(df, name, *rest):
        out = write(df, name, *rest)
        if name == "ranges":
            kept.append(out)
        return out

    monkeypatch.setattr(corpus, "write_through", keep)
    rows = [(i, [f"t{i}"]) for i in range(4000)] + [(2**62, ["far"])]
    corpus.boundary_pairs(in_order(spark, rows, "long"), ranges=16).count()
    sizes = sorted(r["count"] for r in kept[0].groupBy("_range").count().collect())
    assert len(sizes) >= 15 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_ids_that_are_strings(spark):
    rows = [(f"id-{random.Random(i).random()}", [] if i % 4 == 0 else [f"t{i}", f"u{i}"]) for i in range(300)]
    flat = [tokens for _, tokens in sorted(rows) if tokens]
    want = {(a[-1], b[0]) for a, b in zip(flat, flat[1:])}
    assert {tuple(r) for r in corpus.boundary_pairs(in_order(spark, rows, "string"), ranges=7).collect()} == want


def plain_lemma(word, nouns, exceptions):
    ended = lambda forms: [f[: len(f) - len(e)] + new for f in forms for e, new in NOUN_ENDINGS if f.endswith(e)]
    known = lambda forms: [f for f in forms if f in nouns]
    shortest = lambda forms: min(forms, key=lambda f: (len(f), f))
    if word in exceptions:
        found = known([word, *exceptions[word]])
        return shortest(found) if found else None
    forms = ended([word])
    if found := known([word, *forms]):
        return shortest(found)
    while forms:
        forms = ended(forms)
        if found := known(forms):
            return shortest(found)
    return None


def test_lemmas_are_those_of_a_plain_loop(spark):
    rng = random.Random(8)
    parts = ["ba", "ss", "ch", "x", "s", "man", "y", "v", "ie", "z", "sh", "f"]
    nouns = {"".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(1000)}
    words = {w + "".join(rng.choices([e for e, _ in NOUN_ENDINGS] + ["s", "ss"], k=rng.randint(0, 4))) for w in nouns} | nouns | {"q", "sss" * 30, "mens", ""}
    exceptions = {w: rng.sample(sorted(nouns), 2) + ["none"] for w in rng.sample(sorted(words), 60)}
    got = corpus.lemma_table(
        spark.createDataFrame([(w,) for w in sorted(words)], "token string"),
        spark.createDataFrame([(n,) for n in nouns], "noun string"),
        spark.createDataFrame([(w, x) for w, ls in exceptions.items() for x in ls], "form string, lemma string"),
    )
    want = {w: plain_lemma(w, nouns, exceptions) for w in words}
    assert {r["form"]: r["lemma"] for r in got.collect()} == {w: x for w, x in want.items() if x is not None}
    assert sum(x is not None for x in want.values()) > 500


TEXTS = (
    ["Dr. Low met Mr. Bell at 5 p.m. in the town.", "The dog ran.", "Ask Dr. Low about the dog.", "Mr. Bell said no.", "It was (Dr. Low) again."] * 6
    + ["A town is a town.", "The dog and the town and the man.", "no dog, no town", "He saw Low. Then Bell.", "The end."] * 6
)


def test_abbreviations_by_plain_counts(spark):
    stops, all_ = Counter(), Counter()
    for text in TEXTS:
        for w in re.findall(r"\S+", text.lower()):
            w = re.sub(r"""^[("'\[{“„«‘]+|[)"'\]},;:!?”»’]+$""", "", w)
            if re.search(r"[a-z]", w) and not w.endswith(".."):
                word = w[:-1] if w.endswith(".") else w
                stops[word] += w.endswith(".")
                all_[word] += 1
    share = sum(stops.values()) / sum(all_.values())

    def likelihood(k, n, p):
        return (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n > k else 0)

    want = {}
    for word, n in all_.items():
        k = stops[word]
        if k < 2 or k / n <= share:
            continue
        inner = word.count(".")
        letters = max(len(word) - inner, 1)
        score = 2 * (likelihood(k, n, k / n) - likelihood(k, n, share)) * (inner + 1) * math.exp(-letters) * letters ** -(n - k)
        if score >= 0.3:
            want[word] = score
    docs = spark.createDataFrame([(x,) for x in TEXTS] + [(None,), ("",)], "text string")
    got = {r["word"]: r["score"] for r in corpus.abbreviations(docs).collect()}
    assert got == pytest.approx(want)
    assert {"dr", "mr", "p.m"} <= set(got) and not {"town", "dog", "low"} & set(got)


def test_stops_of_abbreviations_stay(spark):
    df = spark.createDataFrame([("Dr. Low met Mr. Bell at 5 p.m. in the town. End... of it.",), ("DR. No",), ("",)], "text string")
    got = [r[0] for r in df.select(t.word_tokens(F.col("text"), ["dr", "mr", "p.m"])).collect()]
    assert got[0] == ["Dr.", "Low", "met", "Mr.", "Bell", "at", "5", "p.m.", "in", "the", "town", ".", "End", "...", "of", "it", "."]
    assert got[1] == ["DR.", "No"] and got[2] == []
    plain = [r[0] for r in df.select(t.word_tokens(F.col("text"))).collect()]
    assert plain[0][:3] == ["Dr", ".", "Low"]
    unknown = [r[0] for r in df.select(t.word_tokens(F.col("text"), ["xyz"])).collect()]
    assert unknown == plain


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=12))
def test_folding_by_table_and_by_function_agree(value):
    for compatibility in (True, False):
        matched, replaced, others = t._folding(compatibility)
        table = {ord(m): (replaced[i] if i < len(replaced) else None) for i, m in enumerate(matched)}
        plain = "".join(c for c in value if not 0xD800 <= ord(c) < 0xE000)
        if not re.search(_class(others), plain):
            assert plain.translate(table) == t._folded(plain, compatibility)


def _class(others):
    """The regular expression class in Python's spelling."""
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", others)


def test_folding_of_all_scripts(spark):
    raws = ["Ünï Ñandú ǅ ŉ ß", "ﬁ ½ Ⅻ ｆｕｌｌ", "한국어 がぎ", "é̈x", "ẬḀỳ", "Ёлка ΆΈ", "עִבְרִית", "\U0001d4d0", None, ""]
    df = spark.createDataFrame([(x,) for x in raws], "x string")
    got = [tuple(r) for r in df.select(t.fold_case_and_accents(F.col("x")), t.model_text(F.col("x"))).collect()]
    for raw, (nfkd, nfd) in zip(raws, got):
        low = (raw or "").lower()
        want = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
        assert nfkd == (None if raw is None else want)
        assert nfd == "".join(c for c in unicodedata.normalize("NFD", low) if unicodedata.category(c) != "Mn")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_move_below_the_cleaning_chain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for made in (t.clean_tokens(F.col("text")), t.model_text(F.col("text"))):
        df = docs.select("lang", made.alias("made")).where("lang = 'en'")
        assert "EqualTo(lang,en)" in plan_of(df)


def test_mean_weights_sort_no_documents_and_terms(spark):
    docs = spark.createDataFrame([(1, "a", ["x", "x", "y"]), (2, "b", ["x", "z"]), (3, "b", []), (4, None, ["y"])], "doc_id long, label string, terms array<string>")
    got = tfidf.mean_tfidf_per_label(docs)
    idf = {"x": math.log(5 / 3) + 1, "y": math.log(5 / 3) + 1, "z": math.log(5 / 2) + 1}
    rows = {1: {"x": 2 * idf["x"], "y": idf["y"]}, 2: {"x": idf["x"], "z": idf["z"]}, 4: {"y": idf["y"]}}
    unit = {d: {w: v / math.sqrt(sum(x * x for x in r.values())) for w, v in r.items()} for d, r in rows.items()}
    want = {("a", "x"): unit[1]["x"], ("a", "y"): unit[1]["y"], ("b", "x"): unit[2]["x"] / 2, ("b", "z"): unit[2]["z"] / 2, (None, "y"): 1.0}
    assert {(r["label"], r["term"]): r["weight"] for r in got.collect()} == pytest.approx(want)
    assert "Window" not in plan_of(got)


def test_level_four_without_names_is_an_error(spark):
    with pytest.raises(ValueError, match="gazetteer"):
        masking.mask_text(F.col("text"), 4)


def test_pair_scores_in_another_order(spark):
    rows = [(i, -i, [f"t{i}", f"u{i}"]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, at long, tokens array<string>")
    got = {(r["w1"], r["w2"]) for r in corpus.pair_counts(docs, True, "at").collect()}
    assert {(f"u{i + 1}", f"t{i}") for i in range(29)} <= got


def test_masks_are_seen_before_word_borders(spark):
    """What may begin a rule is looked for first; rules that begin otherwise keep their plain form."""
    assert masking._guard(["(?:joe )?biden", r"far[-\s]?(?:left|right)", "ICE"]) == "(?<![A-Za-z])(?=[Ibfj])"
    for odd in ("a?b", "a|b", "(?i)a", r"\w+", "[ab]c", "(?:a|b)c", "(?:a?b )?c", "", r"a\(b|c\)d", "a[(]b|c[)]d"):
        assert masking._guard(["x", odd]) == "" and masking._guard([]) == ""
    texts = ["élib lib lib\u0301 _lib 1lib lib1 lib-lib (lib)", "xjoe biden joe bidenx joe biden", "éjoe biden", "far-left farleft a far left ICE ice"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    rules = {1: ["lib", r"far[-\s]?(?:left|right)"], 2: ["(?:joe )?biden", "ICE"]}
    plain = F.col("text")
    for at in (1, 2):
        plain = F.regexp_replace(plain, rf"(?U)\b(?:{'|'.join(rules[at])})\b", "")
    rows = df.select(masking.mask_text(F.col("text"), 3, rules=rules).alias("got"), collapse_blanks(plain).alias("want")).collect()
    assert all(r.got == r.want for r in rows) and rows[0].got != texts[0]


def test_masks_are_made_once(spark):
    df = spark.createDataFrame([(1, "liberal paris may")], "doc_id long, text string")
    names = masking.gazetteer(spark.createDataFrame([("Paris",)], "n string"))
    assert "regexp_replace" not in plan_of(masking.mask_texts(df, 4, names))


def test_adjacent_pairs_are_compiled(spark):
    df = spark.createDataFrame([(["a", None, "c"],), (["a"],), ([],), (None,)], "t array<string>")
    pairs = df.select(adjacent_pairs(F.col("t")).alias("p"))
    assert [r.p and [tuple(x) for x in r.p] for r in pairs.collect()] == [[("a", None), (None, "c")], [], [], None]
    assert pairs.schema["p"].dataType.elementType.names == ["w1", "w2"]
    assert "lambda" not in plan_of(pairs)


def test_ends_for_pairs_across_documents_are_made_once(spark, monkeypatch):
    """Sampling for ranges and the shuffle read the written ends, not the documents."""
    read = []
    write = corpus.write_through
    monkeypatch.setattr(corpus, "write_through", lambda df, name, *a, **b: read.append((name, "tokens" in plan_of(df))) or write(df, name, *a, **b))
    docs = spark.createDataFrame([(i, [f"a{i}", f"b{i}"]) for i in range(20)], "doc_id long, tokens array<string>")
    assert corpus.boundary_pairs(docs).count() == 19
    assert read == [("ends", True), ("ranges", False)]


def test_top_terms_sum_up_only_what_may_be_in_the_top(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        label = rng.choice(["a", "a", "b", None])
        words = [f"w{int(rng.paretovariate(0.5)) % 60}" for _ in range(rng.randrange(30))] + [f"{label}x{rng.randrange(2000)}" for _ in range(20)]
        rows.append((i if i % 50 else 7, label, " ".join(words)))
    rows += [(1000, "rare", "one two three three"), (1001, "none", ""), (1002, "null", None)]
    docs = spark.createDataFrame(rows, "doc_id long, label string, text string")
    monkeypatch.setattr(tfidf, "_SEEDS", 200)
    sizes, write = {}, tfidf.write_through

    def noted(df, name, *a, **b):
        out = write(df, name, *a, **b)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(tfidf, "write_through", noted)
    for n in (3, 5, 400):
        means = tfidf.mean_tfidf_per_label(tfidf.profile_terms(docs)).withColumn("weight", F.round("weight", 6))
        want = sorted(map(repr, tfidf.top_of_label(means, n).collect()))
        assert sorted(map(repr, tfidf.top_terms_per_label(docs, n).select("label", "term", "weight", "rank").collect())) == want
        if n == 3:
            assert 0 < sizes["needs"] and sizes["candidates"] < sizes["shared-terms"] / 5


@pytest.mark.parametrize("cross", [False, True])
def test_pairs_and_frequencies_come_from_one_pass(spark, monkeypatch, cross):
    """Nothing written reads the tokens but the pairs and, across documents, the ends."""
    read, write = [], corpus.write_through
    monkeypatch.setattr(corpus, "write_through", lambda df, name, *a, **b: read.append((name, "tokens" in plan_of(df))) or write(df, name, *a, **b))
    docs = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, []), (3, None), (4, ["a"]), (5, ["b", None, "a"])], "doc_id long, tokens array<string>")
    got = {(r.w1, r.w2): (r.n, r.pmi) for r in corpus.pair_scores(docs, 1, cross).collect()}
    pairs = {("a", "b"): 2, ("b", "a"): 1} if not cross else {("a", "b"): 3, ("b", "a"): 2}
    assert got == {k: (n, pytest.approx(math.log2(n * 7 / 9 if k[0] == k[1] else n * 7 / 12))) for k, n in pairs.items()}
    assert [name for name, tokens in read if tokens] == (["ends"] if cross else []) + ["all-pairs"]
