"""Literal cases for the text functions."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tamis.functions import text as t
from tamis.functions.wordlists import STOP_WORDS


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "raw, want", [(" a \t\n b ", "a b"), ("a b", "a b"), ("a\x1cb", "a b"), ("", ""), (" ", "")]
)
def test_collapse_blanks(spark, raw, want):
    assert one(spark, raw, t.collapse_blanks) == want


@pytest.mark.parametrize("raw", ["a b", " two  words ", "", "é😀", "x\x1fy z"])
def test_counts_match_python(spark, raw):
    assert one(spark, raw, t.word_count) == len(raw.split())
    assert one(spark, raw, t.char_count) == len(raw)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("he's", "he is"),
        ("he’s", "he’s"),
        ("it's café", "it is caf"),
        ("café", "café"),
        ("I can't, won't and shan't", "I cannot, will not and shall not"),
        ("They're here; we've won; I'll go; she'd stay", "They are here; we have won; I will go; she would stay"),
        ("Ann's dog isn't, let's go", "Ann's dog is not, let us go"),
        ("TBH it's fine", "TO BE HONEST it is fine"),
        ("TBH fine", "TBH fine"),
    ],
)
def test_contractions(spark, raw, want):
    assert one(spark, raw, t.expand_contractions) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ('You can "buy" it.', ["You", "can", '"', "buy", '"', "it", "."]),
        ("[Season 6, Episode 9](url", ["[", "Season", "6", ",", "Episode", "9", "]", "(", "url"]),
        ("well-known 2nd a/b end", ["well-known", "2nd", "a/b", "end"]),
        ("Ann's dogs' bone", ["Ann", "'s", "dogs", "'", "bone"]),
        ("wait... no--yes", ["wait", "...", "no", "--", "yes"]),
        ("don’t", ["don", "’", "t"]),
        ("", []),
        ("  ", []),
    ],
)
def test_word_tokens(spark, raw, want):
    assert one(spark, raw, t.word_tokens) == want


SAMPLES = ["café", "café", "ÉCOLE", "ﬁn", "Ångström", "İ", "ΟΔΟΣ", "한국", "½", "ß", "हिन्दी", "a¨b", "ﷺ"]


@pytest.mark.parametrize("raw", SAMPLES)
def test_accents_match_python(spark, raw):
    nfkd = "".join(c for c in unicodedata.normalize("NFKD", raw.lower()) if not unicodedata.combining(c))
    assert one(spark, raw, t.fold_case_and_accents) == nfkd
    nfd = "".join(c for c in unicodedata.normalize("NFD", raw.lower()) if unicodedata.category(c) != "Mn")
    assert one(spark, raw, t.model_text) == nfd


def test_null_text_becomes_empty(spark):
    assert one(spark, None, t.model_text) == ""


def test_normalize_tokens_keeps_shape(spark):
    df = spark.createDataFrame([(["É", "a¨b", "x"],), ([],)], "tokens array<string>")
    got = [r[0] for r in df.select(t.normalize_tokens(F.col("tokens"))).collect()]
    assert got == [["e", "a ̈b".replace("̈", ""), "x"], []]


def test_alphabetic_and_stop_words(spark):
    df = spark.createDataFrame([(["well-known", "2nd", "ok", "été", "the", "The"],)], "tokens array<string>")
    kept = df.select(t.keep_alphabetic(F.col("tokens")).alias("k")).first().k
    assert kept == ["ok", "été", "the", "The"]
    assert df.select(t.drop_words(F.col("tokens")).alias("k")).first().k == ["well-known", "2nd", "ok", "été", "The"]


TEXTS = [
    "You can \"buy\" the show. It's [Lethal Weapon 6](url episode, which I assume isn't new.",
    "Le café d'été n'est pas fermé… naïve co­op; x¨y",
    "ALL CAPS!!! 3.14 a_b e.g. Mr. Smith's",
    "",
    "line break and\x85next\rline",
]


def test_fused_chain_equals_its_parts(spark):
    df = spark.createDataFrame([(x,) for x in TEXTS], "x string")
    text = t.expand_contractions(t.collapse_blanks(F.col("x")))
    parts = t.drop_words(t.keep_alphabetic(t.normalize_tokens(t.word_tokens(text))), STOP_WORDS)
    for row in df.select(t.clean_tokens(F.col("x")).alias("a"), parts.alias("b")).collect():
        assert row.a == row.b


def test_profile_tokens(spark):
    assert one(spark, "A bc Ünïts_1 d2 é", t.profile_tokens) == ["bc", "ünïts_1", "d2"]


@pytest.mark.parametrize(
    "tokens, lo, hi, want",
    [
        (["a", "b", "c"], 1, 2, ["a", "b", "c", "a b", "b c"]),
        (["a", "b", "c"], 1, 3, ["a", "b", "c", "a b", "b c", "a b c"]),
        (["a"], 1, 3, ["a"]),
        ([], 2, 2, []),
        (["a", "b"], 2, 2, ["a b"]),
    ],
)
def test_ngrams(spark, tokens, lo, hi, want):
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    assert df.select(t.ngrams(F.col("t"), lo, hi).alias("g")).first().g == want


def test_adjacent_pairs(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    got = [[tuple(p) for p in r[0]] for r in df.select(t.adjacent_pairs(F.col("t"))).collect()]
    assert got == [[("a", "b"), ("b", "c")], [], []]


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.7],)], "s array<double>")
    assert df.select(t.argmax(F.col("s")).alias("i")).first().i == 1


def test_chain_runs_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "It's the café!")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    query = (
        stream.select("doc_id", t.clean_tokens(F.col("text")).alias("tokens"))
        .writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert [r.tokens for r in spark.table("cleaned").collect()] == [["caf"]]


def test_contractions_by_stretch_are_those_of_the_whole_text(spark):
    rules = [*t.CONTRACTIONS, (r"(?i)\b(y)'all\b", "$1ou"), (r"do n't", "don't")]
    said = ["", "'", " ' ", "Can't  won't\tshan't", "'ain't 'can't", "o'clock'", "\u00e9'cl\u00e9ock o'cl\u00e9ock", "tbh it's TBH",
            "rock'n'roll isn't-it they'll've", "do n't", " he's  she's\n'tis ", "y'all'd", "'\u00a0'cause", "no mark tbh", None]
    df = spark.createDataFrame([(x,) for x in said], "text string")
    for some in (t.CONTRACTIONS, rules, rules[-2:], []):
        whole = F.regexp_replace("text", r"[^\x00-\x7F]+", "")
        for pattern, expansion in some:
            whole = F.regexp_replace(whole, pattern, expansion)
        whole = F.when(F.contains("text", F.lit("'")), whole).otherwise(F.col("text"))
        for r in df.select(t.expand_contractions(F.col("text"), some).alias("got"), whole.alias("want")).collect():
            assert r["got"] == r["want"]
    assert [t._inside_stretches(p) for p, _ in rules] == [True] * 18 + [False, False, True, False]


def test_every_run_of_blanks_collapses(spark):
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    said = [b + "a" + b + b + "c" + b + " d " + b for b in blanks] + ["", " ", "  ", "a b", "\u200b a"]
    df = spark.createDataFrame([(x,) for x in said], "text string")
    got = [r[0] for r in df.select(t.collapse_blanks(F.col("text"))).collect()]
    assert got == [" ".join(x.split()) for x in said]


def test_cleaning_makes_its_lines_once(spark):
    df = spark.createDataFrame([("It's \ufb01ne, \ud55c\uad6d \u017eena",), ("\u2460 caf\u00e9's",)], "text string")
    cleaned = df.select(t.clean_tokens(F.col("text"), stop_words=None).alias("tokens"))
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    # The function over batches looks at the text itself; the chain before was there once more to look at.
    assert "RLIKE(lower(text" in plan
    steps = t.keep_alphabetic(t.normalize_tokens(t.word_tokens(t.expand_contractions(t.collapse_blanks(F.col("text"))))))
    assert [r[0] for r in cleaned.collect()] == [r[0] for r in df.select(steps).collect()]
