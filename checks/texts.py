"""Text functions over whole documents.

The given documents hold neither apostrophes nor odd blanks, so the inputs of those functions are
made from the documents: every "that " becomes "that's ", every " the " gets tabs and hard blanks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import (
    OCC,
    STOPS,
    TOK,
    WORD,
    WS,
    documents,
    joined,
    tokenized,
)
from tamis.functions import text as t
from tamis.functions.wordlists import CONTRACTIONS, NOUN_ENDINGS
from tamis.operators import corpus


def said(spark, path):
    """Documents with apostrophes: English ones get contractions, others stay as they are."""
    text = F.replace(F.col("text"), F.lit("that "), F.lit("that's "))
    text = F.replace(text, F.lit(" on "), F.lit(" don't "))
    return documents(spark, path).withColumn("text", F.replace(text, F.lit(" es "), F.lit(" they'll ")))


def blanked(spark, path):
    text = F.replace(F.col("text"), F.lit(" the "), F.lit("  \tthe\r\n "))
    return documents(spark, path).withColumn("text", F.replace(text, F.lit(" la "), F.lit(" la\x1c")))


def f2_null_text(spark, path):
    docs = documents(spark, path)
    text = F.when(F.col("label") != "de", F.col("text"))
    return docs.select("doc_id", t.model_text(text).alias("text"))


def f3_text_pair(spark, path):
    pair = t.text_pair(t.model_text(F.col("text")), t.model_text(F.col("author")))
    return documents(spark, path).select("doc_id", pair.alias("p")).select("doc_id", "p.*")


def t1_collapse_blanks(spark, path):
    return blanked(spark, path).select("doc_id", t.collapse_blanks(F.col("text")).alias("text"))


def t2_contractions(spark, path):
    return said(spark, path).select("doc_id", t.expand_contractions(F.col("text")).alias("text"))


def t3_word_tokens(spark, path):
    docs = said(spark, path).select("doc_id", t.word_tokens(F.col("text")).alias("tokens"))
    return docs.select("doc_id", joined())


def f4_alphabetic_tokens(spark, path):
    docs = said(spark, path).select("doc_id", t.keep_alphabetic(t.word_tokens(F.col("text"))).alias("tokens"))
    return docs.select("doc_id", joined())


def t4_normalized_tokens(spark, path):
    docs = documents(spark, path).select("doc_id", t.word_tokens(F.col("text")).alias("tokens"))
    return docs.select("doc_id", t.normalize_tokens(F.col("tokens")).alias("tokens")).select("doc_id", joined())


def f5_stop_words(spark, path):
    docs = tokenized(spark, path).select("doc_id", t.drop_words(F.col("tokens")).alias("tokens"))
    return docs.select("doc_id", joined())


def t5_model_text(spark, path):
    return documents(spark, path).select("doc_id", t.model_text(F.col("text")).alias("text"))


def _lemmas(docs, levels=1):
    """Noun lexicon from the corpus itself: words seen at least twice that do not end in s."""
    freq = corpus.token_frequencies(docs)
    nouns = freq.where((F.col("n") >= 2) & ~F.col("token").endswith("s"))
    return corpus.lemma_table(freq, nouns.select(F.col("token").alias("noun")), levels=levels)


def t6_lemma_table(spark, path):
    """Endings taken off once."""
    return _lemmas(tokenized(spark, path))


def t6_lemma_levels(spark, path):
    """Endings taken off until there is a hit."""
    return _lemmas(tokenized(spark, path), None)


def j6_lemmatize(spark, path):
    docs = tokenized(spark, path)
    return corpus.lemmatize(docs, _lemmas(docs)).select("doc_id", joined())


def t7_clean_tokens(spark, path):
    docs = said(spark, path).select("doc_id", t.clean_tokens(F.col("text")).alias("tokens"))
    return docs.select("doc_id", joined())


def t8_profile_tokens(spark, path):
    return tokenized(spark, path).select("doc_id", joined())


def t9_ngrams(spark, path):
    docs = tokenized(spark, path).select("doc_id", t.ngrams(F.col("tokens"), 2, 3).alias("grams"))
    return docs.select("doc_id", F.size("grams").cast("bigint").alias("n"), F.array_join("grams", "|").alias("grams"))


QUERIES = {
    f.__name__: f
    for f in (
        f2_null_text,
        f3_text_pair,
        f4_alphabetic_tokens,
        f5_stop_words,
        t1_collapse_blanks,
        t2_contractions,
        t3_word_tokens,
        t4_normalized_tokens,
        t5_model_text,
        t6_lemma_table,
        t6_lemma_levels,
        j6_lemmatize,
        t7_clean_tokens,
        t8_profile_tokens,
        t9_ngrams,
    )
}


def _sub(value: str, pattern: str, new: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"regexp_replace({value}, '{pattern}', '{new}', 'g')"


def _expand(value: str) -> str:
    opened = _sub(value, r"[^\x00-\x7F]+", "")
    for pattern, expansion in CONTRACTIONS:
        opened = _sub(opened, pattern, expansion.replace("$1", r"\1"))
    return f"CASE WHEN contains({value}, '''') THEN {opened} ELSE {value} END"


def _part(value: str) -> str:
    padded = f"' ' || {_sub(value, WS + '+', ' ')} || ' '"
    padded = _sub(padded, r"""([,;:@#$%&?!"()\[\]{}<>`«»“”„‘’]|--|\.\.\.)""", r" \1 ")
    padded = _sub(padded, r"(n't|N'T|'(?:[sSmMdD]|ll|LL|re|RE|ve|VE)?) ", r" \1 ")
    return _sub(padded, r"([^.])\. ", r"\1 . ")


_SAID = (
    "said AS (SELECT doc_id, replace(replace(replace(text, 'that ', 'that''s '), ' on ', ' don''t '), "
    "' es ', ' they''ll ') AS text FROM documents)"
)
_PARTED = f"parted AS (SELECT doc_id, regexp_extract_all({_part('text')}, '[^ ]+') AS tokens FROM said)"
_MODEL = "strip_accents(lower(coalesce({0}, '')))"
_CASES = " ".join(
    f"UNION SELECT token AS form, substr(token, 1, length(token) - {len(e)}) || '{n}' AS noun "
    f"FROM freq WHERE ends_with(token, '{e}')"
    for e, n in NOUN_ENDINGS
)
_LEMMAS = (
    f"{TOK}, {OCC}, freq AS (SELECT token, count(*) AS n FROM occ GROUP BY token), "
    "nouns AS (SELECT token AS noun FROM freq WHERE n >= 2 AND NOT ends_with(token, 's')), "
    f"forms AS (SELECT token AS form, token AS noun FROM freq {_CASES}), "
    "hits AS (SELECT form, noun, row_number() OVER (PARTITION BY form ORDER BY length(noun), noun) AS r "
    "FROM forms WHERE noun IN (SELECT noun FROM nouns)), "
    "lemmas AS (SELECT form, noun AS lemma FROM hits WHERE r = 1)"
)
_ENDINGS = ", ".join(f"('{e}', '{n}')" for e, n in NOUN_ENDINGS)
_LEMMA_LEVELS = (
    f"WITH RECURSIVE {TOK}, {OCC}, freq AS (SELECT token, count(*) AS n FROM occ GROUP BY token), "
    "nouns AS (SELECT token AS noun FROM freq WHERE n >= 2 AND NOT ends_with(token, 's')), "
    f"endings(old, new) AS (VALUES {_ENDINGS}), "
    "levels AS (SELECT token AS form, token AS noun, 0 AS level FROM freq "
    "UNION SELECT form, left(noun, length(noun) - length(old)) || new, level + 1 FROM levels JOIN endings ON ends_with(noun, old)), "
    "hits AS (SELECT form, noun, row_number() OVER (PARTITION BY form ORDER BY greatest(level, 1), length(noun), noun) AS r "
    "FROM levels WHERE noun IN (SELECT noun FROM nouns)) "
    "SELECT form, noun AS lemma FROM hits WHERE r = 1"
)
SQL = {
    "t6_lemma_levels": _LEMMA_LEVELS,
    "f2_null_text": "SELECT doc_id, CASE WHEN lang = 'de' THEN '' ELSE " + _MODEL.format("text") + " END AS text FROM documents",
    "f3_text_pair": f"SELECT doc_id, {_MODEL.format('text')} AS text_a, {_MODEL.format('source')} AS text_b FROM documents",
    "t1_collapse_blanks": "SELECT doc_id, trim("
    + _sub(
        "replace(replace(text, ' the ', ' ' || chr(160) || chr(9) || 'the' || chr(13) || chr(10) || ' '), "
        "' la ', chr(8195) || 'la' || chr(28))",
        WS + "+",
        " ",
    )
    + ") AS text FROM documents",
    "t2_contractions": f"WITH {_SAID} SELECT doc_id, {_expand('text')} AS text FROM said",
    "t3_word_tokens": f"WITH {_SAID}, {_PARTED} SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM parted",
    "f4_alphabetic_tokens": f"WITH {_SAID}, {_PARTED} SELECT doc_id, array_to_string(list_filter(tokens, "
    r"lambda t: regexp_full_match(t, '\pL+')), ' ') AS tokens FROM parted",
    "t4_normalized_tokens": "WITH said AS (SELECT doc_id, text FROM documents), "
    + _PARTED
    + " SELECT doc_id, strip_accents(lower(array_to_string(tokens, ' '))) AS tokens FROM parted",
    "f5_stop_words": f"WITH {TOK} SELECT doc_id, array_to_string(list_filter(tokens, lambda t: t NOT IN ({STOPS})), ' ') AS tokens FROM tok",
    "t5_model_text": f"SELECT doc_id, {_MODEL.format('text')} AS text FROM documents",
    "t6_lemma_table": f"WITH {_LEMMAS} SELECT form, lemma FROM lemmas",
    "j6_lemmatize": f"WITH {_LEMMAS}, done AS (SELECT doc_id, string_agg(coalesce(lemma, token), ' ' ORDER BY pos) AS tokens "
    "FROM occ LEFT JOIN lemmas ON token = form GROUP BY doc_id) "
    "SELECT tok.doc_id, coalesce(done.tokens, '') AS tokens FROM tok LEFT JOIN done USING (doc_id)",
    "t7_clean_tokens": f"WITH {_SAID}, flat AS (SELECT doc_id, trim({_sub('text', WS + '+', ' ')}) AS text FROM said), "
    f"opened AS (SELECT doc_id, {_expand('text')} AS text FROM flat), "
    f"parted AS (SELECT doc_id, regexp_extract_all({_part('text')}, '[^ ]+') AS tokens FROM opened), "
    "plain AS (SELECT doc_id, list_transform(tokens, lambda t: strip_accents(lower(t))) AS tokens FROM parted) "
    r"SELECT doc_id, array_to_string(list_filter(tokens, lambda t: regexp_full_match(t, '\pL+') "
    f"AND t NOT IN ({STOPS})), ' ') AS tokens FROM plain",
    "t8_profile_tokens": f"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '{WORD}'), ' ') AS tokens FROM documents",
    "t9_ngrams": f"WITH {TOK}, {OCC}, g AS (SELECT doc_id, pos, 2 AS len, token || ' ' || lead(token) OVER w AS gram FROM occ "
    "WINDOW w AS (PARTITION BY doc_id ORDER BY pos) UNION ALL SELECT doc_id, pos, 3, token || ' ' || lead(token) OVER w || ' ' || "
    "lead(token, 2) OVER w FROM occ WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), "
    "a AS (SELECT doc_id, count(*) AS n, string_agg(gram, '|' ORDER BY len, pos) AS grams FROM g WHERE gram IS NOT NULL GROUP BY doc_id) "
    "SELECT tok.doc_id, coalesce(n, 0) AS n, coalesce(grams, '') AS grams FROM tok LEFT JOIN a USING (doc_id)",
}
