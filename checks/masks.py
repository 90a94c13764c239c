"""Masks over documents in which frequent words were replaced by words the rules know."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import WORD, WS, documents, joined, table
from tamis.functions.text import profile_tokens
from tamis.functions.wordlists import TEXT_RULES, TOKEN_RULES
from tamis.operators import corpus, masking

SEEDED = {
    " the ": " liberal ",
    " and ": " Trump ",
    " that ": " vote ",
    " with ": " lefty ",
    " of ": " democrat ",
    " der ": " theresa may ",
    " und ": " conserv ",
    " que ": " left wing ",
    " la ": " libya ",
    " les ": " africa ",
    " los ": " gop, ",
}


def seeded(spark, path):
    text = F.col("text")
    for old, new in SEEDED.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return documents(spark, path).withColumn("text", text)


def seeded_tokens(spark, path):
    return seeded(spark, path).select("doc_id", profile_tokens(F.col("text")).alias("tokens"))


def place_names(spark, path):
    """Region names, and the longer words of the benchmark items: lower-cased, without repeats."""
    words = table(spark, path, "benchmark").select(
        F.explode_outer(profile_tokens(F.col("text"))).alias("name")
    )
    regions = table(spark, path, "region").select("r_name")
    return masking.gazetteer(regions, words.where(F.length("name") >= 5))


def _at(level, rule_set="strict"):
    def query(spark, path):
        names = place_names(spark, path) if level >= masking.PLACE_LEVEL else None
        masked = masking.mask(seeded_tokens(spark, path), level, names, rule_set)
        return masked.select("doc_id", joined())

    return query


def j2_gazetteer_lookup(spark, path):
    """Every place of a token that is no name: an anti-join of the exploded tokens."""
    places = corpus.token_places(seeded_tokens(spark, path))
    left = places.join(place_names(spark, path), F.col("token") == F.col("name"), "left_anti")
    return left.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "token")


def f10_places(spark, path):
    return masking.mask_places(seeded_tokens(spark, path), place_names(spark, path)).select("doc_id", joined())


def f12_mask_text(spark, path):
    lowered = seeded(spark, path).select("doc_id", F.lower("text").alias("text"))
    return masking.mask_texts(lowered, 4, place_names(spark, path))


def u1_gazetteer(spark, path):
    return place_names(spark, path)


QUERIES = {
    "f7_mask_leanings": _at(1),
    "f7_mask_leanings_intended": _at(1, "intended"),
    "f8_mask_figures": _at(2),
    "f9_mask_topics": _at(3),
    "f10_places": f10_places,
    "f10_places_by_join": f10_places,
    "f11_mask_all_levels": _at(4),
    "f11_mask_disabled": _at(0),
    "f12_mask_text": f12_mask_text,
    "j2_gazetteer_lookup": j2_gazetteer_lookup,
    "u1_gazetteer": u1_gazetteer,
}

_SEED = "text"
for _old, _new in SEEDED.items():
    _SEED = f"replace({_SEED}, '{_old}', '{_new}')"
_TOKENS = (
    f"seeded AS (SELECT doc_id, {_SEED} AS text FROM documents), "
    f"tok AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS tokens FROM seeded)"
)
_NAMES = (
    "names AS (SELECT lower(r_name) AS name FROM region UNION SELECT word FROM "
    f"(SELECT unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM benchmark) WHERE length(word) >= 5)"
)
_OCC = "occ AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM tok)"


def _masked(condition: str) -> str:
    return (
        f"WITH {_TOKENS}, {_NAMES}, {_OCC}, kept AS (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS tokens "
        f"FROM occ WHERE {condition} GROUP BY doc_id) "
        "SELECT tok.doc_id, coalesce(kept.tokens, '') AS tokens FROM tok LEFT JOIN kept USING (doc_id)"
    )


def _no_match(level: int, rule_set: str = "strict") -> str:
    rules = "|".join(p for at in range(1, level + 1) for p in TOKEN_RULES[rule_set][at])
    return f"NOT regexp_full_match(token, '(?i)(?:{rules})')"


_NO_PLACE = "token NOT IN (SELECT name FROM names)"
# Word borders of the second engine know ASCII letters only. Lower-case Latin letters outside ASCII are
# therefore written as two capitals, which no lower-cased text holds, while the rules are applied.
_LETTERS = {c: "Z" + chr(ord("A") + i) for i, c in enumerate("ßàáâäåæçèéêëìíîïñòóôöøùúûü")}
_TEXT = "lower(text)"
for _letter, _code in _LETTERS.items():
    _TEXT = f"replace({_TEXT}, '{_letter}', '{_code}')"
for _level in (1, 2, 3):
    _TEXT = f"regexp_replace({_TEXT}, '\\b(?:{'|'.join(TEXT_RULES['strict'][_level])})\\b', '', 'g')"
for _letter, _code in _LETTERS.items():
    _TEXT = f"replace({_TEXT}, '{_code}', '{_letter}')"
SQL = {
    "f7_mask_leanings": _masked(_no_match(1)),
    "f7_mask_leanings_intended": _masked(_no_match(1, "intended")),
    "f8_mask_figures": _masked(_no_match(2)),
    "f9_mask_topics": _masked(_no_match(3)),
    "f10_places": _masked(_NO_PLACE),
    "f10_places_by_join": _masked(_NO_PLACE),
    "f11_mask_all_levels": _masked(f"{_no_match(3)} AND {_NO_PLACE}"),
    "f11_mask_disabled": _masked("true"),
    "f12_mask_text": f"WITH {_TOKENS}, {_NAMES}, cut AS (SELECT doc_id, trim(regexp_replace({_TEXT}, '{WS}+', ' ', 'g')) AS text FROM seeded), "
    "w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM cut), "
    "kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM w WHERE word NOT IN (SELECT name FROM names) GROUP BY doc_id) "
    "SELECT cut.doc_id, coalesce(kept.text, '') AS text FROM cut LEFT JOIN kept USING (doc_id)",
    "j2_gazetteer_lookup": f"WITH {_TOKENS}, {_NAMES}, {_OCC} SELECT doc_id, pos - 1 AS pos, token FROM occ WHERE {_NO_PLACE}",
    "u1_gazetteer": f"WITH {_NAMES} SELECT name FROM names",
}
