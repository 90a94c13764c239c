"""Registered queries of the operators, with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import aligning, bpe, hilbert, language, licences, mixing, near, negatives, packing, quality, rules, warc, wrappers
from tamis.llm.common import LOWER, UPPER, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_LEVEL, SENTENCE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_hilbert_neighbours(spark: SparkSession, path: str) -> DataFrame:
    return hilbert.neighbours(table(spark, path, "embeddings"))


def op2_warc_histories(spark: SparkSession, path: str) -> DataFrame:
    found = warc.captures(table(spark, path, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_best_fit_packing(spark: SparkSession, path: str) -> DataFrame:
    return packing.pack(table(spark, path, "documents"), TOKENIZER)


def op4_diagonal_licences(spark: SparkSession, path: str) -> DataFrame:
    return licences.scan(table(spark, path, "documents"))


def op5_wrapper_texts(spark: SparkSession, path: str) -> DataFrame:
    return wrappers.main_texts(table(spark, path, "pages"))


def op6_crf_quality(spark: SparkSession, path: str) -> DataFrame:
    return quality.rate(table(spark, path, "documents"), table(spark, path, "labels"))


def op7_tensored_minhash(spark: SparkSession, path: str) -> DataFrame:
    found = near.near_duplicates(table(spark, path, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_trie_bpe(spark: SparkSession, path: str) -> DataFrame:
    return bpe.round_trips(table(spark, path, "documents"), TOKENIZER)


def op9_loglik_rules(spark: SparkSession, path: str) -> DataFrame:
    """Trusted are the documents that ``labels`` marks as good."""
    trusted = table(spark, path, "labels").where("quality = 1").select("doc_id")
    return rules.judge(table(spark, path, "documents"), trusted)


def op10_string_kernel_language(spark: SparkSession, path: str) -> DataFrame:
    return language.languages(table(spark, path, "documents"))


def op11_residue_negatives(spark: SparkSession, path: str) -> DataFrame:
    vectors = table(spark, path, "embeddings")
    moved = (F.col("label").cast("bigint") + 1) % 10
    return negatives.hard_negatives(vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label"))))


def op12_source_mix(spark: SparkSession, path: str) -> DataFrame:
    return mixing.mixed(table(spark, path, "documents")).drop("source")


def op13_diagonal_alignment(spark: SparkSession, path: str) -> DataFrame:
    return aligning.aligned(table(spark, path, "documents"), BYTE_LEVEL, SENTENCE)


QUERIES = {f.__name__: f for f in (op1_hilbert_neighbours, op2_warc_histories, op3_best_fit_packing, op4_diagonal_licences, op5_wrapper_texts, op6_crf_quality, op7_tensored_minhash, op8_trie_bpe, op9_loglik_rules, op10_string_kernel_language, op11_residue_negatives, op12_source_mix, op13_diagonal_alignment)}
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_TEMPLATES = ", ".join(
    f"({i}, '{label}', {i < len(licences.BASE)}, string_split('{text}', ' '), {2 if i < len(licences.BASE) else 3})"
    for i, (label, text) in enumerate((*licences.BASE, *licences.NOTICES))
)
_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> {}) & 31)::INT, 1)"
SQL = {
    "op2_warc_histories": f"""
WITH payloads AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM payloads
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string([
        {' || '.join(_DIGIT.format(s) for s in (15, 10, 5, 0))}
        FOR v IN [('0x' || substr(h, 5 * g + 1, 5))::BIGINT FOR g IN range(0, 8)]], '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
""",
    "op4_diagonal_licences": rf"""
WITH words AS (
    SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), templates(template, label, base, tw, k) AS (VALUES {_TEMPLATES}
), template_grams AS (
    SELECT template, label, base, k, len(tw) AS size, t, array_to_string(tw[t + 1 : t + k], ' ') AS gram
    FROM (SELECT *, unnest(range(0, len(tw) - k + 1)) AS t FROM templates)
), grams AS (
    SELECT doc_id, k, d, array_to_string(w[d + 1 : d + k], ' ') AS gram FROM (
        SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS d FROM words CROSS JOIN (VALUES (2), (3)) AS ks(k)
        WHERE len(w) >= k)
), voted AS (
    SELECT doc_id, template, label, base, size, g.k AS k, d - t AS diagonal, list(DISTINCT t) AS ts
    FROM grams g JOIN template_grams USING (k, gram) GROUP BY ALL
), fresh AS (
    SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= 2
        THEN 0 ELSE 1 END AS fresh, len(ts) = size - k + 1 AS is_whole FROM voted
), numbered AS (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM fresh
), merged AS (
    SELECT doc_id, template, label, base, size, k, span, flatten(list(ts)) AS ts,
        count(*) FILTER (is_whole) AS whole, min(diagonal) FILTER (is_whole) AS first_word,
        max(diagonal) FILTER (is_whole) AS last_word
    FROM numbered GROUP BY ALL
), spans AS (
    SELECT *, len(list_distinct(flatten([range(t, t + k) FOR t IN ts])))::DOUBLE / size AS covered FROM merged
), found AS (
    SELECT doc_id, sum(whole) FILTER (base) AS n_base, min(first_word) FILTER (base) AS first_word,
        max(last_word) FILTER (base) AS last_word,
        list_sort(list(DISTINCT label) FILTER (base AND whole > 0)) AS base_labels,
        list_sort(list(DISTINCT label) FILTER ((base AND whole > 0) OR (NOT base AND covered >= 0.8))) AS labels,
        max(covered) AS score
    FROM spans GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
    coalesce(array_to_string(base_labels, ','), '') AS base_labels,
    coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM words LEFT JOIN found USING (doc_id)
""",
    "op7_tensored_minhash": rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT doc_id, unnest(list_distinct(CASE
        WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
    FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * pairs.n >= 85 * (x.n + y.n - pairs.n)
), both_ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reached.a, both_ways.b FROM reached JOIN both_ways ON reached.b = both_ways.a
), components AS (
    SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN components USING (doc_id) LEFT JOIN sizes USING (doc_id)
""",
    "op11_residue_negatives": """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
    FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
""",
    "op12_source_mix": rf"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) AS size,
        ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
        3 * source_size AS most FROM sources
), levels AS (
    -- Sources are full from the least limit per weight on; the first level within the next limit holds.
    SELECT most / w AS full_at, (sum(source_size) OVER () - coalesce(sum(most) OVER earlier, 0))::DOUBLE AS words,
        sum(w) OVER () - coalesce(sum(w) OVER earlier, 0) AS weights
    FROM weighed WINDOW earlier AS (ORDER BY most / w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)
), level AS (
    SELECT words, weights FROM levels WHERE words / weights <= full_at ORDER BY full_at LIMIT 1
), aims AS (
    SELECT source, source_size, target, least(round(target)::BIGINT, most) AS budget
    FROM (SELECT *, least(w * words / weights, most::DOUBLE) AS target FROM weighed, level)
), placed AS (
    SELECT doc_id, size, source_size, target, budget, coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM sized JOIN aims ON sized.source IS NOT DISTINCT FROM aims.source
), passed AS (
    SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes FROM placed
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
    (passes * size + greatest(least(budget - passes * source_size - before, size), 0))::BIGINT AS taken
FROM passed
""",
}
