"""Language and quality by held-out accuracy, and their parts against plain versions."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tamis.llm import language, quality
from tamis.llm.queries import QUERIES

PATH = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()}


def is_held_out(doc):
    return zlib.crc32(str(doc).encode()) % 4 == 2


def test_languages_of_held_out_documents(spark, docs):
    rows = QUERIES["op10_string_kernel_language"](spark, PATH).collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == is_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows if r["held_out"]]
    assert np.mean(right) > 0.99


def test_odd_texts_have_a_language_or_none(spark, documents):
    train = [(i, "the cat and the dog " * 3, "en") for i in range(12)] + [(i + 20, "der Hund und die Katze " * 3, "de") for i in range(12)]
    odd = [(100, None, "en"), (101, "", None), (102, "123 !? ½", "en"), (103, "the dog", None), (None, "die Katze", "xx"), (104, "und " * 50_000, None), (104, "x", None)]
    out = language.languages(documents(*train, *odd)).collect()
    assert len(out) == len(train) + len(odd)
    got = {r["doc_id"]: r for r in out}
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[100]["score"] == 0
    assert got[103]["lang_pred"] == "en" and got[104]["lang_pred"] in ("de", "en")
    assert got[None]["lang_pred"] == "de" and got[None]["held_out"] is False
    unlearnt = language.languages(documents((1, "text", None), (2, None, None))).collect()
    assert {r["lang_pred"] for r in unlearnt} == {"und"}
    assert language.languages(documents()).count() == 0


def test_learning_reads_no_held_out_row(spark, documents):
    ids = [i for i in range(400) if is_held_out(i)][:20]
    rows = [(i, "solo held out", "xx") for i in ids] + [(i, "the cat", "en") for i in range(30) if not is_held_out(i)]
    assert {r["lang_pred"] for r in language.languages(documents(*rows)).collect()} == {"en"}


def test_presence_counts_shared_grams():
    shape = language.Shape(longest=3, slots=65_536)
    a, b = language.letters("abcd"), language.letters("xbcz")
    grams = lambda t: {t[i : i + n] for n in range(1, 4) for i in range(len(t) - n + 1)}
    k = language.presence([a, b], shape)
    want = len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b)))
    assert abs(float(k[0] @ k[1]) - want) < 1e-6


def test_quality_of_held_out_documents(spark, docs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{PATH}/labels.parquet").collect()}
    rows = QUERIES["op6_crf_quality"](spark, PATH).collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == is_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    counts = Counter(held)
    assert counts[0, 1] == 0, "clean documents stay"
    bad = counts[0, 0] + counts[1, 0]
    assert counts[0, 0] >= 0.75 * bad, "single lines that read like prose cannot be told"


def test_odd_texts_have_a_quality(spark, documents):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, None, 0), (None, 1, 0), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    rows = [(1, "A good line of text.\nAnd more."), (3, "BAD!! BAD!! BAD!!"), (5, None), (6, ""), (7, " \n\n"), (None, "x"), (8, "w " * 100_000), (8, "w")]
    out = quality.rate(documents(*rows), labels, rounds=20).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows) and got[5]["score"] == got[6]["score"] == got[7]["score"] == 0
    assert quality.rate(documents(), labels).count() == 0
    blank = quality.rate(documents((1, "text")), labels.where("false")).first()
    assert blank["score"] == 0.5 and blank["predicted"] == 0


def test_marginals_equal_the_sum_over_all_labellings():
    rng = np.random.default_rng(0)
    sizes = [1, 4, 0, 3, 5]
    starts = np.cumsum([0, *sizes])
    evidence, moves = rng.normal(size=starts[-1]), rng.normal(size=(2, 2))
    ahead, back = quality.odds(evidence, starts, moves)
    got = 1 / (1 + np.exp(-(ahead + back)))
    for k, n in enumerate(sizes):
        total, bad = 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=n):
            e = sum(evidence[starts[k] + i] for i in range(n) if labels[i])
            p = math.exp(e + sum(moves[a, b] for a, b in zip(labels, labels[1:])))
            total += p
            bad += p * np.array(labels)
        assert np.allclose(got[starts[k] : starts[k + 1]], bad / total)


def test_neighbours_stay_within_a_document():
    own = np.zeros((3, quality.OWN))
    own[:, 1] = [1, 2, 3]
    x = quality.with_neighbours(own, np.array([0, 1, 1, 3]))
    first, last = quality.OWN, quality.OWN + len(quality.NEAR) + 1
    assert x[:, first].tolist() == [0, 0, 2] and x[:, last].tolist() == [0, 3, 0]
