"""Quality rules and license votes against plain versions."""

import math
import re
from collections import Counter

import xxhash

from tamis.llm import licences, rules
from tamis.llm.queries import QUERIES, SQL

PATH = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    None, "", " \n\t", "word", "a\x0bb\x0cc", "#*$%&|<>", "x\n\nx\n x\nx", "\n".join(["same line"] * 30),
    " ".join("one two three four five six seven eight".split() * 3), "spam " * 40, "ham spam " * 3000, "é ü ß " * 10,
    " ".join(f"w{i}" for i in range(25)), "  ", "end\r\nend\r\n",
]


def base(text):
    text = text or ""
    w = SPLIT.findall(text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if SPLIT.search(line):
            repeated += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), failed


def grams(text, buckets):
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    h = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in SPLIT.findall(text or "")]
    little = lambda x: (x % 2**64).to_bytes(8, "little")
    two = [
        signed(xxhash.xxh64_intdigest(little(b), seed=xxhash.xxh64_intdigest(little(a), seed=42))) for a, b in zip(h, h[1:])
    ]
    return [g % buckets for g in h + two]


def check(rows, texts, trusted, settings):
    raw, target = Counter(), Counter()
    for doc, text in texts:
        found = grams(text, settings.buckets)
        raw.update(found)
        if doc in trusted:
            target.update(found)
    n_raw, n_target = sum(raw.values()) + settings.buckets, sum(target.values()) + settings.buckets
    want = []
    for doc, text in texts:
        found = grams(text, settings.buckets)
        llr = sum(math.log((target[g] + 1) / n_target) - math.log((raw[g] + 1) / n_raw) for g in found) / max(1, len(found))
        b = base(text)
        want.append((str(doc), *b, not b[-1] and llr >= settings.threshold, round(llr, 9) + 0.0))
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    got = [(str(r["doc_id"]), *(r[n] for n in names), round(r["llr"], 9) + 0.0) for r in rows]
    assert sorted(got) == sorted(want)


def test_rules_on_odd_texts(spark, documents):
    texts = [*enumerate(ODD), (None, "no id " * 5), (3, "word"), (3, "word")]
    trusted = spark.createDataFrame([(12,), (11,), (None,), (999,), (12,)], "doc_id bigint")
    settings = rules.Rules(buckets=64)
    check(rules.judge(documents(*texts), trusted, settings).collect(), texts, {11, 12}, settings)
    assert rules.judge(documents(), trusted).count() == 0


def test_rules_query(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()]
    good = {r["doc_id"] for r in spark.read.parquet(f"{PATH}/labels.parquet").where("quality = 1").collect()}
    rows = QUERIES["op9_loglik_rules"](spark, PATH).collect()
    check(rows, texts, good, rules.Rules())
    kept = {r["doc_id"]: r["kept"] or r["base_failed"] for r in rows}
    assert all(kept[d] for d in good if d in kept), "clean documents stay"


def places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [
        (i, label) for label, phrase in licences.BASE for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p
    ]
    starts = [i for i, _ in found]
    labels = sorted({label for _, label in found})
    return len(w), len(found), min(starts, default=None), max(starts, default=None), labels


def test_licences_on_odd_texts(spark, documents):
    mit = next(t for label, t in licences.NOTICES if t.startswith("permission is hereby"))
    texts = [
        (1, None), (2, ""), (3, "MIT License"), (4, "the mit-license, MIT\nLICENSE mit licenses"), (5, "cc by cc by"),
        (6, "Licensed under CC BY-NC 4.0."), (7, "GNU General Public License gnu general public license"), (8, "K cc by İ"),
        (9, mit.replace("any person", "any of the persons").upper()), (10, "permission is hereby granted"), (None, "cc by"),
        (3, "MIT License"), (3, "other"), (11, "all rights reserved. All rights, reserved"), (12, "x " * 40_000 + "cc by"),
        (13, "é" * 50 + " apache license"), (14, "licensed under the apache license version 2 0"),
    ]
    out = licences.scan(documents(*texts)).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out), key=str)
    want = sorted(((d, *places(t)[:4], ",".join(places(t)[4])) for d, t in texts), key=str)
    assert got == want
    labels = {(r["doc_id"], r["n_words"]): (r["labels"], r["score"]) for r in out}
    assert labels[6, 7] == ("cc-by,cc-by-nc-4.0", 1.0)
    assert labels[9, places(texts[8][1])[0]][0] == "mit" and labels[9, places(texts[8][1])[0]][1] < 1
    assert labels[10, 4][0] == "" and 0 < labels[10, 4][1] < 0.8
    assert labels[11, 6] == ("all-rights-reserved", 1.0)
    assert labels[14, 8][0] == "apache,apache-2.0"
    assert licences.scan(documents()).count() == 0
    assert "op4_diagonal_licences" in SQL


def test_time_of_licences_grows_with_the_length_of_a_text(spark, documents):
    """400,000 words take less than twelve times what 40,000 take."""
    import time

    def seconds(n):
        text = " ".join("the mit license" if i % 100 == 0 else f"w{i % 977}" for i in range(n))
        start = time.monotonic()
        (row,) = licences.scan(documents((1, text))).collect()
        assert (row["n_words"], row["n_base"], row["first_word"]) == (n + 2 * (n // 100), n // 100, 1)
        return time.monotonic() - start

    seconds(1_000)
    short = seconds(40_000)
    assert seconds(400_000) < 12 * short
