"""Mixes against the definition: targets by plain filling, cuts at the exact word, and repeatable."""

import random
import re
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from tamis.llm import mixing
from tamis.llm.mixing import Mix, mixed

SCHEMA = "doc_id bigint, text string, source string, size int, target string, _key int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA)


def size_of(text):
    return len(re.findall(mixing.WORD, text or ""))


def plain_targets(sizes, mix):
    """Share by weight, stop at the limit, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values()) * mix.share
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            return full
        left = total - sum(full.values())
        aims = {s: weight[s] * left / sum(weight[r] for r in rest) for s in rest}
        above = {s: float(mix.most * sizes[s]) for s in rest if aims[s] > mix.most * sizes[s]}
        if not above:
            return full | aims
        full |= above


def check(rows, out, mix=Mix()):
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size_of(text)
    aims = plain_targets(sizes, mix)
    taken, counts = defaultdict(int), defaultdict(list)
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(aims[r["source"]], abs=1e-6)
        assert 0 <= r["taken"] <= mix.most * r["size"]
        taken[r["source"]] += r["taken"]
        if r["size"]:
            counts[r["source"]].append((r["taken"] / r["size"]))
    for source in sizes:
        assert abs(taken[source] - aims[source]) <= 0.5 + 1e-6
        # Documents are taken as often as any other of the source, or once more; one is cut.
        passes = {int(c) for c in counts[source]}
        assert not passes or max(passes) - min(passes) <= 1
        assert sum(c != int(c) for c in counts[source]) <= 1
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in out) == sorted((i is None, i or 0, size_of(t)) for i, t, _ in rows)


def random_rows(n, sources, seed):
    rng = random.Random(seed)
    return [(i, " ".join(["wörd"] * int(rng.expovariate(0.05))), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("mix", [Mix(), Mix(range_rows=7), Mix(weights=(1, 9), share=0.3, range_rows=50), Mix(share=2.9), Mix(share=5)])
def test_mixes_follow_the_definition(spark, mix):
    rows = random_rows(300, ["a", "a", "a", "a", "b", "c", "ä", "Z", None, ""], 3)
    check(rows, mixed(table(spark, rows), mix).collect(), mix)


def test_small_sources_with_large_weights_fill_up(spark):
    rows = [(i, "w " * 50, "z") for i in range(40)] + [(100, "one two three", "a"), (101, "four", "a"), (102, "five six", "b"), (103, None, "c"), (104, " \t ", "c")]
    out = mixed(table(spark, rows)).collect()
    check(rows, out)
    got = {r["doc_id"]: r["taken"] for r in out}
    assert got[100] == 9 and got[101] == 3 and got[102] == 6 and got[103] == got[104] == 0


def test_cuts_do_not_depend_on_ranges_or_partitions(spark):
    rows = random_rows(200, ["a", "b", None], 8) + [(None, "no id", "a"), (5, "again", "a"), (5, "again", "a"), (5, "again and longer", "a")]
    make = lambda df, mix: sorted(map(str, mixed(df, mix).select("doc_id", "size", "taken").collect()))
    first = make(table(spark, rows), Mix())
    assert first == make(table(spark, rows[::-1]).repartition(5), Mix())
    assert first == make(table(spark, rows), Mix(range_rows=3))
    assert first != make(table(spark, rows), Mix(seed=1))


def test_odd_tables(spark):
    assert mixed(table(spark, [])).count() == 0
    empty = mixed(table(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 2
    (one,) = mixed(table(spark, [(1, "x " * 200_000, "a")])).collect()
    assert one["size"] == one["taken"] == 200_000 and one["target"] == 200_000


def test_drawn_texts_hold_the_words_taken(spark):
    rows = random_rows(80, ["a", "b", "c", "d"], 4)
    docs = table(spark, rows)
    out = mixed(docs, Mix(weights=(9, 1, 1, 1)))
    texts = out.join(docs.select("doc_id", "text"), "doc_id")
    texts = texts.withColumn("texts", mixing.drawn(F.col("text"), F.col("size"), F.col("taken"))).collect()
    for r in texts:
        assert sum(map(size_of, r["texts"] or [])) == r["taken"]
        assert all(r["text"].startswith(t) for t in r["texts"] or [])


def test_targets_of_many_sources(spark):
    sizes = [(0, f"s{i:05d}", 1 + i * i % 97, 1) for i in range(3000)]
    got = mixing.targets(spark.createDataFrame(sizes, "unnamed int, source string, source_size bigint, documents bigint")).collect()
    want = plain_targets({s[1]: s[2] for s in sizes}, Mix())
    assert {r["source"]: r["target"] for r in got} == pytest.approx(want)
