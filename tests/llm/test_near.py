"""Near duplicates against brute force over all pairs, and components against a union of sets."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import near
from tamis.llm.common import staged
from tamis.llm.components import components
from tamis.llm.near import Scheme, near_duplicates, shingles
from tamis.llm.queries import QUERIES, SQL

PATH = "/root/testdata/sf0.001"


def sets_of(text, width=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    n = min(width, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows):
    """``{(doc_id, n, component)}`` by comparing every pair."""
    sets = [sets_of(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                group[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted((str(d), len(sets[i]), str(least.get(root(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def found(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def varied(seed, copies, words=60):
    """Texts in groups: each copy changes one word of the text or of another copy."""
    rng = random.Random(seed)
    out, doc = [], 1000
    for size in copies:
        group = [[f"w{rng.randrange(400)}" for _ in range(words)]]
        while len(group) < size:
            text = list(rng.choice(group))
            text[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
            group.append(text)
        for text in group:
            out.append((doc, " ".join(text)))
            doc -= 1
    rng.shuffle(out)
    return out


def test_chains_of_copies_keep_every_link(spark, documents):
    rows = varied(3, [40, 12, 2, 2, 1, 1, 1])
    assert found(near_duplicates(documents(*rows))) == brute(rows)


def test_odd_rows(spark, documents):
    same = "One two three four five six seven"
    rows = [
        (5, same), (3, same.upper()), (9, "one  two\tthree\nfour five six seven"), (3, same), (1, None), (2, ""), (4, " \n "),
        (6, "one"), (7, "ONE"), (8, "one two"), (10, "two one"), (None, same), (None, "all alone"), (11, "É é"), (12, "é é"),
    ]
    out = near_duplicates(documents(*rows), carry=True)
    assert found(out) == brute(rows)
    kept = out.where("first_row")
    # One row of each component and every row without words; the columns come back unchanged.
    assert kept.count() == 3 + 1 + 1 + 1 + 1 + 1 + 1 + 1
    assert kept.select("row.*").columns == documents().columns
    flags = {(r["doc_id"], r["n_shingles"]): r["kept"] for r in out.collect()}
    assert flags[3, 5] and not flags[5, 5] and flags[1, 0]
    assert near_duplicates(documents()).count() == 0


def test_a_bucket_with_several_components_is_searched_to_the_end(spark, documents):
    """With one hash in one collection a side nearly everything shares a bucket."""
    rows = varied(5, [6, 5, 4], words=40)
    weak = Scheme(collections=1, hashes=1)
    strong = brute(rows)
    shared = {doc: comp for doc, _, comp in found(near_duplicates(documents(*rows), weak))}
    whole = {doc: comp for doc, _, comp in strong}
    assert all(shared[d] >= whole[d] or shared[d] == d for d in shared)


def nearly(seed, copies, words, changed):
    """Copies of one text, each with words of its own in some places."""
    rng = random.Random(seed)
    text = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for doc in range(copies):
        own = list(text)
        for at in rng.sample(range(0, words, 4), changed):
            own[at] = f"x{rng.randrange(10**9)}"
        out.append((doc, " ".join(own)))
    return out


def test_copies_around_the_limit_keep_every_link(spark, documents):
    rows = nearly(2, 150, 200, 5) + [(1000 + d, t) for d, t in nearly(3, 150, 300, 9)] + [(2000 + d, t) for d, t in nearly(4, 60, 50, 1)]
    assert found(near_duplicates(documents(*rows))) == brute(rows)


def test_links_that_heads_miss_are_found_by_rare_shingles(spark, documents, monkeypatch):
    """Nothing but tables with everything in them: heads link little, the rest comes by shingles."""
    rows = varied(11, [30, 20, 10, 2, 2], words=60)
    monkeypatch.setattr(near, "_heads", heads_of_largest(near._heads))
    weak = Scheme(collections=14, hashes=1)
    assert found(near_duplicates(documents(*rows), weak)) == brute(rows)


def strayed(seed, copies, words, least, most):
    """Copies of one text that differ from it by ``least`` to ``most`` words, from a pool that repeats."""
    rng = random.Random(seed)
    text = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for doc in range(copies):
        own = list(text)
        for at in rng.sample(range(words), rng.randint(least, most)):
            own[at] = f"x{rng.randrange(40)}"
        out.append((doc, " ".join(own)))
    return out


def test_links_between_large_groups_are_found_by_differences(spark, documents, monkeypatch):
    """Every pair that links through places of differences alone."""
    monkeypatch.setattr(near, "FEW", 1)
    rows = strayed(6, 120, 150, 2, 6) + [(1000 + d, t) for d, t in varied(11, [30, 20, 2], words=60)]
    assert found(near_duplicates(documents(*rows), Scheme(collections=14, hashes=1))) == brute(rows)


def test_copies_below_the_limit_do_not_all_meet(spark, documents, monkeypatch):
    """600 copies, most pairs at similarities of 0.6 to 0.84: few of the 179,700 pairs are compared."""
    compared, compare = [], near._compare

    def counted(pairs, *more):
        compared.append(pairs.count())
        return compare(pairs, *more)

    monkeypatch.setattr(near, "_compare", counted)
    rows = strayed(8, 600, 150, 4, 8)
    out = near_duplicates(documents(*rows))
    assert found(out) == brute(rows)
    assert sum(compared) < 179_700 / 4


def test_pairs_that_differ_too_much_are_left_out_by_the_join(spark, documents, monkeypatch):
    """Of 600 copies hardly more pairs come out of the joins of places than link."""
    made, met = [], near._met

    def counted(*args):
        pairs = met(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(near, "_met", counted)
    rows = strayed(8, 600, 150, 4, 8)
    assert found(near_duplicates(documents(*rows))) == brute(rows)
    assert sum(made) < 1500


def test_pairs_meet_in_one_place_of_their_differences(spark):
    """Sets that lack the same ten of the head's elements share nine places; each pair comes once."""
    held = {0: list(range(100))} | {n: [*range(10, 100), 1000 + n] for n in range(1, 21)}
    rows = [(n, x, near.parities(np.array(x, np.uint64)).tolist()) for n, x in held.items()]
    sets = spark.createDataFrame(rows, "node bigint, set array<bigint>, parities array<bigint>")
    met = spark.createDataFrame([(0, n, n, 91) for n in range(1, 21)], "head bigint, node bigint, label bigint, n bigint")
    places = near._differing(met, sets, Scheme())
    assert places.count() > 2 * 20
    pairs = [tuple(r) for r in near._meeting(places, sets, Scheme()).collect()]
    assert sorted(pairs) == [(a, b) for a in range(1, 21) for b in range(a + 1, 21)]


def test_parities_differ_in_no_more_bits_than_sets_in_elements():
    rng = np.random.default_rng(4)
    for size in (0, 1, 30, 400, 5000):
        one = np.unique(rng.integers(0, 2**64, size, np.uint64))
        two = np.unique(np.concatenate([one[rng.random(len(one)) < 0.8], rng.integers(0, 2**64, 40, np.uint64)]))
        bits = sum(int(x).bit_count() for x in (near.parities(one) ^ near.parities(two)).view(np.uint64))
        assert bits <= len(np.setxor1d(one, two)) and len(near.parities(one)) == near.PARITIES
        assert not (near.parities(one) ^ near.parities(one)).any()


def heads_of_largest(heads):
    """Heads that are the largest nodes instead of the smallest: any head must do."""
    from pyspark.sql import functions as F

    def run(members):
        return members.groupBy("cell").agg(F.max("node").alias("head"), F.count("*").alias("_n")).where("_n > 1").select("cell", "head")

    return run


def test_the_result_is_one_join_of_written_tables(spark, documents, capsys):
    """Looking for frequent keys beforehand multiplies the plans that the driver holds."""
    near_duplicates(documents(*varied(7, [6, 3, 1]))).explain()
    plan = capsys.readouterr().out
    assert "Join" in plan and "Aggregate" not in plan and "Union" not in plan


def shuffled_files(spark):
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_behind(spark):
    """Before, shuffles stayed on disk until the driver happened to collect its garbage."""
    before = shuffled_files(spark)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before = spark.conf.get(name, None)
    made = staged(spark.range(20_000).repartition(5, "id").groupBy((F.col("id") % 1_000).alias("k")).count(), "test")
    assert sorted(r["count"] for r in made.collect()) == [20] * 1_000
    assert spark.conf.get(name, None) == set_before
    for _ in range(100):
        left = shuffled_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left


def test_cells_with_components_left_beside_the_head(spark, capsys):
    rng = random.Random(8)
    label = [rng.randrange(6) for _ in range(60)]
    rows = sorted({(rng.randrange(40), node) for node in range(60) for _ in range(4)})
    want = []
    for cell in range(40):
        rest = sorted(node for c, node in rows if c == cell)[1:]
        if len({label[node] for node in rest}) > 1:
            want += [(cell, node, label[node]) for node in rest]
    members = spark.createDataFrame([(c, n, label[n]) for c, n in rows], "cell bigint, node bigint, label bigint")
    out = near._apart(members)
    capsys.readouterr()
    out.explain()
    plan = capsys.readouterr().out
    # Dozens of these plans are made; the driver keeps what they say.
    assert plan.count("Join") == 1 and "Union" not in plan and "Aggregate" not in plan
    assert sorted(map(tuple, out.collect())) == sorted(want) and 0 < len(want) < len(rows)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()]
    out = QUERIES["op7_tensored_minhash"](spark, PATH)
    assert found(out) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect())
    assert "op7_tensored_minhash" in SQL


@pytest.mark.parametrize("text, n", [(None, 0), ("", 0), ("a", 1), ("a b", 1), ("a b c d", 2), ("a b c a b c", 3)])
def test_shingles(text, n):
    assert len(shingles(text, 3)) == n


def test_components_of_long_ways(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    labels = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert labels == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 200: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
