"""Hard negatives against plain Python numbers."""

import math
import random

import numpy as np
import pytest

from tamis.llm import negatives
from tamis.llm.negatives import Mining, hard_negatives, residue_products

SCHEMA = "vec_id bigint, embedding array<float>, label int, score int, row string, anchor string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def brute(rows, mining=Mining()):
    used = []
    for vec_id, v, label in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        units = [math.floor(mining.scale * float(np.float32(x))) for x in v]
        if sum(u * u for u in units) <= 2**60:
            used.append((vec_id, label, units))
    out = []
    for anchor, label, v in used:
        if anchor % mining.every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in used if i != anchor)
        for positive, p in [(i, -s) for s, i, other in scored if other == label][: mining.positives]:
            fits = [(i, -s) for s, i, other in scored if other != label and mining.low * p <= -100 * s <= mining.high * p]
            out += [(anchor, positive, r + 1, i, p, s) for r, (i, s) in enumerate(fits[: mining.negatives])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("size", [10, 2**20, 2**26])
def test_products_are_exact(size):
    rng = np.random.default_rng(size)
    a, b = (rng.integers(-size, size, (n, 150)) for n in (7, 9))
    want = a.astype(object) @ b.astype(object).T
    assert (residue_products(a, b) == want).all()


def test_products_at_the_limit_and_without_components():
    a = np.array([[2**30, 0], [-(2**30), 0], [0, 3]])
    assert (residue_products(a, a) == a.astype(object) @ a.astype(object).T).all()
    assert residue_products(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).tolist() == [[0] * 3] * 2


def random_rows(n, width, labels, seed, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(3)]
    return [(i, [scale * (rng.choice(centres)[j] + rng.gauss(0, 0.2)) for j in range(width)], rng.choice(labels)) for i in range(n)]


@pytest.mark.parametrize("mining", [Mining(every=7), Mining(every=3, block=40, part=13, low=50, high=90, positives=2, negatives=9)])
def test_any_blocks_give_what_plain_numbers_give(spark, mining):
    rows = random_rows(150, 8, [0, 0, 0, 1, 2], 5)
    assert found(hard_negatives(table(spark, rows), mining)) == brute(rows, mining)


def test_long_and_short_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [x * 10 ** rng.uniform(-2, 3) for x in v], label) for i, v, label in random_rows(90, 70, [0, 1], 9)]
    assert found(hard_negatives(table(spark, rows), Mining(every=5))) == brute(rows, Mining(every=5))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (3, [0.9, 0.5], 2), (4, [0.9, 0.5], 2), (5, [0.9, 0.5], 3),
        (6, [0.9, 0.5], 2), (7, [0.9, 0.5], 2), (8, [0.9, 0.5], 2), (9, None, 1), (10, [nan, 1.0], 2), (11, [inf, 1.0], 2),
        (12, [None, 1.0], 2), (13, [1.0, 1.0], None), (None, [1.0, 1.0], 2), (100, [], 1), (200, [0.9], 7), (300, [3e38, 1.0], 1),
        (14, [0.9, 0.5, 4.0], 2), (400, [-1.0, -1.0], 1),
    ]
    assert found(hard_negatives(table(spark, rows))) == brute(rows)


def test_repeated_rows_are_rows_but_not_their_own_positives(spark):
    rows = [(0, [1.0], 1), (0, [1.0], 1), (1, [0.9], 1), (2, [0.85], 2), (2, [0.85], 2)]
    got = found(hard_negatives(table(spark, rows)))
    # Two anchors, one positive each, two negatives each.
    assert [r[:4] for r in got] == [(0, 1, 1, 2), (0, 1, 1, 2), (0, 1, 2, 2), (0, 1, 2, 2)]


def test_tables_without_rows_or_partners(spark):
    assert hard_negatives(table(spark, [])).count() == 0
    assert hard_negatives(table(spark, [(0, [1.0], 1)])).count() == 0
    assert hard_negatives(table(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0


def test_a_label_with_most_rows(spark):
    rows = [(i, [math.cos(i / 50), math.sin(i / 50)], 0 if i % 3 else i % 5) for i in range(400)]
    mining = Mining(every=50, block=64, part=4)
    assert found(hard_negatives(table(spark, rows), mining)) == brute(rows, mining)


def test_primes_keep_sums_below_the_limit_of_float32():
    first = next(negatives.primes())
    assert negatives.INNER * (first // 2) ** 2 < 2**24
