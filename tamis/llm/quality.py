"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good or bad. A line's evidence is linear in its own features and those of
the lines beside it; a table of transitions ties neighbouring labels. Marginals come from the
forward-backward recursion, here in log odds of bad against good, and a document's score is the
mean probability of good over its lines, weighted by their lengths.

Only documents are labelled. Lines start with the label of their document; after a first fit without
transitions the lines of bad documents that look good are taken for good, and the field is fitted to
the labels so mended.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import held_out, learnable, texts

_SYMBOLS = "#*$%&|<>!{}[]=~^\\_@+"
#: Features of a line, and those of its neighbours that count as well.
OWN, NEAR = 10, (1, 2, 3, 4)
WIDTH = OWN + 2 * (len(NEAR) + 1)


@dataclass(frozen=True)
class Field:
    """``weights`` of bad against good; ``moves[i, j]`` from label i to j, 0 good and 1 bad; scores are
    raised to ``power``."""

    weights: np.ndarray
    moves: np.ndarray
    power: float = 1.0


def lines(text: str | None) -> list[tuple[float, ...]]:
    """Length and own features of each line with a word."""
    out = []
    for line in (text or "").split("\n"):
        words = line.split()
        n = len(words)
        if n:
            size, last = len(line), words[-1]
            out.append(
                (
                    size,
                    1.0,
                    sum(map(str.isupper, words)) / n,
                    min(2.0, sum(map(line.count, _SYMBOLS)) / n) / 2,
                    1 - len(set(words)) / n,
                    sum(map(eq, words, words[1:])) / n,
                    sum(map(str.isdigit, words)) / n,
                    float(n < 4),
                    min(n, 200) ** 0.5 / 14,
                    min(size / n, 40) / 20,
                    float(last[-1] in ".!?:;…。\"'"),
                )
            )
    return out


def with_neighbours(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows of consecutive documents; ``starts`` has the first row of each and the end."""
    n = len(own)
    out = np.zeros((n, WIDTH), np.float64)
    out[:, :OWN] = own
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    begun = starts[:-1][starts[:-1] < starts[1:]]
    first[begun] = True
    last[(starts[1:] - 1)[starts[:-1] < starts[1:]]] = True
    at = OWN
    for edge, step in ((first, 1), (last, -1)):
        beside = np.where(edge[:, None], 0, np.roll(own[:, NEAR], step, axis=0))
        out[:, at : at + len(NEAR)] = beside
        out[:, at + len(NEAR)] = edge
        at += len(NEAR) + 1
    return out


def _steps(starts: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the first lines of all documents, of the second lines, and so on."""
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    begun, sizes = starts[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    more = np.searchsorted(-sizes, -np.arange(longest), side="left")
    return [begun[: more[t]] + t for t in range(longest)]


def odds(evidence: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward (with the line's own evidence) and backward log odds of each line."""
    steps = _steps(starts)
    ahead, back = evidence.copy(), np.zeros_like(evidence)
    for t in range(1, len(steps)):
        rows = steps[t]
        a = ahead[rows - 1]
        ahead[rows] += np.logaddexp(a + moves[1, 1], moves[0, 1]) - np.logaddexp(a + moves[1, 0], moves[0, 0])
    for t in range(len(steps) - 1, 0, -1):
        rows = steps[t]
        s = evidence[rows] + back[rows]
        back[rows - 1] = np.logaddexp(s + moves[1, 1], moves[1, 0]) - np.logaddexp(s + moves[0, 1], moves[0, 0])
    return ahead, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _fit(x: np.ndarray, bad: np.ndarray, starts: np.ndarray, chained: bool, rounds: int, decay: float) -> Field:
    """Maximum likelihood by Adam; every document counts the same in the step size only."""
    n = max(1, len(x))
    inner = np.ones(len(x), bool)
    inner[starts[:-1][starts[:-1] < starts[1:]]] = False
    later = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (bad[later - 1].astype(int), bad[later].astype(int)), 1)
    theta = np.zeros(WIDTH + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        weights, moves = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        evidence = x @ weights
        ahead, back = odds(evidence, starts, moves)
        slope = np.concatenate([x.T @ (_sigmoid(ahead + back) - bad), np.zeros(4)])
        if chained and len(later):
            a, s = ahead[later - 1], evidence[later] + back[later]
            joint = np.stack([moves[0, 0] + 0 * a, moves[0, 1] + s, moves[1, 0] + a, moves[1, 1] + a + s])
            joint = np.exp(joint - joint.max(0))
            slope[WIDTH:] = (joint / joint.sum(0)).sum(1) - seen.ravel()
        slope = slope / n + decay * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:WIDTH], theta[WIDTH:].reshape(2, 2))


def fit(
    docs: DataFrame, labels: DataFrame, per_label: int = 1500, rounds: int = 150, decay: float = 1e-4
) -> Field:
    """Learn from at most ``per_label`` learnable documents of each label, taken by hash of the id.

    ``labels`` has ``(doc_id, quality)`` with 1 good and 0 bad; other values, nulls and labels of
    absent documents do not count; a document with both labels counts as either. Without any
    label all evidence is zero. The driver gets line features, not texts.
    """

    @F.arrow_udf("binary")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for n, parts in texts(batches):
            rows = [np.array(lines(t), np.float32).tobytes() for part in parts for t in part]
            yield pa.array(rows, pa.binary())

    known = labels.where(learnable(F.col("doc_id")) & F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct()
    present = known.join(docs.where(F.col("text").isNotNull()).select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [present.where(F.col("quality") == q).orderBy(*order).limit(per_label) for q in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    found = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "quality", features("text").alias("f"))
    rows = sorted(found.collect(), key=lambda r: (r["doc_id"], r["quality"], bytes(r["f"])))
    own = [np.frombuffer(r["f"], np.float32).reshape(-1, OWN + 1) for r in rows]
    if not sum(map(len, own)):
        return Field(np.zeros(WIDTH), np.zeros((2, 2)))
    starts = np.cumsum([0, *map(len, own)])
    x = with_neighbours(np.concatenate(own)[:, 1:].astype(np.float64), starts)
    bad = np.repeat([r["quality"] == 0 for r in rows], np.diff(starts)).astype(np.float64)
    first = _fit(x, bad, starts, False, rounds, decay)
    mended = bad * (x @ first.weights > 0)
    field = _fit(x, mended, starts, True, rounds, decay)
    # Good documents lie close to 1: the power moves the middle between them and 0.7 to 0.7.
    good = _weighed(x @ field.weights, np.concatenate(own)[:, 0], starts, field.moves)
    good = good[[r["quality"] == 1 and len(o) > 0 for r, o in zip(rows, own)]]
    low = float(np.quantile(good, 0.01)) if len(good) else 0.7
    return Field(field.weights, field.moves, float(np.log(0.7) / np.log((0.7 + max(0.7, low)) / 2)))


def _weighed(evidence: np.ndarray, sizes: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the probability of good, for each document."""
    ahead, back = odds(evidence, starts, moves)
    good = np.cumsum(np.concatenate([[0], sizes * _sigmoid(-ahead - back)]))
    total = np.cumsum(np.concatenate([[0], sizes]))
    share = (good[starts[1:]] - good[starts[:-1]]) / np.maximum(total[starts[1:]] - total[starts[:-1]], 1)
    return np.clip(share, 0, 1)


def scores(batch: list[str | None], field: Field) -> list[float]:
    """Length-weighted probability of good; a text without a word scores 0."""
    own = [np.array(lines(t), np.float64).reshape(-1, OWN + 1) for t in batch]
    starts = np.cumsum([0, *map(len, own)])
    rows = np.concatenate(own)
    evidence = with_neighbours(rows[:, 1:], starts) @ field.weights
    return (_weighed(evidence, rows[:, 0], starts, field.moves) ** field.power).tolist()


def score(text: Column, field: Field) -> Column:
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for n, parts in texts(batches, 512):
            yield pa.array([s for part in parts for s in scores(part, field)], pa.float64())

    return run(text)


def rate(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``.

    Null and empty texts, and those of white space, score 0. Rows with a null id are scored, never
    learnt from and not held out. Repeated rows stay.
    """
    field = fit(docs, labels, **options)
    found = docs.select("doc_id", score(F.col("text"), field).alias("score"))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
