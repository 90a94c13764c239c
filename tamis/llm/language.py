"""Language identification with a string kernel.

The kernel of two texts counts the character n-grams, of all lengths up to ``longest``, that occur in
both (presence, blended spectrum), divided by the root of the product of their own counts. N-grams
are hashed into ``slots``. Landmark texts of each language give the Nyström features, and one ridge
regression per language against the rest gives the scores. A ridge score is linear in the presence
vector, so landmarks, projection and regression fold into one matrix of ``slots x languages``; texts
are scored by products of batches of presence vectors with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import held_out, learnable, texts

UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Shape:
    """``longest`` n-gram; hash ``slots`` (a power of two, at most 65536)."""

    longest: int = 4
    slots: int = 16_384


@dataclass(frozen=True)
class Model:
    shape: Shape
    languages: tuple[str, ...]
    weights: np.ndarray
    intercept: np.ndarray


def letters(text: str | None) -> str:
    """Lower-case letters with single spaces around and between words; empty without a letter."""
    kept = _OTHER.sub(" ", (text or "").lower()).strip()
    return f" {kept} " if any(map(str.isalpha, kept)) else ""


def grams(kept: str, shape: Shape) -> np.ndarray:
    """Hash slots of all n-grams, with repeats."""
    code = np.frombuffer(kept.encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed = code * np.uint32(2654435761)
    shift = np.uint32(32 - shape.slots.bit_length() + 1)
    out, rolling = [], mixed
    for n in range(1, shape.longest + 1):
        if n > 1:
            if n > len(code):
                break
            rolling = (rolling[:-1] ^ (rolling[:-1] >> np.uint32(15))) * np.uint32(2246822519) + mixed[n - 1 :]
        spread = rolling ^ (rolling >> np.uint32(16))
        out.append((spread * np.uint32(3266489917 + 2 * n)) >> shift)
    return np.concatenate(out)


def presence(kept: list[str], shape: Shape) -> np.ndarray:
    """One row per text, of unit length."""
    out = np.zeros((len(kept), shape.slots), np.float32)
    for row, text in zip(out, kept):
        if text:
            row[grams(text, shape)] = 1
    norm = np.sqrt(out.sum(1, keepdims=True))
    return out / np.maximum(norm, 1)


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """Up to ``per_language`` learnable documents of each language, by hash of the id.

    Each of 64 shares of a language gives at most four times its part first, so that no task gets a
    whole language.
    """
    slim = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable(F.col("doc_id")))
    slim = slim.select("doc_id", "lang", F.xxhash64("doc_id").alias("_order"))
    share = Window.partitionBy("lang", F.pmod("_order", F.lit(64))).orderBy("_order", "doc_id")
    whole = Window.partitionBy("lang").orderBy("_order", "doc_id")
    for window, most in ((share, -(-per_language // 16)), (whole, per_language)):
        slim = slim.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= most)
    rank = slim.groupBy("doc_id", "lang").agg(F.min("_rank").alias("_rank"))
    return docs.select("doc_id", "lang", "text").join(rank, ["doc_id", "lang"]).where(F.col("text").isNotNull())


def fit(
    docs: DataFrame,
    per_language: int = 400,
    landmarks: int = 64,
    ridge: float = 1e-2,
    shape: Shape = Shape(),
) -> Model:
    """Learn from at most ``per_language`` documents of each language, of which ``landmarks`` are those.

    Only learnable rows with a language and a text count. Without any, every text is undetermined.
    The driver gets the hash slots of the sample, not its texts.
    """

    @F.arrow_udf("binary")
    def slots(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for n, parts in texts(batches):
            rows = [np.unique(grams(k, shape)).astype(np.uint16).tobytes() if k else b"" for p in parts for k in map(letters, p)]
            yield pa.array(rows, pa.binary())

    rows = sample(docs, per_language).select("lang", "_rank", "doc_id", slots("text").alias("slots")).collect()
    rows = sorted((r for r in rows if r["slots"]), key=lambda r: (r["lang"], r["_rank"], r["doc_id"]))
    languages = tuple(sorted({r["lang"] for r in rows}))
    if not rows:
        return Model(shape, (), np.zeros((shape.slots, 0), np.float32), np.zeros(0))
    x = np.zeros((len(rows), shape.slots), np.float32)
    for row, r in zip(x, rows):
        row[np.frombuffer(r["slots"], np.uint16)] = 1
    x /= np.sqrt(x.sum(1, keepdims=True))
    y = np.array([[1.0 if r["lang"] == name else -1.0 for name in languages] for r in rows])
    order, seen = [], dict.fromkeys(languages, 0)
    for i, r in enumerate(rows):
        if seen[r["lang"]] < landmarks:
            order.append(i)
            seen[r["lang"]] += 1
    marks = x[order]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > 1e-6 * values.max()
    project = vectors[:, kept] / np.sqrt(values[kept])
    features = (x @ marks.T).astype(np.float64) @ project
    # Every language weighs the same, however many of its documents are in the sample.
    weight = 1 / (y > 0).sum(0)[y.argmax(1)]
    weight = (weight / weight.sum())[:, None]
    mean, target = (weight * features).sum(0), (weight * y).sum(0)
    centred = features - mean
    gram = centred.T @ (weight * centred) + ridge * np.eye(len(mean))
    coef = np.linalg.solve(gram, centred.T @ (weight * (y - target)))
    weights = marks.T @ (project @ coef).astype(np.float32)
    return Model(shape, languages, weights, target - mean @ coef)


def identify(text: Column, model: Model, sharpness: float = 4.0) -> Column:
    """``struct(lang_pred, score)`` of each text.

    Null texts and texts without a letter are ``und`` with score 0. The score is the softmax of the
    ridge scores times ``sharpness``. Of equal scores the language first in the alphabet wins.
    """

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for n, parts in texts(batches, 64):
            names, scores = [], []
            for part in parts:
                kept = list(map(letters, part))
                if not model.languages:
                    names += [UNDETERMINED] * len(kept)
                    scores += [0.0] * len(kept)
                    continue
                ridge = presence(kept, model.shape) @ model.weights + model.intercept
                best = ridge.argmax(1)
                share = np.exp(sharpness * (ridge - ridge.max(1, keepdims=True)))
                names += [model.languages[b] if k else UNDETERMINED for b, k in zip(best, kept)]
                scores += [float(s) if k else 0.0 for s, k in zip(1 / share.sum(1), kept)]
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"]
            )

    return run(text)


def languages(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row per row of ``docs``.

    Rows with a null id are scored, never learnt from and not held out. Repeated rows stay.
    """
    model = fit(docs, **options)
    found = docs.select("doc_id", identify(F.col("text"), model).alias("_found"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_found.lang_pred", "_found.score")
