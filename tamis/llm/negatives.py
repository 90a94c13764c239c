"""Hard negatives by exact integer scores from a residue number system.

Integer vectors are reduced modulo several small primes, each residue matrix is multiplied in
float32, where no sum reaches 2**24 and every product is exact, and the signed scores come back by
Chinese remaindering in mixed radix. As many primes are taken as the lengths of the vectors at hand
ask for, so scores are exact whatever the vectors.

Anchors, a stated set, meet all rows in blocks: a task holds at most about ``block`` rows and ``part``
anchors. A first pass finds the positives of each anchor and multiplies rows of the same label only;
a second one selects, for each positive score, the best rows of other labels in its window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import staged

#: Inner dimensions multiplied at a time, and the largest prime that keeps their sum below 2**24.
INNER, LARGEST_PRIME = 64, 1021
#: Anchors scored at a time.
AT_ONCE = 256
#: Below every score: the squared length of a vector is at most 2**60.
NEVER = -(2**62)


@dataclass(frozen=True)
class Mining:
    """``every``: anchors are rows whose id it divides. ``low`` and ``high``: the window in percent of the
    positive's score. ``scale``: integer units per 1.0 of a component."""

    every: int = 100
    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    scale: int = 256
    block: int = 8192
    part: int = 8192


def primes() -> Iterator[int]:
    """Primes from ``LARGEST_PRIME`` down."""
    for n in range(LARGEST_PRIME, 1, -1):
        if all(n % d for d in range(2, int(n**0.5) + 1)):
            yield n


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` modulo the odd ``p``, from ``-p // 2`` to ``p // 2``."""
    return (x + p // 2) % p - p // 2


def residue_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, exact; no row's squared length may exceed 2**60."""
    lengths = [np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) for x in (a, b)]
    bound = int(lengths[0] * lengths[1] * 1.000001) + 1
    value, radix = np.zeros((len(a), len(b)), np.int64), 1
    for p in primes():
        x, y = centred(a, p).astype(np.float32), centred(b, p).astype(np.float32)
        product = np.zeros_like(value)
        for i in range(0, a.shape[1], INNER):
            product += (x[:, i : i + INNER] @ y[:, i : i + INNER].T).astype(np.int64)
        # The next mixed-radix digit; the digits are signed, so is the value they make.
        digit = centred((product - value) % p * pow(radix, -1, p), p)
        value += digit * radix
        radix *= p
        if radix > 2 * bound:
            return value
    raise ValueError("vectors are too long for the primes at hand")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists as rows; shorter ones end in zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = min(a.shape[1], b.shape[1])
    return a[:, :width], b[:, :width]


def _by_id(rows: pa.Table) -> pa.Table:
    """In order of ids, so that a stable sort by score breaks ties by the smaller."""
    return rows.sort_by("vec_id")


_POSITIVES = "anchor bigint, vec_id bigint, score bigint"
_NEGATIVES = "anchor bigint, high bigint, vec_id bigint, score bigint"


def _table(columns: dict[str, list[np.ndarray]]) -> pa.Table:
    joined = {n: np.concatenate(v) if v else np.zeros(0) for n, v in columns.items()}
    return pa.table({n: pa.array(v.astype(np.int64), pa.int64()) for n, v in joined.items()})


def _best_of_label(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The ``k`` best rows of each anchor's label, rows of its own id excepted."""
    rows = _by_id(rows)
    a, b = _same_width(matrix(anchors["units"]), matrix(rows["units"]))
    codes, _ = pd.factorize(pd.concat([anchors["label"].to_pandas(), rows["label"].to_pandas()]))
    anchor_ids, ids, anchor = (np.asarray(c) for c in (anchors["vec_id"], rows["vec_id"], anchors["row"]))
    out = {"anchor": [], "vec_id": [], "score": []}
    groups = pd.Series(np.arange(len(rows))).groupby(codes[len(anchors) :]).indices
    for code, asked in pd.Series(np.arange(len(anchors))).groupby(codes[: len(anchors)]).indices.items():
        held = groups.get(code)
        if held is None:
            continue
        for i in range(0, len(asked), AT_ONCE):
            some = asked[i : i + AT_ONCE]
            score = residue_products(a[some], b[held])
            score[anchor_ids[some][:, None] == ids[held][None, :]] = NEVER
            order = np.argsort(-score, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(score, order, axis=1)
            fine = best > NEVER
            out["anchor"].append(np.broadcast_to(anchor[some][:, None], best.shape)[fine])
            out["vec_id"].append(ids[held][order][fine])
            out["score"].append(best[fine])
    return _table(out)


def _best_in_windows(anchors: pa.Table, rows: pa.Table, mining: Mining) -> pa.Table:
    """For each of an anchor's positive scores the best rows of other labels in its window."""
    rows = _by_id(rows)
    a, b = _same_width(matrix(anchors["units"]), matrix(rows["units"]))
    codes, _ = pd.factorize(pd.concat([anchors["label"].to_pandas(), rows["label"].to_pandas()]))
    asked, held = codes[: len(anchors)], codes[len(anchors) :]
    ids, anchor, highs = np.asarray(rows["vec_id"]), np.asarray(anchors["row"]), matrix(anchors["highs"])
    counts = np.array([len(h) for h in anchors["highs"].to_pylist()])
    out = {"anchor": [], "high": [], "vec_id": [], "score": []}
    places = np.arange(mining.negatives)
    for i in range(0, len(a), AT_ONCE):
        some = slice(i, i + AT_ONCE)
        score = residue_products(a[some], b)
        score[asked[some][:, None] == held[None, :]] = NEVER
        order = np.argsort(-score, axis=1, kind="stable")
        score = np.take_along_axis(score, order, axis=1)
        for j in range(highs.shape[1]):
            high = highs[some][:, j]
            # Whole numbers of any size: a percentage of a score may not fit in 64 bits.
            exact = high.astype(object)
            least = (-(-exact * mining.low // 100)).astype(np.int64)
            most = (exact * mining.high // 100).astype(np.int64)
            at = (score > most[:, None]).sum(axis=1)[:, None] + places
            found = np.take_along_axis(score, np.minimum(at, score.shape[1] - 1), axis=1)
            fine = (at < score.shape[1]) & (found >= least[:, None]) & (found > NEVER) & (counts[some] > j)[:, None]
            who = np.take_along_axis(order, np.minimum(at, score.shape[1] - 1), axis=1)
            out["anchor"].append(np.broadcast_to(anchor[some][:, None], at.shape)[fine])
            out["high"].append(np.broadcast_to(high[:, None], at.shape)[fine])
            out["vec_id"].append(ids[who][fine])
            out["score"].append(found[fine])
    return _table(out)


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """``(vec_id, label, units)`` of the rows that take part, components as whole units."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    units = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    rows = rows.select("vec_id", "label", units.alias("units"))
    squared = F.aggregate("units", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return rows.where(squared <= 2.0**60)


def hard_negatives(vectors: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of
    ``vectors(vec_id, label, embedding)``.

    An anchor's positives are its best rows of the same label and another id; the negatives of each are
    the best rows of other labels whose score lies in the window below the positive's. Ties go by the
    smaller id. Rows with a null id, label, vector or component or a component that is not finite take
    no part, nor do vectors longer than 2**30 units, whose scores would not fit in 64 bits. Of vectors of
    different lengths the shorter one counts as ending in zeros. Rows that share an id are separate
    rows, but not each other's positives. An anchor without a positive, and a positive without a
    negative in its window, give no rows; so does an empty table. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select("vec_id", "label", "embedding"), mining.scale)
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("asks", F.col("vec_id") % mining.every == 0)
    rows = staged(rows, "units")
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, parts = max(1, -(-n // mining.block)), max(1, -(-asking // mining.part))

    def placed(df: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        """Rows in one of ``count`` places by their hash, once for each of the ``others``."""
        hashed = F.pmod(F.xxhash64("row", F.lit(own)), F.lit(count)).cast("bigint")
        named = [F.col(c).alias(c) for c in df.columns]
        return df.select(*named, hashed.alias(own), F.explode(F.expr(f"sequence(0L, {others - 1}L)")).alias(other))

    def met(asked: DataFrame):
        """All rows beside ``asked``, by block and part."""
        held = placed(rows.drop("asks"), "block", blocks, "part", parts).groupBy("block", "part")
        return placed(asked, "part", parts, "block", blocks).groupBy("block", "part").cogroup(held)

    anchors = rows.where("asks").drop("asks")

    def positives_of(a: pa.Table, b: pa.Table) -> pa.Table:
        return _best_of_label(a, b, mining.positives) if len(a) and len(b) else _table({"anchor": [], "vec_id": [], "score": []})

    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    positives = met(anchors).applyInArrow(positives_of, _POSITIVES)
    positives = positives.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= mining.positives).drop("_r")
    positives = staged(positives, "positives")

    # Positives of equal scores have the same window.
    highs = positives.groupBy("anchor").agg(F.sort_array(F.collect_set("score")).alias("highs"))
    windowed = anchors.join(highs.withColumnRenamed("anchor", "row"), "row")

    def negatives_of(a: pa.Table, b: pa.Table) -> pa.Table:
        empty = {"anchor": [], "high": [], "vec_id": [], "score": []}
        return _best_in_windows(a, b, mining) if len(a) and len(b) else _table(empty)

    of_window = Window.partitionBy("anchor", "high").orderBy(F.desc("score"), "vec_id")
    negatives = met(windowed).applyInArrow(negatives_of, _NEGATIVES)
    negatives = negatives.withColumn("rank", F.row_number().over(of_window)).where(F.col("rank") <= mining.negatives)
    chosen = positives.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("high"))
    found = chosen.join(negatives, ["anchor", "high"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return found.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
        F.col("high").alias("positive_score"), F.col("score").alias("negative_score"),
    )
