"""Approximate nearest neighbours along shifted Hilbert curves.

Vectors are projected to a few dimensions in several ways, shifted, and ordered by the Hilbert curve
through the cells they fall in. Each ordering is cut into key ranges at quantiles of all keys. A query
is compared with all vectors of its range and of the ranges beside it, and what the orderings find
is merged and ranked by the exact measure on the original vectors.

Ranges hold about ``1 / cells`` of all vectors. Large ones are worked on in blocks of at most
``block`` vectors and ``block`` queries, so a task's memory does not grow with the table.
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


@dataclass(frozen=True)
class Curves:
    """Number of orderings, dimensions and bits of each, key ranges, and rows in a block."""

    orderings: int = 16
    dimensions: int = 8
    bits: int = 7
    cells: int = 32
    block: int = 4096
    seed: int = 11


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions of integer points (rows, ``bits`` bits a coordinate) on the Hilbert curve."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns and reflections of the sub-cubes, from the coarsest on
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def projections(width: int, curves: Curves) -> tuple[np.ndarray, np.ndarray]:
    """For each ordering orthonormal directions, and shifts in units of the curve's cube."""
    rng = np.random.default_rng(curves.seed)
    made = []
    for _ in range(curves.orderings):
        q, _ = np.linalg.qr(rng.standard_normal((width, min(width, curves.dimensions))))
        made.append(np.pad(q.T, ((0, curves.dimensions - q.shape[1]), (0, 0))))
    return np.array(made), rng.random((curves.orderings, curves.dimensions))


def keys(vectors: np.ndarray, curves: Curves) -> np.ndarray:
    """``(rows, orderings)`` Hilbert keys. Directions count, lengths do not."""
    directions, shifts = projections(vectors.shape[1], curves)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.empty((len(vectors), curves.orderings), np.int64)
    side = (1 << curves.bits) - 1
    for c in range(curves.orderings):
        # The projections of unit vectors spread like 1 / sqrt(width); four spreads and the shift fit.
        at = (unit @ directions[c].T) * np.sqrt(vectors.shape[1]) / 4
        place = (np.clip(at, -1, 1) + 1 + shifts[c]) / 3
        out[:, c] = hilbert_keys(np.clip(place * side, 0, side).astype(np.int64), curves.bits)
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` of rows that take part: not null, not zero, all components finite, and of the
    length that most rows have (of equally common lengths the smallest)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", v.alias("v"), F.size("embedding").alias("size")).where(fine)
    size = rows.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).select("size")
    return rows.join(F.broadcast(size), "size").select("vec_id", "v")


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, curves: Curves = Curves()) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every`` the ``k`` rows
    of largest inner product that were found, itself excepted; equal scores go by the smaller id.

    Equal vectors are one entry with its ``k + 1`` smallest ids, however many there are. Rows that
    share an id are separate. Vectors that do not take part are neither queries nor found. With
    few vectors (three ranges or fewer) all are compared. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select("vec_id", "embedding"))
    rows = rows.withColumn("h", F.xxhash64("v")).withColumn("asks", F.col("vec_id") % every == 0)
    rows = staged(rows, "vectors")
    # The smallest ids of each distinct vector: first of each share of it, then of all.
    members, most = rows.select("v", "h", "vec_id"), k + 1
    for part in ([F.pmod(F.xxhash64("vec_id"), F.lit(64))], []):
        window = Window.partitionBy("h", "v", *part).orderBy("vec_id")
        members = members.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= most).drop("_r")
    lists = members.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.groupBy("h", "v").agg(F.max("asks").alias("asks"))
    points = staged(lists.join(asked, ["h", "v"]).withColumn("node", F.monotonically_increasing_id()), "points")
    n, asking = points.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("int")), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    @F.arrow_udf("array<bigint>")
    def placed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            width = len(batch[0]) if len(batch) else 0
            found = keys(batch.flatten().to_numpy().reshape(-1, width), curves) if len(batch) else []
            yield pa.array(list(found), pa.list_(pa.int64()))

    first = F.element_at("ids", 1).alias("low")
    keyed = points.select("node", "v", "asks", first, F.posexplode(placed("v")).alias("ordering", "key"))
    keyed = staged(keyed, "keyed")
    cells = int(max(1, min(curves.cells, n // 64)))
    inner = [i / cells for i in range(1, cells)]
    if inner:
        ends = keyed.groupBy("ordering").agg(F.percentile_approx("key", inner, 10_000).alias("ends"))
        # One row per ordering with an end per range.
        keyed = keyed.join(F.broadcast(ends), "ordering").withColumn("cell", F.size(F.filter("ends", lambda e: e < F.col("key")))).drop("ends")
    else:
        keyed = keyed.withColumn("cell", F.lit(0))
    blocks = max(1, -(-2 * n // (cells * curves.block)))
    asks = max(1, -(-6 * int(asking) // (cells * curves.block)))
    hashed = lambda salt, to: F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(to)).cast("bigint")
    every_one = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
    row = ["ordering", "cell", "block", "part", "node", "low", "v"]
    candidates = keyed.withColumn("block", hashed(1, blocks)).withColumn("part", every_one(asks)).select(*row, F.lit(False).alias("asks"))
    beside = [F.greatest(F.col("cell") - 1, F.lit(0)), F.col("cell"), F.least(F.col("cell") + 1, F.lit(cells - 1))]
    queries = keyed.where("asks").withColumn("part", hashed(2, asks)).withColumn("cell", F.explode(F.array_distinct(F.array(*beside))))
    queries = queries.withColumn("block", every_one(blocks)).select(*row, F.lit(True).alias("asks"))

    def best(group: pd.DataFrame) -> pd.DataFrame:
        asked, held = group[group["asks"]], group[~group["asks"]]
        empty = pd.DataFrame({"query": [], "node": [], "low": [], "score": []})
        if not len(asked) or not len(held):
            return empty.astype({"query": "int64", "node": "int64", "low": "int64", "score": "float64"})
        held = held.sort_values("low")
        x = np.stack(held["v"].to_list())
        node, low, out = held["node"].to_numpy(), held["low"].to_numpy(), []
        for i in range(0, len(asked), 256):
            some = asked.iloc[i : i + 256]
            score = np.stack(some["v"].to_list()) @ x.T
            kept = min(most, len(held))
            # Rows are in order of their ids and the sort is stable, so ties go to the smaller.
            limit = np.partition(score, -kept, axis=1)[:, -kept]
            for q, line, least in zip(some["node"].to_numpy(), score, limit):
                at = np.flatnonzero(line >= least)
                at = at[np.argsort(-line[at], kind="stable")[:kept]]
                out.append(pd.DataFrame({"query": q, "node": node[at], "low": low[at], "score": line[at]}))
        return pd.concat(out)

    work = candidates.unionByName(queries).groupBy("ordering", "cell", "block", "part")
    found = work.applyInPandas(best, "query bigint, node bigint, low bigint, score double")
    found = found.groupBy("query", "node").agg(F.max("score").alias("score"), F.first("low").alias("low"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "low")
    found = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")
    entries = found.join(points.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    entries = entries.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    tops = entries.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("top"))
    heads = points.where("asks").select(F.col("node").alias("query"), "h", "v").join(tops, "query").select("h", "v", "top")
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), "h", "v").join(heads, ["h", "v"])
    others = F.slice(F.filter("top", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    out = asked.select("query_id", F.posexplode(others).alias("_at", "_e"))
    return out.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_e.vec_id").alias("vec_id"), F.col("_e.score").alias("score"))
