"""Near duplicates by MinHash with tensored banding.

Two groups of ``collections`` hold ``hashes`` minhashes each. The key of table (i, j) pairs
collection i of the first group with collection j of the second, so that ``collections`` squared
tables of ``2 * hashes`` minhashes need ``2 * collections * hashes`` minhashes in all, about the square
root of what separate tables would take. At similarity 0.85 a pair shares no table with probability
``2 * (1 - 0.85**3)**10``, about 1 in 7,000.

Equal shingle sets are one node. First every node is compared with the heads (smallest nodes) of its
table buckets, which connects most copies. In buckets that still hold several components the other
pairs are found by the rare shingles that similar sets must share: sets are ordered by the rising
frequency of their shingles, and in a band of sizes a pair at the limit has so many in common that one
of them stands in the first few of both. Nodes that meet there are compared with the head of the
place. Where many of several components are left, they are described by their differences from the
head: two similar sets differ from it in much the same elements, and again one of the rarest of
these is in both. Sets also carry a bitmap of the parities of their hashed elements, and two bitmaps differ
in no more bits than the sets in elements: joins leave out what differs too much. So every pair that
shares a bucket is compared, is too dissimilar to link, or is known to be connected; copies are not
expanded into pairs, and most sets that are only nearly similar do not meet. Comparisons are made
on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import small_batches, staged, values
from tamis.llm.components import components

_P1, _P2, _P3 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_S = np.uint64(29)


@dataclass(frozen=True)
class Scheme:
    """Words in a shingle, the percentage of the union that must be common, and the banding."""

    width: int = 3
    percent: int = 85
    collections: int = 10
    hashes: int = 3
    seed: int = 7

    @property
    def common(self) -> int:
        """The keys that a pair must share to be compared: a pair at the limit has fewer five times in a million at most."""
        keys, p = 2 * self.collections, (self.percent / 100) ** self.hashes
        least, fewer = 0, (1 - p) ** keys
        while fewer <= 5e-6:
            least += 1
            fewer += math.comb(keys, least) * p**least * (1 - p) ** (keys - least)
        # All that share a table have two.
        return max(least, 2)


class _WordHashes(dict):
    """Word hashes seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _P2
    return x ^ (x >> _S)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of the shingles; none without a word."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    rolling = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        rolling = _mix(rolling * _P1 + hashes[i : len(words) - n + 1 + i])
    return np.unique(rolling)


#: Numbers of 64 bits in a set's parities. Sets that differ by many more elements than there are bits are not told apart.
PARITIES = 8


def parities(found: np.ndarray) -> np.ndarray:
    """For every hash slot whether an odd number of elements falls in it, as ``PARITIES`` numbers.

    Elements of both sets cancel out, so the parities of two sets differ in at most as many bits as the sets
    differ by elements.
    """
    odd = np.bincount((found % np.uint64(64 * PARITIES)).view(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _within(n_a: str, p_a: str, n_b: str, p_b: str, scheme: Scheme) -> Column:
    """Whether sets of these sizes and parities may link: those that do differ by at most
    ``(100 - percent) / (100 + percent)`` of the sum of their sizes."""
    bits = sum((F.bit_count(F.col(p_a)[i].bitwiseXOR(F.col(p_b)[i])) for i in range(PARITIES)), F.lit(0))
    return bits * (100 + scheme.percent) <= (F.col(n_a) + F.col(n_b)) * (100 - scheme.percent)


def signature(text: Column, scheme: Scheme) -> Column:
    """``struct(n, identity, keys, parities)``: set size, its 128-bit identity, the keys of all collections, and parities."""
    rng = np.random.default_rng(scheme.seed)
    count = 2 * scheme.collections * scheme.hashes
    flips = rng.integers(0, 2**64, count, np.uint64)
    factors = rng.integers(0, 2**64, count, np.uint64) | np.uint64(1)
    salts = np.arange(1, 2 * scheme.collections + 1, dtype=np.uint64) * _P3

    @F.arrow_udf("struct<n: bigint, identity: binary, keys: array<bigint>, parities: array<bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes, nodes, keys, odd = [], [], [], []
            for text in values(batch):
                found = shingles(text, scheme.width)
                sizes.append(len(found))
                if not len(found):
                    nodes.append(None)
                    keys.append(None)
                    odd.append(None)
                    continue
                nodes.append(blake2b(found.tobytes(), digest_size=16).digest())
                least = np.array([((found ^ f) * m).min() for f, m in zip(flips, factors)], np.uint64)
                key = salts
                for part in least.reshape(-1, scheme.hashes).T:
                    key = _mix(key * _P1 + part)
                keys.append(key.view(np.int64))
                odd.append(parities(found))
            arrays = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary())]
            arrays += [pa.array(x, pa.list_(pa.int64())) for x in (keys, odd)]
            yield pa.StructArray.from_arrays(arrays, ["n", "identity", "keys", "parities"])

    return run(text)


def shingle_set(text: Column, scheme: Scheme) -> Column:
    @F.arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingles(t, scheme.width).view(np.int64) for t in values(batch)], pa.list_(pa.int64()))

    return run(text)


#: Sizes in a band differ by this factor.
BAND = 1.02


def _looked_up(rows: DataFrame, keyed: DataFrame, key: str, on: Column | None = None, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of a written table that has one row per key.

    A plain join, for use where nothing behind it needs the rows of a key together: there adaptive execution splits
    what a frequent key sends. Plans with counts and broadcasts of frequent keys are many times as large, and dozens
    of them take much of the driver's memory.
    """
    marked = rows.withColumn("_key", F.col(key) if on is None else on)
    return marked.join(keyed.withColumnRenamed(key, "_key"), "_key", how).drop("_key")


def _shared(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """``(node, first, second)``: the keys of both groups' collections that some other node has too, for
    nodes that have one in each group."""
    held = nodes.select("node", F.posexplode("keys").alias("pos", "key"))
    shared = held.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    of_group = lambda inside: F.collect_list(F.when(inside, F.col("key")))
    kept = held.join(shared, "key", "left_semi").groupBy("node")
    kept = kept.agg(of_group(F.col("pos") < scheme.collections).alias("first"), of_group(F.col("pos") >= scheme.collections).alias("second"))
    return kept.where((F.size("first") > 0) & (F.size("second") > 0))


def _tables(shared: DataFrame, *keep: str) -> DataFrame:
    """``(keep..., cell)`` for each table bucket of a node."""
    cells = F.flatten(F.transform("first", lambda x: F.transform("second", lambda y: F.xxhash64(x, y))))
    return shared.select(*keep, F.explode(cells).alias("cell"))


def _rare(sets: DataFrame, scheme: Scheme) -> DataFrame:
    """``(node, label, n, cell)``: for each band of sizes that a partner may have, the first of a set's shingles
    by rising frequency, of which a similar set of that band has one among its own first.

    Sets of sizes n and s, s the smaller one, that reach the limit have at least ``percent / (100 + percent)``
    of ``n + s`` shingles in common. Shingles of one set only come first and need no place.
    """
    percent = scheme.percent
    held = staged(sets.select("node", F.explode("set").alias("s")), "shingles")
    counts = staged(held.groupBy("s").agg(F.count("*").alias("times")).where("times > 1"), "shared")
    ordered = _looked_up(held, counts, "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "s"))).alias("o"))
    size = F.size("set")
    known = sets.select("node", "label", size.alias("n")).join(ordered, "node")
    band = lambda x: F.floor(F.log(x) / math.log(BAND) + 1e-9).cast("int")
    least = F.ceil(F.col("n") * percent / 100)
    banded = known.withColumn("band", F.explode(F.sequence(band(least), band(F.col("n")))))
    # The smallest size of a band, or less.
    lowest = F.greatest(F.floor(F.pow(F.lit(BAND), F.col("band")) * (1 - 1e-6)), F.lit(1))
    common = F.ceil((F.col("n") + lowest) * percent / (100 + percent) - 1e-9)
    own = F.col("n") - F.size("o")
    first = F.greatest(F.col("n") - common + 1 - own, F.lit(0)).cast("int")
    cells = F.transform(F.slice("o", 1, first), lambda x: F.xxhash64(x["s"], F.col("band")))
    return banded.select("node", "label", "n", F.explode(cells).alias("cell"))


#: Nodes of a cell that meet pair by pair, which takes at most half as many pairs a place.
FEW = 32
#: Elements that the differences in a level may vary by.
LEVEL = 4


def _meeting(places: DataFrame, profile: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs ``(a, b)`` of ``places(cell, node, label, n, low, before)`` that share a cell, are of two labels,
    of sizes and parities that can link, and of which one is ``low``. ``before`` has cells of the node in which
    those that it shares with another have met already."""
    places = _looked_up(places, profile.select("node", "parities"), "node")
    columns = ("node", "label", "n", "low", "parities", "before")
    one, two = (places.select("cell", *[F.col(c).alias(f"{c}_{end}") for c in columns]) for end in "ab")
    near_sizes = (F.col("n_a") * 100 >= scheme.percent * F.col("n_b")) & (F.col("n_b") * 100 >= scheme.percent * F.col("n_a"))
    once = ~F.col("low_b") | (F.col("node_a") < F.col("node_b"))
    apart = F.col("label_a") != F.col("label_b")
    within = _within("n_a", "parities_a", "n_b", "parities_b", scheme)
    anew = ~F.arrays_overlap("before_a", "before_b")
    pairs = one.where("low_a").join(two, "cell").where(near_sizes & once & apart & within & anew)
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def _met(places: DataFrame, profile: DataFrame, scheme: Scheme) -> DataFrame:
    return _meeting(places, profile, scheme).distinct()


def _differing(met: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """``(cell, node, label, n, low, before)`` for nodes that have been compared with the same head: places by what
    they do not have in common with it.

    Sets A and B differ by the elements in which one of them alone differs from the head's. With
    ``w = (100 + percent) * d - (100 - percent) * n`` for a set of size n that differs from the head's by d
    elements, A and B link exactly if their differences share ``(w(A) + w(B)) / (2 * (100 + percent))``
    elements. Pairs that need to share none link to the head both, which is known by now. The others
    share one of the first of their differences by rising frequency, the fewer of them the more they
    must share. In a level of w stand the sets of that level, which are low in it, and those of higher
    w; each pair meets in the level of its lower w, and there in the first cell that both have.
    """
    more, less = 100 + scheme.percent, 100 - scheme.percent
    of_head = sets.select(F.col("node").alias("head"), F.col("set").alias("y"))
    held = met.join(sets.select("node", F.col("set").alias("x")), "node")
    held = _looked_up(held, of_head, "head")
    differing = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
    told = staged(held.select("head", "node", "label", "n", F.transform(differing, lambda e: F.xxhash64("head", e)).alias("d")), "told")
    w = more * F.size("d") - less * F.col("n")
    known = told.withColumn("w", w).withColumn("own", F.floor(F.col("w") / (LEVEL * more)))
    lowest = staged(known.groupBy("head").agg(F.min("own").alias("lowest")), "lowest")
    each = told.select("head", "node", F.explode("d").alias("e"))
    counts = staged(each.groupBy("e").agg(F.count("*").alias("times")).where("times > 1"), "shared")
    ordered = _looked_up(each, counts, "e").groupBy("head", "node").agg(F.sort_array(F.collect_list(F.struct("times", "e"))).alias("o"))
    known = _looked_up(known, lowest, "head").join(ordered, ["head", "node"])
    # The level of the lowest partner with which something must be shared.
    least = F.greatest(F.col("lowest"), F.floor(-F.col("w") / (LEVEL * more)))
    levels = F.when(F.col("w") >= 0, F.sequence(least, F.col("own"))).otherwise(F.array("own"))
    known = known.withColumn("level", F.explode(levels))
    needed = F.greatest(F.ceil((F.col("level") * LEVEL * more + F.col("w")) / (2 * more) - 1e-9), F.lit(1))
    # Differences of one set only come first and need no place.
    alone = F.size("d") - F.size("o")
    first = F.greatest(F.size("d") - needed + 1 - alone, F.lit(0)).cast("int")
    cells = F.transform(F.slice("o", 1, first), lambda e: F.xxhash64(e["e"], F.col("level")))
    low = (F.col("level") == F.col("own")).alias("low")
    known = known.select("node", "label", "n", low, cells.alias("cells"))
    placed = known.select("*", F.posexplode("cells").alias("pos", "cell"))
    # All cells of a level come in the same order in every node.
    return placed.select("cell", "node", "label", "n", "low", F.slice("cells", 1, F.col("pos")).alias("before"))


def _compare(pairs: DataFrame, profile: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """Of the pairs ``(a, b)`` those that are similar enough, by their full sets.

    Pairs whose sizes, keys or parities rule that out are not taken that far.
    """
    of = {"n": "n", "keys": "k", "parities": "p"}
    one, two = (profile.select(F.col("node").alias(end), *[F.col(c).alias(f"{x}_{end}") for c, x in of.items()]) for end in "ab")
    known = pairs.join(one, "a").join(two, "b")
    close = (F.col("n_a") * 100 >= scheme.percent * F.col("n_b")) & (F.col("n_b") * 100 >= scheme.percent * F.col("n_a"))
    # By default a pair above the limit has 12 of 20 keys in common on average.
    alike = F.size(F.filter(F.zip_with("k_a", "k_b", lambda x, y: x == y), lambda same: same)) >= scheme.common
    known = known.where(close & alike & _within("n_a", "p_a", "n_b", "p_b", scheme)).select("a", "b")
    a = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    enough = both * 100 >= scheme.percent * (F.size("x") + F.size("y") - both)
    return known.join(b, "b").join(a, "a").where(enough).select("a", "b")


def near_duplicates(docs: DataFrame, scheme: Scheme = Scheme(), carry: bool = False) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, first_row)``, one row per row of ``docs``.

    Links join documents with at least ``percent`` of the union of their shingles in common; the
    component is named by its smallest id. Texts that are null or have no word have no shingles and
    no links. Rows that share an id and a text are linked like others and all are kept if that id is
    the smallest. A null id counts as larger than all; alone, it is kept. ``first_row`` marks one row
    of each component, the one to keep where one must stay. With ``carry`` the struct ``row`` has all
    columns of ``docs``, whatever their names.
    """
    carried = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else []
    rows = docs.select("doc_id", signature(F.col("text"), scheme).alias("_s"), F.xxhash64("text").alias("text_hash"), *carried)
    with small_batches(docs.sparkSession):
        # Carried texts are most of what is written here.
        rows = staged(rows.withColumn("row_id", F.monotonically_increasing_id()), "signed", "zstd" if carry else None)
    slim = rows.select("doc_id", "_s.*", "text_hash", "row_id").where("n > 0")
    nodes = slim.groupBy("identity").agg(
        F.first("n").alias("n"),
        F.first("keys").alias("keys"),
        F.first("parities").alias("parities"),
        F.min(F.struct("doc_id", "text_hash")).alias("where"),
        F.min("doc_id").alias("id"),
        F.min(F.struct(F.isnull("doc_id"), "doc_id", "row_id")).alias("best"),
    )
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    labels = _linked(docs, nodes, scheme)
    named = nodes.select("identity", "node", "id", "best").join(labels, "node", "left")
    named = staged(named.select("identity", "id", "best", F.coalesce("label", "node").alias("label")), "named")
    names = named.groupBy("label").agg(F.min("id").alias("component_id"), F.min("best").alias("best"))
    found = named.select("identity", "label").join(names, "label")
    found = found.select("identity", "component_id", F.col("best.row_id").alias("first"))
    # Copies of one text are looked up, not gathered in one task.
    out = _looked_up(rows, staged(found, "found"), "identity", F.col("_s.identity"), "left")
    component = F.when(F.col("_s.n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        *(["row"] if carry else []),
        F.col("_s.n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        (F.col("first").isNull() | (F.col("first") == F.col("row_id"))).alias("first_row"),
    )


def _heads(members: DataFrame) -> DataFrame:
    """``(cell, head)``: the smallest node of every cell that has two or more."""
    return members.groupBy("cell").agg(F.min("node").alias("head"), F.count("*").alias("_n")).where("_n > 1").select("cell", "head")


def _apart(members: DataFrame) -> DataFrame:
    """``members(cell, node, label, ...)`` of the cells where nodes of two components are left beside the head;
    the head itself has been compared with all and is left out."""

    def several(rows: DataFrame, name: str) -> DataFrame:
        """The rows of cells of two or more components. The cells are written, so that the join needs no rows together."""
        ends = rows.groupBy("cell").agg(F.min("label").alias("_low"), F.max("label").alias("_high"))
        return _looked_up(rows, staged(ends.where("_low != _high").select("cell"), name), "cell")

    some = staged(several(members, "mixed"), "some")
    beside = _looked_up(some, staged(_heads(some), "heads"), "cell").where("node != head").drop("head")
    return several(staged(beside, "beside"), "apart")


def _linked(docs: DataFrame, nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """``(node, label)`` of all nodes that share a table with another; unlinked ones are their own label."""
    profile = nodes.select("node", "n", "keys", "parities")
    shared = staged(_shared(nodes, scheme), "keys")
    heads = staged(_heads(_tables(shared, "node")), "heads")

    # The sets of all nodes that share a table: their texts are read once more.
    where = nodes.join(shared.select("node"), "node", "left_semi").select("node", "where.*")
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    same = source["doc_id"].eqNullSafe(where["doc_id"]) & (source["text_hash"] == where["text_hash"])
    # Repeated rows would give a node's set again; the set is the same, so any will do.
    sets = source.join(where, same).select("node", "text").dropDuplicates(["node"])
    with small_batches(docs.sparkSession):
        sets = staged(sets.select("node", shingle_set(F.col("text"), scheme).alias("set")), "sets")

    def joined(labels: DataFrame, pairs: DataFrame) -> tuple[DataFrame, int]:
        """The labels after the similar ones of some pairs are linked, and how many links were new."""
        links = staged(_compare(pairs, profile, sets, scheme), "links")
        of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"_{end}"))
        ends = _looked_up(_looked_up(links, of("a"), "a"), of("b"), "b").where("_a != _b")
        ends = staged(ends.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "ends")
        found = ends.count()
        if not found:
            return labels, 0
        names = components(ends).select(F.col("node").alias("label"), F.col("label").alias("_new"))
        named = _looked_up(labels, names, "label", how="left")
        return staged(named.select("node", F.coalesce("_new", "label").alias("label")), "labels"), found

    # Every node with the heads of its buckets.
    labels = staged(shared.select("node", F.col("node").alias("label")), "labels")
    met = _looked_up(_tables(shared, "node"), heads, "cell").where("node != head")
    labels, _ = joined(labels, staged(met.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "pairs"))

    # What is still apart meets by rare shingles.
    open_ = _apart(_tables(shared.join(labels, "node"), "node", "label")).select("node").distinct()
    open_ = staged(open_, "open")
    if open_.isEmpty():
        return labels
    places = staged(_rare(sets.join(open_, "node").join(labels, "node"), scheme).drop("label"), "places")
    while True:
        firsts = staged(_heads(places), "firsts")
        named = places.join(labels, "node")
        head = labels.select(F.col("node").alias("head"), F.col("label").alias("_of_head"))
        pairs = _looked_up(named, firsts, "cell").select("node", "head", "label").distinct()
        pairs = staged(_looked_up(pairs, head, "head").where("label != _of_head").select(F.col("head").alias("a"), F.col("node").alias("b")), "pairs")
        labels, found = joined(labels, pairs)
        left = staged(_apart(places.join(labels, "node")).drop("label"), "left")
        if left.isEmpty():
            return labels
        # Once more with the next nodes as heads, as long as that connects many.
        if found <= 0.1 * pairs.count():
            break
        places = left
    rest = left.join(labels, "node")
    sizes = staged(rest.groupBy("cell").agg((F.count("*") > FEW).alias("large")), "sizes")
    rest = staged(_looked_up(rest, sizes, "cell").select("cell", "node", "label", "n", "large"), "rest")
    few = rest.where("not large").withColumn("low", F.lit(True)).withColumn("before", F.array().cast("array<bigint>"))
    few = _met(few, profile, scheme)
    met = _looked_up(rest.where("large"), firsts, "cell").select("head", "node", "label", "n").distinct()
    many = _met(_differing(staged(met, "met"), sets, scheme), profile, scheme)
    return joined(labels, staged(few.unionByName(many).distinct(), "pairs"))[0]
