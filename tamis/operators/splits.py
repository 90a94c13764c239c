"""Caps and folds that depend only on keys and a seed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.operators.ranking import row_number
from tamis.sources.store import write_through

# Hex digits of the shuffle hash that make a bucket: 4096 buckets per group.
_BUCKET_DIGITS = 3

# Classes of authors that the driver deals with; binary digits of a count that tell classes apart, the
# first of these with which there are no more.
_MOST_CLASSES, _DIGITS = 50_000, (62, 5, 3, 2, 1)


def cap_per_author(
    docs: DataFrame, k: int = 97, order: str = "doc_id", salts: int = 64
) -> DataFrame:
    """The first ``k`` posts of each author by ``order``; rows without an author are dropped.

    Only ``(author, order)`` pairs are ranked, and only the last kept position of authors who exceed
    the cap is joined back, so texts are not sorted. Ranking first inside ``author x salt`` leaves
    at most ``salts * k`` rows of any author for the final step, however many posts there are.
    """
    slim = docs.where(F.col("author").isNotNull()).select(
        "author", F.col(order).alias("_at"), F.pmod(F.xxhash64(order), F.lit(salts)).alias("_salt")
    )
    salted = Window.partitionBy("author", "_salt").orderBy("_at")
    whole = Window.partitionBy("author").orderBy("_at")
    # One position more than the cap tells whether the author exceeds it.
    first = (
        slim.withColumn("_rank", F.row_number().over(salted))
        .where(F.col("_rank") <= k + 1)
        .drop("_rank")
        .withColumn("_rank", F.row_number().over(whole))
        .where(F.col("_rank") <= k + 1)
    )
    cutoffs = first.where(F.col("_rank") == k + 1).select("author", F.col("_at").alias("_cutoff"))
    return (
        docs.where(F.col("author").isNotNull())
        .join(cutoffs, "author", "left")
        .where(F.col("_cutoff").isNull() | (F.col(order) < F.col("_cutoff")))
        .select(*docs.columns)
    )


def _shuffle_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _bucket_of(hashed: str) -> Column:
    """Leading digits; never null, so that joins by bucket do not add filters that hash again."""
    return F.coalesce(F.substring(hashed, 1, _BUCKET_DIGITS), F.lit(""))


def stratified_folds(docs: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """``(doc_id, label, fold)``: each label is dealt evenly over the folds in a seeded order."""
    hashed = docs.select("doc_id", "label", _shuffle_hash("doc_id", seed).alias("_hash")).withColumn(
        "_bucket", _bucket_of("_hash")
    )
    placed = row_number(
        hashed, "_place", ["label"], ["_bucket"], [F.col("_bucket")], [F.col("_hash")]
    )
    return placed.select("doc_id", "label", F.pmod("_place", F.lit(k)).cast("int").alias("fold"))


def author_folds(docs: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """``(author, fold)``: no author in two folds, labels spread over the folds.

    Authors are grouped by the rarest label they have (rarest in the whole corpus, then by name).
    Inside a group they are ordered by number of posts, largest first, then by a seeded hash, and
    dealt to and fro over the folds. This is not the sequential greedy of the usual library: the
    guarantees are the same, single assignments are not.
    """
    counts = (
        docs.where(F.col("author").isNotNull())
        .groupBy("author", "label")
        .agg(F.count("*").alias("_n"))
    )
    # Posts without a label count like those of one more label.
    counts = counts.withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("\0")))
    rarity = counts.groupBy("label").agg(F.sum("_n").alias("_corpus"))
    authors = (
        counts.join(rarity, "label")
        .groupBy("author")
        .agg(
            F.min(F.struct("_corpus", "label"))["label"].alias("_stratum"),
            F.sum("_n").alias("_size"),
        )
        .withColumn("_hash", _shuffle_hash("author", seed))
        .withColumn("_bucket", _bucket_of("_hash"))
    )
    placed = row_number(
        authors,
        "_place",
        ["_stratum"],
        ["_size", "_bucket"],
        [F.desc("_size"), F.col("_bucket")],
        [F.col("_hash")],
    )
    step = F.pmod("_place", F.lit(2 * k))
    fold = F.when(step < k, step).otherwise(2 * k - 1 - step)
    return placed.select("author", fold.cast("int").alias("fold"))


def _rounded(n: Column, digits: int) -> Column:
    """``n`` with its first binary digits kept and the others 0."""
    spare = F.greatest(F.floor(F.log2(n)).cast("int") - (digits - 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", n, spare), spare)


def _deal_rest(classes: list, totals: np.ndarray, k: int) -> list[list[int]]:
    """Folds for the authors of each class that are left over when the class is dealt evenly.

    ``classes`` are ``(counts, left over)`` in the order in which they are placed, ``counts`` a mapping of labels to
    posts of one author. Each author goes where the labels' shares of the folds then spread least, on average
    over the labels; of equal folds to that with the fewest posts. Even deals spread nothing, so they may
    be left out of account.
    """
    held = np.zeros((k, len(totals)))
    placed = []
    for counts, rest in classes:
        at, add = np.fromiter(counts, int), np.fromiter(counts.values(), float)
        folds = []
        for _ in range(rest):
            share = held[:, at] / totals[at]
            # Only the labels of this author change their spread, so only they are compared.
            after = np.broadcast_to(share, (k, *share.shape)).copy()
            after[np.arange(k), np.arange(k)] += add / totals[at]
            spread = (after.std(axis=1) - share.std(axis=0)).sum(axis=1)
            posts = held.sum(axis=1)
            fold = min(range(k), key=lambda f: (round(spread[f], 12), posts[f], f))
            held[fold, at] += add
            folds.append(fold)
        placed.append(folds)
    return placed


def balanced_author_folds(docs: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """``(author, fold)``: no author in two folds, and each label's posts spread evenly over the folds.

    Authors with equal counts of all labels are one class. A class deals its authors, in seeded order,
    evenly over the folds; the fewer than ``k`` that are left over in each class are placed by a greedy
    rule, classes of uneven labels first (by the deviation of their counts), each author where the labels'
    shares spread least. So all labels count, not only the rarest, and the greedy sees classes, not
    authors. With more than 50,000 different classes, large counts are told apart by their leading binary
    digits only. Posts without a label count like those of one more label; posts without an author are
    left out.
    """
    spark = docs.sparkSession
    counts = (
        docs.where(F.col("author").isNotNull())
        .groupBy("author", "label")
        .agg(F.count("*").alias("n"))
        .withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("\0")))
    )
    pairs = F.sort_array(F.collect_list(F.struct("label", "n")))
    authors = write_through(counts.groupBy("author").agg(pairs.alias("counts")), "author-counts")
    for digits in _DIGITS:
        key = F.transform("counts", lambda c: F.struct(c["label"].alias("label"), _rounded(c["n"], digits).alias("n")))
        classed = authors.select("author", key.alias("class"))
        sizes = classed.groupBy("class").agg(F.count("*").alias("authors"))
        if sizes.limit(_MOST_CLASSES + 1).count() <= _MOST_CLASSES:
            break
    else:
        # Too many labels for that: classes are the rarest label of an author and the number of posts.
        of_label = counts.groupBy("label").agg(F.sum("n").alias("_corpus"))
        rarest = counts.join(of_label, "label").groupBy("author").agg(
            F.min(F.struct("_corpus", "label"))["label"].alias("label"), _rounded(F.sum("n"), 2).alias("n")
        )
        classed = rarest.select("author", F.array(F.struct("label", "n")).alias("class"))
        sizes = classed.groupBy("class").agg(F.count("*").alias("authors"))
    order = F.aggregate("class", F.lit(0.0), lambda a, c: a + c["n"] * c["n"]).alias("squares")
    found = sizes.select("class", "authors", order, F.md5(F.concat(F.lit(f"{seed}:"), F.to_json("class"))).alias("hash")).collect()
    labels: dict[str, int] = {}
    for r in found:
        for c in r["class"]:
            labels.setdefault(c["label"], len(labels))
    totals = np.zeros(len(labels))
    for r in found:
        for c in r["class"]:
            totals[labels[c["label"]]] += c["n"] * r["authors"]

    def deviation(r) -> float:
        mean = sum(c["n"] for c in r["class"]) / len(labels)
        return r["squares"] / len(labels) - mean * mean

    found.sort(key=lambda r: (-deviation(r), r["hash"]))
    rest = [({labels[c["label"]]: c["n"] for c in r["class"]}, r["authors"] % k) for r in found]
    folds = _deal_rest(rest, totals, k)
    schema = T.StructType([
        T.StructField("class", classed.schema["class"].dataType), T.StructField("_even", T.LongType()), T.StructField("_folds", T.ArrayType(T.IntegerType()))
    ])
    # No more rows than classes that the driver deals with.
    dealt = spark.createDataFrame([(r["class"], r["authors"] - r["authors"] % k, f) for r, f in zip(found, folds)], schema)
    hashed = classed.withColumn("_hash", _shuffle_hash("author", seed)).withColumn("_bucket", _bucket_of("_hash"))
    placed = row_number(hashed, "_place", ["class"], ["_bucket"], [F.col("_bucket")], [F.col("_hash")])
    last = F.get("_folds", (F.col("_place") - F.col("_even")).cast("int"))
    fold = F.when(F.col("_place") < F.col("_even"), F.pmod("_place", F.lit(k)).cast("int")).otherwise(last)
    return placed.join(F.broadcast(dealt), "class").select("author", fold.alias("fold"))


def with_author_folds(docs: DataFrame, folds: DataFrame) -> DataFrame:
    """Bring the fold of each author to the posts; AQE splits an author with very many posts.

    A post without an author, or whose author has no fold, is dealt to a fold by its id.
    """
    k = folds.agg(F.coalesce(F.max("fold"), F.lit(0)) + 1).scalar()
    alone = F.pmod(F.xxhash64("doc_id"), k).cast("int")
    return docs.join(folds, "author", "left").withColumn("fold", F.coalesce("fold", alone))


def train_part(docs: DataFrame, fold: int) -> DataFrame:
    return docs.where(F.col("fold") != fold)


def validation_part(docs: DataFrame, fold: int) -> DataFrame:
    return docs.where(F.col("fold") == fold)


def all_splits(docs: DataFrame, k: int = 5) -> DataFrame:
    """Every row once per model fold, marked ``train`` or ``val``; no shuffle."""
    return docs.withColumn("model_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(
        "split", F.when(F.col("fold") == F.col("model_fold"), "val").otherwise("train")
    )
