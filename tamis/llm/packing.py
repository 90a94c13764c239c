"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition packs its own pieces best-fit. Bins that are nearly full are done; the others become
the items of the next round, dealt to fewer partitions, and so on up a tree. A task never holds more
than ``most`` items, so the tree ends early where bins do not fit together (then hardly anything
merges, and further rounds could not either).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.bpe import binary_coder
from tamis.llm.common import small_batches, staged, values

_FIELDS = ("doc_id bigint", "piece int", "start bigint", "length bigint", "ids_crc32 bigint", "offset bigint")
_BIN = "used bigint, done boolean, pieces array<struct<%s>>" % ", ".join(f.replace(" ", ":") for f in _FIELDS)
_ARROW = pa.list_(
    pa.struct([(f.split()[0], pa.int32() if f.endswith(" int") else pa.int64()) for f in _FIELDS])
)


class BestFit:
    """Open bins by free space. An item goes where it leaves least; items come longest first."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.free: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.mask = 0  # bit r: some bin has r free

    def add(self, length: int, pieces: list) -> None:
        fitting = self.mask >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            held = self.free[room].pop()
            if not self.free[room]:
                self.mask ^= 1 << room
            held += pieces
        else:
            room, held = self.capacity, list(pieces)
        self.free[room - length].append(held)
        self.mask |= 1 << (room - length)

    def bins(self) -> Iterator[tuple[int, list]]:
        for room, held in enumerate(self.free):
            for pieces in held:
                yield self.capacity - room, pieces


def _packed(items: list[tuple[int, list]], capacity: int, slack: int) -> pa.RecordBatch:
    fit = BestFit(capacity)
    for length, pieces in sorted(items, key=lambda x: (-x[0], str(x[1][0]))):
        fit.add(length, pieces)
    used, placed = [], []
    for total, pieces in fit.bins():
        starts = accumulate((p[3] for p in pieces), initial=0)
        used.append(total)
        placed.append([(*p, at) for p, at in zip(pieces, starts)])
    columns = [pa.array(used, pa.int64()), pa.array([capacity - u <= slack for u in used], pa.bool_())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(placed, _ARROW)], ["used", "done", "pieces"])


def _first_round(tokenizer: str, capacity: int, closing: int, slack: int, most: int, remembered: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, items = binary_coder(tokenizer, remembered), []
        end, whole = closing.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            for doc, tokens in zip(batch.column(0).to_pylist(), coder.encode(values(batch.column(1)))):
                tokens += end
                for k in range(0, len(tokens), whole):
                    cut = tokens[k : k + whole]
                    piece = (doc, k // whole, k // 4, len(cut) // 4, zlib.crc32(cut))
                    items.append((len(cut) // 4, [piece]))
                if len(items) >= most:
                    yield _packed(items, capacity, slack)
                    items = []
        yield _packed(items, capacity, slack)

    return run


def _next_round(capacity: int, slack: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = []
        for batch in batches:
            for used, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                items.append((used, [tuple(p.values())[:5] for p in pieces]))
            if len(items) >= most:
                yield _packed(items, capacity, slack)
                items = []
        yield _packed(items, capacity, slack)

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    closing: int = 1,
    slack: int = 64,
    fan_in: int = 8,
    most: int = 50_000,
    remembered: int | None = None,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    A document is its ids and then the id ``closing``; one of more than ``capacity`` ids is cut into
    pieces of that length, of which the last may be shorter. A bin with at most ``slack`` places left
    counts as nearly full. ``fan_in`` partitions of a round meet in one of the next. A worker remembers the
    ids of ``remembered`` chunks (``bpe.REMEMBERED`` by default), twice as many at most: fewer take less of its
    memory and more time.

    Null and empty texts are the closing id alone. Rows that share an id, or have none, are separate
    documents. Ties go to the bin opened last. An empty table gives no rows; other columns are not read.
    """
    first = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        _first_round(tokenizer, capacity, closing, slack, most, remembered), _BIN
    )
    with small_batches(docs.sparkSession):
        made = staged(first, "bins")
    finished, open_bins = [made.where("done")], made.where(~F.col("done"))
    count = open_bins.count()
    parts = made.rdd.getNumPartitions()
    while count > 1:
        before, parts = count, max(-(-parts // fan_in), -(-2 * count // most))
        key = F.xxhash64(F.col("pieces")[0]["doc_id"], F.col("pieces")[0]["piece"], "used")
        dealt = open_bins.select("used", "pieces").repartition(parts, key)
        made = staged(dealt.mapInArrow(_next_round(capacity, slack, most), _BIN), "bins")
        finished.append(made.where("done"))
        open_bins = made.where(~F.col("done"))
        count = open_bins.count()
        if parts == 1 or (parts * most < 4 * count and count > 0.95 * before):
            break
    bins = open_bins
    for part in finished:
        bins = bins.unionByName(part)
    numbered = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "pieces")
    placed = numbered.select("sequence_id", F.explode("pieces").alias("p"))
    return placed.select(*(f"p.{f.split()[0]}" for f in _FIELDS[:5]), "sequence_id", "p.offset")
