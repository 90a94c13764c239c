"""Alignment of two tokenizers' tokens by diagonal run skipping.

Both tokenizers cut the same bytes, so a token is known by the byte where it ends. Groups end where
tokens of both do. The ends of A and B are compared at the current shift between their indices: while
they are equal, tokens stand one to one, and the stretch is jumped over by exponential probing; where
they differ, the irregular group is walked to the next common end, which gives the new shift.

Texts are cut between words, where neither tokenizer joins characters, into pieces that are encoded
once and remembered; what is aligned are the ends of whole texts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tamis.llm.common import staged

#: A space between a character that is no space and one that is no white space. Byte-level pre-splitting
#: starts a word at such a space, and no piece of the other vocabulary has a space behind another character.
BETWEEN = re.compile(r"(?<! )(?= \S)")
#: Characters of remembered pieces after which all are forgotten. Forgetting costs time only.
REMEMBERED = 4_000_000
#: Characters of a text that are split and aligned at a time; a part ends with the piece.
SLAB = 1 << 20
#: Bytes of texts that are encoded together, unless one text has more.
AT_ONCE = 1 << 20
#: Tokens of a stretch that are compared one by one before probing; a power of two.
SINGLE = 8
#: Pairs that make up at least this part of all pairs of documents: there are no more than its inverse.
FREQUENT = 1 << 17


def byte_of_letter() -> dict[str, int]:
    """The bytes that stand behind the letters of a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the letters from U+0100 on, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Pieces:
    """Both encodings of pieces of text: token ids, and where tokens end inside the piece, in bytes."""

    def __init__(self, byte_level: str, sentence: str):
        # Spark runs a task per core already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        a = Tokenizer.from_file(byte_level)
        a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_file=sentence)
        letters = byte_of_letter()
        known = a.get_vocab()
        spelled_a = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            spelled_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        spelled_b = []
        for i in range(b.get_piece_size()):
            piece = b.id_to_piece(i)
            spelled_b.append(bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
        #: For each side how to encode, and the bytes of its tokens and how many. The space in front of a
        #: text is the second library's own.
        self.sides = [
            (lambda text: a.encode(text, add_special_tokens=False).ids, spelled_a, np.array([len(t) for t in spelled_a])),
            (lambda text: b.encode(text[1:], num_threads=1), spelled_b, np.array([len(t) for t in spelled_b])),
        ]
        self.forget()

    def forget(self) -> None:
        """Pieces by number: ids and ends of all pieces one after another, and where each one starts."""
        self.number: dict[str, int] = {}
        self.letters = 0
        self.size, self.fine = _Pool(np.int64), _Pool(np.bool_)
        self.ids, self.ends, self.starts = [[_Pool(kind), _Pool(kind)] for kind in (np.int32, np.int32, np.int64)]
        for pool in self.starts:
            pool.add([0])

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that may stand one after another, as one text, and give them numbers.

        Where a tokenizer changes the text, the pieces are halved until the one at fault stands alone.
        """
        text = "".join(pieces)
        raw = text.encode()
        found = [np.array(encode(text), np.int64) for encode, _, _ in self.sides]
        fine = all(b"".join(map(spelled.__getitem__, ids.tolist())) == raw for ids, (_, spelled, _) in zip(found, self.sides))
        if not fine and len(pieces) > 1:
            self.learn(pieces[: len(pieces) // 2])
            self.learn(pieces[len(pieces) // 2 :])
            return
        sizes = np.array([len(p.encode()) for p in pieces], np.int64)
        after = np.cumsum(sizes)
        for side, (ids, (_, _, lengths)) in enumerate(zip(found, self.sides)):
            ends = np.cumsum(lengths[ids])
            counts = np.searchsorted(ends, after, "right") if fine else np.array([len(ids)])
            tokens = np.diff(counts, prepend=0)
            self.starts[side].add(self.ids[side].size + counts)
            self.ids[side].add(ids)
            self.ends[side].add(ends - np.repeat(after - sizes, tokens))
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces))))
        self.letters += len(text)
        self.size.add(sizes)
        self.fine.add([fine] * len(pieces))

    def learn_all(self, pieces: list[str]) -> None:
        """Learn those that are not known yet."""
        new = list(dict.fromkeys(p for p in pieces if p not in self.number))
        # At the ends of texts pieces may begin or end with several spaces; those are encoded alone.
        for p in [p for p in new if p[1:2] == " " or p[-1] == " "]:
            self.learn([p])
        plain = [p for p in new if p not in self.number]
        for i in range(0, len(plain), 20_000):
            self.learn(plain[i : i + 20_000])

    def numbers(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))

    def tokens(self, numbers: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """``(ids, ends)`` of both sides for pieces that stand one after another."""
        before = np.cumsum(self.size.all[numbers]) - self.size.all[numbers]
        out = []
        for side in (0, 1):
            starts = self.starts[side].all
            first, count = starts[numbers], starts[numbers + 1] - starts[numbers]
            at = _ranges(first, count)
            out.append((self.ids[side].all[at], self.ends[side].all[at] + np.repeat(before, count)))
        return out


class _Pool:
    """A growing array."""

    def __init__(self, kind: type):
        self.buffer, self.size = np.zeros(1024, kind), 0

    def add(self, values: list | np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.buffer):
            self.buffer = np.concatenate([self.buffer, np.zeros(max(end, len(self.buffer)), self.buffer.dtype)])
        self.buffer[self.size : end] = values
        self.size = end

    @property
    def all(self) -> np.ndarray:
        return self.buffer[: self.size]


def cut(text: str) -> Iterator[list[str]]:
    """The pieces of a text, some at a time; together they are the text with a space in front."""
    text = " " + text
    at = 0
    while at < len(text):
        cut_at = BETWEEN.search(text, at + SLAB) if at + SLAB < len(text) else None
        end = cut_at.start() if cut_at else len(text)
        yield [p for p in BETWEEN.split(text[at:end]) if p]
        at = end


def runs(a: list[int], b: list[int]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Stretches ``(A from, A to, B from, groups)`` that cover two rows of ends, and the links of irregular ones.

    A stretch of several groups has one A and one B token in each. An irregular group is a stretch of one.
    Links are pairs of token indices whose bytes overlap. Both rows end in the same place.
    """
    stretches, links = [], []
    n = len(a)
    i = j = 0
    while i < n:
        start, shift = i, j - i
        if a[i] == b[j]:
            # Short stretches are the most: their first tokens are compared one by one.
            i, near = i + 1, min(i + SINGLE, n)
            while i < near and a[i] == b[i + shift]:
                i += 1
            step = SINGLE if i == near else 1
            while step > 1 and i + step <= n and a[i : i + step] == b[i + shift : i + shift + step]:
                i += step
                step += step
            while step > 1:  # the ends part within the next ``step``
                step //= 2
                if i + step <= n and a[i : i + step] == b[i + shift : i + shift + step]:
                    i += step
            j = i + shift
            stretches.append((start, i, start + shift, i - start))
        else:
            from_b = j
            x, y = a[i], b[j]
            links.append((i, j))
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
                links.append((i, j))
            i, j = i + 1, j + 1
            stretches.append((start, i, from_b, 1))
    return stretches, links


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[0]``, ``starts[0] + 1`` ... for ``counts[0]`` numbers, and so on."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


class Alignment:
    """``a`` and ``b``: token ids; ``groups_a`` and ``groups_b``: how many tokens stand before the end of each
    group; ``links_a`` and ``links_b``: indices of tokens that overlap."""

    def __init__(self, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray):
        self.a, self.b = a, b
        stretches, links = runs(ends_a.tolist(), ends_b.tolist())
        from_a, to_a, from_b, groups = np.fromiter(chain.from_iterable(stretches), np.int64, 4 * len(stretches)).reshape(-1, 4).T
        to_b = np.append(from_b[1:], len(b))
        single = groups == to_a - from_a
        single &= groups == to_b - from_b
        # Where tokens stand one to one each ends a group; of other stretches the last of either side does.
        inside = _ranges(np.ones(len(groups), np.int64), groups)
        self.groups_a = np.where(np.repeat(single, groups), np.repeat(from_a, groups) + inside, np.repeat(to_a, groups))
        self.groups_b = np.where(np.repeat(single, groups), np.repeat(from_b, groups) + inside, np.repeat(to_b, groups))
        local = np.fromiter(chain.from_iterable(links), np.int64, 2 * len(links)).reshape(-1, 2)
        counts = groups * single
        self.links_a = np.concatenate([_ranges(from_a, counts), local[:, 0]])
        self.links_b = np.concatenate([_ranges(from_b, counts), local[:, 1]])

    def pairs(self) -> np.ndarray:
        """The linked ids, A's in the upper half of 64 bits."""
        return (self.a[self.links_a].astype(np.int64) << 32) | self.b[self.links_b]

    def spelled(self) -> bytes:
        """``a1,a2|b1;a3|b2,b3;`` in decimal."""
        sizes_a, sizes_b = np.diff(self.groups_a, prepend=0), np.diff(self.groups_b, prepend=0)
        out = np.empty(len(self.a) + len(self.b), object)
        for ids, before, ends, between, behind in (
            (self.a, self.groups_b - sizes_b, self.groups_a, b",", b"|"),
            (self.b, self.groups_a, self.groups_b, b",", b";"),
        ):
            last = np.zeros(len(ids), bool)
            last[ends - 1] = True
            at = np.arange(len(ids)) + np.repeat(before, np.diff(ends, prepend=0))
            table = _spelled(between, behind, max(16, int(ids.max()).bit_length()))
            out[at] = table[ids + last * (len(table) // 2)]
        return b"".join(out.tolist())


@cache
def _spelled(between: bytes, behind: bytes, bits: int) -> np.ndarray:
    """Decimal numbers of so many bits with one separator, then the same numbers with the other."""
    return np.array([b"%d%b" % (i, end) for end in (between, behind) for i in range(1 << bits)], object)


class Aligner:
    """Alignments of texts, as parts that follow one another; none where a tokenizer changes the text."""

    def __init__(self, byte_level: str, sentence: str):
        self.pieces = Pieces(byte_level, sentence)

    def parts(self, texts: list[str | None]) -> Iterator[list[Alignment]]:
        """For each text its parts, which end between words, so that they have whole groups."""
        pieces = [list(cut(text)) if text else [] for text in texts]
        if self.pieces.letters > REMEMBERED:
            self.pieces.forget()
        self.pieces.learn_all([p for parts in pieces for part in parts for p in part])
        for parts in pieces:
            numbers = [self.pieces.numbers(part) for part in parts]
            if all(self.pieces.fine.all[n].all() for n in numbers):
                yield [Alignment(a, ends_a, b, ends_b) for (a, ends_a), (b, ends_b) in map(self.pieces.tokens, numbers)]
            else:
                yield []


def _some(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows with a few million characters of text at a time, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(batch):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + AT_ONCE, "right")))
        yield batch.slice(start, end - start)
        start = end


def alignments(docs: DataFrame, byte_level: str, sentence: str) -> DataFrame:
    """``(doc_id, a, b, groups_a, groups_b)``, one row per row of ``docs``: token ids of both tokenizers, and for
    each group how many tokens of either stand before its end.

    A text that is null or empty, or that a tokenizer changes, has empty lists. Rows that share an id are
    separate rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_level, sentence)
        for batch in batches:
            for some in _some(batch):
                rows = [_joined(parts) for parts in aligner.parts(some["text"].to_pylist())]
                yield pa.RecordBatch.from_arrays([some["doc_id"], *(pa.array(c, pa.list_(pa.int32())) for c in zip(*rows))], ["doc_id", "a", "b", "groups_a", "groups_b"])

    ids = ", ".join(f"{name} array<int>" for name in ("a", "b", "groups_a", "groups_b"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"doc_id bigint, {ids}")


def _joined(parts: list[Alignment]) -> list[np.ndarray]:
    if not parts:
        return [np.zeros(0, np.int32)] * 4
    before_a, before_b = (np.cumsum([0, *(len(s) for s in side[:-1])]) for side in ([p.a for p in parts], [p.b for p in parts]))
    columns = (
        [p.a for p in parts], [p.b for p in parts],
        [p.groups_a + n for p, n in zip(parts, before_a)], [p.groups_b + n for p, n in zip(parts, before_b)],
    )
    return [np.concatenate(c).astype(np.int32) for c in columns]


_DIGEST = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"


def _digest(parts: list[Alignment]) -> tuple:
    n_a = n_b = n_groups = n_links = 0
    digest, pairs, before = sha256(), [], b""
    for part in parts:
        n_a, n_b = n_a + len(part.a), n_b + len(part.b)
        n_groups, n_links = n_groups + len(part.groups_a), n_links + len(part.links_a)
        digest.update(before + part.spelled()[:-1])
        before = b";"
        pairs.append(np.unique(part.pairs(), return_counts=True))
    if not pairs:
        return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32)
    if len(pairs) == 1:
        found, times = pairs[0]
    else:
        found, at = np.unique(np.concatenate([p for p, _ in pairs]), return_inverse=True)
        times = np.bincount(at, np.concatenate([t for _, t in pairs]))
    return n_a, n_b, n_groups, n_links, digest.hexdigest(), found, times.astype(np.int32)


def aligned(docs: DataFrame, byte_level: str, sentence: str) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row per row of ``docs``.

    A pair's count is the number of rows that hold it linked; ``n_best`` are the links whose pair has the
    highest count of its A id, ``count_sum`` adds up the counts of all links. A text that is null or
    empty, or whose joined tokens differ from it with a space in front, has no tokens: zeros and an
    empty digest. Rows that share an id, and null ids, are separate rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_level, sentence)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        for batch in batches:
            for some in _some(batch):
                rows = [_digest(parts) for parts in aligner.parts(some["text"].to_pylist())]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([some["row"], some["doc_id"], *columns], [f.split()[0] for f in _DIGEST.split(", ")])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    digests = staged(rows.mapInArrow(run, _DIGEST), "alignments")
    entries = digests.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("_e")).select("row", "_e.pairs", "_e.times")
    counts = staged(entries.groupBy("pairs").agg(F.count("*").alias("count")), "pair-counts")
    # One row per A id: no more than A has tokens.
    best = counts.groupBy(F.shiftright("pairs", 32).alias("_a")).agg(F.max("count").alias("_most"))
    known = counts.join(F.broadcast(best), F.shiftright("pairs", 32) == F.col("_a"))
    known = known.select("pairs", "count", (F.col("count") == F.col("_most")).cast("int").alias("best"))
    (total,) = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()
    frequent = F.col("count") >= max(total / FREQUENT, 1)
    # Frequent pairs, no more than FREQUENT, are looked up in the row; the shuffle by pair has no hot key left.
    looked_up = entries.join(F.broadcast(known.where(frequent)), "pairs", "left")
    sums = lambda df: df.groupBy("row").agg(
        F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
    )
    rare = looked_up.where("count is null").select("row", "pairs", "times").join(known.where(~frequent), "pairs")
    found = sums(looked_up.where("count is not null")).unionByName(sums(rare))
    found = found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    out = digests.drop("pairs", "times").join(found, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
