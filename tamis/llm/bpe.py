"""BPE encoding and decoding by depth-first traversal of a trie of distinct words.

The words of a batch that were not met before go into a trie. At each node the state is the last
token of the encoding of the prefix that the node spells: it is the longest token that ends there
and may follow the last token of what stands before it. A shared prefix is encoded once, and a
word's ids are read back along its path. Two tokens may stand side by side if no merge across
their border would have come first; that needs the merges of the two tokens only.

Results equal the tokenizers library with the same file. A text holding anything besides the
characters listed in ``_PLAIN`` (where letters, digits, spaces, lower case and normal form are the
same in all Unicode versions) is encoded by that library itself.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import values

#: Chunks between spaces, and words in them, that a worker remembers before it begins to forget those
#: not met again. Forgetting costs time only.
REMEMBERED = 500_000
#: Letters by which the tokens that end at a node are looked up.
TAIL = 5

_SPACES = "\t\n\r "
_CHARS = [chr(c) for c in range(0x21, 0x180) if not 0x7F <= c <= 0xA0 and c not in (0xAD, 0x130)]
_PLAIN = re.compile("[%s]*" % re.escape("".join(_CHARS) + _SPACES))


def _group(kind: str) -> str:
    return re.escape("".join(c for c in _CHARS if unicodedata.category(c)[0] == kind))


_WORDS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\\s{L}{N}]+".format(L=_group("L"), N=_group("N"))
)


def _byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in set(visible) else next(hidden)) for b in range(256)]


class TrieEncoder:
    """Ids of words, where words are strings of byte letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.rank: dict[tuple[int, int], int] = {}
        #: Rank of the merge that makes a token, and its two parts; single letters have none.
        self.born: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            token = self.vocab[a + b]
            self.rank[self.vocab[a], self.vocab[b]] = rank
            if token not in self.born:
                self.born[token], self.left[token], self.right[token] = rank, self.vocab[a], self.vocab[b]
        #: Letters in a token; the most in a token of over ``TAIL`` letters with the same last ones.
        self.size, self.reach = {}, {}
        for text, token in self.vocab.items():
            closing = len(self.end) * (bool(self.end) and text.endswith(self.end))
            self.size[token] = n = len(text) - closing
            if n > TAIL:
                tail = text[-TAIL - closing :]
                self.reach[tail] = max(n, self.reach.get(tail, 0))
        self._tails: dict[str, tuple[int, list[tuple[int, int]]]] = {}
        self._fits: defaultdict[int, dict[int, bool]] = defaultdict(dict)

    def fits(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a``.

        Going back in time from the two whole tokens, the later merge is undone first; a merge
        across the border that was due before it would have taken the letters away. Of equal merges
        the left one comes first.
        """
        rank, born, limit = self.rank, self.born, len(self.rank) + 1
        while rank.get((a, b), limit) >= limit:
            made_a, made_b = born.get(a, -1), born.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                a, limit = self.right[a], made_a
            else:
                b, limit = self.left[b], made_b + 1
        return False

    def _ending(self, tail: str) -> tuple[int, list[tuple[int, int]]]:
        """Of what ends with ``tail``: the longest token's letters if over ``TAIL``, else 0, and the
        tokens of at most ``TAIL`` letters with their lengths, longest first."""
        n = len(tail) - len(self.end) * (bool(self.end) and tail.endswith(self.end))
        found = [(n - i, self.vocab.get(tail[i:])) for i in range(n)]
        if len(self._tails) > 500_000:
            self._tails.clear()
        out = self._tails[tail] = self.reach.get(tail, 0), [x for x in found if x[1] is not None]
        return out

    def _longer(self, spelled: str, depth: int, reach: int) -> Iterator[tuple[int, int]]:
        for start in range(max(0, depth - reach), depth - TAIL):
            token = self.vocab.get(spelled[start:])
            if token is not None:
                yield depth - start, token

    def _state(self, word: str, depth: int, lasts: list[int]) -> int:
        """The last token of the encoding of the first ``depth`` letters, or of the whole word."""
        closed = depth == len(word)
        tail = word[depth - TAIL if depth > TAIL else 0 : depth] + (self.end if closed else "")
        reach, ending = self._tails.get(tail) or self._ending(tail)
        if reach and depth > TAIL:
            ending = [*self._longer(word[:depth] + self.end * closed, depth, reach), *ending]
        token = -1
        for length, token in ending:
            if length == depth:
                break
            before = lasts[depth - length]
            if before < 0:
                before = self._state(word, depth - length, lasts)
            known = self._fits[token]
            fits = known.get(before)
            if fits is None:
                fits = known[before] = self.fits(before, token)
            if fits:
                break
        lasts[depth] = token
        return token

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each distinct word with its ids.

        In sorted order the words are the depth-first traversal of their trie: what a word shares
        with the one before is the part of the path that stays on the stack. ``lasts[d]`` is the
        last token of the encoding of the first ``d`` letters, the state of the node at that depth,
        found when it is first asked for (-1 before that).
        """
        size, state = self.size, self._state
        path, lasts = "", [-1]
        for word in sorted(set(words)):
            if not word:
                continue
            n = len(word)
            keep, most = 0, min(len(path), n - 1)
            while keep < most and path[keep] == word[keep]:
                keep += 1
            lasts[keep + 1 :] = [-1] * (n - keep)
            path = word[:-1]
            for depth in range(keep + 1, n if n > 200 else 0):  # from the front, or the recursion gets deep
                state(word, depth, lasts)
            token = state(word, n, lasts)
            ids, at = [token], n - size[token]
            while at:
                token = lasts[at]
                ids.append(token)
                at -= size[token]
            ids.reverse()
            yield word, ids
        if sum(map(len, self._fits.values())) > 1_000_000:
            self._fits.clear()


class TextCoder:
    """Whole texts to ids and back; ``form`` turns the ids of a chunk between spaces into bytes that
    ``glue`` joins to those of a text."""

    def __init__(self, path: str, form, glue: bytes, remembered: int | None = None):
        from tokenizers import Tokenizer

        self.trie = self._trie(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokens = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size())]
        self.form, self.glue, self.remembered = form, glue, remembered
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        letters = _byte_letters()
        self._as_bytes = {ord(c): "".join(letters[b] for b in c.encode()) for c in _CHARS}

    def _trie(self, path: str) -> TrieEncoder | None:
        return TrieEncoder(path)

    def _learn(self, new: set[str]) -> None:
        """Make sure that ``chunks`` holds these."""
        if len(self.chunks) + len(new) > (self.remembered or REMEMBERED):
            self.chunks, self.older = {}, self.chunks
        chunks, older = self.chunks, self.older
        words: dict[str, list[str]] = {}
        spelled: dict[str, str] = {}
        letters, find = self._as_bytes, _WORDS.findall
        for chunk in new:
            if chunk in older:
                chunks[chunk] = older[chunk]
                continue
            words[chunk] = parts = find(chunk.lower())
            # A word is remembered as a chunk of its own: other chunks differ in case or signs only.
            for word in parts:
                if word not in chunks:
                    if word in older:
                        chunks[word] = older[word]
                    else:
                        spelled[word.translate(letters)] = word
        form, get, glue = self.form, chunks.__getitem__, self.glue.join
        for letter_bytes, ids in self.trie.encode(spelled):
            chunks[spelled[letter_bytes]] = form(ids)
        for chunk, parts in words.items():
            if chunk not in chunks:
                chunks[chunk] = get(parts[0]) if len(parts) == 1 else glue(map(get, parts))

    def _some(self, texts: list[str | None]) -> list[bytes]:
        plain = [bool(t) and "<|" not in t and _PLAIN.fullmatch(t) is not None for t in texts]
        seen: set[str] = set()
        for text, by_chunk in zip(texts, plain):
            if by_chunk:
                seen.update(text.split())
        new = seen.difference(self.chunks)
        if new:
            self._learn(new if len(self.chunks) + len(new) <= (self.remembered or REMEMBERED) else seen)
        get, out = self.chunks.__getitem__, []
        for text, by_chunk in zip(texts, plain):
            if by_chunk:
                out.append(self.glue.join(map(get, text.split())))
            elif text:
                out.append(self.form(self.library.encode(text, add_special_tokens=False).ids))
            else:
                out.append(b"")
        return out

    def encode(self, texts: Iterable[str | None], size: int = 5_000_000) -> Iterator[bytes]:
        """The glued forms of each text, a trie for every ``size`` characters; a null text is empty."""
        some, held = [], 0
        for text in texts:
            some.append(text)
            held += len(text or "")
            if held >= size:
                yield from self._some(some)
                some, held = [], 0
        yield from self._some(some)


class FastCoder(TextCoder):
    """``TextCoder`` for jobs that need the ids only, not how they are found: distinct words go to the
    library's own model, and texts are split once."""

    def _trie(self, path: str) -> None:
        return None

    def _learn(self, new: set[str]) -> None:
        if len(self.chunks) + len(new) > (self.remembered or REMEMBERED):
            self.chunks, self.older = {}, self.chunks
        chunks, older, glue = self.chunks, self.older, self.glue.join
        letters, find, form, tokenize = self._as_bytes, _WORDS.findall, self.form, self.library.model.tokenize

        def known(word: str) -> bytes:
            """A word is remembered as a chunk of its own: other chunks differ in case or signs only."""
            data = chunks.get(word)
            if data is None:
                data = older.get(word)
                if data is None:
                    # ASCII signs stand for themselves.
                    spelled = word if word.isascii() else word.translate(letters)
                    data = form([token.id for token in tokenize(spelled)])
                chunks[word] = data
            return data

        for chunk in new:
            data = older.get(chunk)
            chunks[chunk] = glue(map(known, find(chunk.lower()))) if data is None else data

    def _some(self, texts: list[str | None]) -> list[bytes]:
        parts = [t.split() if t and "<|" not in t and _PLAIN.fullmatch(t) else None for t in texts]
        seen: set[str] = set()
        for chunks in parts:
            if chunks:
                seen.update(chunks)
        new = seen.difference(self.chunks)
        if new:
            self._learn(new if len(self.chunks) + len(new) <= (self.remembered or REMEMBERED) else seen)
        get, out = self.chunks.__getitem__, []
        for text, chunks in zip(texts, parts):
            if chunks is not None:
                out.append(self.glue.join(map(get, chunks)))
            elif text:
                out.append(self.form(self.library.encode(text, add_special_tokens=False).ids))
            else:
                out.append(b"")
        return out

    def encode(self, texts: Iterable[str | None], size: int = 500_000) -> Iterator[bytes]:
        return super().encode(texts, size)


def decimal(ids: list[int]) -> bytes:
    return b" ".join(b"%d" % i for i in ids)


def little_endian(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=4)
def decimal_coder(path: str) -> TextCoder:
    return TextCoder(path, decimal, b" ")


@lru_cache(maxsize=4)
def binary_coder(path: str, remembered: int | None = None) -> FastCoder:
    """One in each worker, kept between tasks."""
    return FastCoder(path, little_endian, b"", remembered)


def encode(text: Column, tokenizer: str) -> Column:
    """Ids of whole texts as decimal numbers with one space between; null and empty texts give ``""``.

    ``tokenizer`` is the path of a tokenizers file that every executor has.
    """

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = decimal_coder(tokenizer)
        for batch in batches:
            yield pa.array(list(coder.encode(values(batch))), pa.binary()).cast(pa.string())

    return run(text)


def decode(ids: Column, tokenizer: str) -> Column:
    """The text that the library decodes from ids in decimal, special tokens included; null gives null."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = {str(i): t for i, t in enumerate(decimal_coder(tokenizer).tokens)}
        get = tokens.__getitem__
        for batch in batches:
            yield pa.array(
                [None if x is None else " ".join(map(get, x.split())) for x in batch.to_pylist()], pa.string()
            )

    return run(ids)


def digests(text: Column, tokenizer: str) -> Column:
    """``struct(n_tokens, ids_sha256, decoded_sha256)``: what ``encode`` and ``decode`` give, hashed where
    it is made, so that no ids or decoded texts leave the worker."""

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = decimal_coder(tokenizer)
        tokens = {b"%d" % i: t for i, t in enumerate(coder.tokens)}
        for batch in batches:
            count, before, after = [], [], []
            for ids in coder.encode(values(batch)):
                split = ids.split()
                count.append(len(split))
                before.append(sha256(ids).hexdigest())
                after.append(sha256(" ".join(map(tokens.__getitem__, split)).encode()).hexdigest())
            arrays = [pa.array(count, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())]
            yield pa.StructArray.from_arrays(arrays, ["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def round_trips(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, one row per row of ``docs``.

    Null and empty texts have no tokens, and the hashes of the empty string. Rows with the same id
    are separate rows; a null id stays null. Further columns are not read.
    """
    found = docs.select("doc_id", digests(F.col("text"), tokenizer).alias("_found"))
    return found.select("doc_id", "_found.n_tokens", "_found.ids_sha256", "_found.decoded_sha256")
