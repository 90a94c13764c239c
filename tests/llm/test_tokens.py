"""Trie BPE against the tokenizers library; packing against its contract and brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tamis.llm import bpe, packing
from tamis.llm.queries import QUERIES

PATH = "/root/testdata/sf0.001"
ODD = [
    "", " \n\t ", "Hello  World!", "it's I'LL don't'sxx", "2nd ½ x² ª", "<|endoftext|> a<|startoftext|>b", "a</w>b </w>",
    "İstanbul ŉ ǅ ß ﬁ", "é é Å", "中文 текст ΣΑΣ", "a b c\x85d", "\x00\x01\x7f", "x" * 3000, "ab" * 700,
    "!!!..??--__", "\U0001f600 \U0001f1e9\U0001f1ea", "line\r\nline\x0b\x0cend", "thThTH the THE",
]


@pytest.fixture(scope="module")
def library(tokenizer):
    return Tokenizer.from_file(tokenizer)


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_odd_texts_encode_as_the_library_does(library, tokenizer):
    coder = bpe.TextCoder(tokenizer, bpe.decimal, b" ")
    for text, got in zip(ODD, coder.encode(ODD)):
        assert got == bpe.decimal(expected(library, text)), text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcdeinrstTHEéüñß'.,-1 \n", max_size=60), max_size=8))
def test_any_text_encodes_as_the_library_does(library, tokenizer, texts):
    coder = bpe.binary_coder(tokenizer)
    for text, got in zip(texts, coder.encode(texts, size=40)):
        assert got == bpe.little_endian(expected(library, text))


def test_forgetting_changes_nothing(library, tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    coder = bpe.TextCoder(tokenizer, bpe.decimal, b" ")
    texts = [" ".join(random.Random(i).choices("alpha beta gamma delta, Delta. epsilon zeta".split(), k=9)) for i in range(40)]
    assert list(coder.encode(texts, size=60)) == [bpe.decimal(expected(library, t)) for t in texts]


def test_packing_takes_ids_from_the_library_itself(library, tokenizer, monkeypatch):
    """No trie is built or walked for ids alone, and words that were forgotten are found again."""

    def unwanted(path):
        raise AssertionError(path)

    monkeypatch.setattr(bpe, "TrieEncoder", unwanted)
    words = "alpha Beta's gamma, <b>Delta.</b> épsilon ZÆTA 12,5 don't".split()
    texts = ODD + [" ".join(random.Random(i).choices(words, k=9)) for i in range(40)]
    want = [bpe.little_endian(expected(library, t)) for t in texts]
    for remembered in (5, None):
        coder = bpe.binary_coder.__wrapped__(tokenizer, remembered)
        assert list(coder.encode(texts, size=60)) == want
        assert list(coder.encode(texts)) == want


def test_round_trips_of_a_table(spark, library, tokenizer, documents):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "no id"), (7, "again"), (7, "again")]
    out = bpe.round_trips(documents(*rows), tokenizer).collect()
    assert len(out) == len(rows)
    want = set()
    for i, text in rows:
        ids = expected(library, text)
        decoded = library.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(bpe.decimal(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert {tuple(r) for r in out} == want
    assert bpe.round_trips(documents(), tokenizer).count() == 0


def test_encode_and_decode_as_columns(spark, library, tokenizer, documents):
    df = documents((1, "The end."), (2, None)).select("doc_id", bpe.encode("text", tokenizer).alias("ids"))
    got = {r[0]: (r[1], r[2]) for r in df.select("doc_id", "ids", bpe.decode("ids", tokenizer).alias("t")).collect()}
    ids = expected(library, "The end.")
    assert got == {1: (" ".join(map(str, ids)), library.decode(ids)), 2: ("", "")}


def test_registered_query_equals_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()}
    rows = QUERIES["op8_trie_bpe"](spark, PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = expected(library, texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(bpe.decimal(ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_packing(rows, texts, library, capacity=4096):
    """Every piece of every document once, right in itself, and sequences full without gaps."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for doc, text in texts:
        data = bpe.little_endian(expected(library, text) + [1])
        for k in range(0, len(data), 4 * capacity):
            cut = data[k : k + 4 * capacity]
            want[doc].append((k // (4 * capacity), k // 4, len(cut) // 4, zlib.crc32(cut)))
    assert set(pieces) == set(want)
    for doc, found in pieces.items():
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(want[doc])
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(sequences)


def test_packing_query(spark, library):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()]
    rows = QUERIES["op3_best_fit_packing"](spark, PATH).collect()
    made = check_packing(rows, texts, library)
    lengths = [r["length"] for r in rows]
    assert made <= first_fit_decreasing(lengths, 4096) + 1
    assert made >= sum(lengths) / 4096


def first_fit_decreasing(lengths, capacity):
    free = []
    for length in sorted(lengths, reverse=True):
        for i, room in enumerate(free):
            if room >= length:
                free[i] -= length
                break
        else:
            free.append(capacity - length)
    return len(free)


def test_packing_odd_tables(spark, library, tokenizer, documents):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "a b c"), (3, "a b c"), (3, "other"), (4, "word " * 200)]
    out = packing.pack(documents(*rows), tokenizer, capacity=32, slack=2).collect()
    check_packing(out, rows, library, 32)
    assert packing.pack(documents(), tokenizer).count() == 0


def test_rounds_meet_in_a_tree(spark, library, tokenizer, documents):
    """Many partitions, each with an underfull bin, still give about as few sequences as one."""
    random.seed(1)
    rows = [(i, " ".join(random.choices(["a", "of", "the", "end"], k=random.randint(1, 40)))) for i in range(600)]
    docs = documents(*rows).repartition(40)
    out = packing.pack(docs, tokenizer, capacity=64, slack=1, fan_in=4).collect()
    made = check_packing(out, rows, library, 64)
    assert made <= 1.03 * first_fit_decreasing([r["length"] for r in out], 64) + 1


def test_items_that_never_fit_stop_the_tree(spark, library, tokenizer, documents):
    rows = [(i, "a " * 39) for i in range(300)]
    out = packing.pack(documents(*rows).repartition(16), tokenizer, capacity=64, most=20).collect()
    assert check_packing(out, rows, library, 64) == 300


def test_best_fit_takes_the_tightest_place():
    fit = packing.BestFit(10)
    for length in (6, 7, 3, 4):
        fit.add(length, [length])
    assert sorted(p for _, p in fit.bins()) == [[6, 4], [7, 3]]
