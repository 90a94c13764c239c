"""Alignments against both libraries on whole texts, and overlaps by plain loops."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tamis.llm import aligning
from tamis.llm.queries import BYTE_LEVEL, QUERIES, SENTENCE

PATH = "/root/testdata/sf0.001"
ODD = [
    "", " ", "   ", "a", "  x", "tail  ", "a  b   c", "Hello, World! it's 2nd", "\n\t a\r\nb\n", "a▁b", "▁", "<s></s><unk><0x41>", "x<|endoftext|>y <|endoftext|>",
    "日本語 テキスト 😀 \U0001f1e9\U0001f1ea", "ﬁ ½ é é​\xa0z", "x　y \x85z \x1cq", "\x00 \x01\x7f", "ab" * 3000, " ".join("xyz" * i for i in range(60)),
    "Größe, año; garçon — “quoted” …", " \n ", "\n \n  a", "a ́b", "tab\tspace ​",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain(libraries, text):
    """Token ids, groups and links of one text, character by character of the definition."""
    a, b = libraries
    if not text:
        return [], [], [], []
    letters = aligning.byte_of_letter()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    ids_b = b.encode(text)
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], [], []

    def spans(tokens):
        at, out = 0, []
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    spans_a, spans_b = spans(bytes_a), spans(bytes_b)
    common = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
    groups, start = [], 0
    for end in common:
        inside = lambda ids, at: [i for i, (s, e) in zip(ids, at) if s >= start and e <= end]  # noqa: B023, E731
        groups.append((inside(ids_a, spans_a), inside(ids_b, spans_b)))
        start = end
    links = [(x, y) for x, (s, e) in zip(ids_a, spans_a) for y, (u, v) in zip(ids_b, spans_b) if s < v and u < e]
    return ids_a, ids_b, groups, links


def spelled(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def expected(libraries, rows):
    """``{row: (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)}``."""
    done = [plain(libraries, text) for _, text in rows]
    held = Counter(pair for _, _, _, links in done for pair in set(links))
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for (doc_id, _), (a, b, groups, links) in zip(rows, done):
        digest = hashlib.sha256(spelled(groups).encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), digest))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def of_parts(parts):
    parts = list(parts)
    text = b";".join(p.spelled()[:-1] for p in parts).decode()
    links = [pair for p in parts for pair in zip(p.a[p.links_a].tolist(), p.b[p.links_b].tolist())]
    return text, sorted(links)


def test_texts_encoded_together(libraries):
    for text, parts in zip(ODD, aligning.Aligner(BYTE_LEVEL, SENTENCE).parts(ODD)):
        _, _, groups, links = plain(libraries, text)
        assert of_parts(parts) == (spelled(groups), sorted(links)), text


def test_odd_texts(libraries):
    aligner = aligning.Aligner(BYTE_LEVEL, SENTENCE)
    for text in ODD:
        a, _, groups, links = plain(libraries, text)
        assert of_parts(next(aligner.parts([text]))) == (spelled(groups), sorted(links)), text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeiorstTHé.,'-19 \n\t▁日😀<>sx0", max_size=80))
def test_any_text(libraries, text):
    aligner = _shared()
    a, _, groups, links = plain(libraries, text)
    assert of_parts(next(aligner.parts([text]))) == (spelled(groups), sorted(links))


_ALIGNER = []


def _shared():
    if not _ALIGNER:
        _ALIGNER.append(aligning.Aligner(BYTE_LEVEL, SENTENCE))
    return _ALIGNER[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40), st.lists(st.integers(1, 60), max_size=40), st.integers(1, 60))
def test_runs_cover_any_two_rows_of_ends(x, y, shared):
    base = sorted(set(x))
    a, b = sorted({*base, 61 + shared}), sorted({*y, *base[::2], 61 + shared})
    stretches, links = aligning.runs(a, b)
    groups, at, single = [], 0, []
    for from_a, to_a, from_b, n in stretches:
        assert from_a == at
        at = to_a
        if n == to_a - from_a and a[from_a] == b[from_b] and b[from_b : from_b + n] == a[from_a:to_a]:
            groups += a[from_a:to_a]
            single += [(from_a + k, from_b + k) for k in range(n)]
        else:
            groups.append(a[to_a - 1])
    assert groups == sorted(set(a) & set(b))
    span = lambda ends, i: (ends[i - 1] if i else 0, ends[i])
    overlap = [(i, j) for i in range(len(a)) for j in range(len(b)) if span(a, i)[0] < span(b, j)[1] and span(b, j)[0] < span(a, i)[1]]
    assert sorted(links + single) == overlap


def test_a_table_and_its_counts(spark, libraries, documents, monkeypatch):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50 + i, " ".join(rng.choices(["the", "unbelievable", "Zwölf", "año,", "x9", "<s>"], k=20))) for i in range(30)]
    rows += [(100, None), (None, "no id"), (7, "again"), (7, "again")]
    want = expected(libraries, rows)
    assert found(aligning.aligned(documents(*rows), BYTE_LEVEL, SENTENCE)) == want
    # Hardly any pair is frequent: the counts come by the shuffle.
    monkeypatch.setattr(aligning, "FREQUENT", 3)
    assert found(aligning.aligned(documents(*rows), BYTE_LEVEL, SENTENCE)) == want


def test_empty_tables(spark, documents):
    assert aligning.aligned(documents(), BYTE_LEVEL, SENTENCE).count() == 0
    assert found(aligning.aligned(documents((1, None), (2, "")), BYTE_LEVEL, SENTENCE)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_parts_and_forgetting_change_nothing(libraries, monkeypatch):
    text = " ".join(random.Random(1).choices(["alpha", "Überraschung", "日本", " ", "\n", "gamma-delta"], k=300))
    whole = of_parts(next(aligning.Aligner(BYTE_LEVEL, SENTENCE).parts([text])))
    monkeypatch.setattr(aligning, "SLAB", 50)
    monkeypatch.setattr(aligning, "REMEMBERED", 40)
    aligner = aligning.Aligner(BYTE_LEVEL, SENTENCE)
    assert len(next(aligner.parts([text]))) > 5 and of_parts(next(aligner.parts([text]))) == whole
    _, _, groups, links = plain(libraries, text)
    assert whole == (spelled(groups), sorted(links))
    assert list(aligner.parts([text + " a▁b", "a▁b", None])) == [[]] * 3


def test_alignments_of_a_table(spark, libraries, documents):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(90, None)]
    for r in aligning.alignments(documents(*rows), BYTE_LEVEL, SENTENCE).collect():
        a, b, groups, _ = plain(libraries, dict(rows)[r["doc_id"]])
        assert (r["a"], r["b"]) == (a, b)
        cuts_a, cuts_b = [0, *r["groups_a"]], [0, *r["groups_b"]]
        got = [(a[i:j], b[k:m]) for i, j, k, m in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:])]
        assert got == groups


def test_a_very_long_text(spark, documents):
    text = "Der Hund, the dog y el perro unübersichtlich. " * 60_000
    (row,) = aligning.aligned(documents((1, text)), BYTE_LEVEL, SENTENCE).collect()
    assert row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"] and row["n_groups"] > 500_000
    assert row["n_best"] <= row["n_links"] == row["count_sum"]


def test_the_query(spark, libraries):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{PATH}/documents.parquet").collect() if len(r["text"] or "") < 4000]
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{PATH}/documents.parquet").where(F.coalesce(F.length("text"), F.lit(0)) < 4000)
    assert found(aligning.aligned(docs, BYTE_LEVEL, SENTENCE)) == expected(libraries, rows)
    out = QUERIES["op13_diagonal_alignment"](spark, PATH)
    assert out.columns == COLUMNS and out.count() == spark.read.parquet(f"{PATH}/documents.parquet").count()
