"""Archives by round trip and brute force, main texts by known answers, neighbours by brute force."""

import gzip
import io
import random
import time

import numpy as np
import pytest

from tamis.llm import hilbert, warc, wrappers
from tamis.llm.queries import QUERIES, SQL

PATH = "/root/testdata/sf0.001"


@pytest.fixture
def pages(spark):
    def make(*rows):
        df = spark.createDataFrame([*rows], "page_id bigint, url string, html string")
        return df.selectExpr("*", "'x' AS archive", "1 AS host", "2 AS text")

    return make


def expected_records(rows):
    groups = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if page is not None:
            groups[data] = min(page, groups.get(data, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = groups.get(data)
        again = first is not None and page != first
        out.append((str(page), len(data), warc.digest(data), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_archives_of_odd_pages(spark, pages, tmp_path):
    rows = [
        (5, "http://a.example/x?b=1#f", "<p>é</p>"), (3, "https://www.a.example/x", "<p>é</p>"), (3, "http://a.example/", "<p>é</p>"),
        (7, None, None), (8, "", ""), (-4, "not a url\r\n", "x\r\n\r\ny"), (None, "http://[bad", "<p>é</p>"), (None, "u", "alone"),
        (9, "http://b.example", "z" * 300_000), (2**62, "http://b.example", "a\r\n\r\n"),
    ]
    found = warc.captures(pages(*rows), str(tmp_path / "warc"))
    out = found.collect()
    got = sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=str)
    assert got == expected_records(rows)
    order = [(r["url_key"], r["captured"]) for r in sorted(out, key=lambda r: (r["part"], r["place"]))]
    assert order == sorted(order)
    assert warc.captures(pages(), str(tmp_path / "none")).count() == 0
    for file in (tmp_path / "warc").glob("*.warc.gz"):
        assert gzip.open(io.BytesIO(file.read_bytes())).read().startswith(b"WARC/1.1\r\n")


def test_small_payloads_are_no_revisits(spark, pages, tmp_path):
    out = warc.captures(pages((1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")), str(tmp_path / "w"), least=3)
    assert {r["page_id"]: r["refers_to"] for r in out.collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_loser_tree():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randrange(20), r) for _ in range(rng.randrange(12))) for r in range(k)]
        assert list(warc.merge(runs)) == sorted(x for r in runs for x in r)


def test_warc_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{PATH}/pages.parquet").select("page_id", "url", "html").collect()]
    out = QUERIES["op2_warc_histories"](spark, PATH).collect()
    assert sorted((tuple(map(lambda x: x, (str(r["page_id"]), *r[1:]))) for r in out), key=str) == expected_records(rows)
    assert "op2_warc_histories" in SQL


PAGE = (
    '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></ul></nav>'
    '<div id="cookie-notice">We use cookies</div><header><h2>Site</h2></header><aside>Side</aside>{0}'
    '<footer>&copy; me</footer></body></html>'
)


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("just words &amp; more", "just words & more"),
        (PAGE.format("<article><h1>A&nbsp;B</h1><p>one<b>two</b>\n three<br>four<p>five</article>"), "A B onetwo three four five"),
        (PAGE.format('<article><p>x</p><section class="comments"><p>bad</p></section><div class="ad">buy</div><p>y</article>'), "x y"),
        (PAGE.format("<article><form><input><p>no</p></form><p>a &lt; b < c</p><!-- <p>no</p> --></article>"), "a < b < c"),
        (PAGE.format('<div class="wrap"><div class="post"><p>long text of the post</p></div></div>'), "long text of the post"),
        ("<article><p>cut off &am", "cut off &am"),
    ],
)
def test_main_text(html, text):
    assert wrappers.main_text(html, None) == text


def test_wrappers_repeat_and_skip():
    a = wrappers.page_wrapper("<body><ul><li>1</li><li>2</li></ul><p>x</p></body>")
    b = wrappers.page_wrapper("<body><ul><li>3</li></ul><h1>t</h1><p>y</p></body>")
    told = wrappers.expression(wrappers.aligned(a, b))
    assert "( <li> #text </li> )+" in told and "( <h1> #text </h1> )?" in told and "<p> #text </p>" in told


def test_pages_of_a_host_share_a_wrapper(spark, pages):
    html = '<html><body><div class="menu"><a href="/">m</a></div><div class="story"><p>text {0} of a page</p></div></body></html>'
    rows = [(i, f"http://h.example/{i}", html.format(i)) for i in range(30)] + [(99, None, None), (None, "x", "<p>free"), (5, "http://h.example/5", "")]
    out = wrappers.main_texts(pages(*rows)).collect()
    got = {(r["page_id"], r["url"]): r["text"] for r in out}
    assert len(out) == len(rows)
    assert all(got[i, f"http://h.example/{i}"] in (f"text {i} of a page", "") for i in range(30))
    assert got[99, None] == "" and got[None, "x"] == "free"
    told = {r["host"]: r for r in wrappers.infer(pages(*rows)).collect()}
    assert told["h.example"]["path"][-1] == "div.story"
    assert wrappers.main_texts(pages()).count() == 0


LONG = "a long line of the story " * 20


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<div class=content><h1>Title</h1><div class=intro>intro</div><div class=entry>{LONG}</div></div>", f"Title intro {LONG}"),
        (f"<main><div class=a>short</div><div class=b>{LONG}</div></main>", f"short {LONG}"),
        (f"<main><h1>Title</h1><article>{LONG}</article></main>", f"Title {LONG}"),
        (f"<div class=post><p>short</p><blockquote>{LONG}</blockquote></div>", f"short {LONG}"),
        (f"<div class=post><section>{LONG}</section></div><div class=x><a href=/>link</a></div>", LONG),
    ],
)
def test_all_text_of_an_article_is_kept(html, text):
    assert wrappers.main_text(f"<html><body>{html}</body></html>", None) == text.strip()


def test_a_host_led_by_long_pages_keeps_short_ones_whole(pages):
    page = "<html><body><div class=content><div class=entry>{0}</div>{1}</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(f"{i} {LONG}", "")) for i in range(20)]
    rows += [(50, "http://h.example/50", page.format("short", "<div class=more>and more</div>"))]
    rows += [(51, "http://h.example/51", page.format("", "<div class=more>only here</div>"))]
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(pages(*rows)).collect()}
    assert got[50] == "short and more" and got[51] == "only here" and got[3] == f"3 {LONG}".strip()
    # A path that leaves text out is not followed.
    assert wrappers.main_text(rows[20][2], ["html", "body", "div.content", "div.entry"]) == "short and more"


def test_extraction_query(spark):
    import re
    from html import unescape

    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{PATH}/pages.parquet").collect()}
    for r in QUERIES["op5_wrapper_texts"](spark, PATH).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", html[r["page_id"]], re.S).group(1)
        want = " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", inner))).split())
        assert (r["text"], r["n_chars"]) == (want, len(want))


def test_hilbert_curve_visits_neighbours():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    keys = hilbert.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def brute(rows, every, k):
    held = {i: np.array(v, float) for i, v in rows}
    return {
        q: sorted(((-float(held[q] @ v), i) for i, v in held.items() if i != q))[:k] for q in held if q % every == 0
    }


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(3).tolist()) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(60)]
    bad = [(200, None), (220, [0.0] * 6), (240, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (260, [float("nan")] * 6), (280, [float("inf")] * 6), (300, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS node", "2 AS label")
    out = hilbert.neighbours(df).orderBy("query_id", "rank").collect()
    got = {}
    for r in out:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, 20, 20)
    assert set(got) == set(want)
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [i for _, i, _ in found] == [i for _, i in want[q]]
        assert np.allclose([s for _, _, s in found], [-s for s, _ in want[q]])
    few = df.where("vec_id IN (0, 1, 2)")
    assert [(r["rank"], r["vec_id"]) for r in hilbert.neighbours(few).where("query_id = 0").orderBy("rank").collect()] == [
        (n + 1, i) for n, (_, i) in enumerate(brute(rows[:3], 20, 20)[0])
    ]
    assert hilbert.neighbours(df.where("false")).count() == 0


def test_recall_of_the_query(spark):
    path = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = brute(rows, 20, 20)
    got = {}
    for r in QUERIES["op1_hilbert_neighbours"](spark, path).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(got[q] & {i for _, i in w}) for q, w in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9


def test_deep_nesting_and_open_quotes_take_seconds(spark):
    """100,000 open tags, as many closes that match none, and a megabyte of unbalanced quotes."""
    from tamis.llm.wrappers import main_texts

    article = "<article><p>One text.</p></article>"
    pages = {
        1: "<div>" * 100_000 + article,
        2: "<div><b>" * 50_000 + article + "</i>" * 100_000,
        3: article + '<p title="x ' * 80_000,
        4: article + "<p title='x> " * 40_001,
        5: "<div>" + "<p>a" * 20_000 + "</div>" + "</script" * 50_000,
        6: article + "</script" * 50_000 + "<script>" + "</script" * 50_000,
        7: article + "<!-- never closed " * 1_000,
    }
    rows = [(i, f"http://h{i}.example/", html) for i, html in pages.items()]
    start = time.monotonic()
    got = {r["page_id"]: r["text"] for r in main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert time.monotonic() - start < 60
    assert got[1] == got[2] == got[7] == "One text."
    assert all(got[i].startswith("One text.") for i in (3, 4, 6)) and got[5].count("a") == 20_000
