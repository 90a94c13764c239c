"""Main text of web pages through wrappers inferred per host.

A wrapper is a union-free regular expression over tags and text slots. It starts as the token stream
of one page, nested by its tags; further pages of the host are aligned with it one by one. Where text
differs there is a slot; neighbouring equal groups become one repeated group; a group that only one
side has becomes optional. Each group sums how many pages and characters it has seen, so the wrapper
shows which group holds the articles of the host.

Alignment folds pages into wrappers and wrappers into wrappers alike: each task folds what it has of a
host, shares of a host are folded next, and last the host's few shares. A wrapper's size depends on
the variety of a site's templates, not on its pages.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import staged, values

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that end a block of text.
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
#: An open element that the start of another ends, and what it cannot reach beyond.
_ENDS = {
    **dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), ("p",)),
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
_SCOPE = frozenset("ul ol dl table td th tr div section article body html select aside nav main form".split())
_DROPPED = frozenset(
    "head script style noscript template nav footer aside form iframe object embed svg canvas button select textarea "
    "dialog menu title audio video map".split()
)
_KEPT = frozenset("html body main article".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent notice notices gdpr popup "
    "modal overlay newsletter subscribe subscription signup login comment comments disqus reply replies respond "
    "related recommended recommendations share sharing social toolbar pagination pager widget widgets search alert "
    "skip hidden".split()
)
_HOLDERS = frozenset("content main article body post entry story text".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar toolbar form".split())
_CONTAINERS = frozenset("html body main article section div td blockquote center".split())

_OTHER = r"<!--.*?(?:-->|$)|<[!?][^>]*+>"
#: A tag ends at the first > outside quotes, or at the first one.
_TOKEN = re.compile(rf"{_OTHER}|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_LENIENT = re.compile(rf"{_OTHER}|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_STARTS = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME_PARTS = re.compile(r"[A-Za-z]+")


def events(html: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name, rest)``: ``open`` with attributes, ``close``, or ``text`` as written.

    From a tag on whose quotes do not end before the page does, tags end at their first ``>``. Each part
    of a page is read a bounded number of times, whatever its quotes.
    """
    token, n, last = _TOKEN, len(html), html.rfind(">")
    told = at = 0
    while at < n:
        start = html.find("<", at)
        if start > last:
            # No tag can end here, only a comment may begin.
            start = html.find("<!--", start)
        if start < 0:
            break
        found = token.match(html, start)
        if not found and token is _TOKEN and _STARTS.match(html, start):
            token = _LENIENT
            found = token.match(html, start)
        if not found:
            at = start + 1
            continue
        if start > told:
            yield "text", "", html[told:start]
        told = at = found.end()
        name = (found.group(2) or "").lower()
        if not name:
            continue
        if found.group(1):
            yield "close", name, ""
            continue
        yield "open", name, found.group(3)
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*+>", re.I).search(html, at, last + 1)
            inner = html[at : end.start()] if end else html[at:]
            if name in ("title", "textarea"):
                yield "text", "", inner
            yield "close", name, ""
            told = at = end.end() if end else n
    if told < n:
        yield "text", "", html[told:]


def _attributes(rest: str) -> dict[str, str]:
    if not rest or rest.isspace():
        return {}
    return {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(rest)}


def boilerplate(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element is no part of an article: by its kind, its names, its role, or as hidden."""
    if name in _DROPPED or (name == "header" and not in_article):
        return True
    if not attributes or name in _KEPT:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return True
    if attributes.get("role", "").lower() in _ROLES:
        return True
    words = set(_NAME_PARTS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", f"{attributes.get('class', '')} {attributes.get('id', '')}")))
    words = {w.lower() for w in words}
    if not in_article and "header" in words:
        return True
    return bool(words & _WORDS) and not words & _HOLDERS


def key(name: str, attributes: dict[str, str]) -> str:
    """What tokens are aligned by: the element and its classes, digits left out."""
    classes = sorted(set(_NAME_PARTS.findall(attributes.get("class", "").lower())))
    return ".".join([name, *classes])


class Page:
    """A page walked once: ``text(stack, raw)`` for each text.

    The stack holds ``(name, key, in_article, boilerplate, node, in_link)`` of the open elements.
    """

    def __init__(self, html: str):
        self.html = html

    def walk(self, node, enter, text, block) -> None:
        stack = [("", "", False, False, node, False)]
        is_open = Counter()

        def cut(i: int) -> None:
            is_open.subtract(s[0] for s in stack[i:])
            del stack[i:]

        for kind, name, rest in events(self.html):
            if kind == "text":
                text(stack, rest)
            elif kind == "open":
                for ended in _ENDS.get(name, ()):
                    for i in range(len(stack) - 1, 0, -1) if is_open[ended] else ():
                        if stack[i][0] == ended:
                            cut(i)
                            break
                        if stack[i][0] in _SCOPE:
                            break
                if name in _BLOCK:
                    block(stack)
                if name in _VOID:
                    continue
                attributes = _attributes(rest)
                above = stack[-1]
                dropped = above[3] or boilerplate(name, attributes, above[2])
                within = above[2] or name in ("article", "main")
                k = key(name, attributes)
                stack.append((name, k, within, dropped, enter(stack, k, dropped), above[5] or name == "a"))
                is_open[name] += 1
            else:
                if name in _BLOCK:
                    block(stack)
                for i in range(len(stack) - 1, 0, -1) if is_open[name] else ():
                    if stack[i][0] == name:
                        cut(i)
                        break


#: A group of a wrapper: key, quantifier ("", "?", "+", "*"), pages, characters outside links, children.
Group = list
SLOT = "#text"
#: Elements nested deeper than this belong to the group at this depth.
DEEPEST = 150


def _group(k: str) -> Group:
    return [k, "", 1, 0, []]


def page_wrapper(html: str) -> Group:
    """The wrapper of one page; boilerplate is marked with ``!`` before its key."""
    root = _group("")

    def enter(stack, k, dropped):
        if len(stack) > DEEPEST:
            return stack[-1][4]
        made = _group("!" + k if dropped else k)
        stack[-1][4][4].append(made)
        return made

    def text(stack, raw):
        size = len(raw.strip())
        if size:
            inside = stack[-1][4][4]
            if not inside or inside[-1][0] != SLOT:
                inside.append(_group(SLOT))
            inside[-1][3] += 0 if stack[-1][5] or stack[-1][3] else size

    Page(html).walk(root, enter, text, lambda stack: None)
    return _folded(root)


def _folded(group: Group) -> Group:
    """Neighbouring children of equal key become one repeated group, and characters are summed, from the leaves up."""
    out: list[Group] = []
    for child in map(_folded, group[4]):
        if out and out[-1][0] == child[0]:
            out[-1] = _joined(out[-1], child, same_page=True)
            out[-1][1] = "*" if out[-1][1] in ("?", "*") else "+"
        else:
            out.append(child)
    group[3] += sum(child[3] for child in out)
    group[4] = out
    return group


_WIDER = {"": 0, "?": 1, "+": 2, "*": 3}
_QUANTIFIERS = ("", "?", "+", "*")


def _joined(a: Group, b: Group, same_page: bool = False) -> Group:
    pages = max(a[2], b[2]) if same_page else a[2] + b[2]
    return [a[0], _QUANTIFIERS[_WIDER[a[1]] | _WIDER[b[1]]], pages, a[3] + b[3], _aligned(a[4], b[4])]


def _optional(group: Group) -> Group:
    return [group[0], _QUANTIFIERS[_WIDER[group[1]] | 1], *group[2:]]


def _aligned(a: list[Group], b: list[Group]) -> list[Group]:
    """Two sequences of groups as one; what only one has is optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [_joined(x, y) for x, y in zip(a, b)]
    # Longest common subsequence of keys.
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            rows[i][j] = rows[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(rows[i + 1][j], rows[i][j + 1])
    i = j = 0
    out: list[Group] = []
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][0] == b[j][0]:
            found = _joined(a[i], b[j])
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and rows[i + 1][j] >= rows[i][j + 1]):
            found, i = _optional(a[i]), i + 1
        else:
            found, j = _optional(b[j]), j + 1
        if out and out[-1][0] == found[0]:
            out[-1] = _joined(out[-1], found)
            out[-1][1] = "*" if "*" in (out[-1][1],) or out[-1][1] == "?" else "+"
        else:
            out.append(found)
    return out


def aligned(a: Group | None, b: Group | None) -> Group | None:
    if a is None or b is None:
        return a or b
    return _joined(a, b)


def expression(group: Group) -> str:
    """The wrapper as a regular expression over tags; ``#text`` is a slot."""
    name = group[0].removeprefix("!")
    if name == SLOT:
        inner = SLOT
    else:
        parts = " ".join(map(expression, group[4]))
        inner = f"<{name}> {parts} </{name.split('.')[0]}>" if name else parts
    return f"( {inner} ){group[1]}" if group[1] else inner


def main_path(wrapper: Group) -> list[str]:
    """Keys from the root to the innermost container that holds all text of articles outside links.

    A container is left as soon as a second group in it has such text, be it a heading. Empty where no
    page has text.
    """
    path, group = [], wrapper
    while True:
        inside = [g for g in group[4] if g[3]]
        if len(inside) != 1 or inside[0][0].split(".")[0] not in _CONTAINERS:
            return path
        group = inside[0]
        path = [*path, group[0]]
        if group[0].split(".")[0] == "article":
            return path


def _below(html: str, path: list[str]) -> tuple[str | None, bool]:
    """What ``extract`` gives, and whether text outside boilerplate and links is left out of it."""
    parts: list[str] = []
    found, missed = not path, False

    def enter(stack, k, dropped):
        nonlocal found
        above = stack[-1][4]  # keys matched so far, or -1 off the path
        depth = above + 1 if 0 <= above < len(path) and path[above] == k else (above if above == len(path) else -1)
        found |= depth == len(path)
        return depth

    def text(stack, raw):
        nonlocal missed
        if stack[-1][3]:
            return
        if stack[-1][4] == len(path):
            parts.append(unescape(raw))
        elif not missed and raw.strip():
            missed = not stack[-1][5]

    Page(html).walk(0, enter, text, lambda stack: parts.append(" "))
    return (" ".join("".join(parts).split()) if found else None), missed


def extract(html: str, path: list[str]) -> str | None:
    """Text below ``path`` without boilerplate, blocks joined by a space; None if the page has no such place."""
    return _below(html, path)[0]


def main_text(html: str | None, path: list[str] | None) -> str:
    """By the host's path; a page without that place, or with text beside it, goes by the wrapper of its own."""
    if not html:
        return ""
    found, missed = _below(html, path) if path else (None, True)
    return extract(html, main_path(page_wrapper(html))) or "" if found is None or missed else found


def _fold(rows: Iterator[tuple[str, str]]) -> pd.DataFrame:
    held: dict[str, Group] = {}
    for host, wrapper in rows:
        held[host] = aligned(held.get(host), json.loads(wrapper))
    return pd.DataFrame({"host": list(held), "wrapper": [json.dumps(w) for w in held.values()]})


def host_of(column: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(column, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def infer(pages: DataFrame, shares: int = 32) -> DataFrame:
    """``(host, wrapper, expression, path)``: one wrapper for each host, from all its pages.

    ``wrapper`` is JSON of the groups, ``path`` the keys down to the main text. Pages without html
    do not count; pages without a host share the empty one.
    """

    def pages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Group] = {}
        for batch in batches:
            for host, html in zip(values(batch.column(0)), values(batch.column(1), 64)):
                held[host] = aligned(held.get(host), page_wrapper(html))
                if len(held) > 10_000:
                    yield _batch(held)
                    held = {}
        yield _batch(held)

    def _batch(held: dict[str, Group]) -> pa.RecordBatch:
        columns = [pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["host", "wrapper"])

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        return _fold(zip(group["host"], group["wrapper"]))

    rows = pages.where("html is not null and html <> ''").select(host_of().alias("host"), "html")
    schema = "host string, wrapper string"
    local = rows.mapInArrow(pages_of, schema).withColumn("share", F.pmod(F.spark_partition_id(), F.lit(shares)))
    shared = local.groupBy("host", "share").applyInPandas(fold, schema)
    whole = shared.groupBy("host").applyInPandas(fold, schema)

    @F.pandas_udf("struct<expression: string, path: array<string>>")
    def told(wrapper: pd.Series) -> pd.DataFrame:
        groups = wrapper.map(json.loads)
        return pd.DataFrame({"expression": groups.map(expression), "path": groups.map(main_path)})

    return staged(whole.withColumn("_t", told("wrapper")).select("host", "wrapper", "_t.*"), "wrappers")


def main_texts(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages``.

    Null and empty html, and pages without an article, have the empty text. Tags may be nested to any depth
    and left open, quotes may be unbalanced (see ``events``). Repeated rows stay, null
    ids and urls stay null. Character references are decoded, white space becomes one space.
    """
    paths = infer(pages).select(F.col("host").alias("_host"), F.col("path").alias("_path"))

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for html, path in batches:
            yield pa.array([main_text(h, p) for h, p in zip(values(html, 64), values(path))], pa.string())

    rows = pages.select("page_id", "url", "html", host_of().alias("_host")).join(paths, "_host", "left")
    found = rows.select("page_id", "url", run("html", "_path").alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
