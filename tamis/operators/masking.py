"""Removal of words that give the label away. Levels add up: level n applies 1..n."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import collapse_blanks
from tamis.functions.wordlists import TEXT_RULES, TOKEN_RULES
from tamis.operators.corpus import remove_tokens, token_sets
from tamis.sources.store import write_through

PLACE_LEVEL = 4

Rules = Mapping[int, Sequence[str]]


def _up_to(rules: Rules, level: int) -> list[str]:
    return [pattern for at in sorted(rules) if at <= level for pattern in rules[at]]


def mask_tokens(tokens: Column, level: int, rules: Rules = TOKEN_RULES["strict"]) -> Column:
    """Drop tokens that a rule up to ``level`` matches as a whole, whatever their case.

    Rules that are plain words are looked up as a hash set, all others form one expression.
    """
    patterns = _up_to(rules, level)
    words = [p for p in patterns if re.fullmatch(r"[\w-]+", p)]
    others = [p for p in patterns if p not in words]
    keep = tokens
    if words:
        keep = F.filter(keep, lambda t: ~F.lower(t).isin(*[w.lower() for w in words]))
    if others:
        whole = f"(?iU)^(?:{'|'.join(others)})$"
        keep = F.filter(keep, lambda t: ~t.rlike(whole))
    return keep


def gazetteer(*name_tables: DataFrame) -> DataFrame:
    """Union of one-column tables of place names, lower-cased, without repeats."""
    lowered = [
        table.select(F.lower(F.col(table.columns[0])).alias("name")) for table in name_tables
    ]
    merged = lowered[0]
    for table in lowered[1:]:
        merged = merged.union(table)
    return merged.where(F.col("name").isNotNull()).distinct()


def _one_column(names: DataFrame) -> DataFrame:
    return names.select(F.lower(F.col(names.columns[0])).alias("name")).where("name IS NOT NULL").distinct()


def mask_places(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Drop tokens that are a name in the gazetteer. Names of several words match no token.

    ``names`` has one column, of any name; nulls in it match nothing. A document sends each of its
    distinct tokens to the join once, adaptive execution splits what frequent tokens send, and only
    the hits are joined back to their documents.
    """
    sent = token_sets(docs).withColumn("name", F.lower("token"))
    return remove_tokens(docs, sent.join(_one_column(names), "name", "left_semi"))


def _need_names(level: int, names: object) -> None:
    if level >= PLACE_LEVEL and names is None:
        raise ValueError(f"mask level {level} removes place names: pass a gazetteer (argument names)")


def mask(
    docs: DataFrame,
    level: int,
    names: DataFrame | None = None,
    rule_set: str = "strict",
) -> DataFrame:
    """All token masks up to ``level``; level 0 changes nothing, level 4 needs ``names``."""
    _need_names(level, names)
    if level < 1:
        return docs
    masked = docs.withColumn("tokens", mask_tokens(F.col("tokens"), level, TOKEN_RULES[rule_set]))
    if level >= PLACE_LEVEL:
        masked = mask_places(masked, names)
    return masked


def _guard(patterns: Sequence[str]) -> str:
    """What is cheap to see before ``\\b`` and one of ``patterns``: no letter, then one of their first letters.

    Empty if a pattern may begin otherwise. All it rules out are places that are no word border or where no
    pattern begins, but Unicode word borders take long at every character.
    """
    letters = set()
    for pattern in patterns:
        plain = re.sub(r"\([^()]*\)", "", pattern)
        odd = re.search(r"\(\?[^:]|\\[()QE]|\[[^\]]*[()]", pattern) or "|" in plain
        begins = re.match(r"(?:\(\?:([A-Za-z])(?![?*+{])[^()|]*\)\?)?([A-Za-z])(?![?*+{])", pattern)
        if odd or not begins:
            return ""
        letters.update(filter(None, begins.groups()))
    return f"(?<![A-Za-z])(?=[{''.join(sorted(letters))}])" if letters else ""


def mask_text(
    text: Column,
    level: int,
    names: Sequence[str] = (),
    rules: Rules = TEXT_RULES["strict"],
    extra: Sequence[str] = (),
) -> Column:
    """Delete rule matches inside running text, then place names, then surplus blanks.

    Case matters, so lower-case first. ``extra`` patterns (links, handles) go before the levels.
    ``names`` are compared with whole stretches between blanks, whatever their case; level 4 needs them.
    """
    _need_names(level, names or None)
    out = text
    for pattern in extra:
        out = F.regexp_replace(out, f"(?U){pattern}", "")
    for at in sorted(rules):
        if at <= level:
            out = F.regexp_replace(out, rf"(?U){_guard(rules[at])}\b(?:{'|'.join(rules[at])})\b", "")
    out = collapse_blanks(out)
    if level >= PLACE_LEVEL:
        lowered = [n.lower() for n in names]
        words = F.filter(F.split(out, " "), lambda w: ~F.lower(w).isin(*lowered))
        out = F.array_join(words, " ")
    return out


def mask_texts(
    docs: DataFrame,
    level: int,
    names: DataFrame | None = None,
    rule_set: str = "strict",
) -> DataFrame:
    """``mask_text`` of the ``text`` column with a gazetteer table of any size; level 4 needs one."""
    _need_names(level, names)
    rules = min(level, PLACE_LEVEL - 1)
    out = docs.withColumn("text", mask_text(F.col("text"), rules, rules=TEXT_RULES[rule_set]))
    if level < PLACE_LEVEL:
        return out
    # Written: the masks take long, and both the look-up and the documents need them.
    split = write_through(out, "masked").withColumn("tokens", F.split("text", " "))
    return mask_places(split, names).withColumn("text", F.array_join("tokens", " ")).select(*docs.columns)
