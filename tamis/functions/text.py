"""Text cleaning and tokens, as column expressions.

They stay in the JVM, but for texts with letters that no table of single letters folds.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions.wordlists import CONTRACTIONS, STOP_WORDS

# Unicode white space, and the four ASCII separators that text tools also split at. Listed behind a range that
# printable ASCII is not in, because a class of properties or of many ranges takes long for every character.
_OTHER_BLANKS = r"\x09-\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_ANY_BLANK = rf"[\x00-\x20\x{{7F}}-\x{{10FFFF}}&&[\x20{_OTHER_BLANKS}]]"
_OTHER_BLANK = rf"[\x00-\x1F\x{{7F}}-\x{{10FFFF}}&&[{_OTHER_BLANKS}]]"
# Every run but a single blank, which a blank would replace.
_BLANK = rf"{_OTHER_BLANK}{_ANY_BLANK}*+|\x20{_ANY_BLANK}++"
_NOT_BLANK = r"(?U)[^\s\x1C-\x1F]+"
# Marks that become tokens of their own wherever they stand.
_PUNCTUATION = r"""([,;:@#$%&?!"()\[\]{}<>`«»“”„‘’]|--|\.\.\.)"""
# Endings that part from their word before a blank.
_CLITIC = r"(n't|N'T|'(?:[sSmMdD]|ll|LL|re|RE|ve|VE)?) "
# A full stop before a blank, but not the end of an ellipsis.
_FINAL_STOP = r"\.(?<!\.\.) "
# Whole lines made of letters only: `(?d)` lets nothing but a line feed end a line.
_LETTER_LINE = r"(?dm)^\p{L}+$"


def collapse_blanks(text: Column) -> Column:
    """Every run of white space becomes one blank; none at either end."""
    return F.trim(F.regexp_replace(text, _BLANK, " "))


def char_count(text: Column) -> Column:
    """Code points."""
    return F.length(text).cast("bigint")


def word_count(text: Column) -> Column:
    """Stretches between white space."""
    return F.regexp_count(text, F.lit(_NOT_BLANK)).cast("bigint")


def _inside_stretches(pattern: str) -> bool:
    """Whether all that a pattern matches has an apostrophe and no blank: letters, groups of them and ``\\b``."""
    plain = pattern.removeprefix("(?i)").replace(r"\b", "").replace("[a-z]+", "a")
    outside = re.sub(r"\([A-Za-z|']*\)", "", plain)
    return bool(re.fullmatch(r"[A-Za-z']*", outside)) and "'" in outside


def expand_contractions(
    text: Column,
    rules: Sequence[tuple[str, str]] = CONTRACTIONS,
    source: Column | None = None,
) -> Column:
    """Open contractions where an ASCII apostrophe occurs; such texts lose all non-ASCII characters.

    Typographic apostrophes are left alone. ``rules`` are ``(pattern, expansion)`` pairs applied in
    order; texts without an apostrophe skip the whole chain. ``source`` may name the column that
    ``text`` was made from, to look for the apostrophe there.
    """
    def expand(opened: Column, rules: Sequence[tuple[str, str]]) -> Column:
        for pattern, expansion in rules:
            opened = F.regexp_replace(opened, pattern, expansion)
        return opened

    opened = F.regexp_replace(text, r"[^\x00-\x7F]+", "")
    # The first rules that can only match inside a stretch with an apostrophe need no other.
    inside = next((i for i, (pattern, _) in enumerate(rules) if not _inside_stretches(pattern)), len(rules))
    if inside:
        said = lambda w: F.when(F.contains(w, F.lit("'")), expand(w, rules[:inside])).otherwise(w)
        opened = F.array_join(F.transform(F.split(opened, " "), said), " ")
    opened = expand(opened, rules[inside:])
    apostrophe = F.contains(text if source is None else source, F.lit("'"))
    return F.when(apostrophe, opened).otherwise(text)


def _part_punctuation(collapsed: Column, source: Column, abbreviations: Sequence[str] = ()) -> Column:
    """Blanks around every token of a text whose only white space is single blanks.

    ``source`` is the column the text was made from: it tells, without computing the text a second
    time, whether there can be an apostrophe. Final stops of ``abbreviations`` stay.
    """
    padded = F.concat(F.lit(" "), collapsed, F.lit(" "))
    padded = F.regexp_replace(padded, _PUNCTUATION, " $1 ")
    clitics = F.regexp_replace(padded, _CLITIC, " $1 ")
    padded = F.when(F.contains(source, F.lit("'")), clitics).otherwise(padded)
    if not abbreviations:
        return F.regexp_replace(padded, _FINAL_STOP, " . ")
    stretches = F.regexp_extract_all(padded, F.lit("[^ ]+"), F.lit(0))
    stem = lambda t: F.substring(t, F.lit(1), F.length(t) - 1)
    final = lambda t: t.endswith(".") & ~t.endswith("..") & (F.length(t) > 1)
    whole = lambda t: F.lower(stem(t)).isin(*abbreviations)
    parted = F.transform(stretches, lambda t: F.when(final(t) & ~whole(t), F.concat(stem(t), F.lit(" ."))).otherwise(t))
    return F.concat(F.lit(" "), F.array_join(parted, " "), F.lit(" "))


def word_tokens(text: Column, abbreviations: Sequence[str] = ()) -> Column:
    """Treebank-like tokens: punctuation, quotes, clitics and a word-final full stop stand alone.

    Words with an inner hyphen, slash, dot or digit stay whole. The full stop of a word in
    ``abbreviations`` (lower case, without the stop) stays with it; ``corpus.abbreviations`` finds them.
    """
    parted = _part_punctuation(F.regexp_replace(text, _BLANK, " "), text, abbreviations)
    return F.regexp_extract_all(parted, F.lit("[^ ]+"), F.lit(0))


#: Latin, Greek and Cyrillic letters, marks, and general punctuation are folded by a translation table.
_TABLE = [range(0x80, 0x600), range(0x1E00, 0x1F00), range(0x2000, 0x2070)]


def _folded(text: str, compatibility: bool) -> str:
    """Decomposed, and without combining characters (compatibility form) or marks of no width."""
    if compatibility:
        return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


@cache
def _folding(compatibility: bool) -> tuple[str, str, str]:
    """What ``translate`` replaces and by what, characters to delete last, and a regular expression class of
    the characters that it cannot fold, behind one range that tells ASCII apart: it has some forty ranges."""
    single, gone, others = [], [], []
    for code in (c for part in _TABLE for c in part):
        folded = _folded(chr(code), compatibility)
        if folded != chr(code) and len(folded) > 1:
            others.append((code, code))
        elif folded != chr(code):
            (single if folded else gone).append((chr(code), folded))
    others += [(a.stop, b.start - 1) for a, b in zip(_TABLE, _TABLE[1:])] + [(_TABLE[-1].stop, 0x10FFFF)]
    ranges = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in others)
    return "".join(c for c, _ in single + gone), "".join(f for _, f in single), rf"[\x{{80}}-\x{{10FFFF}}&&[{ranges}]]"


def _fold(text: Column, compatibility: bool, source: Column | None = None) -> Column:
    """``_folded`` of a lower-cased text: a table for Latin, Greek and Cyrillic letters, inside the JVM, and a
    function over batches for texts with any other character that changes. Both give the same for
    the same text, so filters move below and plans may compute either again. ``source`` may name a lower-cased
    text that has every character of ``text`` beyond ASCII: looking for others there spares making ``text`` twice.
    """

    @F.arrow_udf("string")
    def fold(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None else _folded(t, compatibility) for t in texts.to_pylist()], pa.string())

    matched, replaced, others = _folding(compatibility)
    elsewhere = fold(F.when((text if source is None else source).rlike(others), text))
    return F.coalesce(elsewhere, F.translate(text, matched, replaced))


def fold_case_and_accents(text: Column, source: Column | None = None) -> Column:
    """Lower case, compatibility decomposition, combining characters dropped. ``source`` may name the column that
    ``text`` was made from without adding any character beyond ASCII."""
    return _fold(F.lower(text), True, None if source is None else F.lower(source))


def normalize_tokens(tokens: Column) -> Column:
    """``fold_case_and_accents`` of every token, in one call per document."""
    folded = F.split(fold_case_and_accents(F.array_join(tokens, "\n")), "\n")
    return F.when(F.size(tokens) > 0, folded).otherwise(tokens)


def model_text(text: Column) -> Column:
    """Input for uncased models: null becomes empty, lower case, accents (Mn) dropped."""
    return _fold(F.lower(F.coalesce(text, F.lit(""))), False)


def text_pair(text_a: Column, text_b: Column) -> Column:
    return F.struct(text_a.alias("text_a"), text_b.alias("text_b"))


def keep_alphabetic(tokens: Column) -> Column:
    """Tokens made of letters only."""
    return F.filter(tokens, lambda t: t.rlike(r"^\p{L}+$"))


def drop_words(tokens: Column, words: Sequence[str] = STOP_WORDS) -> Column:
    """Tokens not in a fixed list; case matters. The list is looked up as a hash set."""
    return F.filter(tokens, lambda t: ~t.isin(*words)) if words else tokens


def clean_tokens(
    text: Column,
    contractions: Sequence[tuple[str, str]] = CONTRACTIONS,
    stop_words: Sequence[str] | None = STOP_WORDS,
    abbreviations: Sequence[str] = (),
) -> Column:
    """The cleaning chain up to the stop words, in one projection.

    The same as ``drop_words(keep_alphabetic(normalize_tokens(word_tokens(expand_contractions(
    collapse_blanks(text))))))``, but the text is held one token per line until the end, so that
    normalising, splitting and keeping alphabetic tokens are one pass each over one string.
    """
    opened = expand_contractions(collapse_blanks(text), contractions, text)
    parted = _part_punctuation(opened, text, abbreviations)
    lines = fold_case_and_accents(F.replace(parted, F.lit(" "), F.lit("\n")), text)
    tokens = F.regexp_extract_all(lines, F.lit(_LETTER_LINE), F.lit(0))
    return drop_words(tokens, stop_words) if stop_words else tokens


def profile_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def ngrams(tokens: Column, shortest: int = 1, longest: int = 1) -> Column:
    """All n-grams of ``shortest`` to ``longest`` tokens, joined by blanks, as one array."""

    def of_length(n: int) -> Column:
        if n == 1:
            return tokens
        joined = F.transform(
            tokens, lambda t, i: F.concat_ws(" ", t, *[F.get(tokens, i + j) for j in range(1, n)])
        )
        return F.slice(joined, F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(0)))

    return F.concat(*[of_length(n) for n in range(shortest, longest + 1)])


def adjacent_pairs(tokens: Column) -> Column:
    """Neighbouring tokens as ``(w1, w2)`` structs; none for fewer than two tokens."""
    count = F.greatest(F.size(tokens) - 1, F.lit(0))
    # Two shifted slices in compiled code: a function of every token would be interpreted.
    firsts, seconds = (F.slice(tokens, F.lit(at), count) for at in (1, 2))
    return F.arrays_zip(firsts.alias("w1"), seconds.alias("w2"))


def argmax(scores: Column) -> Column:
    """Position of the highest score, the first on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
