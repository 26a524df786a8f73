"""Text predicates and counts as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode case folding and classes: Java's plain (?i) knows ASCII only.
FLAGS = "(?iuU)"


def word_pattern(words: Sequence[str], boundary: str = "word") -> str:
    """Pattern that matches any of ``words`` as whole words.

    ``boundary='word'`` asks for a word boundary on both sides, so a word that
    ends in a symbol ("c++") only matches before a letter or digit;
    ``'lookaround'`` asks that no word character touches it instead.
    """
    body = "(?:" + "|".join(re.escape(w) for w in words) + ")"
    return f"{FLAGS}\\b{body}\\b" if boundary == "word" else f"{FLAGS}(?<!\\w){body}(?!\\w)"


def filled(column: Column | str) -> Column:
    return F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit(""))


def matches_any(columns: Sequence[Column | str], words: Sequence[str], boundary: str = "word") -> Column:
    """Whether any column holds any word; no words: false."""
    if not words:
        return F.lit(False)
    pattern = F.lit(word_pattern(words, boundary))
    return reduce(or_, [F.rlike(filled(c), pattern) for c in columns])


def keyword_hits(columns: Sequence[Column | str], words: Sequence[str], boundary: str = "word") -> Column:
    """Occurrences of the words in all columns (repeats count); no words: 0."""
    if not words:
        return F.lit(0).cast("long")
    pattern = F.lit(word_pattern(words, boundary))
    return reduce(lambda a, b: a + b, [F.regexp_count(filled(c), pattern) for c in columns]).cast("long")


def strip(column: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def is_blank(column: Column | str) -> Column:
    """Null, only white space, or the text "nan" that some writers leave for missing cells."""
    return F.coalesce(strip(column).isin("", "nan"), F.lit(True))


def blank_to_null(column: Column | str) -> Column:
    return F.when(~is_blank(column), column if isinstance(column, Column) else F.col(column))


def collapse_blank_lines(column: Column) -> Column:
    return F.regexp_replace(column, "\n{3,}", "\n\n")


def without_decoration(column: Column) -> Column:
    """Without pictographs and white space other than plain spaces; the left is stripped if anything went."""
    clean = F.regexp_replace(column, r"(?U)[^\S ]|[\x{2600}-\x{27BF}\x{1F000}-\x{1FAFF}]", "")
    return F.when(clean == column, column).otherwise(F.ltrim(clean))


def prompt(*parts: Column | str, separator: str = "\n\n") -> Column:
    """Prompt from its parts; null parts are left out."""
    return F.concat_ws(separator, *parts)


def interval_of(modifier: str) -> str:
    """SQL interval of a modifier such as ``-24 hours``; ValueError for any other text."""
    found = re.fullmatch(r"\s*([+-]?\d+)\s+(second|minute|hour|day|month|year)s?\s*", modifier)
    if not found:
        raise ValueError(f"not a time modifier: {modifier!r}")
    return f"INTERVAL '{int(found[1])}' {found[2].upper()}"


def first_heading(html: Column | str) -> Column:
    """Text of the first ``h1`` in the markup, without tags; of references only ``&lt;``, ``&gt;`` and ``&amp;`` are decoded.

    Spaces of any kind around it go, line ends stay; null where nothing is left. ``html.extract_detail``
    reads the tree instead and decodes every reference, also unfinished ones.
    """
    text = F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", "")
    for reference, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(reference), F.lit(sign))
    return F.nullif(F.regexp_replace(text, r"\A\p{Zs}+|\p{Zs}+\z", ""), F.lit(""))


def only_references(html: Column | str, names: Sequence[str]) -> Column:
    """Markup in which a parser decodes these references alone (``quot;``, or ``amp`` for one that may end early): all others become text.

    Not for markup whose scripts are read: nothing is decoded in them.
    """
    return F.regexp_replace(html, "&(?!" + "|".join(re.escape(n) for n in names) + ")", "&amp;")
