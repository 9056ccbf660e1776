"""Whitespace, literal and null-ordering helpers shared by every operator.

Spark ``trim`` and Java ``\\s`` leave the ideographic space alone, while the rules reproduced here
treat every Unicode space as white. The class is spelled out so that Java and RE2 agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white-space code points, as a character-class body for Java and RE2.
WS = (
    r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    """Missing text counts as the empty string."""
    return F.coalesce(as_col(c), F.lit(""))


def null_if_empty(c: Column | str) -> Column:
    return F.nullif(as_col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Remove any Unicode white space at both ends."""
    return F.btrim(as_col(c), F.lit(WS_CHARS))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(as_col(c), F.lit(WS_CHARS))


def first_group(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Capture group, or null where the pattern does not match."""
    c = as_col(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def quote_regex(c: Column | str) -> Column:
    """Regex that matches the column's text literally."""
    return F.regexp_replace(as_col(c), r"([\\.\[\]{}()*+\-?^$|#&~])", r"\\$1")


def alternation(words) -> str:
    """Regex alternation of literal words."""
    import re

    return "|".join(re.escape(w) for w in words)


def contains_any(c: Column | str, words) -> Column:
    return as_col(c).rlike(alternation(words))


def count_words_present(c: Column | str, words) -> Column:
    """How many of the words occur in the text (each counted once)."""
    c = as_col(c)
    arr = F.array(*[F.lit(w) for w in words])
    return F.size(F.filter(arr, lambda w: F.contains(c, w)))


def try_int(c: Column | str) -> Column:
    """Integer value of a text, or null."""
    return as_col(c).try_cast("int")


def count_occurrences(text: Column | str, needle: Column | str) -> Column:
    """Non-overlapping occurrences of ``needle`` in ``text``, as Python's ``str.count``."""
    t, n = as_col(text), as_col(needle)
    return F.when(F.length(n) == 0, F.lit(0)).otherwise(
        ((F.length(t) - F.length(F.replace(t, n, F.lit("")))) / F.length(n)).cast("bigint")
    )


def text_windows(col: Column | str, lo: int, hi: Column | int) -> Column:
    """The window of ``lo`` to ``hi`` characters that starts at each position, in order.

    One look-ahead pass of the regex engine over the text: linear, where taking a substring per
    position would walk the UTF-8 text again for each. The guard keeps the second half of a
    supplementary character from counting as a position.
    """
    hi = F.lit(hi) if isinstance(hi, int) else hi
    pattern = F.concat(F.lit(r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(.{%d," % lo), hi.cast("string"), F.lit("}))"))
    return F.regexp_extract_all(as_col(col), pattern, F.lit(1))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
