"""Text functions: normalization that keeps positions, masking, separators, windows and markers.

Each has a Column form for plans and, where the matcher needs it, a Python form with the same results.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_HYPHENS = [0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2212, 0xFE63, 0x00AD, 0x2043, 0xFE58, 0x2E3A]
_SPACES = [0x3000, 0x00A0, 0x202F, 0x205F, *range(0x2000, 0x200B), 0x200B, 0x2060, 0xFEFF]
_KANA = (
    "。「」、・ヲァィゥェォャュョッー"
    "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゙゚"
)
#: Every character that normalization replaces on its own, and what by.
TABLE: dict[int, int] = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
TABLE |= dict.fromkeys(_HYPHENS, ord("-")) | dict.fromkeys(_SPACES, ord(" ")) | {0xFF61 + i: ord(k) for i, k in enumerate(_KANA)}
_FROM, _TO = "".join(map(chr, TABLE)), "".join(map(chr, TABLE.values()))
assert len(_FROM) == len(_TO)
_LONG = re.compile("(?<=[0-9])[ー゠]|[ー゠](?=[0-9])")
#: What exempts a line, as a token of its own in a comment; a scan may name others.
IGNORE_MARKERS = ("shirabe:ignore", "shirabe:allow")


def normalize(c: Column) -> Column:
    """Full-width ASCII, half-width kana, hyphens and spaces in one form, a character for a character; long
    vowel marks beside a digit are hyphens."""
    return F.regexp_replace(F.translate(c, _FROM, _TO), _LONG.pattern, "-")


#: Whether a line has anything to normalise; most lines of any language have not.
_ODD = re.compile("[" + "".join(map(re.escape, map(chr, TABLE))) + "ー゠]")


def normalize_line(s: str) -> str:
    if s.isascii() or not _ODD.search(s):
        return s
    out = list(s.translate(TABLE))
    for i, ch in enumerate(out):
        if ch in "ー゠" and ((i and "0" <= out[i - 1] <= "9") or (i + 1 < len(out) and "0" <= out[i + 1] <= "9")):
            out[i] = "-"
    return "".join(out)


def lines(text: Column) -> Column:
    """The lines of a text, without a carriage return at their ends."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, "\\r\\z", ""))


def has_digit(c: Column) -> Column:
    return c.rlike("[0-9]")


def has_at(c: Column) -> Column:
    return F.contains(c, F.lit("@"))


def has_cjk(c: Column) -> Column:
    return c.rlike("[\\x{3000}-\\x{10FFFF}]")


def has_literal(c: Column, words: list[str]) -> Column:
    """Whether any word stands in the text, in this or in lower case."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(c, F.lit(w)) | F.contains(F.lower(c), F.lit(w))
    return hit


def strip_separators(c: Column) -> Column:
    return F.translate(c, "- .()/", "")


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def mask(c: Column) -> Column:
    """Up to 4 characters: all stars; up to 7: the first and last stay; else two at either end."""
    n = F.length(c)
    keep = F.when(n < 8, F.lit(1)).otherwise(F.lit(2))
    inner = F.concat(F.substring(c, F.lit(1), keep), F.repeat(F.lit("*"), n - 2 * keep), F.substring(c, n - keep + 1, keep))
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(inner)


def mask_value(s: str) -> str:
    if len(s) <= 4:
        return "*" * len(s)
    k = 1 if len(s) < 8 else 2
    return s[:k] + "*" * (len(s) - 2 * k) + s[-k:]


def window(c: Column, start: Column, end: Column, radius: int) -> Column:
    """The text from ``radius`` characters before a span (0-based, half open) to as many after it."""
    a = F.greatest(start - radius, F.lit(0))
    return F.substring(c, a + 1, end + radius - a)


def identifier_tokens(c: Column) -> Column:
    """Identifiers in lower-case words: at case changes, between letters and digits (but not from capitals to
    digits), and wherever no ASCII letter or digit stands."""
    s = F.regexp_replace(c, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " ")
    return F.filter(F.split(F.lower(F.regexp_replace(s, "[^0-9A-Za-z]+", " ")), " "), lambda x: x != "")


def word_contained(c: Column, word: str) -> Column:
    """Whether a keyword stands in a lower-case text, on its own if it begins and ends in ASCII letters or
    digits."""
    if word.isascii() and word[0].isalnum() and word[-1].isalnum():
        return c.rlike("(?<![0-9a-zA-Z])" + re.escape(word) + "(?![0-9a-zA-Z])")
    return F.contains(c, F.lit(word))


def ignored(c: Column, markers=IGNORE_MARKERS) -> Column:
    """Whether a line bears one of the markers that exempt it, as a token of its own."""
    names = "|".join(map(re.escape, markers))
    return c.rlike(f"(?<![\\p{{L}}\\p{{Nd}}_-])(?:{names})(?![\\p{{L}}\\p{{Nd}}_-])")


def uuid_token(c: Column) -> Column:
    """Whether a token is a UUID of version 4, with hyphens or without."""
    return c.rlike("\\A(?:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{12}4[0-9a-fA-F]{3}[89abAB][0-9a-fA-F]{15})\\z")


def line_offset(text: Column, line_no: Column, column: Column) -> Column:
    """Where a line's column (both from 1) stands in the text, in characters from 0."""
    before = F.slice(F.split(text, "\n", -1), 1, line_no - 1)
    return F.aggregate(before, F.lit(0), lambda a, x: a + F.length(x) + 1) + column - 1


def path_is_test(c: Column) -> Column:
    """Whether a path looks like tests or fixtures."""
    return c.rlike("(?:^|/)(?:testdata|fixtures|__tests__|spec|mocks|seeds?)(?:/|$)") | F.element_at(F.split(c, "/"), -1).rlike("(?:_test\\.go\\z|\\.spec\\.|\\.test\\.)")


def compose_kana(c: Column) -> Column:
    """Kana and a combining voice mark in one character."""
    from ..detect.dictionaries import _PAIRS

    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sorted(_PAIRS.items())))
    return F.aggregate(pairs, c, lambda acc, x: F.replace(acc, x["a"], x["b"]))
