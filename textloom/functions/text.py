"""Column helpers with ECMAScript semantics: lengths, trimming, rounding, previews.

All are plain expressions: no UDF, no shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.regex import _SPACE, java, java_search

#: ECMAScript white space and line terminators.
SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
WS = _SPACE["java"]
WS_RE2 = _SPACE["re2"]


def u16_length(text) -> Column:
    """Length in UTF-16 units: code points, plus one for each beyond the basic plane. (§1.2)"""
    text = F.col(text) if isinstance(text, str) else text
    # as many bytes as code points: ASCII alone; else whole runs are cut, not single characters
    beyond = F.when(F.octet_length(text) == F.length(text), F.lit(0)).otherwise(F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]++", "")))
    return (F.length(text) + beyond).cast("long")


def estimate_tokens(text) -> Column:
    """A quarter of the length, rounded up."""
    return F.ceil(u16_length(text) / 4).cast("long")


def js_round(x) -> Column:
    """Half toward plus infinity."""
    return F.floor(x + F.lit(0.5))


def savings_ratio(before, after) -> Column:
    """Whole percent saved; 0 where nothing was there."""
    return F.when(before > 0, js_round((1 - after / before) * 100)).otherwise(F.lit(0)).cast("int")


def to_fixed_2(x) -> Column:
    """Two decimals, decided on the exact binary value, ties up; for values from 0 to a million.

    x is split into a part of 26 fractional bits and the rest, so that both products by 200
    are exact and their sum has the true sign.
    """
    n = F.floor(x * 100)
    head = F.floor(x * 2.0**26) / 2.0**26
    n = F.when(200 * head - (2 * n + 1) + 200 * (x - head) >= 0, n + 1).when(200 * head - (2 * n - 1) + 200 * (x - head) < 0, n - 1).otherwise(n)
    return n / F.lit(100.0)


def trim(text) -> Column:
    return F.btrim(text, F.lit(SPACES))


def trim_end(text) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def trim_start(text) -> Column:
    return F.ltrim(text, F.lit(SPACES))


def squeeze(text) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(text, rf"[{WS}]+", " ")


def truncate_preview(text, most: int = 120) -> Column:
    compact = trim(squeeze(text))
    return F.when(F.length(compact) <= most, compact).otherwise(F.concat(F.substring(compact, 1, most - 3), F.lit("...")))


def lines(text) -> Column:
    """The text's lines, empty ones at the end included."""
    return F.split(text, "\n", -1)


def hinted(text, flags: str, hints) -> Column:
    """Does the text hold one of the literals, of which any match holds one?"""
    where = F.lower(text) if "i" in flags else text
    return reduce(or_, (F.contains(where, F.lit(h)) for h in hints))


def test(text, pattern: str, flags: str = "", hints=()) -> Column:
    """Does an ECMAScript pattern occur in the text? Texts without a hint skip it."""
    found = text.rlike(java_search(pattern, flags))
    return hinted(text, flags, hints) & found if hints else found


def any_of(text, patterns) -> Column:
    """Does any (pattern, flags[, hints]) occur?

    Hints are literals of which a match holds one (lower-case if the pattern ignores case);
    texts without them skip the pattern. Patterns of equal flags without hints become one.
    """
    by_flags: dict[str, list[str]] = {}
    out = F.lit(False)
    for pattern, flags, *hints in patterns:
        if hints:
            out = out | test(text, pattern, flags, hints[0])
        else:
            by_flags.setdefault(flags, []).append(java_search(pattern, flags.replace("i", "")))
    for flags, group in by_flags.items():
        joined = "|".join(f"(?:{p})" for p in group)
        out = out | text.rlike(f"(?i){joined}" if "i" in flags else joined)
    return out


def first_case(pairs, otherwise) -> Column:
    """Value of the first condition that holds."""
    out = F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise
    for condition, value in reversed(pairs):
        out = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def format_count(n) -> Column:
    """Thousands separators."""
    return F.format_number(n.cast("long"), 0)


def let(value, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
