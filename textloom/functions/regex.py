"""One pattern, three dialects.

Rules are written once, in ECMAScript notation. ``java`` gives the Java pattern for
Spark's regular-expression functions, ``re2`` the RE2 pattern for DuckDB, and ``py`` the
one for Python's ``re``. Differences that matter are made explicit: ECMAScript's white
space and line ends, ASCII word boundaries, ``.`` and ``$``.
"""

from __future__ import annotations

import re

#: ECMAScript white space and line terminators as the inside of a character class.
_SPACE = {
    "java": r"\t\n\x0B\f\r \xA0  -     　﻿",
    "re2": r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}",
    "py": r"\t\n\x0B\f\r \xA0  -     　﻿",
}
_LINE_END = {"java": r"\n\r\u2028\u2029", "re2": r"\n\r\x{2028}\x{2029}", "py": r"\n\r\u2028\u2029"}
#: Every character, line ends included; a class in Java, whose groups recurse for each character.
ANY_CHARACTER = {"java": r"[\x{0}-\x{10FFFF}]", "re2": "(?s:.)", "py": "(?s:.)"}
_WORD, _DIGIT = "A-Za-z0-9_", "0-9"


def _starts_with_word(pattern: str, i: int) -> bool:
    """Does the pattern ask for a plain word character at ``i``, for certain?"""
    return pattern[i : i + 1].isascii() and pattern[i : i + 1].isalnum() and pattern[i + 1 : i + 2] not in ("?", "*", "{")


def _known_edge(pattern: str, at: int) -> str | None:
    """What a word boundary at ``at`` comes down to where a neighbour is known to be a word character:
    the other neighbour must not be one. "first" says that the next character is a plain one."""
    if at and pattern[at - 1].isascii() and pattern[at - 1].isalnum() and pattern[at - 2 : at - 1] != "\\":
        return f"(?![{_WORD}])"
    i = at + 2
    if _starts_with_word(pattern, i):
        return "first"
    group = re.match(r"\((?:\?:)?((?:[^()\\\[\]]|\\.|\[[^\]]*\]|\((?:[^()\\\[\]]|\\.|\[[^\]]*\])*\))*)\)(.?)", pattern[i:])
    if group and group[2] not in ("?", "*", "{"):
        depth, starts = 0, [0]
        for k, c in enumerate(group[1]):
            depth += (c == "(") - (c == ")")
            if c == "|" and depth == 0:
                starts.append(k + 1)
        if all(_starts_with_word(group[1], k) for k in starts):
            return f"(?<![{_WORD}])"
    return None


def _translate(pattern: str, to: str, flags: str) -> str:
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1]
            i += 2
            if e in "sS":
                if inside and e == "S":
                    raise ValueError("a negated class inside a class")
                out.append(_SPACE[to] if inside else f"[{'^' if e == 'S' else ''}{_SPACE[to]}]")
            elif e in "wWdD":
                body = _WORD if e in "wW" else _DIGIT
                out.append(body if inside and e.islower() else f"[{'^' if e.isupper() else ''}{body}]")
            elif e in "bB" and not inside:
                known = _known_edge(pattern, i - 2) if e == "b" and to == "java" else None
                if known == "first":  # the character is asked first: most places fail there
                    out.append(f"{pattern[i]}(?<![{_WORD}].)")
                    i += 1
                elif known:
                    out.append(known)
                elif to == "java":
                    edge = rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
                    out.append(edge if e == "b" else rf"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))")
                elif to == "py":
                    out.append(rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))" if e == "b" else rf"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))")
                else:
                    out.append("\\" + e)
            elif e == "/":
                out.append("/")
            else:
                out.append("\\" + e)
            continue
        if inside:
            inside = c != "]"
            out.append("\\[" if c == "[" else "\\&" if c == "&" and to == "java" else c)
        elif pattern.startswith(r"[\s\S]", i):  # any character at all
            out.append(ANY_CHARACTER[to])
            i += 5
        elif c == "[":
            inside = True
            out.append(c)
            if pattern.startswith("^", i + 1):
                out.append("^")
                i += 1
        elif c == ".":
            out.append(f"[^{_LINE_END[to]}]")
        elif c == "^" and "m" in flags:
            out.append("(?m:^)" if to == "re2" else rf"(?:\A|(?<=[{_LINE_END[to]}]))")
        elif c == "$":
            end = r"\z" if to in ("java", "re2") else r"\Z"
            out.append(("(?m:$)" if to == "re2" else rf"(?:{end}|(?=[{_LINE_END[to]}]))") if "m" in flags else end)
        else:
            out.append(c)
        i += 1
    text = "".join(out)
    return f"(?i){text}" if "i" in flags else text


def java(pattern: str, flags: str = "") -> str:
    return _translate(pattern, "java", flags)


def java_search(pattern: str, flags: str = "") -> str:
    """The Java pattern to ask whether ``pattern`` occurs at all.

    ``A[\\s\\S]*B`` is tried from the first A only: if no B follows that one, none follows a later
    one. This keeps the search linear where A is frequent and B absent.
    """
    first, between, then = pattern.partition(r"[\s\S]*")
    if not between:
        return java(pattern, flags)
    anything = ANY_CHARACTER["java"]
    text = rf"\A(?>{anything}*?{java(first, flags.replace('i', ''))}){anything}*{java(then, flags.replace('i', ''))}"
    return f"(?i){text}" if "i" in flags else text


def re2(pattern: str, flags: str = "") -> str:
    return _translate(pattern, "re2", flags)


def py(pattern: str, flags: str = "") -> str:
    return _translate(pattern, "py", flags)


def sql_string(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_test(column: str, pattern: str, flags: str = "", hints=()) -> str:
    """DuckDB: does the pattern occur in the column?"""
    return f"regexp_matches({column}, {sql_string(re2(pattern, flags))})"


def sql_any(column: str, patterns) -> str:
    """DuckDB: does any of (pattern, flags, ...) occur?"""
    return "(" + " OR ".join(sql_test(column, p[0], p[1]) for p in patterns) + ")"
