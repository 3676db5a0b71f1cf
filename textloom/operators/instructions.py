"""Markdown prose: tighter wording, with code, links, commands, paths and files untouched.

A text is walked line by line with a fence and front-matter state, paragraphs are joined,
and protected spans are taken out of a sentence and put back after; this runs as one
Arrow-batched function.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.regex import py
from textloom.operators.code import _JS_SPACE
from textloom.operators.output import with_savings

#: Fixed values: (pattern, replacement) in the order in which they are applied.
FILLER = r"\b(?:really|basically|actually|simply|generally|just|quite|very|clearly|obviously|essentially)\b"
PLEASANTRY = r"^(?:please\s+|you\s+should\s+|you\s+can\s+|you\s+may\s+|remember\s+to\s+|make\s+sure\s+to\s+)"
PHRASES = [
    (r"\bin order to\b", "to"),
    (r"\bit is important to\b", ""),
    (r"\bit is useful to\b", ""),
    (r"\bit is recommended to\b", ""),
    (r"\bthat you\s+", "to "),
    (r"\bdo not forget to\b", ""),
    (r"\bYour sole job is to\b", ""),
    (r"\bThis agent is intended for\b", "Target:"),
    (r"\bThis repository already contains\b", "Repo already has"),
    (r"\bThe kit already includes\b", "Kit includes"),
    (r"\bTreat it as the starting point for every run, not as empty space to fill\b", "Start from existing kit, not blank space"),
    (
        r"\bIf a capability such as web retrieval is unavailable in the current IDE runtime, note that limitation explicitly and continue with the strongest available local and web-accessible evidence path rather than assuming Claude-style tool availability\b",
        "If web retrieval is unavailable, note it and continue with the strongest local or web-accessible evidence path available",
    ),
    (r"\bOn every run, research\b", "Research"),
    (r"\bTreat lack of change as a finding and record it when relevant\b", "Record lack of change when relevant"),
    (r"\bDo not\s+", "Do not "),
    (r"^This repository\s+", "Repo "),
    (r"^This (?:file|repo|repository|kit|document)\s+", ""),
    (r"^There are\s+", ""),
]
PROTECTED = [
    r"`[^`]*`",
    r"\[[^\]]+\]\([^)]+\)",
    r"https?:\/\/\S+",
    r"\b(?:npm|pnpm|yarn|node|npx|git|docker|kubectl|python|python3|pip|uv|curl|bash|pwsh|powershell)\b[^\n]*",
    r"(?:\.{0,2}\/|~\/|\/?[A-Za-z0-9_.-]+\/)[^\s`)]*",
    r"\b[A-Za-z0-9_.-]+\.(?:md|ts|tsx|js|jsx|json|ya?ml|toml|feature|spec\.ts|instructions\.md|agent\.md)\b",
]
LINE_STARTS = ("#", "---", "|", ">", "```", "<!--")

_PROTECTED = re.compile("|".join(py(p) for p in PROTECTED))
_STEPS = [(re.compile(py(FILLER), re.I), ""), (re.compile(py(PLEASANTRY), re.I), ""), *[(re.compile(py(p), re.I), r) for p, r in PHRASES]]
_TIDY = [(re.compile(py(p)), r) for p, r in ((r"\s{2,}", " "), (r"\s+([,.;:!?])", r"\1"), (r":\s*$", ":"))]
_NUMBERED, _BULLET = re.compile(py(r"^\s*\d+\.\s+")), re.compile(py(r"^\s*[-*]\s+"))
_HELD = "{}"


def _put_back(text: str, held: list[str]) -> str:
    """Restore spans; ``$`` sequences in a span act as in ECMAScript replacement strings."""
    for k, span in enumerate(held):
        mark = _HELD.format(k)
        at = text.find(mark)
        if at < 0:
            continue
        special = {"$$": "$", "$&": mark, "$`": text[:at], "$'": text[at + len(mark) :]}
        text = text[:at] + re.sub(r"\$[$&`']", lambda m: special[m[0]], span) + text[at + len(mark) :]
    return text


def tighten(sentence: str) -> str:
    """A shorter wording of one sentence."""
    held: list[str] = []

    def take(m):
        held.append(m[0])
        return _HELD.format(len(held) - 1)

    out = _PROTECTED.sub(take, sentence)
    for pattern, by in [*_STEPS, *_TIDY]:
        out = pattern.sub(by, out)
    return _put_back(out.strip(_JS_SPACE), held)


def compress_text(text: str) -> str:
    """The whole text. Only a bare ``` toggles a fence, and front matter starts on the first line."""
    out: list[str] = []
    paragraph: list[str] = []
    fenced = front = front_done = False

    def flush():
        if paragraph:
            joined = " ".join(x.strip(_JS_SPACE) for x in paragraph)
            out.append(tighten(joined) or joined.strip(_JS_SPACE) or joined)
            paragraph.clear()

    for i, line in enumerate(text.split("\n")):
        bare = line.strip(_JS_SPACE)
        if bare == "```":
            fenced = not fenced
        elif not front_done and i == 0 and bare == "---":
            front = True
        elif front:
            if bare == "---":
                front, front_done = False, True
        elif not fenced and bare and not bare.startswith(LINE_STARTS):
            lead = _NUMBERED.match(line) or _BULLET.match(line)
            if lead is None:
                paragraph.append(line)
                continue
            body = tighten(line[lead.end() :])
            line = lead[0] + body if body else line
        flush()
        out.append(line)
    flush()
    while out and out[0] == "":
        out.pop(0)
    while out and out[-1] == "":
        out.pop()
    return "\n".join(out)


def _compress(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else compress_text(t) for t in texts], dtype=object)


def compress(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds output and the token columns."""
    return with_savings(df.withColumn(f"{prefix}output", F.pandas_udf(_compress, "string")(F.col(text_col))), text_col, prefix)
