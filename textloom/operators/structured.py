"""JSON payloads of unknown shape: pruned, summarised, flattened.

The shape differs from row to row and nests freely, which no Spark type expresses; the
walk runs as an Arrow-batched function. Number spelling and key order follow ECMAScript.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.output import with_savings

#: Arrays longer than this are summarised to their first items.
ARRAY_LIMIT, ARRAY_KEPT = 5, 3
SUMMARY_KEY = "_headroom_summary"
PATHS, VALUE_CHARS = 40, 80


def _order(pairs):
    """Keys that are array indexes come first, in order; a repeated key keeps its first place and last value."""
    d = dict(pairs)
    index = sorted((k for k in d if k.isdigit() and (k == "0" or k[0] != "0") and int(k) < 2**32 - 1), key=int)
    return {**{k: d[k] for k in index}, **{k: v for k, v in d.items() if k not in set(index)}} if index else d


def _refuse(name):
    raise ValueError(f"{name} is no JSON")


def parse(text: str):
    return json.loads(text, object_pairs_hook=_order, parse_int=float, parse_constant=_refuse)


def number(x: float) -> str:
    """The shortest spelling of a double, as ECMAScript writes it."""
    if math.isinf(x):
        return "null"
    if x == 0:
        return "0"
    sign, x = ("-" if x < 0 else ""), abs(x)
    mantissa, _, exponent = repr(x).partition("e")
    whole, _, fraction = mantissa.partition(".")
    fraction = "" if fraction == "0" else fraction
    digits = (whole + fraction).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + fraction) - len(digits)) if whole.strip("0") == "" else len(whole) + int(exponent or 0)
    digits = digits.rstrip("0") or "0"
    if len(digits) <= point <= 21:
        return sign + digits + "0" * (point - len(digits))
    if 0 < point <= 21:
        return sign + digits[:point] + "." + digits[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + digits
    e = point - 1
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"


def write(value) -> str:
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    if isinstance(value, float):
        return number(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False).replace("\x7f", "\x7f")
    if isinstance(value, list):
        return "[" + ",".join(map(write, value)) + "]"
    return "{" + ",".join(f"{write(k)}:{write(v)}" for k, v in value.items()) + "}"


_NOTHING = object()


def prune(value):
    """Nulls, and arrays and objects that hold nothing else, vanish."""
    if value is None:
        return _NOTHING
    if isinstance(value, list):
        return [v for v in map(prune, value) if v is not _NOTHING] or _NOTHING
    if isinstance(value, dict):
        return {k: v for k, v in ((k, prune(v)) for k, v in value.items()) if v is not _NOTHING} or _NOTHING
    return value


def shorten(value):
    """Long arrays of objects whose keys the first object all has keep three items and a count."""
    if isinstance(value, dict):
        return {k: shorten(v) for k, v in value.items()}
    if not isinstance(value, list):
        return value
    items = [shorten(v) for v in value]
    if len(items) > ARRAY_LIMIT and all(isinstance(v, dict) and v.keys() <= items[0].keys() for v in items):
        return [*items[:ARRAY_KEPT], {SUMMARY_KEY: f"... {len(items) - ARRAY_KEPT} more items (same schema)"}]
    return items


def compress_text(text: str) -> tuple[str | None, str | None]:
    """(minified text, error)."""
    try:
        value = prune(parse(text))
    except (ValueError, RecursionError) as e:
        return None, f"Invalid JSON: {e}"
    return (None, "nothing left after pruning") if value is _NOTHING else (write(shorten(value)), None)


def _compress(texts: pd.Series) -> pd.DataFrame:
    if texts.isna().all():
        return pd.DataFrame({"output": texts, "error": texts})
    return pd.DataFrame([(None, None) if t is None else compress_text(t) for t in texts], columns=["output", "error"])


def compress(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds output, error (null if none) and the token columns."""
    df = df.withColumn("_json", F.pandas_udf(_compress, "output string, error string")(F.col(text_col)))
    df = df.withColumn(f"{prefix}output", F.col("_json.output")).withColumn(f"{prefix}error", F.col("_json.error")).drop("_json")
    return with_savings(df, text_col, prefix)


def flatten_text(text: str) -> list[str] | None:
    """C12d: ``a.b.c: value`` lines, depth first, at most 40; None if the text is no JSON."""
    try:
        value = parse(text)
    except (ValueError, RecursionError):
        return None
    out: list[str] = []

    def shown(v):
        s = v if isinstance(v, str) else write(v)
        return s[: VALUE_CHARS - 3] + "…" if len(s) > VALUE_CHARS else s

    def walk(v, path):
        pairs = v.items() if isinstance(v, dict) else ((str(i), x) for i, x in enumerate(v))
        for k, x in pairs:
            if len(out) >= PATHS:
                return
            here = f"{path}.{k}" if path else k
            if isinstance(x, dict | list):
                walk(x, here)
            else:
                out.append(f"{here}: {shown(x)}")

    if isinstance(value, dict | list):
        walk(value, "")
    return out


def _flatten(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else flatten_text(t) for t in texts], dtype=object)


def flat_paths(text, wanted=None):
    """Flattened lines of the text; null where it is no JSON (or not ``wanted``)."""
    return F.pandas_udf(_flatten, "array<string>")(text if wanted is None else F.when(wanted, text))


def is_json_like(text):
    """Trimmed text in braces or brackets."""
    braces = text.rlike(rf"\A[{T.WS}]*\{{") & text.rlike(rf"\}}[{T.WS}]*\z")
    return braces | (text.rlike(rf"\A[{T.WS}]*\[") & text.rlike(rf"\][{T.WS}]*\z"))
