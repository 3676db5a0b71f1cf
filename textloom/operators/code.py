"""Source code: comments dropped, or outlined to signatures.

Comment dropping is row-local and native: the string of line classes is cut into block
comments and other lines by one pattern. Outlining keeps a running depth per line and
drops whole regions, which no built-in expresses without a quadratic fold; it runs as
one Arrow-batched function.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.regex import py
from textloom.operators.output import chosen_lines, trim_blank_edges, with_savings

#: Languages with // and /* */ comments, and with # comments.
SLASH = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "java", "go", "c", "cpp", "h", "hpp"]
HASH = ["py", "sh", "bash"]
BRACE_OUTLINE = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "java", "go", "c", "cpp", "cc", "h", "hpp", "cs", "rs", "swift", "kt", "kts", "scala", "php"]
PY_OUTLINE = ["py", "pyi"]
BODY = "{ /* … */ }"
CONTROL = r"^(export\s+|public\s+|private\s+|protected\s+|static\s+|async\s+)*\b(if|else|for|while|switch|catch|try|do|finally|with)\b"
CONTAINER = r"\b(class|interface|enum|namespace|module|struct|trait|impl|object)\b"


def language(filename):
    """P5: the extension if its comments are known, else ``unknown``; a name without a dot is its own extension."""
    ext = F.lower(F.substring_index(F.coalesce(filename, F.lit("")), ".", -1))
    return F.when(ext.isin(*SLASH, *HASH), ext).otherwise(F.lit("unknown"))


def compress(df: DataFrame, text_col: str = "text", filename_col: str = "filename", keep_comments=False, prefix: str = "") -> DataFrame:
    """Without comment lines and block comments; blank runs collapsed; trailing space cut.

    ``keep_comments`` may be a boolean or a boolean column. Adds output, language and the
    token columns.
    """
    keep = keep_comments if not isinstance(keep_comments, bool) else F.lit(keep_comments)
    df = df.withColumn("_lang", language(F.col(filename_col))).withColumn("_lines", F.transform(T.lines(F.col(text_col)), T.trim_end)).withColumn("_keep", keep)
    slash, hashed = F.col("_lang").isin(*SLASH), F.col("_lang").isin(*HASH)

    def kind(x, i):
        s = T.trim_start(x)
        opens, closes = slash & s.startswith("/*"), slash & s.contains("*/")
        line_comment = (slash & s.startswith("//")) | (hashed & s.startswith("#") & ~((i == 0) & s.startswith("#!")))
        # O opens a block; S is a block in one line; C ends a block and may be code outside one; L is a line comment
        return (
            F.when(opens & ~closes, "O")
            .when(opens & s.endswith("*/"), "S")
            .when(closes, F.when(line_comment, "c").otherwise(F.when(s == "", "B").otherwise("C")))
            .when(line_comment, "L")
            .when(s == "", "B")
            .otherwise("N")
        )

    df = df.withColumn("_class", F.array_join(F.transform("_lines", kind), ""))
    pieces = F.regexp_extract_all("_class", F.lit("O[OLBN]*[SCc]?|[SCcLBN]"), F.lit(0))
    dropped = F.array_join(F.transform(pieces, lambda t: F.when(t.startswith("O"), F.repeat(F.lit("d"), F.length(t))).when(t.isin("S", "L", "c"), "d").otherwise(t)), "")
    df = df.withColumn("_class", F.when(F.col("_keep"), F.regexp_replace("_class", "[^B]", "N")).otherwise(dropped))
    # a blank is kept unless another blank comes before it with only dropped lines between
    df = df.withColumn("_class", F.array_join(F.transform(F.regexp_extract_all("_class", F.lit("[NC]+|[Bd]+"), F.lit(0)), _one_blank), ""))
    df = df.withColumn("_kept", chosen_lines("_lines", "_class", ["N", "C", "B"])).withColumn(f"{prefix}output", F.array_join(trim_blank_edges(F.col("_kept")), "\n")).withColumn(f"{prefix}language", F.col("_lang"))
    return with_savings(df, text_col, prefix).drop("_lang", "_lines", "_class", "_kept", "_keep")


def _one_blank(s):
    at = F.instr(s, "B")
    return F.when(at > 0, F.concat(F.substr(s, F.lit(1), at), F.translate(F.substr(s, at + 1), "B", "d"))).otherwise(s)


# --- outline -----------------------------------------------------------------------------

_OPENS = re.compile(py(r"\{\s*$"))
_CONTROL, _CONTAINER = re.compile(py(CONTROL)), re.compile(py(CONTAINER))
_CALLABLE = [re.compile(py(p)) for p in (r"=>\s*\{\s*$", r"\bfunction\b", r"\)\s*(:\s*[^={]+)?\{\s*$")]
_QUIET = [(re.compile(p), r) for p, r in ((r"//[^\n\r\u2028\u2029]*\Z", ""), (r"'(?:\\.|[^'\\])*'", "''"), (r'"(?:\\.|[^"\\])*"', '""'), (r"`(?:\\.|[^`\\])*`", "``"), (r"\[(?:\\.|[^\]\\])*\]", "[]"))]
_DEF, _COLON = re.compile(py(r"^(async\s+)?def\s+")), re.compile(py(r":\s*$"))
_JS_SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def brace_delta(line: str) -> int:
    """Net braces of a line, those in comments, strings and brackets aside."""
    for pattern, by in _QUIET:
        line = pattern.sub(by, line)
    return line.count("{") - line.count("}")


def is_function_opener(stripped: str) -> bool:
    """Does the line open a function's body?"""
    return bool(_OPENS.search(stripped)) and not _CONTROL.search(stripped) and not _CONTAINER.search(stripped) and any(p.search(stripped) for p in _CALLABLE)


def _brace_bodies(lines: list[str]) -> list[tuple[int, int]]:
    """(opener, first line after the body) of the outermost function bodies, by running brace depth.

    A body ends with the first later line that brings the depth back to what it was before its opener.
    """
    delta = np.array([brace_delta(x) if "{" in x or "}" in x else 0 for x in lines], np.int64)
    after = np.cumsum(delta)
    before = (after - delta).tolist()
    after, bodies, free = after.tolist(), [], 0
    for k in [k for k, x in enumerate(lines) if "{" in x]:
        if k >= free and is_function_opener(lines[k].strip(_JS_SPACE)):
            free = next((j for j in range(k + 1, len(lines)) if after[j] <= before[k]), len(lines) - 1) + 1
            bodies.append((k, free))
    return bodies


def _indented_bodies(lines: list[str]) -> list[tuple[int, int]]:
    """(last line of a def's signature, first line after its body), by indentation."""
    bare = [x.lstrip(_JS_SPACE) for x in lines]
    indent = [len(x) - len(y) for x, y in zip(lines, bare)]
    bodies, free = [], 0
    for k in [k for k, x in enumerate(bare) if _DEF.search(x)]:
        if k >= free:
            head = next((j for j in range(k, len(lines)) if _COLON.search(lines[j])), None)
            if head is None:
                break  # a signature without an end takes all that follows
            free = next((j for j in range(head + 1, len(lines)) if bare[j] and indent[j] <= indent[k]), len(lines))
            bodies.append((head, free))
    return bodies


def outline_text(text: str, ext: str) -> str:
    """C4: signatures and structure; function bodies, found as intervals of lines, become a placeholder."""
    lines = text.split("\n")
    bodies, end, mark = (_indented_bodies(lines), _COLON, ": ...") if ext in PY_OUTLINE else (_brace_bodies(lines), _OPENS, BODY)
    kept, at = [], 0
    for head, free in bodies:
        kept += [*lines[at:head], end.sub(lambda _: mark, lines[head], count=1)]
        at = free
    return re.sub(r"\n{3,}", "\n\n", "\n".join([*kept, *lines[at:]])).strip(_JS_SPACE)


def _outline(texts: pd.Series, exts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else outline_text(t, e) for t, e in zip(texts, exts)])


def outline(df: DataFrame, text_col: str = "text", filename_col: str = "filename", prefix: str = "") -> DataFrame:
    """C4: outline where the language is known, else C3."""
    name = F.coalesce(F.col(filename_col), F.lit(""))
    ext = F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))
    df = compress(df, text_col, filename_col, prefix="_c_").withColumn("_ext", ext)
    known = F.col("_ext").isin(*BRACE_OUTLINE, *PY_OUTLINE)
    # null goes in where the outline isn't wanted, so that no work is done there
    df = df.withColumn("_out", F.pandas_udf(_outline, "string")(F.when(known, F.col(text_col)), F.col("_ext")))
    df = df.withColumn(f"{prefix}output", F.when(known, F.col("_out")).otherwise(F.col("_c_output"))).withColumn(f"{prefix}language", F.when(known, F.col("_ext")).otherwise(F.col("_c_language")))
    return with_savings(df, text_col, prefix).drop("_ext", "_out", "_c_output", "_c_language", "_c_before_tokens", "_c_after_tokens", "_c_ratio")
