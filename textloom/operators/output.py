"""Test and log output: keep what decides a failure, drop the rest.

The compressor is row-local. Each line gets a one-letter class; runs that a loop would
count (stack frames, blank lines) are found by matching the string of classes, so no
line leaves its row, nothing is shuffled, and every step is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

#: Lines to keep and lines to strip (a strip wins), as (pattern, flags, hints).
KEEP = [
    (r"^\s*\d+\)\s", "", (")",)),
    (r"Error:", "i", ("error:",)),
    (r"AssertionError", "i", ("assertionerror",)),
    (r"expect\(", "", ("expect(",)),
    (r"Expected|Received", "", ("Expected", "Received")),
    (r"^\s*>\s*\d+\s*\|", "", ("|",)),
    (r"^\s*\d+\s*\|", "", ("|",)),
    (r"at\s+\w+.*\.(ts|js|tsx|jsx):\d+", "", (".ts:", ".js:", ".tsx:", ".jsx:")),
    (r"FAILED|FAIL\b", "", ("FAIL",)),
    (r"● ", "", ("● ",)),
    (r"✗|✘|×", "", ("✗", "✘", "×")),
    (r"\d+ (failed|passed|skipped)", "i", (" failed", " passed", " skipped")),
    (r"Test Suites:|Tests:", "", ("Test Suites:", "Tests:")),
    (r"Call log:", "i", ("call log:",)),
    (r"^\s+-\s+(waiting|locator|resolved|attempting|element|unexpected|expect|navigat|received|\d+ element)", "i", ("-",)),
    (r"\[(error|err|warn|fatal)\]", "i", ("[",)),
    (r"Failed to load resource|status of \d{3}", "i", ("failed to load resource", "status of ")),
    (r"\b(violat\w*|blocked|refused|denied|rejected|unauthorized|forbidden|attestation)\b", "i", ("violat", "blocked", "refused", "denied", "rejected", "unauthorized", "forbidden", "attestation")),
]
STRIP = [
    (r"^\s*✓|^\s*✔|^\s*PASS\b", "", ("✓", "✔", "PASS")),
    (r"^\s*\[.*\]\s*(chromium|firefox|webkit)", "i", ("chromium", "firefox", "webkit")),
    (r"workers?", "i", ("worker",)),
    (r"^Running\s+\d+", "i", ("running",)),
    (r"Slowest\s+\d+\s+tests", "i", ("slowest",)),
    (r"\s+at\s+.*node:internal", "", ("node:internal",)),
    (r"\s+at\s+.*node_modules[/\\]", "", ("node_modules",)),
    (r"\s+at\s+.*webpack", "i", ("webpack",)),
    (r"\s+at\s+.*jest-circus", "i", ("jest-circus",)),
]
FRAME = (r"^\s+at\s+", "")
FRAMES_KEPT = 3


def shape(line):
    """A line without what varies: long hex, numbers, white space."""
    short = F.regexp_replace(line, r"(?i)[0-9a-f]{8,}", "#")
    return T.trim(T.squeeze(F.regexp_replace(short, "[0-9]+", "#")))


def _first_of_shape(lines):
    """Lines whose shape hasn't occurred before, and all blank ones, in order.

    Sorting (shape, place) puts a shape's first line in front: n log n per text.
    """
    marked = F.transform(lines, lambda x, i: F.struct(F.when(T.trim(x) == "", F.concat(F.lit("\n"), i.cast("string"))).otherwise(shape(x)).alias("s"), i.alias("i"), x.alias("x")))
    ordered = F.array_sort(marked)
    return ordered, lambda a: F.transform(
        F.array_sort(F.transform(F.filter(a, lambda e, k: (k == 0) | (F.get(a, k - 1)["s"] != e["s"])), lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))),
        lambda e: e["x"],
    )


def dedupe_by_shape(df: DataFrame, lines_col: str = "lines", out: str = "lines") -> DataFrame:
    """Drop lines of an earlier line's shape; blank lines pass."""
    ordered, finish = _first_of_shape(F.col(lines_col))
    return df.withColumn("_ordered", ordered).withColumn(out, finish(F.col("_ordered"))).drop("_ordered")


def trim_blank_edges(lines):
    """Without empty lines at either end."""
    solid = F.filter(F.transform(lines, lambda x, i: F.when(x != "", i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(solid) == 0, F.array().cast("array<string>")).otherwise(F.slice(lines, F.array_min(solid), F.array_max(solid) - F.array_min(solid) + 1))


def compress(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds output, before_tokens, after_tokens and ratio."""
    p = prefix
    line_class = lambda x: F.when(
        T.test(x, *FRAME), F.when(T.any_of(x, STRIP), "s").otherwise("f")
    ).otherwise(F.when(x == "", "b").when(~T.any_of(x, STRIP) & T.any_of(x, KEEP), "k").otherwise("x"))
    df = df.withColumn("_lines", F.transform(T.lines(F.col(text_col)), T.trim_end))
    df = df.withColumn("_class", F.array_join(F.transform("_lines", line_class), ""))
    # A frame after three frames goes. W3: of the blanks between two other lines, frames aside, the first stays
    df = df.withColumn("_class", F.regexp_replace("_class", rf"(?<=[fs]{{{FRAMES_KEPT}}})[fs]", "d"))
    stretch = F.regexp_extract_all("_class", F.lit("[kx]+|[bfsd]+"), F.lit(0))
    df = df.withColumn("_class", F.array_join(F.transform(stretch, _one_blank), ""))
    df = df.withColumn("_kept", chosen_lines("_lines", "_class", ["f", "k", "b"])).withColumn("_kept", F.when(F.forall("_kept", lambda x: T.trim(x) == ""), F.col("_lines")).otherwise(F.col("_kept")))
    df = dedupe_by_shape(df, "_kept", "_kept").withColumn("_kept", trim_blank_edges(F.col("_kept")))
    df = df.withColumn(f"{p}output", F.array_join("_kept", "\n"))
    return with_savings(df, text_col, p).drop("_lines", "_class", "_kept")


def chosen_lines(lines, classes, wanted: list[str]):
    """Lines whose letter in the string of classes is wanted.

    Zipped and not looked up by place: a column used inside a lambda alone would be worked
    out again for every line.
    """
    marked = F.zip_with(lines, F.split(classes, ""), lambda x, c: F.struct(x.alias("x"), c.alias("c")))
    return F.transform(F.filter(marked, lambda m: m["c"].isin(*wanted)), lambda m: m["x"])


def _one_blank(s):
    at = F.instr(s, "b")
    return F.when(at > 0, F.concat(F.substr(s, F.lit(1), at), F.translate(F.substr(s, at + 1), "b", "d"))).otherwise(s)


def with_savings(df: DataFrame, text_col: str, prefix: str = "") -> DataFrame:
    """D3: token estimates before and after, and the ratio."""
    df = df.withColumn(f"{prefix}before_tokens", T.estimate_tokens(text_col)).withColumn(f"{prefix}after_tokens", T.estimate_tokens(f"{prefix}output"))
    return df.withColumn(f"{prefix}ratio", T.savings_ratio(F.col(f"{prefix}before_tokens"), F.col(f"{prefix}after_tokens")))
