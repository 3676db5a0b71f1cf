"""Diffs: compression, per-file statistics, risk and hotspots.

A diff is cut at its ``diff --git`` lines; each section is handled on its own inside the
row. Only the per-file table (``file_stats``) explodes, and its grouping pre-aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.regex import java
from textloom.operators.output import with_savings

#: Files whose changes are noise, and lines of file data.
NOISE_FILE = (r"(package-lock\.json|yarn\.lock|pnpm-lock\.ya?ml|composer\.lock|Cargo\.lock|go\.sum|poetry\.lock|Gemfile\.lock|\.min\.(js|css)|\.map|\.snap)$|(^|\/)(__snapshots__|dist|build)\/", "i")
FILE_META = (r"^(index |--- |\+\+\+ |new file |deleted file |old mode |new mode |rename |copy |similarity |dissimilarity |Binary files )", "")
#: Literals of which the path of a noise file holds one, in lower case.
NOISE_HINTS = ("lock", "go.sum", ".min.", ".map", ".snap", "__snapshots__/", "dist/", "build/")
GIT_PATH = r"^diff --git a\/(.+?) b\/(.+)$"
PLUS_PATH = r"^\+\+\+\s+b\/(.+)$"
#: Fixed values: (type, risk, pattern), the first that fits; else code, medium.
FILE_TYPES = [
    ("auth", "high", r"(auth|login|session|token|oauth|sso|credential|rbac|permission)"),
    ("ci", "high", r"(^|\/)(\.github\/workflows|gitlab-ci|azure-pipelines|jenkinsfile|circleci)"),
    ("deps", "high", r"(package-lock\.json|pnpm-lock\.ya?ml|yarn\.lock|requirements\.txt|poetry\.lock|pom\.xml|build\.gradle|go\.sum|cargo\.lock)$"),
    ("config", "medium", r"(tsconfig|eslint|prettier|babel|vite|webpack|rollup|dockerfile|compose|\.env|\.ya?ml$|\.toml$|\.ini$|\.json$)"),
    ("infra", "medium", r"(terraform|k8s|helm|ansible|pulumi|docker|compose)"),
    ("tests", "low", r"(^|\/)(test|tests|spec|__tests__|features)\/"),
    ("docs", "low", r"\.(md|mdx|adoc|rst|txt)$"),
]
RANK = {"low": 1, "medium": 2, "high": 3}
SUMMARY_CHARS, HOTSPOTS = 220, 3


def file_type(path):
    """Type of a changed file."""
    return T.first_case([(T.test(path, p, "i"), t) for t, _, p in FILE_TYPES], "code")


def file_risk(path):
    """Risk of a changed file."""
    return T.first_case([(T.test(path, p, "i"), r) for _, r, p in FILE_TYPES], "medium")


def risk_of(kind):
    """The risk of a file type."""
    return T.first_case([(kind == t, r) for t, r, _ in FILE_TYPES], "medium")


def risk_rank(risk):
    return T.first_case([(risk == r, n) for r, n in RANK.items()], 0)


def _git_path(line):
    """The second group of GIT_PATH by plain search, empty where the pattern doesn't fit."""
    at = F.locate(" b/", line, len("diff --git a/") + 2)
    fits = line.startswith("diff --git a/") & (at > 0) & (F.translate(line, "\r\u2028\u2029", "") == line)
    return F.when(fits, F.substr(line, at + 3)).otherwise(F.lit(""))


def compress(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Headers and changed lines; a noise file becomes one line that counts its changes.

    Lines go by one pattern over the whole text; only texts that may hold a noise file are cut
    into sections, at their "diff --git" lines (text before the first is its own).
    """
    other = rf"\n(?: |(?![+-]|@@|diff --git|{java(FILE_META[0]).removeprefix('^')}))[^\n]*+"
    df = df.withColumn("_kept", F.regexp_replace(F.concat(F.lit("\n"), F.col(text_col)), other, "")).withColumn("_low", F.lower("_kept"))

    def section(s):
        head = F.substring_index(s, "\n", 1)
        path = _git_path(head)
        omitted = F.regexp_count(s, F.lit(r"\n(?:\+(?!\+\+)|-(?!--))"))
        noise = F.concat(head, F.lit("\n  ("), path, F.lit(": "), omitted.cast("string"), F.lit(" changed line(s) omitted — lock/generated/binary file)"))
        return F.when(T.test(path, *NOISE_FILE), noise).otherwise(s)

    sections = F.split("_kept", r"\n(?=diff --git)", -1)
    shown = F.when(T.hinted(F.col("_low"), "", NOISE_HINTS), F.array_join(F.transform(sections, section), "\n")).otherwise(F.col("_kept"))
    return with_savings(df.withColumn(f"{prefix}output", T.trim(shown)), text_col, prefix).drop("_kept", "_low")


def diff_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, line, path the line names, path it belongs to).

    The path is carried forward by a window per document; rows hold one line each.
    """
    e = df.select(F.col(id_col).alias("id"), F.posexplode(T.lines(F.col(text_col))).alias("pos", "line"))
    line = F.col("line")
    git, plus = F.regexp_extract(line, java(GIT_PATH), 2), F.regexp_extract(line, java(PLUS_PATH), 1)
    e = e.withColumn("named", F.when(git != "", git).when(plus != "", plus))
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("path", F.last("named", ignorenulls=True).over(w))


def file_stats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per (id, path): hunks, additions, deletions, type, risk, first line.

    Changes before any named file have a null path.
    """
    e = diff_lines(df, id_col, text_col)
    body = F.col("named").isNull()
    line = F.col("line")
    return (
        e.groupBy("id", "path")
        .agg(
            F.min("pos").alias("first_pos"),
            F.count_if(body & line.startswith("@@ ")).alias("hunks"),
            F.count_if(body & line.startswith("+") & ~line.startswith("+++")).alias("additions"),
            F.count_if(body & line.startswith("-") & ~line.startswith("---")).alias("deletions"),
        )
        .withColumn("type", file_type(F.col("path")))
        .withColumn("risk", file_risk(F.col("path")))
    )


def _files(text):
    """A1 inside the row: array of (path, at, hunks, additions, deletions), first-seen order.

    The text is cut before every line that names a file; equal paths are summed.
    """
    mark = r"(?:(?<=\n)|\A)(?=diff --git a/[^\n]+? b/[^\n]|\+\+\+\s+b/[^\n])"
    starts = lambda s, what: F.regexp_count(s, F.lit(rf"(?:(?<=\n)|\A){what}"))
    head = lambda s: F.substring_index(s, "\n", 1)

    def part(s):
        git, plus = F.regexp_extract(head(s), java(GIT_PATH), 2), F.regexp_extract(head(s), java(PLUS_PATH), 1)
        path = F.when(git != "", git).when(plus != "", plus)
        body = F.when(path.isNull(), s).otherwise(F.substr(s, F.length(head(s)) + 2))
        return F.struct(path.alias("path"), starts(body, "@@ ").alias("hunks"), starts(body, r"\+(?!\+\+)").alias("additions"), starts(body, "-(?!--)").alias("deletions"))

    return F.transform(F.split(F.regexp_replace(text, mark, "\u0001"), "\u0001", -1), part)


def with_summary(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """C10, A1-A3 row by row: files, hunks, additions, deletions, risk, by_type, hotspots, and
    the compact and expanded summary texts. Nothing leaves the row."""
    p = prefix
    df = df.withColumn("_parts", _files(F.col(text_col)))
    total = lambda a, f: F.aggregate(a, F.lit(0), lambda n, x: n + x[f])
    # parts in the order of their paths, so that a path's parts stand together and each is looked at once
    named = F.filter(F.transform("_parts", lambda x, i: F.struct(x["path"].alias("path"), i.alias("i"), (x["additions"] + x["deletions"]).alias("churn"))), lambda x: x["path"].isNotNull())

    def records(ordered):
        at = lambda i: F.get(ordered, i)
        places = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(F.array().cast("array<int>"))

        def record(starts):
            def one(start, k):
                own = F.slice(ordered, start + 1, F.coalesce(F.get(starts, k + 1), F.size(ordered)) - start)
                return F.struct((-total(own, "churn")).alias("c"), at(start)["i"].alias("i"), at(start)["path"].alias("path"), file_type(at(start)["path"]).alias("type"))

            return F.transform(starts, one)

        return T.let(F.filter(places, lambda i: (i == 0) | (at(i)["path"] != at(i - 1)["path"])), record)

    df = df.withColumn("_records", T.let(F.array_sort(named), records))
    df = df.withColumn("_files", F.transform("_records", lambda x: F.struct((-risk_rank(risk_of(x["type"]))).alias("r"), x["c"].alias("c"), x["i"].alias("i"), x["path"].alias("path"), x["type"].alias("type"))))
    by_place = F.array_sort(F.transform("_records", lambda x: F.struct(x["i"].alias("i"), x["type"].alias("type"))))
    types = F.array_distinct(F.transform(by_place, lambda x: x["type"]))

    def kind(t, i):
        own = F.filter("_files", lambda x: x["type"] == t)
        return F.struct(F.array_min(F.transform(own, lambda x: x["r"])).alias("r"), (-F.size(own)).alias("n"), i.alias("i"), t.alias("type"))

    risk_name = lambda r: T.first_case([(r == n, name) for name, n in RANK.items()], "low")
    df = df.withColumn("_types", F.array_sort(F.transform(types, kind)))
    df = df.withColumn(f"{p}files", F.greatest(F.size("_files"), F.lit(1))).withColumn(f"{p}hunks", F.greatest(total(F.col("_parts"), "hunks"), F.lit(1)))
    df = df.withColumn(f"{p}additions", total(F.col("_parts"), "additions")).withColumn(f"{p}deletions", total(F.col("_parts"), "deletions"))
    df = df.withColumn(f"{p}risk", risk_name(F.coalesce(-F.array_min(F.transform("_files", lambda x: x["r"])), F.lit(1))))
    df = df.withColumn(f"{p}by_type", F.array_join(F.transform(F.slice("_types", 1, 2), lambda x: F.concat(x["type"], F.lit("="), risk_name(-x["r"]))), ", "))
    df = df.withColumn(f"{p}hotspots", F.transform(F.slice(F.array_sort("_files"), 1, HOTSPOTS), lambda x: x["path"]))
    c = lambda name: F.col(p + name)
    compact = F.concat_ws(
        "; ",
        F.format_string("Selected diff: files=%s, hunks=%s, +%s/-%s, risk=%s", c("files"), c("hunks"), c("additions"), c("deletions"), c("risk")),
        F.when(c("by_type") != "", F.concat(F.lit("byType="), c("by_type"))),
        F.when(F.size(c("hotspots")) > 0, F.concat(F.lit("hotspots="), F.array_join(c("hotspots"), "|"))),
    )
    expanded = F.concat_ws(
        "\n",
        F.lit("Selected diff summary:"),
        F.format_string("- Files changed: %s", c("files")),
        F.format_string("- Hunks: %s", c("hunks")),
        F.format_string("- Net lines: +%s/-%s", c("additions"), c("deletions")),
        F.concat(F.lit("- Risk: "), c("risk"), F.when(c("by_type") != "", F.concat(F.lit(" (by type: "), c("by_type"), F.lit(")"))).otherwise(F.lit(""))),
        F.concat(F.lit("- Hotspots: "), F.when(F.size(c("hotspots")) > 0, F.array_join(c("hotspots"), ", ")).otherwise(F.lit("none"))),
    )
    df = df.withColumn(f"{p}summary", T.truncate_preview(compact, SUMMARY_CHARS)).withColumn(f"{p}expanded", expanded)
    return df.drop("_parts", "_records", "_files", "_types")
