"""Selections: what kind of text it is, and the compression, summary or pack that suits it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.regex import java
from textloom.operators import code, diff, instructions, output, structured
from textloom.operators.output import with_savings

#: Fixed values.
MODES = ["json", "code", "output", "instructions", "outline", "diff"]
OPTIMIZED = ["code", "json", "output", "diff"]
MODE_BY_EXTENSION = {"json": "json", "md": "instructions", "markdown": "instructions", "log": "output", "txt": "output"}
CODE_EXTENSIONS = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "java", "py", "go", "c", "cpp", "h", "hpp", "sh", "bash"]
STACK_FRAME = (r"^\s*at\s+.+:\d+:\d+\)?$", "m", tuple(f":{d}" for d in range(10)))
DIFF_HEADER = (r"^(diff --git|@@ |---\s|\+\+\+\s)", "m", ("diff --git", "@@ ", "---", "+++"))
ERROR_WORD = (r"\b(error|exception|failed|failure|assert)\b", "i", ("error", "exception", "fail", "assert"))
PACK_DIFF = (r"^(?:diff --git |@@ -\d|\+\+\+ |--- )", "m", ("diff --git ", "@@ -", "+++ ", "--- "))
PACK_TEST = (r"\b(?:FAIL|✕|✗|✖|not ok|AssertionError|Expected:|Received:|expect\(|to (?:be|equal|match|contain))\b", "", ("FAIL", "✕", "✗", "✖", "not ok", "AssertionError", "Expected:", "Received:", "expect(", "to be", "to equal", "to match", "to contain"))
PACK_STACK = (r"(?:^|\n)\s*(?:at\s+.+:\d+:\d+|File \".+\", line \d+)|Traceback \(most recent call last\)", "", ("at", "File", "Traceback"))
SELECTION_WARNINGS = {
    "diff": "Diff detected. Ask for changed behavior, regression risk, or the smallest safe fix.",
    "stack-trace": "Stack trace detected. Include the failing assertion or top error line if you have it.",
}
OUTLINE_TOKENS = 1200
FRAME_NOISE = (r"node_modules|site-packages|(^|\/)dist\/|(^|\/)build\/|internal\/|<anonymous>", "")
LOCKFILE = (r"(^|\/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|Cargo\.lock|poetry\.lock|composer\.lock)", "")
FILE_REF = r"(?:^|\s|\()([A-Za-z0-9_./-]+\.(?:tsx?|jsx?|mjs|cjs|py|go|rb|java|cs|rs|php|kt|swift)):(\d+)(?::\d+)?"
FAILING = (r"(?:^|\s)(?:FAIL|✕|✗|✖|×|not ok|●)\s|\b\d+ (?:failing|failed)\b", "")
ASSERTION = (r"Expected:|Received:|AssertionError|expect\(|toBe|toEqual|to (?:be|equal|match|contain)|\bactual\b|\bexpected\b", "i")
ERROR_LINE = (r"(?:^|\s)(?:[A-Z]\w*Error|Exception|panic:|FATAL|Traceback)\b", "")
PACK_FRAME = (r"^\s*(?:at\s+.+:\d+|File \".+\", line \d+|\S+\.\w+:\d+)", "")
JSON_LINE = (r"\"[^\"]+\"\s*:|error|status|message|code", "i")
ERROR_FIELD = (r"(?:^|\.)(?:error|message|status|code)\b", "i")
SIGNATURE = (r"^\s*(?:export\s+)?(?:async\s+)?(?:function|class|interface|type|enum|const\s+\w+\s*=\s*(?:async\s*)?\(|def|func|fn|public|private|protected)\b", "")
LABELS = {
    "test": "Focused context — test failure",
    "stack": "Focused context — stack trace",
    "diff": "Focused context — diff",
    "json": "Focused context — payload",
    "code": "Focused context — code",
}


def mode_of(filename):
    """Compression mode by extension, else ``unknown``."""
    name = F.coalesce(filename, F.lit(""))
    ext = F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))
    by_ext = T.first_case([(ext == e, m) for e, m in MODE_BY_EXTENSION.items()], "unknown")
    return F.when(ext.isin(*CODE_EXTENSIONS), "code").otherwise(by_ext)


def is_mode(mode):
    """P4."""
    return F.coalesce(mode.isin(*MODES), F.lit(False))


def kind_of(text, filename=None):
    """The selection's kind, by the first test that holds."""
    by_name = mode_of(filename) if filename is not None else F.lit("unknown")
    return T.first_case(
        [
            (~text.rlike(f"[^{T.WS}]"), "selected-text"),
            (T.test(text, *DIFF_HEADER), "diff"),
            (T.test(text, *STACK_FRAME), "stack-trace"),
            (by_name.isin("code", "json", "output"), by_name),
            (T.test(text, *ERROR_WORD), "stack-trace"),
            (structured.is_json_like(text), "json"),
        ],
        "selected-text",
    )


def pack_kind_of(text):
    """P8."""
    return T.first_case([(T.test(text, *PACK_DIFF), "diff"), (T.test(text, *PACK_TEST), "test"), (T.test(text, *PACK_STACK), "stack"), (structured.is_json_like(text), "json")], "code")


def selection_warnings(kind):
    """P18."""
    return T.first_case([(kind == k, F.array(F.lit(w))) for k, w in SELECTION_WARNINGS.items()], F.array().cast("array<string>"))


def compress(df: DataFrame, text_col: str = "text", filename_col: str = "filename", mode_col: str | None = None) -> DataFrame:
    """Each row by its mode (given, or from the file name). Adds mode, output, language,
    before_tokens, after_tokens, ratio and error; an unknown mode is an error, with no output.
    """
    return _compress(df, text_col, filename_col, mode_col, MODES)


def _compress(df: DataFrame, text_col: str, filename_col: str, mode_col: str | None, modes: list[str]) -> DataFrame:
    """C0 where no other mode than ``modes`` has a compressor to run.

    Every compressor sees null where another mode applies, so no row pays for two.
    """
    mode = F.coalesce(F.col(mode_col) if mode_col else F.lit(None), mode_of(F.col(filename_col)))
    df = df.withColumn("mode", mode)
    at = lambda m: F.when(F.col("mode") == m, F.col(text_col))
    compressors = {
        "output": lambda d, p: output.compress(d, "_o", p),
        "code": lambda d, p: code.compress(d, "_o", filename_col, prefix=p),
        "diff": lambda d, p: diff.compress(d, "_o", p),
        "json": lambda d, p: structured.compress(d, "_o", p),
        "instructions": lambda d, p: instructions.compress(d, "_o", p),
        "outline": lambda d, p: code.outline(d, "_o", filename_col, p),
    }
    for m in compressors:
        if m in modes:
            df = compressors[m](df.withColumn("_o", at(m)), f"_{m}_")
    out = T.first_case([(F.col("mode") == m, F.col(f"_{m}_output")) for m in modes], F.lit(None).cast("string"))
    language = T.first_case([(F.col("mode") == m, F.col(f"_{m}_language")) for m in ("code", "outline") if m in modes], F.lit(None).cast("string"))
    error = F.when(~is_mode(F.col("mode")), F.lit("unknown compression mode; use one of: " + ", ".join(MODES))).otherwise(F.col("_json_error"))
    df = df.withColumn("output", out).withColumn("language", language).withColumn("error", error)
    df = df.drop("_o", *[c for c in df.columns if any(c.startswith(f"_{m}_") for m in MODES)])
    df = with_savings(df, text_col)
    bad = F.col("error").isNotNull()
    return df.withColumn("after_tokens", F.when(~bad, F.col("after_tokens"))).withColumn("ratio", F.when(~bad, F.col("ratio")))


def _first_line(text):
    """The first line that isn't blank, trimmed; null if there is none."""
    return F.nullif(T.trim(F.substring_index(T.trim(text), "\n", 1)), F.lit(""))


def _line_summary(what: str, n, first):
    return F.concat(F.lit(f"Selected {what} ("), n, F.lit(" lines): "), T.truncate_preview(first), F.lit("."))


def summaries(df: DataFrame, text_col: str = "text", filename_col: str | None = None) -> DataFrame:
    """Adds kind and a one-line summary, row by row."""
    text = F.col(text_col)
    df = df.withColumn("kind", kind_of(text, F.col(filename_col) if filename_col else None)).withColumn("_lines", T.lines(text))
    bare = F.filter(F.transform("_lines", T.trim), lambda x: x != "")
    first = _first_line(text)
    error = F.coalesce(F.get(F.filter(bare, lambda x: T.test(x, *ERROR_WORD)), F.lit(0)), first, F.lit("Stack trace selected."))
    frames = F.transform(F.slice(F.filter(F.transform("_lines", T.trim), lambda x: T.test(x, *STACK_FRAME)), 1, 3), lambda x: T.truncate_preview(x, 90))
    stack = F.when(F.size(frames) > 0, F.concat(F.lit("Selected stack trace: "), T.truncate_preview(error), F.lit(" Frames: "), F.array_join(frames, " | "), F.lit("."))).otherwise(
        F.concat(F.lit("Selected error output: "), T.truncate_preview(error), F.lit("."))
    )
    n = F.size("_lines").cast("string")
    line = lambda what, fallback: _line_summary(what, n, F.coalesce(first, F.lit(fallback)))
    own = T.first_case(
        [
            (F.col("kind") == "stack-trace", stack),
            (F.col("kind") == "code", line("code", "Code selection")),
            (F.col("kind") == "json", F.concat(F.lit("Selected JSON payload ("), n, F.lit(" lines). Keep only the fields relevant to the task."))),
            (F.col("kind") == "output", line("output", "Output selection")),
        ],
        line("text", "Selected text"),
    )
    df = df.withColumn("_own", own).drop("_lines").withColumn("_diff", F.when(F.col("kind") == "diff", text))
    df = diff.with_summary(df, "_diff", "_d_")
    df = df.withColumn("summary", F.when(F.col("kind") == "diff", F.col("_d_summary")).otherwise(F.col("_own")))
    return df.drop("_own", "_diff", *[c for c in df.columns if c.startswith("_d_")])


def optimize(df: DataFrame, text_col: str = "text", filename_col: str = "filename") -> DataFrame:
    """Kind, output, token columns and warnings. Plain text alone is summarised."""
    text = F.col(text_col)
    df = df.withColumn("kind", kind_of(text, F.col(filename_col)))
    mode = T.first_case([(F.col("kind").isin(*OPTIMIZED), F.col("kind")), (F.col("kind") == "stack-trace", F.lit("output"))], F.lit("none"))
    df = _compress(df.withColumn("_mode", mode), text_col, filename_col, "_mode", OPTIMIZED).drop("mode")
    none = F.col("_mode") == "none"
    summary = _line_summary("text", F.size(T.lines(text)).cast("string"), F.coalesce(_first_line(text), F.lit("Selected text")))
    df = df.withColumn("output", F.when(none, summary).otherwise(F.col("output"))).withColumn("error", F.when(~none, F.col("error")))
    df = df.withColumn("warnings", F.when(none, selection_warnings(F.col("kind"))).otherwise(F.array().cast("array<string>")))
    return with_savings(df, text_col).drop("_mode")


def explain(df: DataFrame, text_col: str = "text", filename_col: str = "filename") -> DataFrame:
    """C11: code is outlined if large, else kept with its comments; anything else as in C8."""
    df = optimize(df, text_col, filename_col)
    is_code = F.col("kind") == "code"
    outlined = is_code & (T.estimate_tokens(text_col) >= OUTLINE_TOKENS)
    df = df.withColumn("outlined", outlined)
    df = df.withColumn("_big", F.when(F.col("outlined"), F.col(text_col))).withColumn("_small", F.when(is_code & ~F.col("outlined"), F.col(text_col)))
    df = code.outline(df, "_big", filename_col, "_b_")
    df = code.compress(df, "_small", filename_col, True, "_s_")
    df = df.withColumn("output", F.coalesce("_b_output", "_s_output", "output"))
    return with_savings(df.drop(*[c for c in df.columns if c.startswith(("_b_", "_s_"))], "_big", "_small"), text_col)


# --- context packs -----------------------------------------------------------------------


def keep_lines(lines, pattern, limit: int):
    """C12f, W9: the first lines that the pattern fits, trailing space cut."""
    return F.transform(F.slice(F.filter(lines, lambda x: T.test(x, *pattern)), 1, limit), T.trim_end)


def file_refs(text, limit: int = 6):
    """C12g: distinct ``file:line`` references in order of appearance, noise aside."""
    files, at = F.regexp_extract_all(text, F.lit(java(FILE_REF)), F.lit(1)), F.regexp_extract_all(text, F.lit(java(FILE_REF)), F.lit(2))
    pairs = F.filter(F.arrays_zip(files.alias("f"), at.alias("n")), lambda p: ~T.test(p["f"], *FRAME_NOISE))
    return F.slice(F.array_distinct(F.transform(pairs, lambda p: F.concat_ws(":", p["f"], p["n"]))), 1, limit)


def _test_sections(df):
    return [("Failing test(s)", keep_lines("_lines", FAILING, 12)), ("Assertion (expected vs actual)", keep_lines("_lines", ASSERTION, 20)), ("Where", file_refs(F.col("_text")))]


def _stack_sections(df):
    error = T.trim(F.coalesce(F.get(F.filter("_lines", lambda x: T.test(x, *ERROR_LINE)), F.lit(0)), F.lit("")))
    frames = F.slice(F.filter(keep_lines("_lines", PACK_FRAME, 30), lambda x: ~T.test(x, *FRAME_NOISE)), 1, 6)
    return [("Error", F.when(error != "", F.array(error)).otherwise(F.array().cast("array<string>"))), ("Top app frames", frames)]


def _diff_sections(df):
    # a section runs from a "diff --git" line to the next; a lock file's name in its header, or in a
    # later ---/+++ line, hides the rest of the section
    sections = F.split(F.regexp_replace("_text", r"(?:(?<=\n)|\A)(?=diff --git )", "\u0001"), "\u0001", -1)

    def shown(s):
        lines = F.transform(F.split(F.regexp_replace(s, r"\n\z", ""), "\n", -1), T.trim_end)
        hides = lambda x, i: T.test(x, *LOCKFILE) & (x.startswith("diff --git ") | x.startswith("+++ ") | x.startswith("--- "))
        bad = F.filter(F.transform(lines, lambda x, i: F.when(hides(x, i), i)), lambda i: i.isNotNull())
        return F.when(F.size(bad) > 0, F.slice(lines, F.lit(1), F.array_min(bad))).otherwise(lines)

    lines = F.flatten(F.transform(sections, shown))
    headers = F.filter(lines, lambda x: x.startswith("diff --git ") | x.startswith("+++ ") | x.startswith("--- "))
    changed = F.filter(lines, lambda x: x.rlike("^[+-](?![+-])"))
    return [("Changed files", F.slice(headers, 1, 20)), ("Hunks", F.slice(F.filter(lines, lambda x: x.startswith("@@ ")), 1, 20)), ("Changed lines", F.slice(changed, 1, 60))]


def _json_sections(df):
    keys = F.coalesce(F.col("_paths"), keep_lines("_lines", JSON_LINE, 40))
    return [("Error / status fields", F.filter(keys, lambda x: T.test(x, *ERROR_FIELD))), ("Shape (keys → truncated values)", F.slice(keys, 1, 30))]


def _code_sections(df):
    found = keep_lines("_lines", SIGNATURE, 40)
    return [("Signatures", F.when(F.size(found) > 0, found).otherwise(F.slice(T.lines(T.trim(F.col("_text"))), 1, 20)))]


SECTIONS = {"test": _test_sections, "stack": _stack_sections, "diff": _diff_sections, "json": _json_sections, "code": _code_sections}


def context_pack(df: DataFrame, text_col: str = "text", kind_col: str | None = None) -> DataFrame:
    """Adds pack_kind, sections (title, lines), pack, before_tokens and after_tokens.

    ``kind_col`` may force a kind; blank text is kind ``empty`` with an empty pack; where
    nothing is extracted the pack is the trimmed text.
    """
    df = df.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_lines", T.lines(F.col("_text")))
    forced = F.when(F.col(kind_col).isin(*SECTIONS), F.col(kind_col)) if kind_col else F.lit(None).cast("string")
    df = df.withColumn("pack_kind", F.when(T.trim(F.col("_text")) == "", F.lit("empty")).otherwise(F.coalesce(forced, pack_kind_of(F.col("_text")))))
    df = df.withColumn("_paths", structured.flat_paths(F.col("_text"), F.col("pack_kind") == "json"))
    section = lambda title, lines: F.struct(F.lit(title).alias("title"), lines.alias("lines"))
    choice = F.array().cast("array<struct<title:string,lines:array<string>>>")
    for kind, make in SECTIONS.items():
        choice = F.when(F.col("pack_kind") == kind, F.array(*[section(t, x) for t, x in make(df)])).otherwise(choice)
    df = df.withColumn("sections", F.filter(choice, lambda s: F.size(s["lines"]) > 0))
    body = T.trim(F.array_join(F.transform("sections", lambda s: F.concat(F.lit("## "), s["title"], F.lit("\n"), F.array_join(s["lines"], "\n"), F.lit("\n"))), "\n"))
    label = reduce(lambda o, kv: F.when(F.col("pack_kind") == kv[0], F.lit(kv[1])).otherwise(o), LABELS.items(), F.lit(""))
    df = df.withColumn("_body", body)
    df = df.withColumn("pack", F.when(F.col("_body") != "", F.concat(F.lit("# "), label, F.lit("\n\n"), F.col("_body"))).otherwise(T.trim(F.col("_text"))))
    empty = F.col("pack_kind") == "empty"
    df = df.withColumn("before_tokens", F.when(empty, F.lit(0).cast("long")).otherwise(T.estimate_tokens("_text"))).withColumn("after_tokens", T.estimate_tokens("pack"))
    return df.drop("_text", "_lines", "_paths", "_body")
