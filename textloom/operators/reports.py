"""Reports as long tables (section, ord, metric, value), and as markdown made from them.

The tables are what queries return; ``markdown`` joins a table of one report into a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import evals, prompt, readiness, runs, secrets, select


def long_table(df: DataFrame, section: str, metrics: list, by: list[str] | None = None) -> DataFrame:
    """One row per (name, column) of ``metrics`` for each row of ``df``."""
    rows = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(k).alias("ord"), F.lit(name).alias("metric"), F.coalesce(value.cast("string"), F.lit("")).alias("value")) for k, (name, value) in enumerate(metrics)])
    return df.select(*(by or []), F.explode(rows).alias("r")).select(*(by or []), "r.*")


def stats_report(events: DataFrame) -> DataFrame:
    """A7 in full: totals, the split of compression and prompt shaping, warnings, recurrence."""
    s = runs.run_stats(events)
    net = F.col("total_before_tokens") - F.col("total_after_tokens")
    change = F.when(net >= 0, F.concat(T.format_count(net), F.lit(" saved"))).otherwise(F.concat(T.format_count(-net), F.lit(" added")))
    squeezed = F.col("selection_before_tokens") - F.col("selection_after_tokens")
    shaped = F.col("prompt_before_tokens") - F.col("prompt_after_tokens")
    return long_table(
        s,
        "stats",
        [
            ("Prompt runs", F.col("prompt_runs")),
            ("Selection runs", F.col("selection_runs")),
            ("Estimated tokens", change),
            ("Change in percent", runs.percent(F.abs(net), F.col("total_before_tokens"))),
            ("Compression saved", T.format_count(squeezed)),
            ("Compression in percent", runs.percent(squeezed, F.col("selection_before_tokens"))),
            ("Prompt-shaping delta", F.when(shaped >= 0, F.concat(T.format_count(shaped), F.lit(" saved"))).otherwise(F.concat(T.format_count(-shaped), F.lit(" added")))),
            ("Warnings", F.col("total_warnings")),
            *[(name.replace("_", " "), F.col(name)) for name in runs.WARNING_CLASSES],
            ("Unique prompt skeletons", F.col("unique_prompt_skeletons")),
            ("Repeated prompt skeletons", F.col("repeated_prompt_skeletons")),
            ("Last context type", F.col("last_context_type")),
        ],
    )


def evidence_report(events: DataFrame, rate: float = 0.0) -> DataFrame:
    """A6 as a report."""
    e = runs.evidence(runs.run_stats(events), F.col("prompt_runs") + F.col("selection_runs"), rate)
    cost = F.when(F.col("cost_saved_usd").isNotNull(), F.format_string("$%.2f", "cost_saved_usd")).otherwise(F.lit("no rate given"))
    return long_table(e, "evidence", [(c, F.col(c)) for c in ("before", "after", "saved", "saved_pct", "compression_saved", "compression_pct", "secret_redactions", "total_runs")] + [("cost saved", cost)])


def readiness_report(workspaces: DataFrame) -> DataFrame:
    """A8, A9 as a report: a section per workspace, a line per signal."""
    s = readiness.signals(workspaces)
    total = readiness.scores(s)
    lines = s.select("name", F.lit("signals").alias("section"), F.col("ord"), F.col("label").alias("metric"), F.concat(F.upper("status"), F.lit(" "), F.col("earned").cast("string"), F.lit("/"), F.col("weight").cast("string")).alias("value"))
    head = long_table(total, "score", [("Score", F.concat(F.col("score").cast("string"), F.lit("/"), F.col("max_score").cast("string"))), ("Verdict", F.col("verdict"))], ["name"])
    return head.unionByName(lines)


def advice_report(tasks: DataFrame, advice_col: str = "advice", by: str = "id") -> DataFrame:
    """P19, P20 as a report."""
    a = lambda f: F.col(f"{advice_col}.{f}")
    return long_table(tasks, "advice", [("Tier", a("tier")), ("Route", a("routing")), ("Signals", F.array_join(a("reasons"), "; "))], [by])


def direct_answer_report(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Per prompt and variant the tokens, what is missing, and the verdicts.

    ``prompts`` (id, groups), ``answers`` (id, variant, output, kept_main_idea, kept_reason,
    kept_next_action, kept_safety).
    """
    joined = prompts.join(answers, "id", "left")
    verdicts = [evals.verdict_cell(F.col(c)).alias(c) for c in ("kept_main_idea", "kept_reason", "kept_next_action", "kept_safety")]
    missing = evals.missing_requirements(F.col("output"), F.col("groups"))
    return joined.select("id", "variant", T.estimate_tokens(F.coalesce("output", F.lit(""))).alias("tokens"), F.array_join(missing, "; ").alias("missing"), *verdicts)


def markdown(report: DataFrame, title: str, by: list[str] | None = None) -> DataFrame:
    """A long table as markdown, one text per group."""
    line = F.concat(F.lit("- "), "metric", F.lit(": "), "value")
    rows = report.select(*(by or []), F.struct("section", "ord", line.alias("line")).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["line"]), "\n")
    return rows.groupBy(*(by or [])).agg(F.concat(F.lit(f"# {title}\n\n"), body).alias("markdown"))


# --- what surrounds an answer -------------------------------------------------------------


def clipboard_bundle(result, follow_up, kind):
    """A compressed selection with the question that goes with it."""
    return F.concat(follow_up, F.lit("\n\n"), prompt.fence(result), F.lit("\n"), F.when(kind == "diff", F.lit("Focus on the changed behavior.")).otherwise(F.lit("")))


def agent_compress(df: DataFrame, text_col: str = "text", filename_col: str = "filename") -> DataFrame:
    """Blank texts are refused; others are optimised (C8), then redacted (K10), with a note."""
    df = select.optimize(df, text_col, filename_col)
    df = secrets.protected_result(df, "output", filename_col)
    blank = F.coalesce(T.trim(F.col(text_col)) == "", F.lit(True))
    note = F.concat(F.lit("Compressed locally: ~"), T.format_count(F.col("before_tokens")), F.lit(" to ~"), T.format_count(F.col("after_tokens")), F.lit(" tokens."))
    return df.withColumn("note", F.when(blank, F.lit("No text to compress.")).otherwise(note)).withColumn("output", F.when(~blank, F.col("output")))


def concise_request(df: DataFrame, prompt_col: str = "prompt", level_col: str = "level") -> DataFrame:
    """The prompt with its response shape and the level it is to be answered at."""
    from textloom.operators import advisor

    shape = prompt.response_shape(F.col(prompt_col))
    return df.withColumn("level", advisor.concise_level(F.coalesce(F.col(level_col), F.lit(advisor.CONCISE_DEFAULT)))).withColumn("request", F.concat_ws("\n\n", F.col(prompt_col), shape))
