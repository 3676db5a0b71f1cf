"""Run events: usage counters, savings, recurring prompts, reports.

Run events have the columns seq, ts, command_key, grp (prompt or selection), skeleton_id,
before_tokens, after_tokens, context_type and warnings (array of strings). Counters are
plain aggregates, partial before every exchange; only ``skeleton_counts`` needs a group per
fingerprint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

#: Fixed values.
COMMANDS = "optimizePrompt reviewDiff debugStackTrace explainSelection chatOptimize chatCompress chatFocus chatOutline chatReview chatDebug chatExplain chatConcise agentCompress".split()
WARNING_CLASSES = {
    "volatile_context_warnings": "Volatile context detected",
    "low_reuse_warnings": "Low prompt reuse score detected",
    "instruction_selection_warnings": "Instruction-like selection detected",
    "verbosity_control_warnings": "Repeated verbosity controls detected",
    "mcp_tool_bloat_warnings": "MCP/tool-bloat risk detected",
    "mcp_deferred_loading_warnings": "Large MCP tool catalog detected without deferred loading",
}
REDACTED = r"(?i)secret patterns were redacted locally \(([0-9]+) match"
ACTIONS = [
    ("MCP/tool-bloat risk detected", "- MCP/tool bloat: scope the task to required tools only and set an allowlist (for example `allowed_tools`)."),
    ("Large MCP tool catalog detected without deferred loading", "- MCP deferred loading: enable `defer_loading` for low-frequency tools so large catalogs are loaded only when needed."),
    ("Instruction-like selection detected", "- Instruction-like selection: compress the file with `--mode instructions` or split repo-wide rules from path-specific guidance."),
    ("Repeated verbosity controls detected", "- Repeated verbosity controls: move stable direct-answer defaults into repo instructions and keep per-prompt shaping for exceptions."),
    ("High-cost review request detected", "- High-cost review request: run local diff review first and send only risky hunks to Copilot review."),
    ("Volatile context detected", "- Volatile context: move run-specific details after stable instructions or trim them before sending."),
    ("Unstable prompt prefix detected", "- Unstable prefix: keep stable instructions first, then append timestamps, IDs, and stack traces at the end."),
    ("Low prompt reuse score detected", "- Reuse structure: use a stable template (goal, file, constraints) and place volatile runtime data in a final error/details block."),
]
NUDGE_AT, TOP_SKELETONS = 3, 5


def _says(w, what):
    return F.contains(F.lower(w), F.lit(what.lower()))


def run_counters() -> list:
    """A4: the aggregates over run events that need no grouping by fingerprint."""
    warnings = F.coalesce("warnings", F.array().cast("array<string>"))
    count = lambda what: F.size(F.filter(warnings, lambda w: _says(w, what)))
    redactions = F.aggregate(F.transform(warnings, lambda w: F.coalesce(F.nullif(F.regexp_extract(w, REDACTED, 1), F.lit("")).cast("long"), F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    part = lambda g, c: F.when(F.col("grp") == g, F.col(c))
    return [
        F.count_if(F.col("grp") == "prompt").alias("prompt_runs"),
        F.count_if(F.col("grp") == "selection").alias("selection_runs"),
        total("before_tokens", "total_before_tokens"),
        total("after_tokens", "total_after_tokens"),
        total(part("selection", "before_tokens"), "selection_before_tokens"),
        total(part("selection", "after_tokens"), "selection_after_tokens"),
        total(part("prompt", "before_tokens"), "prompt_before_tokens"),
        total(part("prompt", "after_tokens"), "prompt_after_tokens"),
        total(F.size(warnings), "total_warnings"),
        total(redactions, "redactions_total"),
        *[total(count(what), name) for name, what in WARNING_CLASSES.items()],
        F.coalesce(F.max_by(F.coalesce("context_type", F.lit("unknown")), "seq"), F.lit("none")).alias("last_context_type"),
    ]


def skeleton_counts(runs: DataFrame) -> DataFrame:
    """Prompt runs per fingerprint."""
    return runs.where("grp = 'prompt' AND skeleton_id IS NOT NULL AND skeleton_id <> ''").groupBy("skeleton_id").agg(F.count("*").alias("n"))


def run_stats(runs: DataFrame) -> DataFrame:
    """A4: one row of counters, fingerprint repeats and uniques included."""
    repeats = skeleton_counts(runs).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("repeated_prompt_skeletons"), F.count("*").alias("unique_prompt_skeletons"))
    return runs.agg(*run_counters()).crossJoin(F.broadcast(repeats))  # one row by one row


def since_reset(events: DataFrame, type_col: str = "event_type", reset: str = "reset", ts_col: str = "ts") -> DataFrame:
    """T4: the events after the last reset; all, if there was none."""
    last = events.agg(F.max(F.when(F.col(type_col) == reset, F.col(ts_col))).alias("_reset"))
    return events.crossJoin(F.broadcast(last)).where(F.col("_reset").isNull() | (F.col(ts_col) > F.col("_reset"))).drop("_reset")  # one row


def command_runs(runs: DataFrame) -> DataFrame:
    """A5: runs per command, zero for commands never run."""
    spark = runs.sparkSession
    known = spark.createDataFrame([(c,) for c in COMMANDS], "command_key string")
    counted = runs.groupBy("command_key").agg(F.count("*").alias("n"))
    return counted.join(known, "command_key", "full").select("command_key", F.coalesce("n", F.lit(0)).alias("runs"))


def command_run_map(runs: DataFrame) -> DataFrame:
    """The same as one map."""
    return command_runs(runs).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("command_key", "runs")))).alias("command_runs"))


def percent(part, whole):
    return F.when(whole > 0, T.js_round(part / whole * 100)).otherwise(F.lit(0)).cast("long")


def evidence(stats: DataFrame, runs_total, rate: float = 0.0) -> DataFrame:
    """Savings, percentages and cost (null where no rate is given)."""
    saved = F.col("total_before_tokens") - F.col("total_after_tokens")
    squeezed = F.col("selection_before_tokens") - F.col("selection_after_tokens")
    return stats.select(
        F.col("total_before_tokens").alias("before"),
        F.col("total_after_tokens").alias("after"),
        saved.alias("saved"),
        percent(saved, F.col("total_before_tokens")).alias("saved_pct"),
        squeezed.alias("compression_saved"),
        percent(squeezed, F.col("selection_before_tokens")).alias("compression_pct"),
        (T.to_fixed_2(saved / F.lit(1_000_000.0) * F.lit(float(rate))) if rate > 0 else F.lit(None).cast("double")).alias("cost_saved_usd"),
        F.col("redactions_total").alias("secret_redactions"),
        runs_total.alias("total_runs"),
    )


def stats_metrics(stats: DataFrame, review_runs=None) -> DataFrame:
    """Net change, its percentage, compression percentage, prompt delta, preflight share."""
    net = F.col("total_before_tokens") - F.col("total_after_tokens")
    squeezed = F.col("selection_before_tokens") - F.col("selection_after_tokens")
    review = review_runs if review_runs is not None else F.lit(0)
    return stats.select(
        net.alias("net_saved"),
        percent(F.abs(net), F.col("total_before_tokens")).alias("saved_pct"),
        percent(squeezed, F.col("selection_before_tokens")).alias("compression_pct"),
        (F.col("prompt_before_tokens") - F.col("prompt_after_tokens")).alias("prompt_delta"),
        percent(review, F.col("selection_runs")).alias("review_preflight_share"),
    )


def format_delta(before, after):
    """Report line for a change in tokens."""
    d = before - after
    return F.when(d > 0, F.concat(F.lit("saved ~"), T.format_count(d), F.lit(" tokens"))).when(d < 0, F.concat(F.lit("added ~"), T.format_count(F.abs(d)), F.lit(" tokens"))).otherwise(F.lit("no token change"))


def stats_block(label, before, after, ratio, tool: str = "textloom"):
    """The block that follows a compression."""
    return F.concat(
        F.lit(f"\n[{tool}] "), label,
        F.lit("\n  Before : ~"), T.format_count(before),
        F.lit(" tokens\n  After  : ~"), T.format_count(after),
        F.lit(" tokens\n  Saved  : ~"), T.format_count(before - after),
        F.lit(" tokens ("), ratio.cast("string"), F.lit("% reduction)\n\n"),
    )


def recurring(runs: DataFrame, n: int = TOP_SKELETONS) -> DataFrame:
    """The fingerprints used most, if used more than once."""
    return skeleton_counts(runs).where("n > 1").orderBy(F.desc("n"), "skeleton_id").limit(n)


def nudges(runs: DataFrame) -> DataFrame:
    """Prompt runs that are at least the third of their fingerprint."""
    w = Window.partitionBy("skeleton_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return runs.where("grp = 'prompt' AND skeleton_id IS NOT NULL AND skeleton_id <> ''").withColumn("running", F.count("*").over(w)).where(F.col("running") >= NUDGE_AT).select("seq", "skeleton_id", "running")


def coaching(runs: DataFrame) -> DataFrame:
    """Warning totals with the recurring fingerprints."""
    top = recurring(runs).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "skeleton_id"))), lambda x: x["skeleton_id"]).alias("top_skeletons"))
    return run_stats(runs).select("total_warnings", *WARNING_CLASSES, "repeated_prompt_skeletons").crossJoin(F.broadcast(top))  # one row by one row


def advice_counters(advice: DataFrame) -> DataFrame:
    """Recommendations given, and those that a local transform would do."""
    return advice.agg(F.count("*").alias("model_advice_runs"), F.count_if(F.col("routing") == "local-transform").alias("local_transform_opportunities"))


def warning_actions(warnings):
    """What to do about the warnings that occur."""
    return F.array_compact(F.array(*[F.when(F.exists(warnings, _sayer(what)), F.lit(action)) for what, action in ACTIONS]))


def _sayer(what):
    return lambda w: _says(w, what)


def cacheability_lines(cache):
    """Report lines on how reusable a prompt's prefix is."""
    stable = T.js_round(cache["stable_prefix_ratio"] * 100).cast("string")
    noisy = (cache["volatility_density"] > 0) | (cache["stable_prefix_ratio"] < 1)
    return F.array(
        F.lit(""),
        F.lit("## Cacheability"),
        F.lit(""),
        F.concat(F.lit("- Reuse score: "), cache["score"].cast("string"), F.lit("/100 (stable prefix "), stable, F.lit("%).")),
        F.when(
            noisy,
            F.lit(
                "- To raise it: keep the stable task instructions first and move run-specific noise (IDs, timestamps, error dumps) to the END. An identical prefix across runs lets the model reuse its cached context, so you only pay for the changing tail."
            ),
        ).otherwise(F.lit("- Stable prefix, no run-specific noise: repeated runs of this prompt can reuse the cached prefix.")),
    )


def runs_from_conversations(turns: DataFrame) -> DataFrame:
    """Run events out of conversation turns (conv_id, turn, role, text): user turns are prompt
    runs, other turns selection runs. ``after_tokens`` are those of the whole text with its white
    space squeezed, and a prompt's fingerprint is that of the whole squeezed text in lower case:
    a plain stand-in for ``prompt.with_skeleton``, which SQL can say too."""
    from textloom.operators import prompt

    text = F.coalesce("text", F.lit(""))
    squeezed = T.trim(T.squeeze(text))
    seq = F.col("conv_id") * 1000 + F.col("turn")
    df = turns.select(
        seq.alias("seq"),
        F.when(F.col("role") == "user", "chatOptimize").when(F.col("role") == "assistant", "chatCompress").otherwise("reviewDiff").alias("command_key"),
        F.when(F.col("role") == "user", "prompt").otherwise("selection").alias("grp"),
        text.alias("_text"),
        F.when(F.col("role") == "user", F.concat(F.lit("psk_"), prompt.fnv1a(F.lower(squeezed)))).alias("skeleton_id"),
        T.estimate_tokens(text).alias("before_tokens"),
        T.estimate_tokens(squeezed).alias("after_tokens"),
        F.when(F.col("role") == "user", "prompt-only").otherwise("selected-text").alias("context_type"),
    )
    df = prompt.with_cache(df, "_text")
    return prompt.with_warnings(df, "_text").drop("_text", "cache")
