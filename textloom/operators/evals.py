"""Evaluation: arm comparison, calibration, quality gates, coverage and link checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

FAILED = "__ERROR__"
VARIANTS = ["baseline", "concise", "directDefault"]


def arm_tokens(outputs: DataFrame) -> DataFrame:
    """Tokens per (arm, prompt_idx); null where the output is missing or failed."""
    ok = (F.col("output") != "") & ~F.col("output").startswith(FAILED)
    return outputs.select("arm", "prompt_idx", F.when(F.coalesce(ok, F.lit(False)), T.estimate_tokens("output")).alias("tokens"))


def usable_prompts(tokens: DataFrame, arms: list[str]) -> DataFrame:
    """Prompts that every arm answered, an arm per column."""
    wide = tokens.groupBy("prompt_idx").pivot("arm", arms).agg(F.max("tokens"))
    return wide.where(" AND ".join(f"coalesce(`{a}`, 0) > 0" for a in arms))


def arm_means(outputs: DataFrame, arms: list[str]) -> DataFrame:
    """Mean tokens per arm over usable prompts."""
    wide = usable_prompts(arm_tokens(outputs), arms)
    row = wide.agg(*[F.avg(f"`{a}`").alias(a) for a in arms])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), T.js_round(F.col(f"`{a}`")).alias("mean_tokens")) for a in arms])).alias("x")).select("x.*")


def reductions(outputs: DataFrame, arms: list[str], arm: str, versus: str) -> DataFrame:
    """Median, mean, least and greatest reduction of one arm against another."""
    wide = usable_prompts(arm_tokens(outputs), arms).select((1 - F.col(f"`{arm}`") / F.col(f"`{versus}`")).alias("r"))
    return wide.agg(F.lit(arm).alias("arm"), F.lit(versus).alias("versus"), F.count("*").alias("prompts"), F.median("r").alias("median"), F.avg("r").alias("mean"), F.min("r").alias("least"), F.max("r").alias("greatest"))


def arm_matrix(outputs: DataFrame, prompts: DataFrame, arms: DataFrame) -> DataFrame:
    """(arm, prompt_idx, output) of every arm and prompt, empty where missing. Rows, as an arm's
    outputs together are as many as the prompts; ``arms`` is a list of a few."""
    jobs = prompts.select("prompt_idx").crossJoin(F.broadcast(arms.select("arm")))  # the job list is the product
    return jobs.join(outputs, ["arm", "prompt_idx"], "left").select("arm", "prompt_idx", F.coalesce("output", F.lit("")).alias("output"))


def calibration(samples: DataFrame) -> DataFrame:
    """Per sample the estimate's error and the ratio's bias; real counts are columns.

    ``samples``: name, est_before, real_before, est_after, real_after.
    """
    ratio = lambda a, b: F.when(F.col(b) > 0, (1 - F.col(a) / F.col(b)) * 100).otherwise(F.lit(0.0))
    error = F.when(F.col("real_before") > 0, (F.col("est_before") - F.col("real_before")) / F.col("real_before") * 100).otherwise(F.lit(0.0))
    return samples.select("name", error.alias("est_err_pct"), (ratio("est_after", "est_before") - ratio("real_after", "real_before")).alias("ratio_bias_pp"))


def calibration_summary(rows: DataFrame) -> DataFrame:
    """Mean, median and greatest of the absolute values."""
    both = [F.struct(F.lit(m).alias("metric"), F.abs(c).alias("x")) for m, c in (("est_err_pct", "est_err_pct"), ("ratio_bias_pp", "ratio_bias_pp"))]
    flat = rows.select(F.explode(F.array(*both)).alias("v")).select("v.*")
    return flat.groupBy("metric").agg(F.avg("x").alias("mean"), F.median("x").alias("median"), F.max("x").alias("greatest"))


def missing_requirements(output, groups):
    """The groups of alternatives of which the output contains none."""
    said = F.lower(F.coalesce(output, F.lit("")))
    unmet = F.filter(F.coalesce(groups, F.array().cast("array<array<string>>")), lambda g: ~F.exists(g, lambda a: F.contains(said, F.lower(a))))
    return F.transform(unmet, lambda g: F.array_join(g, " | "))


def verdict_cell(value):
    """P30."""
    return F.when(value.isNull(), "review").when(value, "pass").otherwise("fail")


def resolve_output(answers: DataFrame, files: DataFrame) -> DataFrame:
    """The inline output, else the referenced file's text, else empty."""
    texts = files.select(F.col("path").alias("output_file"), F.col("text").alias("_file_text"))
    return answers.join(texts, "output_file", "left").withColumn("output", F.coalesce("output", T.trim_end(F.col("_file_text")), F.lit(""))).drop("_file_text")


def coverage_errors(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Prompts without a result, variants missing, outputs blank."""
    have = answers.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("variant", F.coalesce("output", F.lit(""))))).alias("v"))
    joined = prompts.select("id").join(have, "id", "left")
    name = F.col("id")

    def complaint(v):
        got = F.element_at("v", v)
        return (
            F.when(got.isNull(), F.concat(F.lit("Missing variant '"), v, F.lit("' for prompt '"), name, F.lit("'.")))
            .when(T.trim(got) == "", F.concat(F.lit("Missing output for variant '"), v, F.lit("' in prompt '"), name, F.lit("'.")))
        )

    whole = F.concat(F.lit("Missing snapshot result for prompt '"), name, F.lit("'."))
    errors = F.when(F.col("v").isNull(), F.array(whole)).otherwise(F.array_compact(F.array(*[complaint(F.lit(v)) for v in VARIANTS])))
    return joined.select("id", F.explode(errors).alias("error"))


LINK = r"\[[^\]]+\]\(([^)]+)\)"


def _absolute(path):
    """Path without ``.`` and ``..``: POSIX rules, by a fold over its parts."""
    keep = lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), keep), "/"))


def broken_links(docs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Local markdown links whose target isn't among the files.

    ``docs`` (path, text), ``files`` (path; the docs' own paths by default).
    """
    known = (files if files is not None else docs).select(_absolute(F.col("path")).alias("target")).distinct()
    raw = docs.select("path", F.explode(F.regexp_extract_all("text", F.lit(LINK), F.lit(1))).alias("raw"))
    raw = raw.where(~F.col("raw").startswith("#") & ~F.col("raw").rlike("(?i)^[a-z][a-z0-9+.-]*:"))
    bare = F.url_decode(F.regexp_replace(F.substring_index(F.split(T.trim(F.col("raw")), r'\s+"').getItem(0), "#", 1), r"\+", "%2B"))
    raw = raw.withColumn("local", bare).where(F.col("local").endswith(".md"))
    base = F.regexp_replace("path", "[^/]*$", "")
    raw = raw.withColumn("target", _absolute(F.when(F.col("local").startswith("/"), F.col("local")).otherwise(F.concat(base, F.lit("/"), F.col("local")))))
    return raw.join(known, "target", "left_anti").select("path", "raw", "target")


def to_write(planned: DataFrame, present: DataFrame) -> DataFrame:
    """Planned files that don't exist yet."""
    return planned.join(present.select("path"), "path", "left_anti")


def skipped(planned: DataFrame, present: DataFrame) -> DataFrame:
    return planned.join(present.select("path"), "path", "left_semi")


def drift(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Missing, stale and extraneous files of a generated tree (path, content)."""
    a, b = planned.select("path", F.col("content").alias("_p")), existing.select("path", F.col("content").alias("_e"))
    state = F.when(F.col("_e").isNull(), "missing").when(F.col("_p").isNull(), "extraneous").when(F.col("_p") != F.col("_e"), "stale")
    return a.join(b, "path", "full").select("path", state.alias("state")).where("state IS NOT NULL")


def rule_matches(df: DataFrame, rules: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts by the rules (id, pattern) that fit them.

    The rule table becomes an array literal per row, so nothing is shuffled and no text is copied.
    """
    table = [(r["id"], r["pattern"]) for r in rules.orderBy("id").collect()]  # a rule table, not data
    hits = F.array_compact(F.array(*[F.when(F.col(text_col).rlike(p), F.lit(i)) for i, p in table]))
    return df.withColumn("rules", hits)
