"""Workspace readiness: instruction hygiene, agent and tool-server checks, weighted score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.regex import java

#: Fixed values.
BLOAT_LINES = 200
BROAD_DIRECTIVES = [
    r"@workspace",
    r"\b(whole|entire)\s+(project|code\s?base|repo(?:sitory)?)\b",
    r"\bread all (?:the )?files\b",
    r"\bfix everything\b",
    r"\bgenerate (?:all|everything)\b",
    r"\blook through the (?:whole |entire )?(?:project|repo(?:sitory)?)\b",
    r"\bscan the (?:whole |entire )?repo(?:sitory)?\b",
]
SIGNALS = [
    ("repoInstructions", "Repository instructions", 20),
    ("pathInstructions", "Path-specific instructions", 10),
    ("agentsPolicy", "Agent policy", 15),
    ("contentExclusion", "Content exclusion", 15),
    ("copilotIgnore", "Copilot ignore (convention only)", 5),
    ("mcpConfig", "MCP configuration", 15),
    ("devcontainer", "Dev container", 10),
    ("contextFreshness", "Context freshness", 10),
]
DAY_MS, FRESH_DAYS, STALE_DAYS = 86_400_000, 90, 180
NAMES_SHOWN, GAPS_SHOWN = 8, 6
HOOK_MARKER = "textloom-hook"
OWN_HOOKS = ".textloom/hooks"
READINESS_FILES = [".github/copilot-instructions.md", "AGENTS.md", ".vscode/mcp.json", ".vscode/mcp.jsonc"]


def instruction_hygiene(text):
    """Struct line_count, bloated, broad_scope_hits, broad_scope_examples."""
    text = F.coalesce(text, F.lit(""))
    lines = F.when(text == "", 0).otherwise(F.size(F.split(text, r"\r?\n", -1)))
    hits = F.array_compact(F.array(*[F.nullif(F.regexp_extract(text, java(p, "i"), 0), F.lit("")) for p in BROAD_DIRECTIVES]))
    return F.struct(lines.alias("line_count"), (lines > BLOAT_LINES).alias("bloated"), F.size(hits).alias("broad_scope_hits"), F.slice(hits, 1, 3).alias("broad_scope_examples"))


def front_matter(text):
    """P22."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\A---\r?\n(.*?)\r?\n---", 1)


def agent_definitions(agents: DataFrame, by: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """A10: definitions, those without a tools line, those without a description."""
    front = front_matter(F.col(text_col))
    says = lambda key: T.test(front, rf"^\s*{key}\s*:", "m")
    return agents.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.count_if(~says("tools")).alias("unscoped"), F.count_if(~says("description")).alias("undescribed"))


_SERVERS = "map<string,struct<allowed_tools:array<string>,defer_loading:boolean>>"


def tool_servers(config):
    """Struct server_count, allowlist_count, deferred_count, names, gaps.

    Comments and trailing commas are cut; a text that is still no JSON is counted by its keys.
    """
    config = F.coalesce(config, F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(config, r"(?s)/\*.*?\*/", ""), java(r"^\s*\/\/.*$", "m"), "")
    bare = F.regexp_replace(bare, r",(\s*[}\]])", "$1")
    parsed = F.try_parse_json(bare)
    servers = F.map_entries(F.from_json(F.to_json(F.try_variant_get(parsed, "$.servers", "variant")), _SERVERS, {"mode": "PERMISSIVE"}))
    servers = F.coalesce(servers, F.from_json(F.lit("[]"), f"array<struct<key:string,value:struct<allowed_tools:array<string>,defer_loading:boolean>>>"))
    allow = lambda s: F.coalesce(F.size(s["value"]["allowed_tools"]) > 0, F.lit(False))
    defer = lambda s: F.coalesce(s["value"]["defer_loading"], F.lit(False))
    gaps = F.transform(F.filter(servers, lambda s: ~(allow(s) & defer(s))), lambda s: F.struct(s["key"].alias("name"), (~allow(s)).alias("needs_allowlist"), (~defer(s)).alias("needs_deferred")))
    n_allow, n_defer = F.regexp_count(config, F.lit(r'"allowed_tools"\s*:')), F.regexp_count(config, F.lit(r'"defer_loading"\s*:'))
    blank, broken = T.trim(config) == "", parsed.isNull()
    return F.struct(
        F.when(blank, 0).when(broken, F.greatest(n_allow, n_defer, F.contains(config, F.lit('"servers"')).cast("int"))).otherwise(F.size(servers)).cast("int").alias("server_count"),
        F.when(blank, 0).when(broken, n_allow).otherwise(F.size(F.filter(servers, allow))).cast("int").alias("allowlist_count"),
        F.when(blank, 0).when(broken, n_defer).otherwise(F.size(F.filter(servers, defer))).cast("int").alias("deferred_count"),
        F.when(blank | broken, F.array().cast("array<string>")).otherwise(F.transform(servers, lambda s: s["key"])).alias("names"),
        F.when(blank | broken, F.array().cast("array<struct<name:string,needs_allowlist:boolean,needs_deferred:boolean>>")).otherwise(gaps).alias("gaps"),
    )


def capped(names, most: int, more: str):
    """The first names and how many more there are."""
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(F.size(names) > most, F.format_string(more, F.size(names) - most)).otherwise(F.lit("")))


def server_names(names):
    """P31."""
    return F.when(F.size(names) > 0, F.concat(F.lit(" ("), capped(names, NAMES_SHOWN, ", +%d more"), F.lit(")"))).otherwise(F.lit(""))


def server_gaps(gaps):
    """Each under-scoped server with what it needs."""
    needs = lambda g: F.concat_ws(" + ", F.when(g["needs_allowlist"], F.lit("allowed_tools")), F.when(g["needs_deferred"], F.lit("defer_loading")))
    named = F.transform(gaps, lambda g: F.concat(g["name"], F.lit(" (needs "), needs(g), F.lit(")")))
    return F.when(F.size(gaps) > 0, F.concat(F.lit(" To fix: "), capped(named, GAPS_SHOWN, " and %d more"), F.lit("."))).otherwise(F.lit(""))


def server_status(present, servers, allowed, deferred):
    """P23."""
    good = present & (servers > 0) & (allowed == servers) & (deferred == servers)
    return F.when(good, "pass").otherwise("warn")


def agent_status(present, unscoped, undescribed):
    """P24."""
    return F.when(~present, "missing").when((unscoped > 0) | (undescribed > 0), "warn").otherwise("pass")


def instructions_status(present, bloated, hits):
    """P24."""
    return F.when(~present, "missing").when(bloated | (hits > 0), "warn").otherwise("pass")


def age_days(updated_ms, now_ms):
    return F.floor((now_ms - updated_ms) / DAY_MS)


def freshness_status(updated_ms, now_ms):
    """P25."""
    age = age_days(updated_ms, now_ms)
    return F.when(updated_ms.isNull() | (updated_ms == 0), "missing").when(age <= FRESH_DAYS, "pass").when(age <= STALE_DAYS, "warn").otherwise("missing")


def points(weight, status):
    """P26."""
    return F.when(status == "pass", weight).when(status == "warn", T.js_round(weight / 2)).otherwise(F.lit(0)).cast("int")


def signals(workspaces: DataFrame) -> DataFrame:
    """A row per workspace and signal with weight, status, earned and to_close."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = {
        "repoInstructions": instructions_status(yes("has_repo_instructions"), yes("instructions_bloated"), n("broad_scope_hits")),
        "pathInstructions": F.when(n("path_instruction_count") > 0, "pass").otherwise("warn"),
        "agentsPolicy": agent_status(yes("has_agents"), n("agents_unscoped"), n("agents_undescribed")),
        "contentExclusion": F.when(yes("has_exclusion"), "pass").otherwise("missing"),
        "copilotIgnore": F.when(yes("has_ignore"), "pass").otherwise("warn"),
        "mcpConfig": server_status(yes("has_mcp"), n("mcp_servers"), n("mcp_allow"), n("mcp_defer")),
        "devcontainer": F.when(yes("has_devcontainer"), "pass").otherwise("warn"),
        "contextFreshness": freshness_status(F.col("latest_update_ms"), F.col("now_ms")),
    }
    for c, t in (("instructions_bloated", "boolean"), ("broad_scope_hits", "int"), ("agents_unscoped", "int"), ("agents_undescribed", "int")):
        if c not in workspaces.columns:
            workspaces = workspaces.withColumn(c, F.lit(None).cast(t))
    rows = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(i).alias("signal_id"), F.lit(label).alias("label"), F.lit(w).alias("weight"), status[i].alias("status")) for k, (i, label, w) in enumerate(SIGNALS)])
    flat = workspaces.select("name", F.explode(rows).alias("s")).select("name", "s.*")
    return flat.withColumn("earned", points(F.col("weight"), F.col("status"))).withColumn("to_close", F.col("weight") - F.col("earned"))


def verdict(score):
    return F.when(score >= 80, "Ready").when(score >= 50, "Needs attention").otherwise("Incomplete")


def scores(signal_rows: DataFrame) -> DataFrame:
    """Score, maximum and verdict per workspace."""
    out = signal_rows.groupBy("name").agg(F.sum("earned").alias("score"), F.sum("weight").alias("max_score"))
    return out.withColumn("verdict", verdict(F.col("score")))


def gaps(signal_rows: DataFrame) -> DataFrame:
    """What isn't passing, by the points that closing it would add."""
    return signal_rows.where("status <> 'pass'").select("name", "signal_id", "label", "status", "earned", "weight", "to_close", "ord").orderBy(F.desc("to_close"), "name", "ord")


def overall(signal_rows: DataFrame) -> DataFrame:
    """One row over all workspaces."""
    each = scores(signal_rows)
    total = each.agg(
        F.when(F.coalesce(F.bool_and(F.col("verdict") == "Ready"), F.lit(True)), "Ready").when(F.bool_or(F.col("verdict") == "Incomplete"), "Incomplete").otherwise("Needs attention").alias("verdict"),
        F.coalesce(T.js_round(F.avg("score")), F.lit(0)).cast("long").alias("score"),
        F.coalesce(T.js_round(F.avg("max_score")), F.lit(0)).cast("long").alias("max_score"),
        F.count("*").alias("workspaces"),
    )
    top = signal_rows.where("status <> 'pass'").agg(F.min_by(F.struct("label", "to_close"), F.struct((-F.col("to_close")).alias("k"), "name", "ord")).alias("g")).select(F.col("g.label").alias("top_gap"), F.col("g.to_close").alias("top_gap_points"))
    return total.crossJoin(F.broadcast(top))  # one row by one row


def gap_lines(signal_rows: DataFrame) -> DataFrame:
    """Report block of all gaps, as one text per workspace."""
    line = F.concat(F.lit("- "), "label", F.lit(" — "), F.upper("status"), F.lit(" "), F.col("earned").cast("string"), F.lit("/"), F.col("weight").cast("string"), F.lit(" (+"), F.col("to_close").cast("string"), F.lit(")"))
    rows = signal_rows.where("status <> 'pass'").withColumn("line", line)
    grouped = rows.groupBy("name").agg(F.sum("to_close").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("to_close")).alias("k"), "ord", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return grouped.select("name", F.concat(F.lit("### Close these gaps to raise the score (+"), F.col("n").cast("string"), F.lit(" available)\n\n"), "body").alias("report"))


def hook_plan(hooks_path, existing):
    """Struct action, write_hook, write_scanner."""
    path = T.trim(F.coalesce(hooks_path, F.lit("")))
    foreign = (path != "") & (path != OWN_HOOKS) & ~path.startswith(".git")
    action = F.when(foreign, "conflict-hookspath").when(existing.isNull(), "fresh").when(F.contains(existing, F.lit(HOOK_MARKER)), "already").otherwise("conflict-custom")
    return F.struct(action.alias("action"), action.isin("fresh", "already").alias("write_hook"), F.lit(True).alias("write_scanner"))


def matters_for_readiness(path):
    """P28."""
    p = F.regexp_replace(path, r"\\", "/")
    return p.isin(*READINESS_FILES) | (p.startswith(".github/agents/") & p.endswith(".agent.md")) | (p.startswith(".claude/agents/") & p.endswith(".md"))
