"""Artefacts derived from the tables, so that every operator runs over whole tables.

Each input exists twice, as a DataFrame and as DuckDB SQL, written independently.
"""

from __future__ import annotations

from pyspark.sql import functions as F


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- logs: a test-runner log per user, a line per event --------------------------------------


def logs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n, v = F.col("event_id").cast("string"), (F.col("event_id") % 5).cast("string")
    line = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("  ✓ step "), n, F.lit(" passes")))
        .when(F.col("event_type") == "error", F.concat(F.lit("    Error: expected value "), n, F.lit(" in case "), v))
        .when(F.col("event_type") == "view", F.concat(F.lit("    at view"), v, F.lit(" (/app/src/view.ts:"), n, F.lit(":5)")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("    at run (/app/node_modules/lib/run.js:"), n, F.lit(":1)")))
        .otherwise(F.when(F.col("event_id") % 2 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  "), n, F.lit(") signup"), v, F.lit(".spec.ts \t"))))
    )
    e = e.select("user_id", "event_id", line.alias("line"))
    grouped = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("l"))
    return grouped.select(F.col("user_id").alias("id"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


LOGS_SQL = """
SELECT user_id AS id, string_agg(CASE event_type
  WHEN 'click' THEN '  ✓ step ' || event_id || ' passes'
  WHEN 'error' THEN '    Error: expected value ' || event_id || ' in case ' || (event_id % 5)
  WHEN 'view' THEN '    at view' || (event_id % 5) || ' (/app/src/view.ts:' || event_id || ':5)'
  WHEN 'purchase' THEN '    at run (/app/node_modules/lib/run.js:' || event_id || ':1)'
  ELSE CASE WHEN event_id % 2 = 0 THEN '   ' ELSE '  ' || event_id || ') signup' || (event_id % 5) || '.spec.ts ' || chr(9) END END,
  chr(10) ORDER BY event_id) AS text
FROM events GROUP BY user_id"""


# --- diffs: a diff per order, a file per line item -------------------------------------------

PATHS = ["src/auth/login.ts", "package-lock.json", "docs/guide.md", "tests/a.spec.ts", "infra/terraform/main.tf", "src/core.py", "config/app.yaml"]


def diffs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    heads = F.array(*[F.lit(f"diff --git a/{p} b/{p}\n--- a/{p}\n+++ b/{p}\n@@ -1,3 +1,4 @@\n context line\n") for p in PATHS])

    def part(x):
        head = F.element_at(heads, (x["l_partkey"] % len(PATHS) + 1).cast("int"))
        plus = F.repeat(F.concat(F.lit("+new "), x["l_partkey"].cast("string"), F.lit("\n")), (x["q"] % 4).cast("int"))
        return F.concat(head, plus, F.repeat(F.lit("-old\n"), (x["q"] % 3).cast("int")), F.lit(" more"))

    # texts are made after the grouping, which moves and sorts numbers alone
    grouped = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "q"))).alias("l"))
    return grouped.select(F.col("l_orderkey").alias("id"), F.array_join(F.transform("l", part), "\n").alias("text"))


_PATH_SQL = "['" + "','".join(PATHS) + f"'][(l_partkey % {len(PATHS)} + 1)::int]"
DIFFS_SQL = f"""
SELECT l_orderkey AS id, string_agg('diff --git a/' || p || ' b/' || p || chr(10) || '--- a/' || p || chr(10) || '+++ b/' || p || chr(10)
  || '@@ -1,3 +1,4 @@' || chr(10) || ' context line' || chr(10) || repeat('+new ' || l_partkey || chr(10), q % 4) || repeat('-old' || chr(10), q % 3) || ' more',
  chr(10) ORDER BY l_linenumber, l_partkey, q) AS text
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::int AS q, {_PATH_SQL} AS p FROM lineitem) GROUP BY l_orderkey"""


# --- workspaces: a readiness probe per supplier ----------------------------------------------


def workspaces(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"),
        (k % 3 != 0).alias("has_repo_instructions"),
        (k % 11 == 0).alias("instructions_bloated"),
        (k % 2).cast("int").alias("path_instruction_count"),
        (k % 5 != 1).alias("has_agents"),
        (k % 7 == 0).cast("int").alias("agents_unscoped"),
        (k % 4 != 2).alias("has_exclusion"),
        (k % 6 == 0).alias("has_ignore"),
        (k % 3 != 1).alias("has_mcp"),
        (k % 4).cast("int").alias("mcp_servers"),
        (k % 4).cast("int").alias("mcp_allow"),
        F.when(k % 8 < 4, k % 4).otherwise(0).cast("int").alias("mcp_defer"),
        (k % 9 < 5).alias("has_devcontainer"),
        F.when(k % 13 != 0, F.lit(1_700_000_000_000) - k * 86_400_000 * 3).alias("latest_update_ms"),
        F.lit(1_700_000_000_000).alias("now_ms"),
    )


WORKSPACES_SQL = """
SELECT s_name AS name, s_suppkey % 3 <> 0 AS has_repo_instructions, s_suppkey % 11 = 0 AS instructions_bloated, s_suppkey % 2 AS path_instruction_count,
  s_suppkey % 5 <> 1 AS has_agents, (s_suppkey % 7 = 0)::int AS agents_unscoped, s_suppkey % 4 <> 2 AS has_exclusion, s_suppkey % 6 = 0 AS has_ignore,
  s_suppkey % 3 <> 1 AS has_mcp, s_suppkey % 4 AS mcp_servers, s_suppkey % 4 AS mcp_allow, CASE WHEN s_suppkey % 8 < 4 THEN s_suppkey % 4 ELSE 0 END AS mcp_defer,
  s_suppkey % 9 < 5 AS has_devcontainer, CASE WHEN s_suppkey % 13 <> 0 THEN s_suppkey * 3 END AS age FROM supplier"""
