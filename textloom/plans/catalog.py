"""All registered queries of the engine with their oracle SQL.

A query is a function (spark, sf_dir) -> DataFrame; its oracle, where SQL can express the
operator, is written independently of the Spark plan. Every query runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.regex import sql_any, sql_string, sql_test
from textloom.operators import advisor, code, diff, evals, output, prompt, readiness, reports, runs, secrets, select, structured
from textloom.plans import derived as D
from textloom.plans import sqlgen as S
from textloom.plans.derived import table
from textloom.sources import files
from textloom.streaming import runs as streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)


def rows(spark, schema, data):
    return spark.createDataFrame(data, schema)


# --- tokens, redaction, scanning ----------------------------------------------------------

_OUT, _COUNTS = S.redacted("text")
_TOTAL = " + ".join(c for _, c in _COUNTS)


@query(
    f"""WITH r AS (SELECT lang, text, {_OUT} AS masked, {' + '.join('(' + c + ')' for _, c in _COUNTS)} AS hits FROM documents)
SELECT lang, count(*) AS docs, sum({S.tokens('text')})::bigint AS before_tokens, sum({S.tokens('masked')})::bigint AS after_tokens, sum(hits)::bigint AS redactions FROM r GROUP BY lang"""
)
def token_savings_by_lang(spark, sf_dir):
    """Token estimates before and after redaction, by language."""
    d = secrets.protect(table(spark, sf_dir, "documents").select("lang", "text"))
    return d.groupBy("lang").agg(
        F.count("*").alias("docs"),
        F.sum(T.estimate_tokens("text")).alias("before_tokens"),
        F.sum(T.estimate_tokens("output")).alias("after_tokens"),
        F.sum(F.col("total").cast("long")).alias("redactions"),
    )


@query(f"SELECT doc_id, {S.tokens('text')} AS tokens, {S.u16('text')}::bigint AS units FROM documents")
def token_estimate(spark, sf_dir):
    """P1."""
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens("text").alias("tokens"), T.u16_length("text").alias("units"))


@query(
    f"SELECT id, sum(n)::bigint AS found FROM ("
    + " UNION ALL ".join(f"SELECT '{name}' AS id, sum({c}) AS n FROM documents" for name, c in _COUNTS)
    + ") GROUP BY id HAVING sum(n) > 0"
)
def findings_by_rule(spark, sf_dir):
    """K1, K7, A-level merge: redactions per rule over the corpus."""
    d = secrets.protect(table(spark, sf_dir, "documents").select("text"))
    return d.select(F.explode_outer("findings").alias("f")).where("f IS NOT NULL").groupBy(F.col("f.id").alias("id")).agg(F.sum(F.col("f.count").cast("long")).alias("found"))


_SCAN_RULES = [(name, pattern.split(r"[A-Za-z0-9+/=\s]*-----END")[0]) for name, pattern, _, _ in secrets.RULES]


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) "
    + " UNION ".join(f"SELECT 'doc-' || doc_id || '.md' AS file, '{n}' AS id, line::int AS line FROM l WHERE {sql_test('x', p)}" for n, p in _SCAN_RULES)
)
def scan_lines(spark, sf_dir):
    """K4, K5: places of secrets, never their values."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), "text")
    return secrets.scan(d)


@query(
    "WITH f AS (SELECT 'doc-' || doc_id || '.md' AS file, unnest(string_split(text, chr(10))) AS x, doc_id % 3 = 0 AS tracked FROM documents) SELECT tracked, count(*) AS findings, count(DISTINCT file) AS files FROM ("
    + " UNION ALL ".join(f"SELECT tracked, file, '{n}' AS id FROM f WHERE {sql_test('x', p)}" for n, p in _SCAN_RULES)
    + ") GROUP BY tracked"
)
def scan_files_ranked(spark, sf_dir):
    """Findings of tracked and untracked files."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), "text")
    found, _ = secrets.scan_files(d.select("file", "text"), d.where("doc_id % 3 = 0").select("file"))
    return found.groupBy("tracked").agg(F.count("*").alias("findings"), F.countDistinct("file").alias("files"))


@query(f"SELECT count(*) FILTER (length(text) <= {secrets.LARGEST} AND strpos(text, chr(0)) = 0) AS readable, count(*) AS files FROM documents")
def readable_files(spark, sf_dir):
    """S10."""
    return table(spark, sf_dir, "documents").agg(F.count_if(secrets.readable(F.col("text"))).alias("readable"), F.count("*").alias("files"))


@query(
    f"SELECT conv_id, turn, CASE WHEN text IS NULL OR {S.trim('text')} = '' THEN 'empty' WHEN {' + '.join(c for _, c in _COUNTS)} > 0 THEN 'redacted' ELSE 'clean' END AS status FROM conversations"
)
def clipboard_status(spark, sf_dir):
    """K11."""
    return secrets.clipboard_status(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "status")


# --- output, kinds, packs -----------------------------------------------------------------


@query(S.output_compress(D.LOGS_SQL))
def output_compress_logs(spark, sf_dir):
    """C1, W1-W3, W10 over a log per user."""
    return output.compress(D.logs(spark, sf_dir)).drop("text")


@query(S.output_compress("SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL"))
def output_compress_documents(spark, sf_dir):
    """C1 over prose: the fallback and shape dedupe."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    return output.compress(d).drop("text")


@query(
    f"SELECT kind, pack, count(*) AS n FROM (SELECT {S.kind('text')} AS kind, {S.pack_kind('text')} AS pack FROM (SELECT text FROM documents UNION ALL SELECT html FROM pages UNION ALL SELECT text FROM ({D.LOGS_SQL}) UNION ALL SELECT text FROM ({D.DIFFS_SQL}))) GROUP BY kind, pack"
)
def selection_kinds(spark, sf_dir):
    """P7, P8 over prose, pages, logs and diffs."""
    texts = table(spark, sf_dir, "documents").select("text").unionByName(table(spark, sf_dir, "pages").select(F.col("html").alias("text")))
    texts = texts.unionByName(D.logs(spark, sf_dir).select("text")).unionByName(D.diffs(spark, sf_dir).select("text"))
    t = F.col("text")
    return texts.groupBy(select.kind_of(t).alias("kind"), select.pack_kind_of(t).alias("pack")).agg(F.count("*").alias("n"))


@query(
    f"""WITH src AS ({D.LOGS_SQL}), l AS (SELECT id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM src),
p AS (SELECT id, {S.trim_end('x')} AS x, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn, pos FROM l WHERE {sql_test('x', *select.ASSERTION)})
SELECT id, count(*) AS assertions, string_agg(x, chr(10) ORDER BY pos) AS lines FROM p WHERE rn <= 20 GROUP BY id"""
)
def pack_assertions(spark, sf_dir):
    """C12a, C12f, W9: the assertion section of test packs."""
    p = select.context_pack(D.logs(spark, sf_dir).withColumn("k", F.lit("test")), kind_col="k")
    s = p.select("id", F.explode("sections").alias("s")).where("s.title like 'Assertion%'")
    return s.select("id", F.size("s.lines").cast("long").alias("assertions"), F.array_join("s.lines", "\n").alias("lines"))


@query(
    f"""WITH src AS ({D.LOGS_SQL}), m AS (SELECT id, unnest(regexp_extract_all(text, {sql_string('/app/src/view.ts:[0-9]+')})) AS ref, generate_subscripts(regexp_extract_all(text, '/app/src/view.ts:[0-9]+'), 1) AS k FROM src),
d AS (SELECT id, ref, min(k) AS k FROM m GROUP BY id, ref), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS rn FROM d)
SELECT id, string_agg(ref, ' ' ORDER BY k) AS refs FROM r WHERE rn <= 6 GROUP BY id"""
)
def file_references(spark, sf_dir):
    """C12g: distinct file references in order, module folders aside."""
    refs = select.file_refs(F.col("text"))
    return D.logs(spark, sf_dir).select("id", F.array_join(refs, " ").alias("refs")).where("refs <> ''")


@query()
def context_packs(spark, sf_dir):
    """C12 by detected kind over logs, diffs and documents."""
    texts = D.logs(spark, sf_dir).select("id", "text").unionByName(D.diffs(spark, sf_dir)).unionByName(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return select.context_pack(texts).select("id", "pack_kind", "pack", "before_tokens", "after_tokens")


@query()
def selection_optimized(spark, sf_dir):
    """C8, C9, P18 over logs, diffs and documents without a file name."""
    texts = D.logs(spark, sf_dir).select(F.concat(F.lit("log-"), "id").alias("doc_id"), "text").unionByName(D.diffs(spark, sf_dir).select(F.concat(F.lit("diff-"), "id").alias("doc_id"), "text"))
    texts = texts.unionByName(table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("doc_id"), "text")).withColumn("filename", F.lit(None).cast("string"))
    return select.optimize(texts).select("doc_id", "kind", "output", "before_tokens", "after_tokens", "ratio", "warnings")


_PREVIEW = lambda x, n: f"CASE WHEN length({S.trim(S.squeeze(x))}) <= {n} THEN {S.trim(S.squeeze(x))} ELSE substr({S.trim(S.squeeze(x))}, 1, {n - 3}) || '...' END"


@query(
    f"""WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE {S.kind('text')} = 'selected-text'),
p AS (SELECT doc_id, len(l) AS n, list_filter(list_transform(l, lambda x: {S.trim('x')}), lambda x: x <> '') AS bare FROM t)
SELECT doc_id, 'Selected text (' || n || ' lines): ' || {_PREVIEW("coalesce(bare[1], 'Selected text')", 120)} || '.' AS summary FROM p"""
)
def selection_summaries(spark, sf_dir):
    """C9 for plain text."""
    d = select.summaries(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.where("kind = 'selected-text'").select("doc_id", "summary")


# --- diffs --------------------------------------------------------------------------------

_TYPE = S.case([(sql_test("path", p, "i"), f"'{t}'") for t, _, p in diff.FILE_TYPES], "'code'")
_RISK = S.case([(sql_test("path", p, "i"), f"'{r}'") for _, r, p in diff.FILE_TYPES], "'medium'")
_STATS = f"""
src AS ({D.DIFFS_SQL}), l AS (SELECT id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM src),
n AS (SELECT *, CASE WHEN starts_with(x, 'diff --git a/') THEN regexp_extract(x, '^diff --git a/(.+?) b/(.+)$', 2) WHEN regexp_matches(x, '^\\+\\+\\+ +b/(.+)$') THEN regexp_extract(x, '^\\+\\+\\+ +b/(.+)$', 1) END AS named FROM l),
c AS (SELECT *, last_value(named IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos) AS path FROM n),
s AS (SELECT id, path, min(pos) AS first_pos, count(*) FILTER (named IS NULL AND starts_with(x, '@@ ')) AS hunks,
  count(*) FILTER (named IS NULL AND x[1] = '+' AND x[1:3] <> '+++') AS additions, count(*) FILTER (named IS NULL AND x[1] = '-' AND x[1:3] <> '---') AS deletions FROM c GROUP BY id, path)"""


@query(f"WITH {_STATS} SELECT id, path, hunks, additions, deletions, {_TYPE} AS type, {_RISK} AS risk FROM s")
def diff_file_stats(spark, sf_dir):
    """A1, P9, W4, D12."""
    return diff.file_stats(D.diffs(spark, sf_dir), "id").drop("first_pos")


@query(
    f"""WITH {_STATS}, r AS (SELECT *, CASE {_RISK} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS rank, {_TYPE} AS type FROM s),
ty AS (SELECT id, type, count(*) AS n, max(rank) AS rank, min(first_pos) AS fp FROM r GROUP BY id, type),
tr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank DESC, n DESC, fp) AS k FROM ty),
tt AS (SELECT id, max(rank) AS top, string_agg(type || '=' || ['low', 'medium', 'high'][rank], ', ' ORDER BY k) FILTER (k <= 2) AS by_type FROM tr GROUP BY id),
hr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank DESC, additions + deletions DESC, first_pos) AS k FROM r),
h AS (SELECT id, count(*) AS files, sum(hunks)::bigint AS hunks, sum(additions)::bigint AS additions, sum(deletions)::bigint AS deletions, string_agg(path, '|' ORDER BY k) FILTER (k <= 3) AS hotspots FROM hr GROUP BY id)
SELECT id, files, greatest(hunks, 1) AS hunks, additions, deletions, ['low', 'medium', 'high'][top] AS risk, by_type, hotspots FROM h JOIN tt USING (id)"""
)
def diff_risk_summary(spark, sf_dir):
    """A2, A3, C10."""
    d = diff.with_summary(D.diffs(spark, sf_dir))
    return d.select("id", F.col("files").cast("long").alias("files"), F.col("hunks").cast("long").alias("hunks"), F.col("additions").cast("long").alias("additions"), F.col("deletions").cast("long").alias("deletions"), "risk", "by_type", F.array_join("hotspots", "|").alias("hotspots"))


@query(
    f"""WITH src AS ({D.DIFFS_SQL}), l AS (SELECT id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM src),
s AS (SELECT *, sum(starts_with(x, 'diff --git')::int) OVER (PARTITION BY id ORDER BY pos) AS sec FROM l),
p AS (SELECT *, first_value(regexp_extract(x, '^diff --git a/(.+?) b/(.+)$', 2)) OVER (PARTITION BY id, sec ORDER BY pos) AS path FROM s),
q AS (SELECT *, {sql_test('path', *diff.NOISE_FILE)} AS noise, (x[1] = '+' AND x[1:3] <> '+++') OR (x[1] = '-' AND x[1:3] <> '---') AS changed FROM p),
o AS (SELECT id, sec, CASE WHEN any_value(noise) THEN min(x) FILTER (starts_with(x, 'diff --git')) || chr(10) || '  (' || any_value(path) || ': ' || count(*) FILTER (changed) || ' changed line(s) omitted — lock/generated/binary file)'
  ELSE string_agg(x, chr(10) ORDER BY pos) FILTER (starts_with(x, 'diff --git') OR starts_with(x, '@@') OR starts_with(x, '+') OR starts_with(x, '-') OR {sql_test('x', *diff.FILE_META)}) END AS body FROM q GROUP BY id, sec),
j AS (SELECT id, string_agg(body, chr(10) ORDER BY sec) AS output FROM o GROUP BY id)
SELECT id, output, {S.tokens('text')} AS before_tokens, {S.tokens('output')} AS after_tokens, {S.ratio(S.tokens('text'), S.tokens('output'))} AS ratio FROM j JOIN src USING (id)"""
)
def diff_compress(spark, sf_dir):
    """C5."""
    return diff.compress(D.diffs(spark, sf_dir)).drop("text")


# --- JSON ---------------------------------------------------------------------------------


@query("SELECT event_id, '{\"k\":' || json_extract(props, '$.k') || '}' AS output, NULL::varchar AS error FROM events")
def json_compress(spark, sf_dir):
    """C2 over event payloads."""
    return structured.compress(table(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", "output", "error")


@query("SELECT event_id, 'k: ' || json_extract(props, '$.k') AS paths FROM events")
def json_paths(spark, sf_dir):
    """C12d: flattened payloads."""
    return table(spark, sf_dir, "events").select("event_id", F.array_join(structured.flat_paths(F.col("props")), "\n").alias("paths"))


# --- prompts ------------------------------------------------------------------------------


@query(f"WITH s AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations), {S.cache_ctes('s')} SELECT conv_id, turn, score, prefix AS stable_prefix_ratio, density AS volatility_density, earliest::int AS earliest_volatile_index FROM cached")
def cache_scores(spark, sf_dir):
    """P14, P15 over all turns."""
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return prompt.with_cache(d, "text").select("conv_id", "turn", "cache.*")


@query(f"WITH s AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {S.cache_ctes('s')} SELECT score, count(*) AS docs, count(*) FILTER (earliest >= 0) AS volatile FROM cached GROUP BY score")
def cache_scores_documents(spark, sf_dir):
    """P14, P15 over documents (dates, numbers, hex)."""
    d = prompt.with_cache(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("text"), "text")
    return d.groupBy(F.col("cache.score").alias("score")).agg(F.count("*").alias("docs"), F.count_if(F.col("cache.earliest_volatile_index") >= 0).alias("volatile"))


@query(f"WITH s AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user'), {S.cache_ctes('s')} SELECT conv_id, turn, array_to_string({S.warnings()}, '|') AS warnings FROM cached")
def prompt_warnings(spark, sf_dir):
    """P16, P17 over user turns."""
    d = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return prompt.with_warnings(prompt.with_cache(d, "text"), "text").select("conv_id", "turn", F.array_join("warnings", "|").alias("warnings"))


_SHAPE = S.case(
    [
        (sql_any("text", prompt.BREVITY_SENSITIVE), sql_string(prompt.SHAPES["complete"])),
        (sql_test("text", r"\breview\b", "i"), sql_string(prompt.SHAPES["review"])),
        (sql_test("text", r"\bexplain\b", "i"), sql_string(prompt.SHAPES["explain"])),
        (sql_test("text", r"\b(fix|implement|update|change|refactor)\b", "i"), sql_string(prompt.SHAPES["change"])),
        (f"{S.trim('text')} <> '' AND (ends_with({S.trim('text')}, '?') OR {sql_any(S.trim('text'), prompt.PLAIN_QUESTION)})", sql_string(prompt.SHAPES["question"])),
    ],
    "NULL",
)


@query(f"SELECT conv_id, turn, {sql_any('text', prompt.BREVITY_SENSITIVE)} AS sensitive, {_SHAPE} AS shape FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)")
def response_shapes(spark, sf_dir):
    """P10, P11, P13."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompt.is_brevity_sensitive(t).alias("sensitive"), prompt.response_shape(t).alias("shape"))


_H = "lower(coalesce(text, ''))"
_HITS = {name: " + ".join(f"{sql_test('h', p)}::int" for p, _ in rules) for rules, name in advisor.SIGNALS}
_REASONS = ", ".join(f"CASE WHEN {sql_test('h', p)} THEN {sql_string(name + ': ' + label)} END" for rules, name in advisor.SIGNALS for p, label in rules)


@query(
    f"""WITH t AS (SELECT conv_id, turn, {_H} AS h, length(coalesce(text, '')) AS n FROM conversations),
s AS (SELECT conv_id, turn, {_HITS['cheap/mechanical']} AS economy, {_HITS['needs reasoning']} + (n > 2000)::int AS premium, {_HITS['local transform']} AS loc, {_HITS['bulk/offline']} AS bat,
  list_filter([{_REASONS}, CASE WHEN n > 2000 THEN 'large selection (' || n || ' chars) to reason over' END], lambda x: x IS NOT NULL) AS reasons FROM t),
r AS (SELECT *, CASE WHEN premium > 0 AND premium >= economy THEN 'premium' WHEN economy > premium THEN 'economy' ELSE 'standard' END AS tier FROM s)
SELECT conv_id, turn, tier, CASE WHEN loc > 0 THEN 'local-transform' WHEN bat > 0 THEN 'batch-offline' WHEN tier = 'economy' THEN 'completion-or-base' WHEN tier = 'premium' THEN 'premium' ELSE 'auto' END AS routing,
  CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, '|') ELSE {sql_string(advisor.NO_SIGNAL)} END AS reasons, economy::int AS economy_score, premium::int AS premium_score FROM r"""
)
def task_tiers(spark, sf_dir):
    """P19, P20."""
    d = table(spark, sf_dir, "conversations").withColumn("a", advisor.classify_task(F.col("text"), F.length(F.coalesce("text", F.lit("")))))
    return d.select("conv_id", "turn", "a.tier", "a.routing", F.array_join("a.reasons", "|").alias("reasons"), "a.economy_score", "a.premium_score")


@query(
    f"WITH t AS (SELECT conv_id, turn, {_H} AS h FROM conversations) SELECT count(*) AS model_advice_runs, count(*) FILTER ({_HITS['local transform']} > 0) AS local_transform_opportunities FROM t"
)
def advice_counters(spark, sf_dir):
    """A17."""
    d = table(spark, sf_dir, "conversations").select(advisor.classify_task(F.col("text"))["routing"].alias("routing"))
    return runs.advice_counters(d)


@query(f"SELECT conv_id, turn, {S.fnv1a('text')} AS hash FROM conversations WHERE text IS NOT NULL")
def fnv_fingerprints(spark, sf_dir):
    """N12's hash over whole turns."""
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", prompt.fnv1a(F.col("text")).alias("hash"))


@query()
def prompt_skeletons(spark, sf_dir):
    """N1-N8, N12 over user turns."""
    d = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("prompt"))
    d = prompt.with_constraints(d, "prompt", "cleaned", "constraints")
    return prompt.with_skeleton(prompt.with_normalized(d, "cleaned", "goal"), "prompt").select("conv_id", "turn", "goal", "constraints", "skeleton_id")


@query()
def prompts_optimized(spark, sf_dir):
    """Whole prompts assembled, the previous answer as the selected text."""
    d = table(spark, sf_dir, "conversations")
    said = d.where("role = 'assistant'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("selection_text"))
    d = d.where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("prompt")).join(said, ["conv_id", "turn"], "left")
    d = d.withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    return prompt.optimize(d).select("id", "optimized_prompt", "before_tokens", "after_tokens", "ratio", "context_type", F.array_join("warnings", "|").alias("warnings"), "redactions")


_RUN_LEN = "greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda m: length(m))), 0))"


@query(f"SELECT page_id, repeat('`', {_RUN_LEN}) || 'html' || chr(10) || t || chr(10) || repeat('`', {_RUN_LEN}) AS fenced FROM (SELECT page_id, coalesce(html, '') AS t FROM pages)")
def fenced_pages(spark, sf_dir):
    """N15."""
    return table(spark, sf_dir, "pages").select("page_id", prompt.fence(F.coalesce("html", F.lit("")), F.lit("html")).alias("fenced"))


# --- run analytics ------------------------------------------------------------------------

_RUNS = S.runs()
#: Documents, of which many are copies, as user turns: prompts that recur.
_PROMPT_RUNS = S.runs("(SELECT doc_id // 10 AS conv_id, doc_id % 10 AS turn, 'user' AS role, text FROM documents)")
_SAYS = lambda what: f"len(list_filter(warnings, lambda w: contains(lower(w), {sql_string(what.lower())})))"
_SK = "SELECT skeleton_id, count(*) AS n FROM runs WHERE grp = 'prompt' GROUP BY skeleton_id"
_PART = lambda g, c: f"coalesce(sum({c}) FILTER (grp = '{g}'), 0)::bigint"
_COUNTERS = f"""count(*) FILTER (grp = 'prompt') AS prompt_runs, count(*) FILTER (grp = 'selection') AS selection_runs,
  sum(before_tokens)::bigint AS total_before_tokens, sum(after_tokens)::bigint AS total_after_tokens,
  {_PART('selection', 'before_tokens')} AS selection_before_tokens, {_PART('selection', 'after_tokens')} AS selection_after_tokens,
  {_PART('prompt', 'before_tokens')} AS prompt_before_tokens, {_PART('prompt', 'after_tokens')} AS prompt_after_tokens,
  sum(len(warnings))::bigint AS total_warnings, 0::bigint AS redactions_total, {', '.join(f'sum({_SAYS(w)})::bigint AS {n}' for n, w in runs.WARNING_CLASSES.items())},
  arg_max(context_type, seq) AS last_context_type"""


def _run_events(spark, sf_dir):
    return runs.runs_from_conversations(table(spark, sf_dir, "conversations"))


def _prompt_events(spark, sf_dir):
    turns = table(spark, sf_dir, "documents").select(F.expr("doc_id div 10").alias("conv_id"), (F.col("doc_id") % 10).alias("turn"), F.lit("user").alias("role"), "text")
    return runs.runs_from_conversations(turns)


@query(f"WITH {_RUNS}, k AS ({_SK}) SELECT {_COUNTERS}, (SELECT coalesce(sum(n - 1), 0)::bigint FROM k) AS repeated_prompt_skeletons, (SELECT count(*) FROM k) AS unique_prompt_skeletons FROM runs")
def run_stats(spark, sf_dir):
    """A4."""
    return runs.run_stats(_run_events(spark, sf_dir))


@query(f"WITH {_RUNS}, c AS (SELECT unnest({runs.COMMANDS}) AS command_key) SELECT command_key, count(r.seq) AS runs FROM c LEFT JOIN runs r USING (command_key) GROUP BY command_key")
def command_runs(spark, sf_dir):
    """A5."""
    return runs.command_runs(_run_events(spark, sf_dir))


_PCT = lambda a, b: f"(CASE WHEN {b} > 0 THEN floor({a}::double / {b} * 100 + 0.5) ELSE 0 END)::bigint"


@query(
    f"""WITH {_RUNS}, s AS (SELECT {_COUNTERS}, count(*) AS total_runs FROM runs)
SELECT total_before_tokens AS before, total_after_tokens AS after, total_before_tokens - total_after_tokens AS saved, {_PCT('(total_before_tokens - total_after_tokens)', 'total_before_tokens')} AS saved_pct,
 selection_before_tokens - selection_after_tokens AS compression_saved, {_PCT('(selection_before_tokens - selection_after_tokens)', 'selection_before_tokens')} AS compression_pct,
 {S.fixed_2('((total_before_tokens - total_after_tokens) / 1000000.0::double * 10.0::double)')} AS cost_saved_usd, redactions_total AS secret_redactions, total_runs FROM s"""
)
def audit_evidence(spark, sf_dir):
    """A6."""
    return runs.evidence(runs.run_stats(_run_events(spark, sf_dir)), F.col("prompt_runs") + F.col("selection_runs"), rate=10.0)


@query(
    f"""WITH {_RUNS}, s AS (SELECT {_COUNTERS}, count(*) FILTER (command_key = 'reviewDiff') AS reviews FROM runs)
SELECT total_before_tokens - total_after_tokens AS net_saved, {_PCT('abs(total_before_tokens - total_after_tokens)', 'total_before_tokens')} AS saved_pct,
 {_PCT('(selection_before_tokens - selection_after_tokens)', 'selection_before_tokens')} AS compression_pct, prompt_before_tokens - prompt_after_tokens AS prompt_delta, {_PCT('reviews', 'selection_runs')} AS review_preflight_share FROM s"""
)
def stats_report_metrics(spark, sf_dir):
    """A7."""
    e = _run_events(spark, sf_dir)
    reviews = runs.command_runs(e).where("command_key = 'reviewDiff'").select(F.col("runs").alias("reviews"))
    return runs.stats_metrics(runs.run_stats(e).crossJoin(F.broadcast(reviews)), F.col("reviews"))  # one row by one row


@query(f"WITH {_PROMPT_RUNS} {_SK} HAVING count(*) > 1 ORDER BY n DESC, skeleton_id LIMIT {runs.TOP_SKELETONS}")
def recurring_skeletons(spark, sf_dir):
    """A top-5 report."""
    return runs.recurring(_prompt_events(spark, sf_dir))


@query(f"WITH {_PROMPT_RUNS} SELECT seq, skeleton_id, running FROM (SELECT seq, skeleton_id, count(*) OVER (PARTITION BY skeleton_id ORDER BY seq) AS running FROM runs WHERE grp = 'prompt') WHERE running >= 3")
def recurrence_nudges(spark, sf_dir):
    """W11."""
    return runs.nudges(_prompt_events(spark, sf_dir))


_ACTION_LIST = ", ".join(f"CASE WHEN {_SAYS(w)} > 0 THEN {sql_string(a)} END" for w, a in runs.ACTIONS)


@query(f"WITH {_RUNS} SELECT seq, array_to_string(list_filter([{_ACTION_LIST}], lambda a: a IS NOT NULL), chr(10)) AS actions FROM runs")
def warning_actions(spark, sf_dir):
    """A14."""
    return _run_events(spark, sf_dir).select("seq", F.array_join(runs.warning_actions(F.col("warnings")), "\n").alias("actions"))


@query(
    f"""WITH {_RUNS}, d AS (SELECT seq, before_tokens - after_tokens AS d FROM runs)
SELECT seq, CASE WHEN d > 0 THEN 'saved ~' || format('{{:,}}', d) || ' tokens' WHEN d < 0 THEN 'added ~' || format('{{:,}}', -d) || ' tokens' ELSE 'no token change' END AS delta FROM d"""
)
def token_deltas(spark, sf_dir):
    """Report lines of single runs (section 2.10)."""
    return _run_events(spark, sf_dir).select("seq", runs.format_delta(F.col("before_tokens"), F.col("after_tokens")).alias("delta"))


_TOP = "SELECT skeleton_id, count(*) AS n FROM runs WHERE grp = 'prompt' GROUP BY skeleton_id HAVING count(*) > 1 ORDER BY n DESC, skeleton_id LIMIT 5"


@query(f"WITH {_PROMPT_RUNS}, k AS ({_SK}), c AS (SELECT {_COUNTERS} FROM runs) SELECT total_warnings, {', '.join(runs.WARNING_CLASSES)}, (SELECT coalesce(sum(n - 1), 0)::bigint FROM k) AS repeated_prompt_skeletons, (SELECT coalesce(string_agg(skeleton_id, ',' ORDER BY n DESC, skeleton_id), '') FROM ({_TOP})) AS top_skeletons FROM c")
def coaching_snapshot(spark, sf_dir):
    """A16."""
    return runs.coaching(_prompt_events(spark, sf_dir)).withColumn("top_skeletons", F.array_join("top_skeletons", ","))


@query(
    f"""WITH {_RUNS}, s AS (SELECT {_COUNTERS} FROM runs) SELECT 'Prompt runs' AS metric, prompt_runs::varchar AS value FROM s UNION ALL SELECT 'Selection runs', selection_runs::varchar FROM s
UNION ALL SELECT 'Compression saved', format('{{:,}}', selection_before_tokens - selection_after_tokens) FROM s UNION ALL SELECT 'Warnings', total_warnings::varchar FROM s UNION ALL SELECT 'Last context type', last_context_type FROM s"""
)
def stats_report(spark, sf_dir):
    """Section 2.10: five lines of the usage report."""
    wanted = ["Prompt runs", "Selection runs", "Compression saved", "Warnings", "Last context type"]
    return reports.stats_report(_run_events(spark, sf_dir)).where(F.col("metric").isin(wanted)).select("metric", "value")


@query()
def evidence_report(spark, sf_dir):
    """Section 2.10: the audit record as markdown."""
    return reports.markdown(reports.evidence_report(_run_events(spark, sf_dir), 10.0), "Audit evidence")


@query(f"SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(t, '[?]') THEN 'question' END, CASE WHEN regexp_matches(t, '[0-9]') THEN 'digits' END], lambda x: x IS NOT NULL), ',') AS rules FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)")
def rule_table_matches(spark, sf_dir):
    """Turns by a rule table."""
    table_ = rows(spark, "id string, pattern string", [("question", "[?]"), ("digits", "[0-9]")])
    d = evals.rule_matches(table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit(""))), table_)
    sort = F.array_join(F.reverse(F.array_sort("rules")), ",")
    return d.select("conv_id", "turn", sort.alias("rules"))


@query()
def agent_compressions(spark, sf_dir):
    """N19, K10 over all turns."""
    d = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text", F.lit(None).cast("string").alias("filename"))
    return reports.agent_compress(d).select("doc_id", "output", "note", "protection")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'full' ELSE 'lite' END AS level FROM conversations")
def concise_levels(spark, sf_dir):
    """User turns ask for a retired level, others for a light one."""
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("prompt"), F.when(F.col("role") == "user", "ultra").otherwise("lite").alias("level"))
    return reports.concise_request(d).select("conv_id", "turn", "level")


# --- readiness ----------------------------------------------------------------------------

_SIGNAL_SQL = f"""
w AS ({D.WORKSPACES_SQL}),
g AS (SELECT name, unnest([
  {{'ord': 0, 'signal_id': 'repoInstructions', 'weight': 20, 'status': CASE WHEN NOT has_repo_instructions THEN 'missing' WHEN instructions_bloated THEN 'warn' ELSE 'pass' END}},
  {{'ord': 1, 'signal_id': 'pathInstructions', 'weight': 10, 'status': CASE WHEN path_instruction_count > 0 THEN 'pass' ELSE 'warn' END}},
  {{'ord': 2, 'signal_id': 'agentsPolicy', 'weight': 15, 'status': CASE WHEN NOT has_agents THEN 'missing' WHEN agents_unscoped > 0 THEN 'warn' ELSE 'pass' END}},
  {{'ord': 3, 'signal_id': 'contentExclusion', 'weight': 15, 'status': CASE WHEN has_exclusion THEN 'pass' ELSE 'missing' END}},
  {{'ord': 4, 'signal_id': 'copilotIgnore', 'weight': 5, 'status': CASE WHEN has_ignore THEN 'pass' ELSE 'warn' END}},
  {{'ord': 5, 'signal_id': 'mcpConfig', 'weight': 15, 'status': CASE WHEN has_mcp AND mcp_servers > 0 AND mcp_allow = mcp_servers AND mcp_defer = mcp_servers THEN 'pass' ELSE 'warn' END}},
  {{'ord': 6, 'signal_id': 'devcontainer', 'weight': 10, 'status': CASE WHEN has_devcontainer THEN 'pass' ELSE 'warn' END}},
  {{'ord': 7, 'signal_id': 'contextFreshness', 'weight': 10, 'status': CASE WHEN age IS NULL OR age > 180 THEN 'missing' WHEN age <= 90 THEN 'pass' ELSE 'warn' END}}], recursive := true) FROM w),
e AS (SELECT *, CASE status WHEN 'pass' THEN weight WHEN 'warn' THEN floor(weight / 2.0 + 0.5)::int ELSE 0 END AS earned FROM g)"""
_VERDICT = "CASE WHEN score >= 80 THEN 'Ready' WHEN score >= 50 THEN 'Needs attention' ELSE 'Incomplete' END"


@query(f"WITH {_SIGNAL_SQL}, s AS (SELECT name, sum(earned)::bigint AS score, sum(weight)::bigint AS max_score FROM e GROUP BY name) SELECT *, {_VERDICT} AS verdict FROM s")
def readiness_scores(spark, sf_dir):
    """A8, P23-P26, P32."""
    return readiness.scores(readiness.signals(D.workspaces(spark, sf_dir)))


@query(f"WITH {_SIGNAL_SQL} SELECT name, signal_id, status, earned, weight, weight - earned AS to_close FROM e WHERE status <> 'pass'")
def readiness_gaps(spark, sf_dir):
    """W8, A15."""
    return readiness.gaps(readiness.signals(D.workspaces(spark, sf_dir))).drop("ord", "label")


@query(
    f"""WITH {_SIGNAL_SQL}, s AS (SELECT name, sum(earned) AS score, sum(weight) AS max_score FROM e GROUP BY name), v AS (SELECT *, {_VERDICT} AS verdict FROM s)
SELECT CASE WHEN bool_and(verdict = 'Ready') THEN 'Ready' WHEN bool_or(verdict = 'Incomplete') THEN 'Incomplete' ELSE 'Needs attention' END AS verdict, floor(avg(score) + 0.5)::bigint AS score, floor(avg(max_score) + 0.5)::bigint AS max_score, count(*) AS workspaces,
(SELECT signal_id FROM e WHERE status <> 'pass' ORDER BY weight - earned DESC, name, ord LIMIT 1) AS top_gap_id, (SELECT max(weight - earned) FROM e WHERE status <> 'pass') AS top_gap_points FROM v"""
)
def readiness_overall(spark, sf_dir):
    """A9."""
    o = readiness.overall(readiness.signals(D.workspaces(spark, sf_dir)))
    ids = F.create_map(*[F.lit(x) for i, label, _ in readiness.SIGNALS for x in (label, i)])
    return o.withColumn("top_gap_id", F.element_at(ids, F.col("top_gap"))).drop("top_gap")


# --- evaluation ---------------------------------------------------------------------------

_ARMS = ["assistant", "user"]
_OUTPUTS = "SELECT role AS arm, conv_id AS prompt_idx, arg_min(text, turn) AS output FROM conversations WHERE role IN ('assistant', 'user') GROUP BY role, conv_id"


def _outputs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role IN ('assistant', 'user')")
    return c.groupBy(F.col("role").alias("arm"), F.col("conv_id").alias("prompt_idx")).agg(F.min_by("text", "turn").alias("output"))


_WIDE = f"""o AS ({_OUTPUTS}), t AS (SELECT arm, prompt_idx, CASE WHEN output <> '' AND NOT starts_with(output, '__ERROR__') THEN {S.tokens('output')} END AS tokens FROM o),
w AS (SELECT prompt_idx, max(tokens) FILTER (arm = 'assistant') AS a, max(tokens) FILTER (arm = 'user') AS u FROM t GROUP BY prompt_idx HAVING a > 0 AND u > 0)"""


@query(f"WITH {_WIDE} SELECT 'assistant' AS arm, floor(avg(a) + 0.5)::bigint AS mean_tokens FROM w UNION ALL SELECT 'user', floor(avg(u) + 0.5)::bigint FROM w")
def arm_means(spark, sf_dir):
    """A12."""
    return evals.arm_means(_outputs(spark, sf_dir), _ARMS)


@query(f"WITH {_WIDE}, r AS (SELECT 1 - u::double / a AS r FROM w) SELECT 'user' AS arm, 'assistant' AS versus, count(*) AS prompts, round(median(r), 9) AS median, round(avg(r), 9) AS mean, round(min(r), 9) AS least, round(max(r), 9) AS greatest FROM r")
def arm_reductions(spark, sf_dir):
    """A12, J7."""
    d = evals.reductions(_outputs(spark, sf_dir), _ARMS, "user", "assistant")
    return d.select("arm", "versus", "prompts", *[F.round(c, 9).alias(c) for c in ("median", "mean", "least", "greatest")])


@query(
    f"""WITH o AS ({_OUTPUTS}), j AS (SELECT a.arm, p.prompt_idx FROM (SELECT DISTINCT conv_id AS prompt_idx FROM conversations) p, (SELECT unnest(['assistant', 'user']) AS arm) a)
SELECT j.arm, j.prompt_idx, coalesce(o.output, '') AS output FROM j LEFT JOIN o USING (arm, prompt_idx)"""
)
def arm_matrix(spark, sf_dir):
    """A18, J8."""
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("prompt_idx")).distinct()
    return evals.arm_matrix(_outputs(spark, sf_dir), p, rows(spark, "arm string", [(a,) for a in _ARMS]))


@query(
    f"""WITH d AS (SELECT lang, {S.tokens('text')} AS eb, len(string_split(text, ' ')) AS rb, {S.tokens(S.trim(S.squeeze('text')))} AS ea, len(string_split({S.trim(S.squeeze('text'))}, ' ')) AS ra FROM documents WHERE text IS NOT NULL),
r AS (SELECT abs((eb - rb)::double / rb * 100) AS e, abs((CASE WHEN eb > 0 THEN (1 - ea::double / eb) * 100 ELSE 0 END) - (1 - ra::double / rb) * 100) AS b FROM d)
SELECT 'est_err_pct' AS metric, round(avg(e), 6) AS mean, round(median(e), 6) AS median, round(max(e), 6) AS greatest FROM r UNION ALL SELECT 'ratio_bias_pp', round(avg(b), 6), round(median(b), 6), round(max(b), 6) FROM r"""
)
def calibration(spark, sf_dir):
    """A13, with space-separated words as the real counts."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    words = lambda c: F.size(F.split(c, " ", -1)).cast("long")
    short = T.trim(T.squeeze(F.col("text")))
    d = d.select(F.col("doc_id").alias("name"), T.estimate_tokens("text").alias("est_before"), words(F.col("text")).alias("real_before"), T.estimate_tokens(short).alias("est_after"), words(short).alias("real_after"))
    s = evals.calibration_summary(evals.calibration(d))
    return s.select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "median", "greatest")])


_GROUPS = [["idiot", "moron", "scum"], ["the", "der", "le", "el"], ["worthless"]]
_GROUP_SQL = ", ".join(f"CASE WHEN NOT ({' OR '.join(f'contains(o, {sql_string(a)})' for a in g)}) THEN {sql_string(' | '.join(g))} END" for g in _GROUPS)


@query(f"SELECT doc_id, array_to_string(list_filter([{_GROUP_SQL}], lambda x: x IS NOT NULL), '; ') AS missing FROM (SELECT doc_id, lower(coalesce(text, '')) AS o FROM documents)")
def quality_gate(spark, sf_dir):
    """J10."""
    groups = F.array(*[F.array(*map(F.lit, g)) for g in _GROUPS])
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(evals.missing_requirements(F.col("text"), groups), "; ").alias("missing"))


@query(
    """WITH p AS (SELECT DISTINCT doc_id::varchar AS id FROM documents),
a AS (SELECT doc_id::varchar AS id, unnest(['baseline', 'concise']) AS variant, unnest([CASE quality WHEN 1 THEN 'good' ELSE ' ' END, CASE toxic WHEN 1 THEN 'bad' ELSE '' END]) AS output FROM labels)
SELECT id, 'Missing snapshot result for prompt ''' || id || '''.' AS error FROM p WHERE id NOT IN (SELECT id FROM a)
UNION ALL SELECT a.id, 'Missing output for variant ''' || variant || ''' in prompt ''' || a.id || '''.' FROM a JOIN p USING (id) WHERE trim(output) = ''
UNION ALL SELECT DISTINCT a.id, 'Missing variant ''directDefault'' for prompt ''' || a.id || '''.' FROM a JOIN p USING (id)"""
)
def coverage_errors(spark, sf_dir):
    """Documents as prompts, labels as answers of two variants."""
    p = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id")).distinct()
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality", "toxic")
    one = lab.select("id", F.lit("baseline").alias("variant"), F.when(F.col("quality") == 1, "good").otherwise(" ").alias("output"))
    two = lab.select("id", F.lit("concise").alias("variant"), F.when(F.col("toxic") == 1, "bad").otherwise("").alias("output"))
    return evals.coverage_errors(p, one.unionByName(two))


@query("SELECT lang, count(*) AS unlabelled FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY lang")
def additive_writes(spark, sf_dir):
    """What isn't there yet, by language."""
    planned = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "lang")
    present = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path"))
    return evals.to_write(planned, present).groupBy("lang").agg(F.count("*").alias("unlabelled"))


@query(
    """SELECT state, count(*) AS files FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extraneous' WHEN d.doc_id % 2 <> l.quality THEN 'stale' END AS state
FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN labels l USING (doc_id)) WHERE state IS NOT NULL GROUP BY state"""
)
def generated_drift(spark, sf_dir):
    """J9."""
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") % 2).cast("string").alias("content")).distinct()
    b = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path"), F.col("quality").cast("string").alias("content"))
    return evals.drift(a, b).groupBy("state").agg(F.count("*").alias("files"))


# --- small literal inputs: expectations stated, not computed --------------------------------

_NAMES = ["a.ts", "b.spec.ts", "c.md", "log.txt", "x.JSON", "Makefile", "e.tar.py", "f.unknown", "g.feature", "h.tsx"]
_NAME_ROWS = [
    ("a.ts", "code", "ts", "[TypeScript]"), ("b.spec.ts", "code", "ts", "[Playwright/TypeScript]"), ("c.md", "instructions", "unknown", None), ("log.txt", "output", "unknown", None),
    ("x.JSON", "json", "unknown", None), ("Makefile", "unknown", "unknown", None), ("e.tar.py", "code", "py", "[Python]"), ("f.unknown", "unknown", "unknown", None),
    ("g.feature", "unknown", "unknown", "[Gherkin/Cucumber]"), ("h.tsx", "code", "tsx", "[React/TypeScript]"),
]


@query("WITH " + S.values("v", ["filename", "mode", "language", "tag"], _NAME_ROWS) + " SELECT filename, mode, language, tag::varchar AS tag FROM v")
def filename_rules(spark, sf_dir):
    """P3, P5, P6."""
    f = F.col("filename")
    return rows(spark, "filename string", [(n,) for n in _NAMES]).select("filename", select.mode_of(f).alias("mode"), code.language(f).alias("language"), prompt.language_tag(f).alias("tag"))


_CODE_ROWS = [
    ("module.js", "/** This is docs */\n/* one-line block */\nexport const ready = true;", "export const ready = true;"),
    ("sample.js", "\n\nconst a = 1;  \n\n\n\nconst b = 2;   \n\n", "const a = 1;\n\nconst b = 2;"),
    ("tool.py", "#!/usr/bin/env python3\n# module comment\nprint('ok')\n# tail comment", "#!/usr/bin/env python3\nprint('ok')"),
    ("script.sh", "#!/usr/bin/env bash\n# setup comment\necho ok", "#!/usr/bin/env bash\necho ok"),
    ("sample.ts", "// banner\nconst a = 1; // keep inline comment\n/* block start\nblock middle\nblock end */\n\nconst b = 2;\n", "const a = 1; // keep inline comment\n\nconst b = 2;"),
    ("notes.md", "// unknown comment style should remain\ncontent   \n", "// unknown comment style should remain\ncontent"),
]


@query("WITH " + S.values("v", ["filename", "text", "output"], _CODE_ROWS) + " SELECT filename, output FROM v")
def code_comments(spark, sf_dir):
    """C3."""
    return code.compress(rows(spark, "filename string, text string", [r[:2] for r in _CODE_ROWS])).select("filename", "output")


_PROMPT_ROWS = [
    ("please fixing the login flow", "Fix the login flow.", None),
    ("fix src/auth.spec.ts now", "Fix src/auth.spec.ts now.", "src/auth.spec.ts"),
    ("hey there! could you basically update the readme, thanks so much", "Could you update the readme.", None),
]


@query("WITH " + S.values("v", ["prompt", "goal", "path"], _PROMPT_ROWS) + " SELECT prompt, goal, path FROM v")
def prompt_goals(spark, sf_dir):
    """N1, N2, N8."""
    d = rows(spark, "prompt string", [(r[0],) for r in _PROMPT_ROWS])
    return prompt.with_normalized(d, "prompt", "goal").withColumn("path", prompt.inline_path(F.col("prompt")))


_MCP = '{\n // servers\n "servers": { "github": {"allowed_tools": ["a"], "defer_loading": true}, /* x */ "playwright": {"allowed_tools": ["b"],}, }, }'


@query("SELECT 2 AS server_count, 2 AS allowlist_count, 1 AS deferred_count, 'github,playwright' AS names, ' To fix: playwright (needs defer_loading).' AS gaps")
def tool_server_summary(spark, sf_dir):
    """A11, P31."""
    d = rows(spark, "config string", [(_MCP,)]).select(readiness.tool_servers(F.col("config")).alias("s"))
    return d.select("s.server_count", "s.allowlist_count", "s.deferred_count", F.array_join("s.names", ",").alias("names"), readiness.server_gaps(F.col("s.gaps")).alias("gaps"))


_AGENTS = [("a", "---\ntools: [x]\ndescription: d\n---\nbody"), ("b", "---\ntools: [x]\n---\n"), ("c", "no front matter"), ("d", "---\r\ndescription: d\r\n---\r\nx")]


@query("SELECT 4 AS total, 2 AS unscoped, 2 AS undescribed")
def agent_definitions(spark, sf_dir):
    """A10, P22."""
    return readiness.agent_definitions(rows(spark, "name string, text string", _AGENTS))


@query(
    f"SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split_regex(text, '\\r?\\n')) END AS line_count, {' + '.join(f'{sql_test(chr(116)+chr(101)+chr(120)+chr(116), p, chr(105))}::int' for p in readiness.BROAD_DIRECTIVES)} AS broad_scope_hits FROM documents WHERE text IS NOT NULL"
)
def instruction_hygiene(spark, sf_dir):
    """P21."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", readiness.instruction_hygiene(F.col("text")).alias("h"))
    return d.select("doc_id", "h.line_count", "h.broad_scope_hits")


_HOOKS = [("", None, "fresh", True), (".husky", None, "conflict-hookspath", False), (".git/hooks", "x textloom-hook y", "already", True), (None, "other", "conflict-custom", False), (".textloom/hooks", None, "fresh", True)]


@query("WITH " + S.values("v", ["hooks_path", "existing", "action", "write_hook"], _HOOKS) + " SELECT coalesce(hooks_path, '-') AS hooks_path, action, write_hook FROM v")
def hook_plans(spark, sf_dir):
    """P27."""
    d = rows(spark, "hooks_path string, existing string", [h[:2] for h in _HOOKS]).withColumn("p", readiness.hook_plan(F.col("hooks_path"), F.col("existing")))
    return d.select(F.coalesce("hooks_path", F.lit("-")).alias("hooks_path"), "p.action", "p.write_hook")


_SAVED = [("AGENTS.md", True), (".vscode\\mcp.json", True), (".github/agents/x.agent.md", True), (".claude/agents/y.md", True), ("src/a.ts", False), (".github/agents/x.md", False)]


@query("WITH " + S.values("v", ["path", "matters"], _SAVED) + " SELECT path, matters FROM v")
def readiness_paths(spark, sf_dir):
    """P28."""
    return rows(spark, "path string", [(p,) for p, _ in _SAVED]).select("path", readiness.matters_for_readiness(F.col("path")).alias("matters"))


_LINKS = [("/d/a.md", "see [b](b.md) [c](../x/c.md#top) [w](https://e.org/q.md) [h](#here) [t](gone.md \"T\")"), ("/d/b.md", "[a](./a.md) [e](sub%20dir/e.md)"), ("/x/c.md", "[up](../d/nope.md)")]


@query("SELECT * FROM (VALUES ('/d/a.md', '/d/gone.md'), ('/d/b.md', '/d/sub dir/e.md'), ('/x/c.md', '/d/nope.md')) t(path, target)")
def broken_links(spark, sf_dir):
    """J3."""
    return evals.broken_links(rows(spark, "path string, text string", _LINKS)).select("path", "target")


_EDITOR = [("file", False, "/w/src/a.ts", "/w", "src/a.ts"), ("file", False, "/other/b.ts", None, "b.ts"), ("untitled", True, "U", "/w", None), ("git", False, "/w/c", "/w", None)]


@query("WITH " + S.values("v", ["scheme", "untitled", "file", "folder", "path"], _EDITOR) + " SELECT file, path FROM v")
def editor_paths(spark, sf_dir):
    """S13."""
    d = rows(spark, "scheme string, untitled boolean, file string, folder string", [e[:4] for e in _EDITOR])
    return d.select("file", files.workspace_path(F.col("scheme"), F.col("untitled"), F.col("file"), F.col("folder")).alias("path"))


@query("SELECT conv_id, CASE WHEN trim(coalesce(s, '')) <> '' THEN s ELSE coalesce(r, '') END AS context FROM (SELECT conv_id, max(text) FILTER (role = 'system') AS s, arg_min(text, turn) FILTER (role = 'assistant' AND trim(text) <> '') AS r FROM conversations GROUP BY conv_id)")
def editor_contexts(spark, sf_dir):
    """The system turn as the selection, answers as references."""
    c = table(spark, sf_dir, "conversations")
    refs = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", F.concat(F.lit("file:"), F.col("turn").cast("string")).alias("id"), F.lit(None).cast("string").alias("range"), "text")))), lambda r: r)
    g = c.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "system", F.col("text"))).alias("s"), refs.alias("r"))
    return g.select("conv_id", files.editor_context(F.col("s"), files.intentional_references(F.col("r"))).alias("context"))


# --- streams ------------------------------------------------------------------------------


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def joined_chunks(spark, sf_dir):
    """T6."""
    return streams.joined_chunks(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


_SESSIONS = """WITH e AS (SELECT user_id, ts, event_type, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
s AS (SELECT *, sum((p IS NULL OR ts - p >= INTERVAL 30 MINUTE)::int) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)"""


@query(f"{_SESSIONS} SELECT user_id, epoch_us(min(ts)) AS first_us, count(*) AS saves, arg_max(event_type, ts) AS path FROM s GROUP BY user_id, k")
def debounced_bursts(spark, sf_dir):
    """Bursts of a user's events, 30 minutes apart."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    d = streams.debounce(e, gap="30 minutes", key="user_id", path="event_type")
    return d.select("user_id", F.unix_micros("first_save").alias("first_us"), "saves", "path")


@query("SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_events(spark, sf_dir):
    """Extension: windowed counts."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.hourly(e).select(F.unix_micros("hour").alias("hour_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'signup') - INTERVAL 0 SECOND GROUP BY event_type")
def since_reset(spark, sf_dir):
    """T4: events after the last reset; a signup stands for one."""
    e = runs.since_reset(table(spark, sf_dir, "events"), reset="signup")
    return e.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type AS command_key, count(*) AS runs FROM events GROUP BY event_type")
def streamed_command_counts(spark, sf_dir):
    """The running counts, fed from the files as a stream and drained."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern, as a stream's source has to be a folder or a pattern
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/events.parque[t]")
    return _drained(spark, streams.command_counts(e.withColumnRenamed("event_type", "command_key")), "complete")


def _drained(spark, stream, mode):
    """Run a stream over what there is now; its result as a table in the shared folder."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or "/tmp/textloom-streams"
    path = f"{root.rstrip('/')}/streams/{uuid.uuid4().hex}"
    if mode == "complete":

        def keep(batch, _):
            batch.write.mode("overwrite").parquet(f"{path}/table")

        writer = stream.writeStream.outputMode("complete").foreachBatch(keep)
    else:
        writer = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/table")
    writer.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")
