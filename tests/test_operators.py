"""Operators against the worked examples and against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import regex
from textloom.functions import text as T
from textloom.operators import advisor, code, diff, evals, instructions, output, prompt, readiness, reports, runs, secrets, select, structured


def rows(spark, schema, data):
    return spark.createDataFrame(data, schema)


# --- text helpers -------------------------------------------------------------------------


def test_units_and_tokens(spark):
    got = rows(spark, "t string", [("a😀b",), ("",), ("abcde",), (None,)]).select(T.u16_length("t"), T.estimate_tokens("t")).collect()
    assert [tuple(r) for r in got] == [(4, 1), (0, 0), (5, 2), (None, None)]


def test_rounding(spark):
    got = rows(spark, "x double", [(-2.5,), (2.5,), (0.285,), (0.005,)]).select(T.js_round(F.col("x")), T.to_fixed_2(F.col("x"))).collect()
    assert [r[0] for r in got][:2] == [-2, 3]
    assert got[2][1] == pytest.approx(0.28)


def test_trim_knows_all_white_space(spark):
    got = rows(spark, "t string", [("\ufeff\u00a0 x \t\u2028",)]).select(T.trim(F.col("t")), T.squeeze(F.lit("a \u00a0\n b"))).first()
    assert tuple(got) == ("x", "a b")


def test_dialects():
    assert re.search(regex.py(r"\bcaf\b"), "cafés")  # ASCII words: é ends one
    assert not re.search(regex.py(r"a$"), "a\n")
    assert regex.re2(r"\s") != r"\s" and "(?<" not in regex.re2(r"\bx\b")


# --- output -------------------------------------------------------------------------------


def loop_output(text):
    """The line loop that the column expressions stand for."""
    keep = [re.compile(regex.py(p, f.replace("i", "")), re.I if "i" in f else 0) for p, f, _ in output.KEEP]
    strip = [re.compile(regex.py(p, f.replace("i", "")), re.I if "i" in f else 0) for p, f, _ in output.STRIP]
    space = code._JS_SPACE
    lines, kept, blanks, frames = [x.rstrip(space) for x in text.split("\n")], [], 0, 0
    for line in lines:
        if re.search(regex.py(output.FRAME[0]), line):
            frames += 1
            if frames <= 3 and not any(p.search(line) for p in strip):
                kept.append(line)
            continue
        frames = 0
        if line == "":
            blanks += 1
            if blanks == 1:
                kept.append("")
            continue
        blanks = 0
        if not any(p.search(line) for p in strip) and any(p.search(line) for p in keep):
            kept.append(line)
    if all(not x.strip(space) for x in kept):
        kept = lines
    seen, out = set(), []
    for line in kept:
        if not line.strip(space):
            out.append(line)
            continue
        shape = re.sub(r"[0-9]+", "#", re.sub(r"(?i)[0-9a-f]{8,}", "#", line))
        shape = " ".join(shape.split())
        if shape not in seen:
            seen.add(shape)
            out.append(line)
    while out and out[0] == "":
        out.pop(0)
    while out and out[-1] == "":
        out.pop()
    return "\n".join(out)


PIECES = ["", "", "  ", "  ✓ passes", "    at f (/a/b.ts:3:1)", "    at g (/a/b.ts:4:1)", "  at node (node:internal/x:1)", "Error: boom", "Expected: 5", "Expected: 6 ", "plain words", "  12) case", "3 failed, 4 passed", "Running 5 tests", "[ERROR] x", "deadbeefcafe 1 Error: x", "> 12 | code"]


def test_output_equals_a_loop(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 25))) for _ in range(400)]
    got = output.compress(rows(spark, "id long, text string", list(enumerate(texts)))).orderBy("id").collect()
    assert [r.output for r in got] == [loop_output(t) for t in texts]
    assert all(r.after_tokens <= r.before_tokens for r in got)


def test_output_is_idempotent_on_shapes(spark):
    d = rows(spark, "lines array<string>", [(["a 1", "a 2", "", "b", "a 3"],)])
    once = output.dedupe_by_shape(d)
    assert once.first().lines == ["a 1", "", "b"]
    assert output.dedupe_by_shape(once).first().lines == ["a 1", "", "b"]


# --- code ---------------------------------------------------------------------------------


def loop_code(text, slash, hashed):
    out, inside, blanks = [], False, 0
    for i, line in enumerate(text.split("\n")):
        line = line.rstrip()
        s = line.lstrip()
        if slash:
            if inside:
                inside = "*/" not in s
                continue
            if s.startswith("/*") and "*/" not in s:
                inside = True
                continue
            if s.startswith("/*") and s.endswith("*/"):
                continue
        if (slash and s.startswith("//")) or (hashed and s.startswith("#") and not (i == 0 and s.startswith("#!"))):
            continue
        if not s:
            blanks += 1
            if blanks == 1:
                out.append("")
            continue
        blanks = 0
        out.append(line)
    while out and out[0] == "":
        out.pop(0)
    while out and out[-1] == "":
        out.pop()
    return "\n".join(out)


@pytest.mark.parametrize("name,slash,hashed", [("a.ts", True, False), ("a.py", False, True), ("a.zz", False, False)])
def test_code_equals_a_loop(spark, name, slash, hashed):
    rng = random.Random(5)
    pieces = ["", "  ", "code();", "// c", "# c", "#! x", "/* a */", "/* a", "b */", "b */ code", "/* a */ code", "*/", "x /* y", "/*/"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(0, 15))) for _ in range(300)]
    got = code.compress(rows(spark, "id long, text string, filename string", [(i, t, name) for i, t in enumerate(texts)])).orderBy("id").collect()
    assert [r.output for r in got] == [loop_code(t, slash, hashed) for t in texts]


def test_keep_comments(spark):
    d = rows(spark, "text string, filename string", [("// banner\n\n\n/** doc */\nx", "a.ts")])
    assert code.compress(d, keep_comments=True).first().output == "// banner\n\n/** doc */\nx"


def test_outline():
    ts = "class P {\n  async charge(order: Order): Promise<Receipt> {\n    return order.items.reduce((a, b) => { return a + b; });\n  }\n}\nfunction help() {\n  return /[}]/;\n}\n"
    out = code.outline_text(ts, "ts")
    assert "async charge(order: Order): Promise<Receipt> { /* … */ }" in out and "reduce" not in out
    assert "function help() { /* … */ }" in out
    config = "interface A {\n  x: number;\n}\nfunction f() {\n  for (const a of b) {\n    doThing(a);\n  }\n}"
    assert "x: number" in code.outline_text(config, "ts") and "doThing" not in code.outline_text(config, "ts")
    py = "class A:\n    def charge(self, order):\n        return 1\n\n    def two(\n        self,\n    ):\n        x = 1\ny = 2"
    assert code.outline_text(py, "py") == "class A:\n    def charge(self, order): ...\n    def two(\n        self,\n    ): ...\ny = 2"


def test_outline_falls_back(spark):
    d = rows(spark, "text string, filename string", [("SELECT *\n-- a comment\nFROM users;\n", "query.sql"), (None, "a.ts"), ("function f() {\n  x();\n}", "a.js")])
    got = code.outline(d).collect()
    assert got[0].output == "SELECT *\n-- a comment\nFROM users;" and got[0].language == "unknown"
    assert got[1].output is None and got[2].output == "function f() { /* … */ }"


# --- diff, JSON, instructions -------------------------------------------------------------

DIFF = "diff --git a/src/auth.ts b/src/auth.ts\nindex 1..2\n--- a/src/auth.ts\n+++ b/src/auth.ts\n@@ -10,7 +10,8 @@\n context\n-old\n+new\n+more\ndiff --git a/package-lock.json b/package-lock.json\n--- a/package-lock.json\n+++ b/package-lock.json\n@@ -1 +1 @@\n-1\n+2\n+3"


def test_diff(spark):
    d = rows(spark, "doc_id long, text string", [(1, DIFF), (2, "no diff"), (3, None), (4, "")])
    got = diff.compress(d).orderBy("doc_id").collect()
    assert "package-lock.json: 3 changed line(s) omitted" in got[0].output and " context" not in got[0].output and "+more" in got[0].output
    assert got[1].output == "" and got[2].output is None
    s = diff.with_summary(d.where("doc_id = 1")).first()
    assert s.summary == "Selected diff: files=2, hunks=2, +4/-2, risk=high; byType=auth=high, deps=high; hotspots=src/auth.ts|package-lock.json"
    assert s.expanded.startswith("Selected diff summary:\n- Files changed: 2\n- Hunks: 2\n- Net lines: +4/-2")
    f = {r.path: r for r in diff.file_stats(d.where("doc_id = 1")).collect()}
    assert (f["src/auth.ts"].additions, f["src/auth.ts"].deletions, f["package-lock.json"].risk) == (2, 1, "high")


def test_json():
    api = '{"status":"ok","items":[' + ",".join(f'{{"id":{i},"tags":[]}}' for i in range(8)) + '],"meta":{"page":1,"total":8.0,"cursor":null}}'
    assert structured.compress_text(api)[0] == '{"status":"ok","items":[{"id":0},{"id":1},{"id":2},{"_headroom_summary":"... 5 more items (same schema)"}],"meta":{"page":1,"total":8}}'
    assert structured.compress_text("null") == (None, "nothing left after pruning") and structured.compress_text("{}")[0] is None
    assert structured.compress_text("{x")[1].startswith("Invalid JSON")
    assert structured.compress_text('{"b":1,"2":1,"1":{"a":[null,{}]}}')[0] == '{"2":1,"b":1}'
    assert [structured.number(x) for x in (1e21, 1e20, 0.1, 1e-7, 123456.5, -0.0, 5e-324, 100.0, 0.000001)] == ["1e+21", "100000000000000000000", "0.1", "1e-7", "123456.5", "0", "5e-324", "100", "0.000001"]
    assert structured.flatten_text('{"a":{"b":[1,"x"]},"c":null,"d":"' + "y" * 90 + '"}') == ["a.b.0: 1", "a.b.1: x", "c: null", "d: " + "y" * 77 + "…"]


def test_instructions():
    text = "# Title really\n\nIn order to build, it is important to just run `npm really` now.\nSee docs/really/x.md basically.\n\n- Please actually keep this short\n1. You should simply stop\n```\nreally\n```"
    out = instructions.compress_text(text).split("\n")
    assert out[0] == "# Title really" and "`npm really`" in out[2] and "docs/really/x.md" in out[2]
    assert out[2].startswith("to build, run")
    assert "- keep this short" in out and "1. stop" in out and out[-2] == "really"


# --- kinds, packs -------------------------------------------------------------------------


def test_kinds(spark):
    cases = [
        ("diff --git a/a.ts b/a.ts\n@@ -1,1 +1,1 @@\n-a\n+b", None, "diff"),
        ("Error: boom\n    at run (/tmp/a.ts:12:5)", None, "stack-trace"),
        ("class A { f() { throw new Error('missing task id') } }", "TaskDetailPage.ts", "code"),
        ("---\ntitle: x", None, "diff"),
        ('{"error": 1}', None, "stack-trace"),
        ('{"a": 1}', None, "json"),
        ("   ", None, "selected-text"),
        ("plain", "x.log", "output"),
    ]
    d = rows(spark, "text string, filename string, want string", cases)
    assert [tuple(r) for r in d.select(select.kind_of(F.col("text"), F.col("filename")), "want").collect()] == [(c[2], c[2]) for c in cases]


def test_packs(spark):
    texts = [
        "FAIL src/a.spec.ts\n  ● works\n    Expected: 1\n    Received: 2\n   at x (src/a.ts:3:4)\nnoise",
        "TypeError: bad\n    at run (src/a.ts:1:2)\n    at n (node_modules/x.js:1:2)",
        DIFF,
        '{"error":{"code":5},"items":[1,2]}',
        "",
        "export function f() {\n}\nother",
    ]
    got = select.context_pack(rows(spark, "id long, text string", list(enumerate(texts)))).orderBy("id").collect()
    assert [r.pack_kind for r in got] == ["test", "stack", "diff", "json", "empty", "code"]
    assert got[0].pack.startswith("# Focused context — test failure\n\n## Failing test(s)\nFAIL src/a.spec.ts") and "src/a.ts:3" in got[0].pack and "noise" not in got[0].pack
    assert "node_modules" not in got[1].pack and "TypeError: bad" in got[1].pack
    assert "package-lock" not in got[2].pack and "+more" in got[2].pack
    assert "error.code: 5" in got[3].pack and got[4].pack == "" and "export function f" in got[5].pack


def test_dispatch(spark):
    data = [("x.json", None, '{"a":null,"b":1}'), ("a.py", None, "# c\nx"), ("n.md", None, "Just really do it"), ("zz", None, "x"), ("a.ts", "outline", "function f() {\n 1\n}"), ("d", "diff", DIFF), ("l.log", None, "Error: x\nok")]
    got = {r.filename: r for r in select.compress(rows(spark, "filename string, m string, text string", data), mode_col="m").collect()}
    assert got["x.json"].output == '{"b":1}' and got["a.py"].output == "x" and got["n.md"].output == "do it"
    assert got["zz"].output is None and "unknown" in got["zz"].error
    assert got["a.ts"].output == "function f() { /* … */ }" and "omitted" in got["d"].output and got["l.log"].output == "Error: x"


def test_optimize_runs_no_compressor_that_it_cannot_choose(spark):
    data = rows(spark, "doc_id long, text string, filename string", [(1, DIFF, None), (2, '{"a":null,"b":1}', None), (3, " \n Plain one \nx", None), (4, "Error: x\nok", None), (5, "# c\nx", "a.py"), (6, None, None)])
    optimized = select.optimize(data)
    got = [(r.kind, r.output) for r in optimized.orderBy("doc_id").collect()]
    assert got[0][0] == "diff" and "omitted" in got[0][1]
    assert got[1:] == [("json", '{"b":1}'), ("selected-text", "Selected text (3 lines): Plain one."), ("stack-trace", "Error: x"), ("code", "x"), ("selected-text", None)]
    assert "pythonUDF1" not in optimized._jdf.queryExecution().optimizedPlan().toString()  # JSON alone; no outline, no prose


def test_diff_lines_with_control_characters(spark):
    text = "diff --git a/x.ts b/x.ts\n+a\u0001b\n c\ndiff --git a/yarn.lock b/yarn.lock\n+1\u0001\n-2\n--- q"
    got = diff.compress(rows(spark, "text string", [(text,)])).first().output
    assert got == "diff --git a/x.ts b/x.ts\n+a\u0001b\ndiff --git a/yarn.lock b/yarn.lock\n  (yarn.lock: 2 changed line(s) omitted — lock/generated/binary file)"


def test_explain(spark):
    small = "// why\nconst a = 1;"
    big = "\n".join(f"function f{i}() {{\n  return {i}; // {'x' * 20}\n}}" for i in range(150))
    got = select.explain(rows(spark, "doc_id long, text string, filename string", [(1, small, "a.ts"), (2, big, "b.ts"), (3, "plain", None)])).orderBy("doc_id").collect()
    assert (got[0].outlined, got[0].output) == (False, small)
    assert got[1].outlined and got[1].after_tokens < got[1].before_tokens and "{ /* … */ }" in got[1].output
    assert got[2].output == "Selected text (1 lines): plain."


# --- prompts ------------------------------------------------------------------------------


def test_goals_and_constraints(spark):
    d = rows(spark, "p string", [("please fixing the login flow",), ("Update the parser. Do not touch the tests. Keep it small, but never change the public api",), ("hey there! I was wondering if you could possibly explain caching, thanks so much",), ("   ",)])
    d = prompt.with_constraints(d, "p", "c", "k")
    got = prompt.with_normalized(d, "c", "g").collect()
    assert got[0].g == "Fix the login flow." and got[0].k == []
    assert got[1].k == ["Constraint: Do not touch the tests.", "Constraint: never change the public api."] and "touch" not in got[1].c
    assert got[2].g == "Possibly explain caching." and got[3].g == ""


def test_redundant_sentences(spark):
    p = "Check the login handler for timeouts. Look at login handler timeouts. Then update docs."
    got = rows(spark, "p string", [(p,)]).select(prompt.collapse_redundant(F.col("p"))).first()[0]
    assert "Look" not in got and got.startswith("Check the login") and got.endswith("Then update docs.")


def test_skeleton(spark):
    d = rows(spark, "p string, f string", [("fix it please", "auth.spec.ts"), ("fix it please", "auth.spec.ts"), ("fix it please", "billing.spec.ts")])
    ids = [r[0] for r in prompt.with_skeleton(d, "p", "f").select("skeleton_id").collect()]
    assert ids[0] == ids[1] != ids[2] and re.fullmatch(r"psk_[a-f0-9]{8}", ids[0])
    h = 2166136261
    for c in "a😀".encode("utf-16-be")[0:2], "a😀".encode("utf-16-be")[2:4], "a😀".encode("utf-16-be")[4:6]:
        h = (h ^ int.from_bytes(c, "big")) * 16777619 & 0xFFFFFFFF
    assert rows(spark, "p string", [("a😀",)]).select(prompt.fnv1a(F.col("p"))).first()[0] == f"{h:08x}"


def test_warnings_and_cache(spark):
    prompts = [
        "Please do a code review for this PR.",
        "I prefer concise answers. Always respond with short bullet points.",
        "Code only, no explanation. Keep it brief. Answer concisely.",
        "Run 987654321234 at 2026-06-04T10:12:00Z failed in /tmp/build/worker/log.txt with trace id 0123456789abcdef0123",
        "Refactor the auth module to use async/await.",
        "Review the full MCP tool catalog and use all tools for this task.",
        "",
    ]
    d = prompt.with_warnings(prompt.with_cache(rows(spark, "p string", [(p,) for p in prompts]), "p"), "p").collect()
    says = lambda i, k: prompt.WARNINGS[k] in d[i].warnings
    assert says(0, "review") and says(1, "preference") and says(2, "verbosity") and says(5, "tools")
    assert says(3, "volatile") and says(3, "prefix") and says(3, "reuse")
    assert d[4].cache.score == 100 and d[4].cache.volatility_density == 0 and d[6].cache.score == 100


def test_shapes(spark):
    cases = {"What is database connection pooling?": "question", "fix the login bug": "change", "review this feature": "review", "the login thing on staging": None, "isn't it true that water boils at 50C?": "complete", "git reset --hard the branch": "complete"}
    got = rows(spark, "p string", [(p,) for p in cases]).select("p", prompt.response_shape(F.col("p"))).collect()
    assert {r[0]: r[1] for r in got} == {p: k and prompt.SHAPES[k] for p, k in cases.items()}


def test_optimize(spark):
    data = [("1", "please fix the bug in src/a.ts", None, None), ("2", "Explain this", "Error: boom\n    at run (/tmp/a.ts:12:5)", None), ("3", "token = ghp_" + "a" * 40, None, True), ("4", "thanks", None, None)]
    got = {r.id: r for r in prompt.optimize(rows(spark, "id string, prompt string, selection_text string, xml boolean", data)).collect()}
    assert got["1"].optimized_prompt.startswith("[TypeScript] Fix the bug in src/a.ts. File: src/a.ts.")
    assert got["2"].context_type == "stack-trace" and "Selected stack trace: Error: boom Frames:" in got["2"].optimized_prompt
    assert "ghp_" not in got["3"].optimized_prompt and got["3"].redactions == 1 and got["3"].warnings[0].startswith("High-confidence secret patterns") and got["3"].optimized_prompt.startswith("<goal>")
    assert got["4"].optimized_prompt is None and got["4"].goal_error


def test_fence(spark):
    got = rows(spark, "t string", [("a ```` b",), ("x",)]).select(prompt.fence(F.col("t"), F.lit("js"))).collect()
    assert got[0][0] == "`````js\na ```` b\n`````" and got[1][0] == "```js\nx\n```"


# --- tasks, secrets -----------------------------------------------------------------------


def test_tasks(spark):
    cases = [
        ("rename a variable and fix a typo", 0, "economy", "completion-or-base"),
        ("debug a race condition in the auth refactor", 0, "premium", "premium"),
        ("update the readme wording", 0, "standard", "auto"),
        ("", 5000, "premium", "premium"),
        ("rename during this refactor", 0, "premium", "premium"),
        ("compress this test output", 0, "standard", "local-transform"),
        ("rename a variable and tidy the imports", 0, "economy", "completion-or-base"),
        ("classify every file in the dataset", 0, "standard", "batch-offline"),
    ]
    d = rows(spark, "t string, n int, a string, b string", cases).select(advisor.classify_task(F.col("t"), F.col("n")).alias("x"), "a", "b").collect()
    assert [(r.x.tier, r.x.routing) for r in d] == [(r.a, r.b) for r in d]


def test_secret_scan_flags_and_spares(spark):
    mixed = "aB3dE5fG7hI9jK1lM3nO5pQ7rS"
    jwt = ".".join(["eyJ" + "a" * 12, "b" * 12, "c" * 12])
    files = [
        ("src/x.ts", 'const k = "ghp_' + "a" * 40 + '";', [("github-token", 1)]),
        (".env", "PORT=3000\nDB=localhost", [("dotenv-assignment", 1), ("dotenv-assignment", 2)]),
        ("fp.py", "max_tokens = max_tokens", []),
        ("jira.py", 'next_page_token = data.get("nextPageToken")', []),
        (".env.example", "GITLAB_TOKEN=glpat-...  # note", []),
        ("SKILL.md", "`X-API-Key: <key>`", []),
        ("x", f"SERVICE_API_KEY={mixed}", [("sensitive-env-assignment", 1)]),
        ("y", f"ok\nAuthorization: Bearer {jwt}", [("bearer-token", 2), ("jwt-token", 2)]),
        ("z", "AKIA" + "A" * 16, [("aws-access-key-id", 1)]),
        ("bin", "ghp_" + "a" * 40 + "\u0000", []),
    ]
    found = secrets.scan(rows(spark, "file string, text string", [f[:2] for f in files])).collect()
    for name, _, want in files:
        assert sorted((r.id, r.line) for r in found if r.file == name) == want, name


def test_redaction_leaves_no_match(spark):
    texts = [("a", "x ghp_" + "a" * 40 + " y ghp_" + "b" * 40), (".env", "# c\nKEY=value\n\nexport B=2"), ("b", "clean text"), ("c", None), ("d", "Authorization: Bearer abcdefghijklmnop1234")]
    d = secrets.protect(rows(spark, "file string, text string", texts), filename_col="file")
    got = {r.file: r for r in d.collect()}
    assert got["a"].output == "x [REDACTED_GITHUB_TOKEN] y [REDACTED_GITHUB_TOKEN]" and got["a"].total == 2
    assert got[".env"].output == "# c\nKEY=[REDACTED_ENV_VALUE]\n\nexport B=[REDACTED_ENV_VALUE]"
    assert got["b"].output == "clean text" and not got["b"].redacted and got["c"].output is None
    assert got["d"].output == "Authorization: Bearer [REDACTED_BEARER_TOKEN]"
    again = secrets.protect(d.select("file", F.col("output").alias("text")).where("file <> '.env'"))
    assert again.agg(F.sum("total")).first()[0] == 0


def test_custom_rules(spark):
    rules = secrets.with_custom([{"name": "Ticket", "regex": r"TCK-\d{6}"}, {"name": "bad", "regex": "("}, {"name": "python", "regex": "(?P<x>a)"}, {"name": "none"}, {"regex": "a"}, {"name": "cut", "regex": "a\\"}])
    got = secrets.protect(rows(spark, "text string", [("see TCK-123456",)]), rules=rules).first()
    assert got.output == "see [REDACTED_TICKET]" and got.findings[0].id == "ticket" and len(rules) == len(secrets.RULES) + 1


# --- runs, readiness, evaluation ----------------------------------------------------------

RUN = "seq long, ts string, command_key string, grp string, skeleton_id string, before_tokens long, after_tokens long, context_type string, warnings array<string>"


def test_run_counters(spark):
    w = ["Low prompt reuse score detected. x", "MCP/tool-bloat risk detected. y", "High-confidence secret patterns were redacted locally (3 match(es): a)."]
    d = rows(spark, RUN, [(1, None, "optimizePrompt", "prompt", "psk_1", 120, 80, "prompt-only", w), (2, None, "optimizePrompt", "prompt", "psk_1", 95, 65, "diff", None), (3, None, "reviewDiff", "selection", None, 10, 4, None, [])])
    s = runs.run_stats(d).first()
    assert (s.prompt_runs, s.selection_runs, s.total_warnings, s.low_reuse_warnings, s.mcp_tool_bloat_warnings, s.redactions_total) == (2, 1, 3, 1, 1, 3)
    assert (s.unique_prompt_skeletons, s.repeated_prompt_skeletons, s.last_context_type) == (1, 1, "unknown")
    assert {r.command_key: r.runs for r in runs.command_runs(d).collect()}["optimizePrompt"] == 2
    empty = runs.run_stats(d.limit(0)).first()
    assert (empty.prompt_runs, empty.total_before_tokens, empty.last_context_type) == (0, 0, "none")


def test_evidence(spark):
    d = rows(spark, "total_before_tokens long, total_after_tokens long, selection_before_tokens long, selection_after_tokens long, redactions_total long", [(8000, 3000, 0, 0, 12)])
    free, paid = runs.evidence(d, F.lit(1)).first(), runs.evidence(d, F.lit(1), 10.0).first()
    assert (free.saved, free.saved_pct, free.cost_saved_usd) == (5000, 63, None) and paid.cost_saved_usd == 0.05


WORKSPACE = "name string, has_repo_instructions boolean, path_instruction_count int, has_agents boolean, has_exclusion boolean, has_ignore boolean, has_mcp boolean, mcp_servers int, mcp_allow int, mcp_defer int, has_devcontainer boolean, latest_update_ms long, now_ms long"


def test_readiness(spark):
    day = 86_400_000
    d = rows(spark, WORKSPACE, [("full", True, 2, True, True, True, True, 1, 1, 1, True, 1000 * day, 1014 * day), ("none", False, 0, False, False, False, False, 0, 0, 0, False, None, 1014 * day), ("some", True, 1, True, True, False, False, 0, 0, 0, False, 1000 * day, 1014 * day)])
    s = readiness.signals(d)
    got = {r.name: r for r in readiness.scores(s).collect()}
    assert (got["full"].score, got["full"].verdict, got["none"].verdict) == (100, "Ready", "Incomplete")
    assert [(r.signal_id, r.to_close) for r in readiness.gaps(s.where("name = 'some'")).collect()] == [("mcpConfig", 7), ("devcontainer", 5), ("copilotIgnore", 2)]
    assert readiness.overall(s).first().verdict == "Incomplete"


def test_hygiene(spark):
    got = rows(spark, "t string", [("a\r\nb\nread all files, and scan the repo",), ("",), (None,), ("x\n" * 250,)]).select(readiness.instruction_hygiene(F.col("t")).alias("h")).collect()
    assert got[0].h.line_count == 3 and got[0].h.broad_scope_hits == 2 and got[1].h.line_count == 0 and got[2].h.line_count == 0 and got[3].h.bloated


def test_quality_gate(spark):
    groups = [["drops", "deletes"], ["backup"], ["irreversible", "cannot be undone"]]
    d = rows(spark, "o string, g array<array<string>>", [("It DELETES the table. Take a BACKUP, it cannot be undone", groups), ("It removes it.", groups), ("x", [])])
    assert [len(r[0]) for r in d.select(evals.missing_requirements(F.col("o"), F.col("g"))).collect()] == [0, 3, 0]


def test_arms(spark):
    d = rows(spark, "arm string, prompt_idx int, output string", [("a", 0, "x" * 40), ("b", 0, "x" * 20), ("a", 1, "x" * 40), ("b", 1, "__ERROR__ x"), ("a", 2, "x" * 8), ("b", 2, "x" * 8)])
    r = evals.reductions(d, ["a", "b"], "b", "a").first()
    assert (r.prompts, r.median, r.least, r.greatest) == (2, 0.25, 0.0, 0.5)


def test_resolve_output(spark):
    answers = rows(spark, "id string, output string, output_file string", [("1", "in", None), ("2", None, "f"), ("3", None, "gone")])
    got = {r.id: r.output for r in evals.resolve_output(answers, rows(spark, "path string, text string", [("f", "text \n")])).collect()}
    assert got == {"1": "in", "2": "text", "3": ""}


def test_rule_matches(spark):
    d = evals.rule_matches(rows(spark, "text string", [("abc",), ("x",)]), rows(spark, "id string, pattern string", [("r1", "b"), ("r2", "^a")]))
    assert [r.rules for r in d.collect()] == [["r1", "r2"], []]


def test_generated_scanner_agrees(spark):
    d = rows(spark, "file string, text string", [("a", "x\nghp_" + "a" * 40 + "\nAKIA" + "B" * 16), ("b", "clean")])
    d.createOrReplaceTempView("scanned_files")
    assert sorted(map(tuple, spark.sql(secrets.scanner_sql("scanned_files")).collect())) == sorted(map(tuple, secrets.scan(d).collect()))


def test_reports(spark):
    d = rows(spark, "id string, t string", [("1", "rename a variable")]).withColumn("advice", advisor.classify_task(F.col("t")))
    text = reports.markdown(reports.advice_report(d), "Advice", ["id"]).first().markdown
    assert text == "# Advice\n\n- Tier: economy\n- Route: completion-or-base\n- Signals: cheap/mechanical: rename"
    p = rows(spark, "id string, groups array<array<string>>", [("q", [["yes"]]), ("r", [])])
    a = rows(spark, "id string, variant string, output string, kept_main_idea boolean, kept_reason boolean, kept_next_action boolean, kept_safety boolean", [("q", "baseline", "no", True, False, None, True)])
    got = {r.id: r for r in reports.direct_answer_report(p, a).collect()}
    assert (got["q"].tokens, got["q"].missing, got["q"].kept_main_idea, got["q"].kept_reason, got["q"].kept_next_action) == (1, "yes", "pass", "fail", "review") and got["r"].variant is None
    w = rows(spark, WORKSPACE, [("none", False, 0, False, False, False, False, 0, 0, 0, False, None, 1)])
    assert "- Verdict: Incomplete" in reports.markdown(reports.readiness_report(w), "Readiness", ["name"]).first().markdown
    got = reports.agent_compress(rows(spark, "text string, filename string", [("  ", None), ("Error: token ghp_" + "a" * 40, None)])).collect()
    assert got[0].output is None and got[0].note == "No text to compress." and "ghp_" not in got[1].output
    assert reports.clipboard_bundle(F.lit("x"), F.lit("Ask"), F.lit("diff")) is not None


# --- long rows ---------------------------------------------------------------------------


LONG = 1 << 20


def _long_rows():
    """Rows of a megabyte: one word, words of the patterns, paths, dots, one line, many lines."""
    fill = lambda s: (s * (LONG // len(s) + 1))[:LONG]
    return {
        "letters": fill("a"),
        "delete": "please delete " + fill("x y"),
        "delete without end": fill("delete this "),
        "production": fill("production "),
        "folders": fill("a/"),
        "file": fill("a/") + "b.ts",
        "dots": fill("a."),
        "lines": fill("one line of it\n"),
        "spaced": "x" + fill(" ") + "x",
    }


def test_shape_and_path_patterns_hold_on_long_rows(spark):
    rows = _long_rows()
    df = spark.createDataFrame(list(rows.items()), "name string, text string")
    got = {
        r.name: r
        for r in df.select(
            "name",
            prompt.is_brevity_sensitive(F.col("text")).alias("sensitive"),
            prompt.inline_path(F.col("text")).alias("path"),
            prompt.is_plain_question(F.col("text")).alias("question"),
            T.any_of(F.col("text"), prompt.BROAD_SCOPE).alias("broad"),
            F.length(T.trim(F.col("text"))).alias("trimmed"),
        ).collect()
    }
    assert len(got) == len(rows) and not any(r.sensitive or r.broad for r in got.values())
    assert got["file"].path == rows["file"] and got["folders"].path is None
    assert got["spaced"].trimmed == LONG + 2


def test_brevity_rules_look_from_the_first_word_on(spark):
    cases = {"delete the prod db": True, "prod first, then delete": False, "delete\n\nthe\nvolume": True, "production\n" + "x\n" * 5000 + "rollback": True, "deploy to production": False, "delete prod, delete": True}
    df = spark.createDataFrame(list(cases.items()), "text string, want boolean")
    assert df.where(prompt.is_brevity_sensitive(F.col("text")) != F.col("want")).count() == 0


def test_inline_paths(spark):
    cases = {"see a/b.ts/c": "a/b.ts", "a//b.ts": None, "in /a/b.ts": None, "x a.b/c-d/e_f.feature, y": "a.b/c-d/e_f.feature", "b.ts": None, "a/b.tsx": "a/b.tsx", "a/b.tsq": None, "a/b.ts.md": "a/b.ts.md"}
    df = spark.createDataFrame(list(cases.items()), "text string, want string")
    got = {r.text: r.path for r in df.select("text", prompt.inline_path(F.col("text")).alias("path")).collect()}
    assert got == cases


def test_word_edges_equal_the_plain_ones(spark):
    """The shorter forms of a word boundary find what Python finds, for every rule that has one."""
    patterns = [r"\bmaybe\s+", r"\b(fix|up(date)?|a?b)\b", r"\b(?:it|th[ei]s)\b", r"x\b", r"\bx?y\b", r"a\b|\bb", r"\b(get|set)ters?\b", r"\d\b", r"\b\d+\b", r"ab\b\.", r"\b_a", r"(a|\()\b", r"\b(a|)b", r"[a-c]\bd?"]
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab_x y.é1(fixthe") for _ in range(rng.randint(0, 14))) for _ in range(1500)] + ["fix", "a maybe b", "xmaybe b", "update", "this", "getters", "the\nmaybe x"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[F.col("t").rlike(regex.java(p)).alias(f"p{k}") for k, p in enumerate(patterns)])
    for r in d.collect():
        for k, p in enumerate(patterns):
            assert r[f"p{k}"] == bool(re.search(p, r.t, re.A)), (p, r.t)


def test_tier_hints_miss_no_match():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    for rules, _ in advisor.SIGNALS:
        for pattern, label in rules:

            @settings(max_examples=60, deadline=None, database=None)
            @given(st.from_regex(re.compile(pattern, re.A), fullmatch=True))
            def check(text):
                assert any(h in text for h in advisor.HINTS[label]), (pattern, text)  # noqa: B023

            check()
