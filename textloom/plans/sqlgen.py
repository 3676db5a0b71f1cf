"""DuckDB SQL for text operators, built from the same rule tables in RE2 notation."""

from __future__ import annotations

from textloom.functions.regex import re2, sql_any, sql_string, sql_test
from textloom.functions.text import WS_RE2

NL = "chr(10)"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS_RE2}]+|[{WS_RE2}]+\\z', '', 'g')"


def trim_end(x: str) -> str:
    return f"regexp_replace({x}, '[{WS_RE2}]+\\z', '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '[{WS_RE2}]+', ' ', 'g')"


def u16(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def tokens(x: str) -> str:
    return f"ceil({u16(x)} / 4.0)::bigint"


def ratio(before: str, after: str) -> str:
    return f"(CASE WHEN {before} > 0 THEN floor((1 - {after}::double / {before}) * 100 + 0.5) ELSE 0 END)::int"


def fixed_2(x: str) -> str:
    """Two decimals from the exact binary value; printf rounds exact ties to even, these go up."""
    return f"printf('%.2f', CASE WHEN {x} * 8 = floor({x} * 8) THEN {x} + 1e-9 ELSE {x} END)::double"


def replace(x: str, pattern: str, by: str, flags: str = "") -> str:
    return f"regexp_replace({x}, {sql_string(re2(pattern, flags))}, {sql_string(by)}, 'g')"


def count(x: str, pattern: str, flags: str = "") -> str:
    return f"len(regexp_extract_all({x}, {sql_string(re2(pattern, flags))}))"


def case(pairs, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"


def values(name: str, columns: list[str], rows: list[tuple]) -> str:
    """A CTE of literal rows."""
    one = lambda v: "NULL" if v is None else ("TRUE" if v else "FALSE") if isinstance(v, bool) else sql_string(v) if isinstance(v, str) else str(v)
    return f"{name}({', '.join(columns)}) AS (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def output_compress(source: str) -> str:
    """C1 over a source of (id, text) by windows over exploded lines."""
    from textloom.operators import output as o

    shape = trim(squeeze("regexp_replace(regexp_replace(x, '(?i)[0-9a-f]{8,}', '#', 'g'), '[0-9]+', '#', 'g')"))
    return f"""
WITH src AS ({source}),
l AS (SELECT id, unnest(string_split(text, {NL})) AS raw, generate_subscripts(string_split(text, {NL}), 1) AS pos FROM src),
t AS (SELECT id, pos, {trim_end('raw')} AS x FROM l),
c AS (SELECT id, pos, x, {sql_test('x', *o.FRAME)} AS frame, {sql_any('x', o.STRIP)} AS strip, {sql_any('x', o.KEEP)} AS keep FROM t),
w AS (SELECT *, sum((NOT frame)::int) OVER p AS island, sum((NOT frame AND x <> '')::int) OVER p AS stretch FROM c WINDOW p AS (PARTITION BY id ORDER BY pos)),
f AS (SELECT *, sum(frame::int) OVER (PARTITION BY id, island ORDER BY pos) AS nth_frame,
             sum((x = '' AND NOT frame)::int) OVER (PARTITION BY id, stretch ORDER BY pos) AS nth_blank FROM w),
k AS (SELECT *, CASE WHEN frame THEN nth_frame <= {o.FRAMES_KEPT} AND NOT strip WHEN x = '' THEN nth_blank = 1 ELSE keep AND NOT strip END AS k FROM f),
a AS (SELECT id, bool_or(k AND {trim('x')} <> '') AS hit FROM k GROUP BY id),
r AS (SELECT k.id, pos, x, {shape} AS shape FROM k JOIN a USING (id) WHERE CASE WHEN hit THEN k ELSE TRUE END),
d AS (SELECT id, pos, x FROM (SELECT *, row_number() OVER (PARTITION BY id, shape ORDER BY pos) AS rn FROM r) WHERE rn = 1 OR {trim('x')} = ''),
b AS (SELECT id, min(pos) FILTER (x <> '') AS lo, max(pos) FILTER (x <> '') AS hi FROM d GROUP BY id),
j AS (SELECT b.id, coalesce(string_agg(x, {NL} ORDER BY pos) FILTER (pos BETWEEN lo AND hi), '') AS output FROM d JOIN b USING (id) GROUP BY b.id)
SELECT id, output, {tokens('text')} AS before_tokens, {tokens('output')} AS after_tokens, {ratio(tokens('text'), tokens('output'))} AS ratio FROM j JOIN src USING (id)"""


def redacted(x: str) -> tuple[str, list[tuple[str, str]]]:
    """K1 as nested replacements: (output expression, [(id, count expression)])."""
    from textloom.operators import secrets as s

    counts = []
    for name, pattern, by, _ in s.RULES:
        counts.append((name, count(x, pattern)))
        x = replace(x, pattern, by.replace("$1", "\\1"))
    return x, counts


def kind(x: str) -> str:
    from textloom.operators import select as s

    t = trim(x)
    json_like = f"((starts_with({t}, '{{') AND ends_with({t}, '}}')) OR (starts_with({t}, '[') AND ends_with({t}, ']')))"
    return case([(f"{t} = ''", "'selected-text'"), (sql_test(x, *s.DIFF_HEADER), "'diff'"), (sql_test(x, *s.STACK_FRAME), "'stack-trace'"), (sql_test(t, *s.ERROR_WORD), "'stack-trace'"), (json_like, "'json'")], "'selected-text'")


def pack_kind(x: str) -> str:
    from textloom.operators import select as s

    t = trim(x)
    json_like = f"((starts_with({t}, '{{') AND ends_with({t}, '}}')) OR (starts_with({t}, '[') AND ends_with({t}, ']')))"
    return case([(sql_test(x, *s.PACK_DIFF), "'diff'"), (sql_test(x, *s.PACK_TEST), "'test'"), (sql_test(x, *s.PACK_STACK), "'stack'"), (json_like, "'json'")], "'code'")


def cache_ctes(source: str) -> str:
    """P14, P15 over a CTE ``source`` that has a column text: CTE ``cached`` adds score, prefix, density, earliest."""
    from textloom.operators import prompt as p

    def first(pattern, flags):
        body = re2(pattern, flags.replace("i", ""))
        flag = "(?i)" if "i" in flags else ""
        return f"CASE WHEN {sql_test('text', pattern, flags)} THEN {u16(f'regexp_extract(text, {sql_string(flag + chr(92) + 'A((?s:.*?))(?:' + body + ')')}, 1)')} END"

    size = lambda pattern, flags: f"list_sum(list_transform(regexp_extract_all(text, {sql_string(re2(pattern, flags))}), lambda m: {u16('m')}))"
    return f"""
v AS (SELECT *, least({', '.join(first(a, b) for a, b, _ in p.VOLATILE)}) AS e0, {' + '.join(f'coalesce({size(a, b)}, 0)' for a, b, _ in p.VOLATILE)} AS chars, {u16('text')} AS n FROM {source}),
q AS (SELECT *, coalesce(e0, -1) AS earliest, CASE WHEN n = 0 OR e0 IS NULL THEN 1.0::double ELSE e0::double / n END AS pr, CASE WHEN n = 0 THEN 0.0::double ELSE least(1.0::double, chars::double / n) END AS de FROM v),
cached AS (SELECT * EXCLUDE (pr, de), CASE WHEN n = 0 THEN 100 ELSE greatest(0, 100 - (CASE WHEN pr < 0.35 THEN 35 WHEN pr < 0.6 THEN 15 ELSE 0 END)
  - (CASE WHEN de > 0.2 THEN 25 WHEN de > 0.1 THEN 12 ELSE 0 END) - (CASE WHEN n > 300 AND pr < 0.5 THEN 10 ELSE 0 END)) END::int AS score,
  {fixed_2('pr')} AS prefix, {fixed_2('de')} AS density FROM q)"""


def warnings() -> str:
    """P16 without metadata, as a list expression over the columns of ``cached``."""
    from textloom.operators import prompt as p

    t = lambda rule, x="text": sql_test(x, *rule)
    both = f"(text || {NL})"
    catalog = f"({count(both, *p.TOOL_SCHEMA)} >= 10 OR {u16(both)} > 1800)"
    rules = {
        "scope": sql_any("text", p.BROAD_SCOPE),
        "long": f"{u16('text')} > 500",
        "vague": t(p.VAGUE),
        "compound": t(p.COMPOUND),
        "review": t(p.COSTLY_REVIEW),
        "preference": t(p.PREFERENCE),
        "verbosity": f"{count('text', *p.VERBOSITY)} >= 2",
        "volatile": "density >= 0.12",
        "prefix": "(earliest <> -1 AND prefix < 0.35)",
        "reuse": "score < 50",
        "tools": f"({t(p.TOOL_CONTEXT, both)} AND ({t(p.BROAD_TOOLS, both)} OR {catalog}) AND NOT {t(p.TOOL_ALLOWLIST, both)})",
        "deferral": f"({t(p.TOOL_CONTEXT, both)} AND {catalog} AND NOT {t(p.TOOL_DEFERRAL, both)})",
    }
    parts = [f"CASE WHEN {rules[k]} THEN {sql_string(w)} END" for k, w in p.WARNINGS.items() if k in rules]
    return f"list_filter([{', '.join(parts)}], lambda w: w IS NOT NULL)"


def fnv1a(x: str) -> str:
    """FNV-1a of a text in the basic plane."""
    codes = f"list_transform(string_split({x}, ''), lambda c: unicode(c)::bigint)"
    return f"lpad(lower(to_hex(CASE WHEN length({x}) = 0 THEN 2166136261 ELSE list_reduce(list_concat([2166136261::bigint], {codes}), lambda h, c: (xor(h, c) * 16777619) & 4294967295) END)), 8, '0')"


def runs(source: str = "conversations") -> str:
    """The run-event CTEs (``runs``) out of conversation turns."""
    text = "coalesce(text, '')"
    squeezed = trim(squeeze("text"))
    return f"""
s0 AS (SELECT conv_id * 1000 + turn AS seq, role, {text} AS text FROM {source}),
{cache_ctes('s0')},
runs AS (SELECT seq, CASE role WHEN 'user' THEN 'chatOptimize' WHEN 'assistant' THEN 'chatCompress' ELSE 'reviewDiff' END AS command_key,
  CASE WHEN role = 'user' THEN 'prompt' ELSE 'selection' END AS grp, CASE WHEN role = 'user' THEN 'psk_' || {fnv1a(f'lower({squeezed})')} END AS skeleton_id,
  {tokens('text')} AS before_tokens, {tokens(squeezed)} AS after_tokens,
  CASE WHEN role = 'user' THEN 'prompt-only' ELSE 'selected-text' END AS context_type, {warnings()} AS warnings FROM cached)"""
