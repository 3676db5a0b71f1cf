"""URL filter: host rules first, then a weighted vocabulary found by Aho-Corasick.

Host is what follows the first ``://`` up to ``/ ? #`` (A-Z lower-cased), path is what
follows up to ``? #``. A rule (host, path, verdict) fits its host and all subdomains if
the url's path starts with the rule's path; the longest fitting rule decides. Without
one, the whole url, as it is written (percent escapes aren't decoded), is searched once for all
terms; a hit counts only with a boundary
(no ASCII letter or digit) on both sides. One strict term, or ``soft_needed`` distinct
soft terms, block.

Defined cases: a null url or one without ``://`` has empty host and path and no rule;
a null url is allowed; an empty path fits no rule, as each rule's path starts with ``/``;
other columns of the input are ignored.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import LOWER, UPPER, ascii_lower

#: Terms that block alone, and terms of which several must meet.
STRICT = ("porn", "xxx", "adult-x", "casino", "viagra", "cialis", "spam-farm", "escorts", "warez", "hentai", "camgirls", "torrents")
SOFT = ("ads", "track", "tracker", "cheap", "pills", "pharmacy", "free", "bets", "bet", "win", "spam", "farm", "adult", "sex", "poker", "slots", "loan", "crack", "keygen", "nude", "dating", "prize", "click", "popup")

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def vocabulary(table: DataFrame, most: int = 100_000) -> dict[str, tuple[str, ...]]:
    """The terms of a table (term, weight): weight 2 or more is strict, 1 soft. Terms are lower-cased in
    A-Z, null and empty ones are left out, and one given twice has its greater weight. A table of
    more than ``most`` terms is refused, as every worker holds them all."""
    terms = table.select(ascii_lower(F.col("term")).alias("term"), "weight").where("term <> '' AND weight >= 1")
    found = terms.groupBy("term").agg(F.max("weight").alias("weight")).orderBy("term").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} terms")
    return {"strict": tuple(r["term"] for r in found if r["weight"] >= 2), "soft": tuple(r["term"] for r in found if r["weight"] == 1)}


def automaton(strict=STRICT, soft=SOFT):
    out = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):
        for term in terms:
            out.add_word(term, (term, weight))
    out.make_automaton()
    return out


def vocabulary_hits(url: str | None, machine) -> tuple[int, int]:
    """(strict occurrences' distinct terms, distinct soft terms) with boundaries on both sides."""
    if not url:
        return 0, 0
    s = url.translate(_FOLD)
    strict, soft = set(), set()
    for end, (term, weight) in machine.iter(s):
        start = end - len(term) + 1
        if (start == 0 or s[start - 1] not in _WORD) and (end + 1 == len(s) or s[end + 1] not in _WORD):
            (strict if weight == 2 else soft).add(term)
    return len(strict), len(soft)


_FOLD = str.maketrans(UPPER, LOWER)
_WORD = frozenset(LOWER + "0123456789")


def judge(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_needed: int = 2, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per url: id, host, path, rule, verdict, and the distinct strict and soft hits."""

    def search(batches):
        machine = automaton(strict, soft)
        for batch in batches:
            hits = [vocabulary_hits(u, machine) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([h[0] for h in hits], pa.int32()), pa.array([h[1] for h in hits], pa.int32())],
                ["page_id", "url", "n_strict", "n_soft"],
            )

    hit = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).mapInArrow(search, "page_id long, url string, n_strict int, n_soft int")
    parts = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    hit = hit.withColumn("host", F.coalesce(ascii_lower(F.regexp_extract("url", parts, 1)), F.lit(""))).withColumn("path", F.coalesce(F.regexp_extract("url", parts, 2), F.lit("")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    own = F.when((F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_needed), F.lit("block")).otherwise(F.lit("allow"))
    return hit.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n_strict", "n_soft")


def judge_sql(rules=RULES, strict=STRICT, soft=SOFT, soft_needed: int = 2) -> str:
    """The same rows in DuckDB SQL, with a regular expression per term instead of the automaton."""
    bounded = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::int"
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r), reverse=True)
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ordered) + f" WHEN n_strict >= 1 OR n_soft >= {soft_needed} THEN 'block' ELSE 'allow' END"
    return f"""
WITH s AS (SELECT page_id, url, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u,
             strpos(coalesce(url, ''), '://') AS sep FROM pages),
r AS (SELECT page_id, u, CASE WHEN sep > 0 THEN substr(url, sep + 3) ELSE '' END AS rest FROM s),
p AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
h AS (SELECT page_id, host, path, ({' + '.join(map(bounded, strict))})::int AS n_strict, ({' + '.join(map(bounded, soft))})::int AS n_soft FROM p)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, n_strict, n_soft FROM h"""
