"""Prompts: normalisation, constraints, shape, warnings, cacheability, fingerprint, assembly.

All of it is column expressions: long chains of replacements in the JVM, one pass over a
row, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.regex import java
from textloom.operators import secrets, select

# --- fixed values ------------------------------------------------------------------------

POLITE = r"^(please\s+|can you\s+|could you\s+|would you\s+|i need you to\s+|help me\s+)"
I_NEED = r"^(i\s+need\s+to|i\s+want\s+to|i'?m\s+trying\s+to|we\s+need\s+to|we\s+want\s+to)\s+"
GERUNDS = {
    "fixing": "Fix", "updating": "Update", "adding": "Add", "removing": "Remove", "refactoring": "Refactor",
    "checking": "Check", "testing": "Test", "writing": "Write", "creating": "Create", "debugging": "Debug",
    "improving": "Improve", "changing": "Change", "reviewing": "Review", "investigating": "Investigate", "implementing": "Implement",
}
HEDGES = [
    r",?\s*if\s+(at\s+all\s+)?possible\b",
    r"\bmaybe\s+",
    r"\bideally\s+",
    r"\btry\s+to\s+",
    r"\bsort\s+of\s+",
    r"\bkind\s+of\s+",
    r"\bas\s+much\s+as\s+(you\s+can|possible)\b",
    r"\bhopefully\s+",
    r"\bif\s+you\s+(can|could)\s+",
    r"\bjust\s+(?=\w)",
]
FILLER = [
    (r"^\s*(?:hey|hi|hello|yo)\s+there\b[!.,\s]*", ""),
    (r"^\s*(?:hey|hi|hello|yo|ok|okay)\b[!.,\s]+", ""),
    (r"^\s*so[,\s]+(?=\w)", ""),
    (r"\b(?:basically|honestly|frankly|seriously)\b[,\s]*", " "),
    (r"\bto be honest\b[,\s]*", " "),
    (r"\bthe thing is(?:\s+that)?\b[,\s]*", " "),
    (r"\bwhat\s+(?:seems\s+to\s+be\s+happening|(?:'?s|\s+is|\s+has\s+been)\s+(?:going\s+on|driving\s+me\s+(?:crazy|nuts|mad)))\s+is(?:\s+that)?\b[,\s]*", " "),
    (r"\bi\s+(?:really\s+)?hate\s+to\s+bother\s+you(?:\s+with\s+(?:this|that|it))?\b[,\s]*", " "),
    (r"\bi\s+(?:was|am|'?m)\s+(?:really\s+|just\s+)*(?:hoping|wondering)\s+(?:that\s+|if\s+)?", " "),
    (r"\b(?:if\s+)?you\s+(?:could|might|can)\s+(?:possibly|maybe|kindly|perhaps|please)\s+(?:be\s+able\s+to\s+)?", " "),
    (r"\bwould\s+you\s+mind\b[,\s]*", " "),
    (r"\bhelp\s+me\s+out\b(?:\s+with\s+(?:this|that|it|something))?", " "),
    (r"\bcan\s+you\s+please\s+", " "),
    (r"\bkindly\s+", " "),
    (r",?\s*(?:just\s+)?so\s+you\s+know\b[,\s]*", " "),
    (r",?\s*(?:there\s+(?:is|'?s)\s+)?(?:absolutely\s+)?no\s+(?:rush|pressure|hurry)(?:\s+at\s+all)?\b", " "),
    (r",?\s*(?:and\s+)?please\s+take\s+your\s+time\b", " "),
    (r",?\s*whenever\s+you\s+(?:get|have)\s+(?:a\s+)?(?:spare\s+|free\s+)?(?:moment|chance|minute|time|sec(?:ond)?)\b", " "),
    (r",?\s*when(?:ever)?\s+you\s+(?:get\s+(?:a\s+)?chance|have\s+(?:the\s+)?time)\b", " "),
    (r",?\s*i\s+(?:totally\s+|completely\s+|fully\s+)?understand\s+if\s+you(?:'?re|\s+are)\s+busy\b", " "),
    (r",?\s*in\s+case\s+(?:that|it)\s+(?:matters|is\s+relevant|helps)(?:\s+at\s+all)?\b", " "),
    (r",?\s*if\s+that\s+(?:helps|makes\s+sense)\b", " "),
    (r",?\s*for\s+what\s+it(?:'?s|\s+is)\s+worth\b", " "),
    (r"\bi(?:'?ve|\s+have)\s+been\s+(?:staring\s+at|struggling\s+with|banging\s+my\s+head\s+(?:against|on)|working\s+on|stuck\s+on)\s+(?:it|this|that)\s+for\s+(?:hours|ages|a\s+while|days|so\s+long)\b[,\s]*", " "),
    (r"\bi(?:'?ve|\s+have)\s+spent\s+(?:the\s+)?(?:whole\s+|entire\s+|better\s+part\s+of\s+the\s+)?(?:afternoon|morning|day|evening)\s+(?:trying\s+to\s+figure\s+out\s+why|on\s+(?:this|it))?\b[,\s]*", " "),
    (r"\bi\s+(?:just\s+)?can(?:'?t|not)\s+(?:seem\s+to\s+)?figure\s+(?:it|this|that)?\s*out\b[,\s]*", " "),
    (r",?\s*(?:thanks|thank\s+you)(?:\s+(?:so+\s+)*much|\s+a\s+(?:lot|million|ton|bunch))?(?:\s+in\s+advance)?\s*[.!]*\s*$", ""),
    (r",?\s*(?:thanks|thank\s+you)(?:\s+(?:so+\s+)*much|\s+a\s+(?:lot|million|ton|bunch))?(?:\s+in\s+advance)?\b[,\s]*", " "),
    (r"\bi(?:'?d|\s+would)\s+(?:really\s+|greatly\s+)*(?:appreciate|love)\s+(?:it|that|this)?\b[,\s]*", " "),
    (r",?\s*(?:much\s+)?appreciated\b[.!]*", " "),
    (r",?\s*you(?:'?re|\s+are)\s+(?:such\s+)?(?:an?\s+)?(?:absolute\s+|total\s+|real\s+)?(?:the\s+best|the\s+greatest|life\s?saver|amazing|awesome|brilliant|a\s+star)\b[.!]*", " "),
    (r",?\s*cheers\b[.!]*", " "),
    (r"\boh\s+and\b[,\s]*", " "),
    (r",?\s*(?:oh\s+)?by\s+the\s+way\b[,\s]*", " "),
    (r"\banyway\b[,\s]*", " "),
    (r"\breally\s+really\b", "really"),
    (r"\bso\s+so\s+(?=much|many)", ""),
]
TIDY = [
    (r"\s{2,}", "", " "),
    (r"\s+([,.;:!?])", "", "$1"),
    (r"([,;:])\s*(?=[,;:.])", "", ""),
    (r",\s*\.", "", "."),
    (r"\b(and|but|or|so|then|also)\b(?:\s*,?\s*\1\b)+", "i", "$1"),
    (r"[,\s]+(?:and|but|or|so|then|also|plus)\s*(?=[.!?])", "i", ""),
    (r"(^|[.!?])\s*(?:and|but|or|so|then|also|plus)\s*(?=[.!?])", "i", "$1"),
]
LEADING = r"^(?:[\s,;:.]+|(?:and|but|so|then|also|plus|well)\b[,\s]+)+"
STOP_WORDS = "the a an is are was were to of and or in on at for with this that it be do can will you your".split()
OVERLAP = 0.65
CONSTRAINT_SENTENCE = r"\.\s+((?:Don'?t|Do\s+not|Avoid|Never|Must\s+not|Should\s+not|Without)\s+[A-Za-z][^.!?]{2,120})(?=[.!?]|$)"
CONSTRAINT_CLAUSE = r"([,;]|\s+but)\s+((don'?t|do\s+not|avoid|never|must\s+not|should\s+not|without)\s+[a-z][^,.;!?]{2,120})"
INLINE_PATH = r"(?:^|\s)((?:[\w.-]+\/)+[\w.-]+\.(?:ts|tsx|js|jsx|mjs|cjs|py|go|java|json|feature|md))\b"
#: The same for Java, whose repeated groups recurse for each folder: word characters, dots, dashes and
#: single slashes, the last slash followed by a name.
INLINE_PATH_JAVA = java(r"(?:^|\s)((?=[\w.-])(?:(?!//)[\w./-])*/[\w.-]+\.(?:ts|tsx|js|jsx|mjs|cjs|py|go|java|json|feature|md))\b")
LANGUAGE_TAGS = [
    (r"\.spec\.ts$", "[Playwright/TypeScript]"),
    (r"\.spec\.js$", "[Playwright/JavaScript]"),
    (r"\.feature$", "[Gherkin/Cucumber]"),
    (r"\.tsx$", "[React/TypeScript]"),
    (r"\.ts$", "[TypeScript]"),
    (r"\.jsx$", "[React/JavaScript]"),
    (r"\.js$", "[JavaScript]"),
    (r"\.py$", "[Python]"),
    (r"\.go$", "[Go]"),
    (r"\.java$", "[Java]"),
]
BROAD_SCOPE = [
    (r"@workspace\b", "i"),
    (r"\b(entire|whole)\s+(repo|repository|project|codebase)\b", "i"),
    (r"\bsearch\s+the\s+(repo|repository|project|codebase)\b", "i"),
    (r"\blook\s+through\s+the\s+(repo|repository|project|codebase)\b", "i"),
]
PLAIN_QUESTION = [(r"^\s*(what|why|how|when|where|which|who)\b", "i"), (r"^\s*(explain|describe|summari[sz]e|tell me about|walk me through)\b", "i")]
BREVITY_SENSITIVE = [
    (r"\bis(n'?t)?\s+it\s+true\b", "i"),
    (r"\bisn'?t\s+it\b", "i"),
    (r"\b(right|correct|true)\s*\?\s*$", "i"),
    (r"\bis\s+(this|it|that)\s+(safe|correct|accurate|right|true|valid|secure)\b", "i"),
    (r"\bverify\b", "i"),
    (r"\bfact[-\s]?check\b", "i"),
    (r"\bdouble[-\s]?check\b", "i"),
    (r"\bare\s+you\s+(sure|certain|positive)\b", "i"),
    (r"\bconfirm\s+(that|whether|if)\b", "i"),
    (r"\brm\s+-rf\b", "i"),
    (r"\bforce[-\s]?push\b", "i"),
    (r"\bgit\s+reset\s+--hard\b", "i"),
    (r"\b(drop|truncate)\s+(table|database|schema)\b", "i"),
    (r"\b(delete|wipe|destroy|revoke|rotate|overwrite)\b[\s\S]*\b(prod|production|database|volume|bucket|credential|api[-\s]?key|private[-\s]?key|account|user data)\b", "i"),
    (r"\bproduction\b[\s\S]*\b(deploy|migrat|rollback|delete|drop)", "i"),
]
SHAPES = {
    "complete": "Answer completely; if the question assumes something false or unsafe, say so first.",
    "diff_review": "List the highest-risk regressions in the diff first.",
    "diff": "Focus on the changed behavior in the selected diff first.",
    "stack": "Explain the likely root cause first, then the smallest plausible fix.",
    "review": "List the highest-risk findings first.",
    "explain": "Lead with the answer; keep it to a short paragraph (aim for ≤5 sentences); no preamble.",
    "change": "Return the minimal change needed. Keep the explanation to a sentence or two. Code first; add prose only where the code does not carry it.",
    "narrow": "Aim for ≤150 tokens.",
    "question": "Lead with the answer; aim for ≤3 sentences unless the question needs more.",
}
_DIGITS = tuple("0123456789")
VOLATILE = [
    (r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z\b", "", tuple(f"T{d}" for d in _DIGITS)),
    (r"\b\d{4}-\d{2}-\d{2}\b", "", tuple(f"-{d}" for d in _DIGITS)),
    (r"\b\d{1,2}:\d{2}(?::\d{2})?\b", "", tuple(f":{d}" for d in _DIGITS)),
    (r"\b(?:today|yesterday|tomorrow|tonight)\b", "i", ("today", "yesterday", "tomorrow", "tonight")),
    (r"\b(?:case|run|attempt|build|job|iteration|ticket|try)\s+#?\d+\b", "i", _DIGITS),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b", "i", ("-1", "-2", "-3", "-4", "-5")),
    (r"\b[a-f0-9]{16,40}\b", "i", ()),
    (r"\b\d{10,}\b", "", _DIGITS),
    (r"^\s*at\s+.+:\d+:\d+\)?$", "m", tuple(f":{d}" for d in _DIGITS)),
    (r"\/(tmp|var\/folders)\/[\w./-]+", "i", ("/tmp/", "/var/folders/")),
]
VAGUE = (r"\b(it|this|that|the\s+function|the\s+method|the\s+class|the\s+component|the\s+test)\b", "i")
COMPOUND = (r"\b(and\s+also|and\s+then|while\s+also|as\s+well\s+as|in\s+addition\s+to|plus\s+also)\b", "i")
COSTLY_REVIEW = (r"\b(code\s+review|review\s+the\s+pull\s+request|review\s+my\s+pr)\b", "i")
PREFERENCE = (r"\b(i\s+prefer|my\s+preference|always\s+respond\s+with|my\s+default\s+style|for\s+me\s+always)\b", "i")
VERBOSITY = (r"\b(?:be\s+concise|answer\s+concisely|keep\s+it\s+brief|briefly|short\s+answer|3\s+bullets|bullet\s+points|code\s+only|no\s+explanation|without\s+explanation|minimal\s+change)\b", "i")
INSTRUCTION_FILE = (r"(?:\.github\/copilot-instructions\.md|\.github\/instructions\/|AGENTS\.md|SKILL\.md|\.instructions\.md|README\.md)", "i")
INSTRUCTION_TEXT = (r"(^|\n)#{1,6}\s+|(^|\n)\s*[-*]\s+|(^|\n)\s*\d+\.\s+|(^|\n)---\n|\.github\/copilot-instructions\.md|AGENTS\.md|SKILL\.md", "i")
TOOL_CONTEXT = (r"\b(mcp|model\s+context\s+protocol|playwright\s+mcp|toolset|tool\s+catalog|tool\s+schema|server\s+tools?)\b", "i")
BROAD_TOOLS = (r"\b(all|every|entire|full|complete)\s+(mcp\s+)?(tools?|toolset|tool\s+catalog)\b", "i")
TOOL_ALLOWLIST = (r"\b(allowed_tools|allowlist|tool\s+allowlist|tool_names|only\s+use\s+these\s+tools?)\b", "i")
TOOL_DEFERRAL = (r"\b(defer_loading|deferred\s+loading|lazy\s+load(?:ing)?\s+tools?)\b", "i")
TOOL_SCHEMA = (r"\"name\"\s*:\s*\"[\w.-]+\"", "")
DIFF_WORD = (r"\b(diff|change|regression|patch)\b", "i")
WARNINGS = {
    "scope": "Broad workspace scope detected. Add a target file or narrowed search result before sending to Copilot.",
    "long": "Long prompt detected. Consider pasting compressed code, logs, or a focused snippet instead of a long narrative.",
    "diff": "Diff-like editor selection detected. Ask about changed behavior, regressions, or risk to keep the review focused.",
    "stack": "Stack trace detected. Include the failing assertion or observed error to improve root-cause quality.",
    "large": "Large editor selection detected. Compress or summarize the selected content before sending it to Copilot.",
    "instructions": "Instruction-like selection detected. Compress the prose with instructions mode or split repo-wide rules from path-specific guidance before sending it to Copilot.",
    "vague": "Vague reference detected. Add --file or select a symbol to give Copilot a concrete target.",
    "compound": "Multiple tasks detected. Send one task at a time for higher quality output.",
    "review": "High-cost review request detected. Run local diff review first, then send only risky hunks to Copilot review.",
    "preference": "Recurring preference-style instruction detected. If policy allows Copilot Memory, store personal defaults there instead of repeating them in each prompt.",
    "verbosity": "Repeated verbosity controls detected. Move stable direct-answer defaults into repo instructions and keep per-prompt output shaping for exceptions only.",
    "volatile": "Volatile context detected (timestamps/IDs/stack traces). Move volatile details after stable instructions or trim them before sending to Copilot.",
    "prefix": "Unstable prompt prefix detected. Keep stable task instructions at the top and move run-specific IDs, timestamps, and traces after the stable prefix.",
    "reuse": "Low prompt reuse score detected. Optional structure: put stable task instructions first, then file names, errors, IDs, timestamps, and logs. Trim repeated runtime noise before sending.",
    "tools": "MCP/tool-bloat risk detected. Limit tool exposure with an allowlist (for example `allowed_tools`) so only required tools are loaded.",
    "deferral": "Large MCP tool catalog detected without deferred loading. Enable deferred loading (for example `defer_loading`) for low-frequency tools to reduce token overhead.",
}


# --- normalisation -----------------------------------------------------------------------


def _first(text, pattern, flags, by):
    """Replace an anchored pattern (the only way a first match alone is replaced here)."""
    return F.regexp_replace(text, java(pattern, flags), by)


def normalize_verb(text):
    """N2."""
    bare = _first(text, I_NEED, "i", "")
    word = F.lower(F.regexp_extract(bare, java(r"^([a-z]+ing)\s+", "i"), 1))
    verb = F.element_at(F.create_map(*[F.lit(x) for kv in GERUNDS.items() for x in kv]), F.when(word.isin(*GERUNDS), word))
    return F.when(verb.isNotNull(), F.concat(verb, F.lit(" "), _first(bare, r"^([a-z]+ing)\s+", "i", ""))).otherwise(bare)


def strip_hedges(text):
    """N3."""
    for pattern in HEDGES:
        text = F.regexp_replace(text, java(pattern, "i"), " ")
    return T.trim(F.regexp_replace(text, java(r"\s{2,}"), " "))


def strip_filler(text):
    """N4."""
    for pattern, by in FILLER:
        text = F.regexp_replace(text, java(pattern, "i"), by)
    for pattern, flags, by in TIDY:
        text = F.regexp_replace(text, java(pattern, flags), by)
    return T.trim(F.regexp_replace(text, java(LEADING, "i"), ""))


def content_words(sentence):
    return F.filter(F.split(F.lower(sentence), "[^A-Za-z0-9_]+", -1), lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS))


def sentences(text):
    """Sentences with their closing marks, blank ones left out."""
    marked = F.regexp_replace(text, rf"([.!?]+)[{T.WS}]+", "$1\u0001")
    bodies = F.transform(F.split(marked, "\u0001", -1), T.trim)
    return F.filter(bodies, lambda s: F.regexp_replace(s, "[.!?]+$", "") != "")


def collapse_redundant(text):
    """A sentence goes if 65 % of its content words, repeats counted, were said before."""
    parts = sentences(text)
    start = F.struct(F.array(F.get(parts, F.lit(0))).alias("kept"), content_words(F.get(parts, F.lit(0))).alias("seen"))

    def step(a, s):
        words = content_words(s)
        known = F.size(F.filter(words, lambda w: F.array_contains(a["seen"], w)))
        new = (F.size(words) == 0) | (known / F.size(words) < OVERLAP)
        return F.struct(F.when(new, F.concat(a["kept"], F.array(s))).otherwise(a["kept"]).alias("kept"), F.when(new, F.array_union(a["seen"], words)).otherwise(a["seen"]).alias("seen"))

    folded = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), start, step)["kept"]
    joined = T.trim(F.regexp_replace(F.array_join(folded, " "), java(r"\s{2,}"), " "))
    return F.when(F.size(parts) > 1, joined).otherwise(text)


def capitalize_sentences(text):
    """N6."""
    marked = F.regexp_replace(text, java(r"(^|[.!?]\s+)(?=[a-z])"), "$1\u0001")
    parts = F.split(marked, "\u0001", -1)
    return F.array_join(F.transform(parts, lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2))))), "")


def with_normalized(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """The goal sentence; empty where nothing is left."""
    df = df.withColumn(out, T.trim(_first(T.squeeze(F.col(text_col)), POLITE, "i", "")))
    for step in (normalize_verb, strip_hedges, strip_filler, collapse_redundant, capitalize_sentences):
        df = df.withColumn(out, step(F.col(out)))
    df = df.withColumn(out, T.trim(F.regexp_replace(out, r"[.?!]+\z", "")))
    return df.withColumn(out, F.when(F.col(out) == "", F.lit("")).otherwise(F.concat(F.upper(F.substring(out, 1, 1)), F.substr(F.col(out), F.lit(2)), F.lit("."))))


#: At least three words, none of the given characters.
_THREE = r"(?=(?:[^\s{0}]+\s+){{2}}[^\s{0}])"


def with_constraints(df: DataFrame, text_col: str, cleaned: str, constraints: str) -> DataFrame:
    """Constraint sentences, then clauses, of three words or more, taken out of the text."""
    sentence = java(CONSTRAINT_SENTENCE.replace("((?:Don", _THREE.format(".!?") + "((?:Don"))
    # a match starts where its white space does: no other place in a run need be tried
    clause = java(CONSTRAINT_CLAUSE.replace(r"|\s+but", r"|(?<!\s)\s+but").replace("((don", _THREE.format(",.;!?") + "((don"), "i")
    named = lambda found: F.transform(found, lambda p: F.concat(F.lit("Constraint: "), T.trim(T.squeeze(p)), F.lit(".")))
    df = df.withColumn("_1", F.regexp_extract_all(text_col, F.lit(sentence), F.lit(1))).withColumn(cleaned, F.regexp_replace(text_col, sentence, "."))
    df = df.withColumn("_2", F.regexp_extract_all(cleaned, F.lit(clause), F.lit(2))).withColumn(cleaned, F.regexp_replace(cleaned, clause, ""))
    df = df.withColumn(constraints, F.concat(named(F.col("_1")), named(F.col("_2")))).drop("_1", "_2")
    return df.withColumn(cleaned, T.trim(F.regexp_replace(F.regexp_replace(cleaned, java(r"[,;]\s*\."), "."), java(r"\s{2,}"), " ")))


def inline_path(prompt):
    """The first path named in the prompt, or null."""
    return F.nullif(F.regexp_extract(prompt, INLINE_PATH_JAVA, 1), F.lit(""))


def language_tag(filename):
    """P6."""
    return T.first_case([(T.test(filename, p, "i"), tag) for p, tag in LANGUAGE_TAGS], F.lit(None).cast("string"))


# --- predicates and scores ---------------------------------------------------------------


def is_brevity_sensitive(prompt):
    """P10."""
    return F.coalesce(T.any_of(prompt, BREVITY_SENSITIVE), F.lit(False))


def is_narrow_file_prompt(prompt, file):
    """P12."""
    return F.coalesce(file != "", F.lit(False)) & (T.u16_length(prompt) < 100) & ~T.any_of(prompt, BROAD_SCOPE)


def is_plain_question(prompt):
    """P13."""
    bare = T.trim(prompt)
    return (bare != "") & (bare.endswith("?") | T.any_of(bare, PLAIN_QUESTION))


def response_shape(prompt, kind=None, file=None):
    """The hint, or null."""
    kind = F.coalesce(kind, F.lit("")) if kind is not None else F.lit("")
    file = file if file is not None else F.lit(None).cast("string")
    review = T.test(prompt, r"\breview\b", "i")
    return T.first_case(
        [
            (is_brevity_sensitive(prompt), SHAPES["complete"]),
            ((kind == "diff") & review, SHAPES["diff_review"]),
            (kind == "diff", SHAPES["diff"]),
            (kind == "stack-trace", SHAPES["stack"]),
            (review, SHAPES["review"]),
            (T.test(prompt, r"\bexplain\b", "i"), SHAPES["explain"]),
            (T.test(prompt, r"\b(fix|implement|update|change|refactor)\b", "i"), SHAPES["change"]),
            (is_narrow_file_prompt(prompt, file), SHAPES["narrow"]),
            (is_plain_question(prompt), SHAPES["question"]),
        ],
        F.lit(None).cast("string"),
    )


def volatile_segments(df: DataFrame, prompt_col: str, out: str) -> DataFrame:
    """Struct of the earliest match (0-based, -1 if none) and the summed length of all matches.

    Matches are taken once per pattern, from texts that hold one of its hints; only where
    there are any is the first one's place looked for.
    """
    prompt = F.col(prompt_col)
    none = F.array().cast("array<string>")
    found = lambda p, f, h: F.regexp_extract_all(prompt, F.lit(java(p, f)), F.lit(0))
    df = df.withColumn("_m", F.array(*[F.when(T.hinted(prompt, f, h), found(p, f, h)).otherwise(none) if h else found(p, f, h) for p, f, h in VOLATILE]))
    own = lambda k: F.get(F.col("_m"), F.lit(k))
    first = [F.when(F.size(own(k)) > 0, F.regexp_instr(prompt, F.lit(java(p, f))) - 1) for k, (p, f, _) in enumerate(VOLATILE)]
    total = F.aggregate(F.flatten("_m"), F.lit(0).cast("long"), lambda a, x: a + T.u16_length(x))
    return df.withColumn(out, F.struct(F.coalesce(F.least(*first), F.lit(-1)).cast("int").alias("earliest"), total.alias("chars"))).drop("_m")


def with_cache(df: DataFrame, prompt_col: str, out: str = "cache") -> DataFrame:
    """Struct score, stable_prefix_ratio, volatility_density, earliest_volatile_index.

    Thresholds are held against unrounded ratios.
    """
    df = volatile_segments(df, prompt_col, "_v").withColumn("_n", T.u16_length(prompt_col))
    prefix = F.when((F.col("_n") == 0) | (F.col("_v.earliest") == -1), F.lit(1.0)).otherwise(F.col("_v.earliest") / F.col("_n"))
    density = F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.col("_v.chars") / F.col("_n")))
    df = df.withColumn("_p", prefix).withColumn("_d", density)
    score = (
        F.lit(100)
        - F.when(F.col("_p") < 0.35, 35).when(F.col("_p") < 0.6, 15).otherwise(0)
        - F.when(F.col("_d") > 0.2, 25).when(F.col("_d") > 0.1, 12).otherwise(0)
        - F.when((F.col("_n") > 300) & (F.col("_p") < 0.5), 10).otherwise(0)
    )
    score = F.when(F.col("_n") == 0, F.lit(100)).otherwise(F.greatest(F.lit(0), score))
    cache = F.struct(score.cast("int").alias("score"), T.to_fixed_2(F.col("_p")).alias("stable_prefix_ratio"), T.to_fixed_2(F.col("_d")).alias("volatility_density"), F.when(F.col("_n") == 0, -1).otherwise(F.col("_v.earliest")).cast("int").alias("earliest_volatile_index"))
    return df.withColumn(out, cache).drop("_v", "_n", "_p", "_d")


def with_warnings(df: DataFrame, prompt_col: str, cache_col: str = "cache", file: str | None = None, error: str | None = None, selection: str | None = None, selection_text: str | None = None, kind: str | None = None, out: str = "warnings") -> DataFrame:
    """The warnings that apply, in fixed order. Absent columns count as not given."""
    prompt = F.col(prompt_col)
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False)) if c else F.lit(False)
    has_file, has_error, has_selection = given(file), given(error), given(selection)
    name = F.coalesce(F.col(file), F.lit("")) if file else F.lit("")
    chosen = F.coalesce(F.col(selection_text), F.lit("")) if selection_text else F.lit("")
    what = F.coalesce(F.col(kind), F.lit("")) if kind else F.lit("")
    both = F.concat(prompt, F.lit("\n"), chosen)
    catalog = (F.regexp_count(both, F.lit(java(*TOOL_SCHEMA))) >= 10) | (T.u16_length(both) > 1800)
    tools = T.test(both, *TOOL_CONTEXT)
    instructions = (T.u16_length(chosen) > 1200) & (T.test(chosen, *INSTRUCTION_TEXT) | T.test(name, *INSTRUCTION_FILE))
    cache = lambda f: F.col(f"{cache_col}.{f}")
    rules = {
        "scope": T.any_of(prompt, BROAD_SCOPE) & ~has_file,
        "long": (T.u16_length(prompt) > 500) & ~has_selection,
        "diff": (what == "diff") & ~T.test(prompt, *DIFF_WORD),
        "stack": (what == "stack-trace") & ~has_error,
        "large": T.u16_length(chosen) > 2000,
        "instructions": instructions,
        "vague": T.test(prompt, *VAGUE) & ~has_file & ~has_selection,
        "compound": T.test(prompt, *COMPOUND),
        "review": T.test(prompt, *COSTLY_REVIEW) & (what != "diff") & ~has_selection,
        "preference": T.test(prompt, *PREFERENCE) & ~has_file & ~has_selection,
        "verbosity": (F.regexp_count(prompt, F.lit(java(*VERBOSITY))) >= 2) & ~has_selection,
        "volatile": cache("volatility_density") >= 0.12,
        "prefix": (cache("earliest_volatile_index") != -1) & (cache("stable_prefix_ratio") < 0.35),
        "reuse": cache("score") < 50,
        "tools": tools & (T.test(both, *BROAD_TOOLS) | catalog) & ~T.test(both, *TOOL_ALLOWLIST),
        "deferral": tools & catalog & ~T.test(both, *TOOL_DEFERRAL),
    }
    return df.withColumn(out, F.array_compact(F.array(*[F.when(rules[k], F.lit(w)) for k, w in WARNINGS.items()])))


# --- fingerprint and assembly ------------------------------------------------------------


def fnv1a(text):
    """FNV-1a, 32 bits, over UTF-16 units, as eight hexadecimal digits."""
    wide = F.hex(F.encode(text, "UTF-16BE"))
    # cut by a pattern, not by places: a place in a string is found by walking there
    units = F.transform(F.regexp_extract_all(wide, F.lit("[0-9A-F]{4}"), F.lit(0)), lambda u: F.conv(u, 16, 10).cast("long"))
    h = F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def with_skeleton(df: DataFrame, prompt_col: str, file: str | None = None, output: str | None = None, out: str = "skeleton_id") -> DataFrame:
    """The fingerprint of goal, file, constraints and output shape."""
    df = with_constraints(df, prompt_col, "_cleaned", "_constraints")
    df = with_normalized(df, "_cleaned", "_goal")
    own = F.nullif(F.col(file), F.lit("")) if file else F.lit(None).cast("string")
    path = F.lower(F.coalesce(own, inline_path(F.col(prompt_col)), F.lit("")))
    rules = F.array_join(F.transform("_constraints", lambda c: F.lower(T.trim(F.regexp_replace(c, java(r"^Constraint:\s*", "i"), "")))), "|")
    wanted = F.lower(T.trim(F.coalesce(F.col(output), F.lit("")))) if output else F.lit("")
    source = F.concat_ws("||", F.lower("_goal"), path, rules, wanted)
    return df.withColumn(out, F.concat(F.lit("psk_"), fnv1a(source))).drop("_cleaned", "_constraints", "_goal")


METADATA = ["file", "error", "output", "selection", "selection_text", "xml"]


def optimize(df: DataFrame, prompt_col: str = "prompt") -> DataFrame:
    """Redact, take out constraints, normalise, resolve the context, assemble, assess.

    Metadata columns that are absent count as not given. Adds optimized_prompt, warnings,
    redactions, findings, before_tokens, after_tokens, ratio, cache, context_type and error
    (set where no goal is left; then there is no optimized prompt).
    """
    for c in METADATA:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("boolean" if c == "xml" else "string"))
    fields = ["_prompt", "selection", "selection_text", "error", "output"]  # N11
    df = df.withColumn("_prompt", F.col(prompt_col))
    for c in fields:
        df = secrets.protect(df, c, "file", prefix=f"_{c}_").withColumn(c, F.col(f"_{c}_output"))
    df = df.withColumn("redactions", sum((F.coalesce(F.col(f"_{c}_total"), F.lit(0)) for c in fields), F.lit(0)).cast("int"))
    merged = F.flatten(F.array(*[F.coalesce(F.col(f"_{c}_findings"), F.array().cast("array<struct<id:string,count:int>>")) for c in fields]))
    df = df.withColumn("findings", secrets.merge_findings(merged)).drop(*[f"_{c}_{x}" for c in fields for x in ("output", "total", "findings", "redacted")])
    df = with_constraints(df, "_prompt", "_cleaned", "_constraints")
    df = with_normalized(df, "_cleaned", "_goal")
    # A selection given outright, else a summary of the selected text; a file given, else one named
    df = df.withColumn("_chosen", F.coalesce(F.nullif("selection_text", F.lit("")), F.lit("")))
    df = select.summaries(df, "_chosen", "file")
    has_text = F.col("_chosen") != ""
    df = df.withColumn("context_type", F.when(has_text, F.col("kind")).otherwise(F.lit("prompt-only")))
    df = df.withColumn("_selection", F.coalesce(F.nullif("selection", F.lit("")), F.when(has_text, F.col("summary"))))
    df = df.withColumn("_file", F.coalesce(F.nullif("file", F.lit("")), inline_path(F.col("_prompt")))).drop("kind", "summary")
    tag = language_tag(F.col("_file"))
    goal = F.concat_ws(" ", tag, F.col("_goal"))
    shape = F.coalesce(F.nullif("output", F.lit("")), response_shape(F.col("_prompt"), F.col("context_type"), F.col("_file")))
    error = F.nullif("error", F.lit(""))
    some = F.size("_constraints") > 0
    named = lambda label, x, end="": F.when(x.isNotNull(), F.concat(F.lit(label), x, F.lit(end)))
    plain = F.concat_ws(" ", goal, named("File: ", F.col("_file"), "."), named("Focus: ", F.col("_selection")), named("Error: ", error, "."), F.when(some, F.array_join("_constraints", " ")), shape)
    inner = F.array_join(F.transform("_constraints", lambda c: F.regexp_replace(c, java(r"^Constraint:\s*"), "")), " ")
    slot = lambda t, x: F.when(x.isNotNull(), F.concat(F.lit(f"<{t}>"), x, F.lit(f"</{t}>")))
    xml = F.concat_ws(" ", slot("goal", goal), slot("file", F.col("_file")), slot("context", F.col("_selection")), slot("error", error), slot("constraints", F.when(some, inner)), slot("format", shape))
    df = df.withColumn("optimized_prompt", F.when(F.col("_goal") != "", F.when(F.coalesce("xml", F.lit(False)), xml).otherwise(plain)))
    df = with_cache(df, "_prompt")
    df = with_warnings(df, "_prompt", file="_file", error="error", selection="_selection", selection_text="selection_text", kind="context_type")
    ids = F.array_join(F.transform("findings", lambda f: f["id"]), ", ")
    notice = F.concat(F.lit("High-confidence secret patterns were redacted locally ("), F.col("redactions").cast("string"), F.lit(" match(es): "), ids, F.lit(")."))
    df = df.withColumn("warnings", F.when(F.col("redactions") > 0, F.concat(F.array(notice), F.col("warnings"))).otherwise(F.col("warnings")))
    df = df.withColumn("before_tokens", T.estimate_tokens("_prompt")).withColumn("after_tokens", T.estimate_tokens("optimized_prompt"))
    df = df.withColumn("ratio", T.savings_ratio(F.col("before_tokens"), F.col("after_tokens"))).withColumn("goal_error", F.when(F.col("_goal") == "", F.lit("Prompt text is required.")))
    return df.drop("_prompt", "_cleaned", "_constraints", "_goal", "_chosen", "_selection", "_file")


def fence(content, lang=None):
    """A code fence longer than any run of backticks inside."""
    runs = F.transform(F.regexp_extract_all(content, F.lit("`+"), F.lit(0)), F.length)
    mark = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    return F.concat(mark, F.coalesce(lang, F.lit("")) if lang is not None else F.lit(""), F.lit("\n"), content, F.lit("\n"), mark)


#: What the chat commands do, and what an intent asks for.
CHAT_MODES = {"focus": "pack", "compress": "transform", "outline": "transform", "explain": "answer", "review": "answer", "debug": "answer"}
INTENTS = {"review": "List the highest-risk findings first.", "debug": "Explain the likely root cause first, then the smallest plausible fix.", "explain": "Explain this code."}


def chat_route(command):
    """What a chat command leads to; anything else optimises the prompt."""
    return T.first_case([(command == c, m) for c, m in CHAT_MODES.items()], "optimize")


def intent_prompt(command, content, lang=None):
    """The instruction of an intent with the fenced selection."""
    ask = T.first_case([(command == c, t) for c, t in INTENTS.items()], INTENTS["explain"])
    return F.concat(ask, F.lit("\n\n"), fence(content, lang))


def delta_label(before, after):
    """Percent saved, or that the text was structured where tokens grew."""
    return F.when(after > before, F.lit("structured for clarity")).otherwise(F.concat(T.savings_ratio(before, after).cast("string"), F.lit("% fewer tokens")))
