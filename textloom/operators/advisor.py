"""Task cost tier, routing lane, and small resolvers of the chat surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T

#: Fixed values: (pattern, label); matched on the lower-cased text.
ECONOMY = [
    (r"\brenam(e|ing)\b", "rename"),
    (r"\btypos?\b", "typo fix"),
    (r"\bformat(ting)?\b", "formatting"),
    (r"\bboilerplate\b", "boilerplate"),
    (r"\b(getter|setter)s?\b", "getter/setter"),
    (r"\b(jsdoc|docstrings?|doc comments?)\b", "doc comment"),
    (r"\bimports?\b", "imports"),
    (r"\b(add|insert)\s+(a\s+)?logs?\b", "add logging"),
    (r"\blint(ing)?\b", "lint"),
    (r"\bindent(ation)?\b", "indentation"),
    (r"\bone[- ]?liner\b", "one-liner"),
    (r"\bstubs?\b", "stub"),
    (r"\bspelling\b", "spelling"),
    (r"\bsimple\b", "self-described simple"),
]
PREMIUM = [
    (r"\brefactor(ing)?\b", "refactor"),
    (r"\barchitect(ure|ing)?\b", "architecture"),
    (r"\bdebug(ging)?\b", "debugging"),
    (r"\brace conditions?\b", "race condition"),
    (r"\bconcurren(t|cy)\b", "concurrency"),
    (r"\bdeadlocks?\b", "deadlock"),
    (r"\bmemory leaks?\b", "memory leak"),
    (r"\b(re)?design\b", "design"),
    (r"\bmigrat(e|ion|ing)\b", "migration"),
    (r"\bsecurity\b", "security"),
    (r"\bperformance\b", "performance"),
    (r"\boptimi[sz](e|ation|ing)\b", "optimization"),
    (r"\balgorithms?\b", "algorithm"),
    (r"\broot cause\b", "root-cause analysis"),
    (r"\bwhy (is|does|do|are|did)\b", 'diagnostic "why…"'),
    (r"\b(multi[- ]?file|across (multiple |several )?files)\b", "multi-file"),
    (r"\btrade[- ]?offs?\b", "trade-off reasoning"),
    (r"\bdistributed\b", "distributed system"),
]
LOCAL = [
    (r"\bcompress\b", "compress"),
    (r"\boutline\b", "outline"),
    (r"\bextract\b", "extract"),
    (r"\bredact\b", "redact"),
    (r"\b(shorten|trim|tidy|condense)\b[^.]*\b(output|logs?|context|text|response|answer|paste|dump|diff|json|payload|trace|failure|selection)\b", "shorten output/context"),
]
BATCH = [
    (r"\b(bulk|batch|in bulk)\b", "bulk/batch"),
    (r"\b(every|all)\s+files?\b", "every/all files"),
    (r"\bfor each\b", "for-each"),
    (r"\b(dataset|thousands|corpus)\b", "large dataset"),
    (r"\b(classify|translate)\b", "classify/translate at scale"),
]
SIGNALS = [(ECONOMY, "cheap/mechanical"), (PREMIUM, "needs reasoning"), (LOCAL, "local transform"), (BATCH, "bulk/offline")]
#: Literals of which a match of the label's pattern holds one: texts without them skip the pattern.
HINTS = {
    "rename": ("renam",), "typo fix": ("typo",), "formatting": ("format",), "boilerplate": ("boilerplate",), "getter/setter": ("getter", "setter"),
    "doc comment": ("jsdoc", "docstring", "doc comment"), "imports": ("import",), "add logging": ("log",), "lint": ("lint",), "indentation": ("indent",),
    "one-liner": ("liner",), "stub": ("stub",), "spelling": ("spelling",), "self-described simple": ("simple",),
    "refactor": ("refactor",), "architecture": ("architect",), "debugging": ("debug",), "race condition": ("race condition",), "concurrency": ("concurren",),
    "deadlock": ("deadlock",), "memory leak": ("memory leak",), "design": ("design",), "migration": ("migrat",), "security": ("security",),
    "performance": ("performance",), "optimization": ("optimi",), "algorithm": ("algorithm",), "root-cause analysis": ("root cause",), 'diagnostic "why…"': ("why ",),
    "multi-file": ("file",), "trade-off reasoning": ("trade",), "distributed system": ("distributed",),
    "compress": ("compress",), "outline": ("outline",), "extract": ("extract",), "redact": ("redact",), "shorten output/context": ("shorten", "trim", "tidy", "condense"),
    "bulk/batch": ("bulk", "batch"), "every/all files": ("file",), "for-each": ("for each",), "large dataset": ("dataset", "thousands", "corpus"),
    "classify/translate at scale": ("classify", "translate"),
}
LARGE_SELECTION = 2000
NO_SIGNAL = "no strong signal either way — defaulting to standard"
CONCISE_ALIASES, CONCISE_LEVELS, CONCISE_DEFAULT = {"ultra": "full"}, ["lite", "full"], "full"


def classify_task(text, selection_length=None):
    """Struct tier, routing, reasons, economy_score, premium_score."""
    said = F.lower(F.coalesce(text, F.lit("")))
    size = F.coalesce(selection_length, F.lit(0)) if selection_length is not None else F.lit(0)
    found = {name: F.array_compact(F.array(*[F.when(T.test(said, p, "", HINTS[label]), F.lit(f"{name}: {label}")) for p, label in rules])) for rules, name in SIGNALS}
    cheap, reasoning, local, bulk = found
    large = size > LARGE_SELECTION
    note = F.when(large, F.array(F.concat(F.lit("large selection ("), size.cast("string"), F.lit(" chars) to reason over")))).otherwise(F.array().cast("array<string>"))

    def judge(hits):
        economy, premium = F.size(hits[cheap]), F.size(hits[reasoning]) + large.cast("int")
        reasons = F.concat(*[hits[name] for name in found], note)
        tier = F.when((premium > 0) & (premium >= economy), "premium").when(economy > premium, "economy").otherwise("standard")
        routing = F.when(F.size(hits[local]) > 0, "local-transform").when(F.size(hits[bulk]) > 0, "batch-offline")
        routing = routing.when(tier == "economy", "completion-or-base").when(tier == "premium", "premium").otherwise("auto")
        return F.struct(
            tier.alias("tier"),
            routing.alias("routing"),
            F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit(NO_SIGNAL))).alias("reasons"),
            economy.cast("int").alias("economy_score"),
            premium.cast("int").alias("premium_score"),
        )

    return T.let(F.struct(*[hits.alias(name) for name, hits in found.items()]), judge)  # every signal is tested once


def concise_level(level):
    """Aliases resolved, unknown levels the default."""
    resolved = T.first_case([(level == a, b) for a, b in CONCISE_ALIASES.items()], level)
    return F.when(resolved.isin(*CONCISE_LEVELS), resolved).otherwise(F.lit(CONCISE_DEFAULT))


def concise_label(level):
    resolved = T.first_case([(level == a, b) for a, b in CONCISE_ALIASES.items()], level)
    return F.when(resolved == level, level).otherwise(F.concat(level, F.lit(" → "), resolved))
