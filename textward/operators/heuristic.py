"""Heuristic detector: pattern bank, encodings, contextual rules, fuzzy keywords. It reads the text only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import literals, regex, text
from ..functions.fuzzy import fuzzy_keywords
from ..rules.contexts import RULES
from ..rules.patterns import PATTERNS
from ..schema import CUSTOM, EA, IO, THREAT, UNSAFE, added, constant, metadata, none, threat
from .guard import Guard

# Severity floors of the presets.
FLOORS = {"strict": 0.0, "moderate": 0.5, "lenient": 0.7}

# Words that make an encoded payload suspicious, in order.
PAYLOAD_WORDS = ["ignore", "disregard", "forget", "override", "instructions", "system", "prompt", "assistant", "pretend", "act as", "you are", "new role", "reveal", "repeat", "output"]
# Words looked for in spaced-out letters, in order.
SPACED_WORDS = ["ignore", "forget", "disregard", "override", "pretend", "instructions", "system", "prompt", "bypass", "reveal"]
# Expressions of encodings.
BASE64_RUN = r"[A-Za-z0-9+/]{32,}={0,3}"
ESCAPES = [
    (r"(?:\\x[0-9A-Fa-f]{2}){4,}", 0.75, "hex escape sequence detected, potential encoding-based evasion"),
    (r"(?:0x[0-9A-Fa-f]{2}[\s,]*){4,}", 0.7, "hex literal sequence detected, potential encoding-based evasion"),
    (r"(?:\\[uU][0-9A-Fa-f]{4,8}){3,}", 0.75, "unicode escape sequence detected, potential encoding-based evasion"),
]
# What each of them begins with, and what spaced-out letters hold: tested first, as most texts have neither.
ESCAPE_SIGNS = ["\\x", "0x", "\\"]
SINGLES = r"(?s)[\t\n\f\r ].[\t\n\f\r ].[\t\n\f\r ]"
SPACED = r"(?i)\b[a-z]\s[a-z](?:\s[a-z]){3,}\b"


@dataclass(frozen=True)
class Pattern:
    """A custom pattern in RE2 syntax; an invalid one is an error."""

    pattern: str
    kind: str = CUSTOM
    severity: float = 0.0
    message: str = ""


def bank(s: Column, gates: Column, patterns: list[Pattern], name: str = "heuristic") -> Column:
    """A threat for the first match of each pattern; ``gates`` are the numbers of those that may match (``literals.gated``)."""
    if not patterns:
        return none()
    about = constant([{"kind": p.kind, "severity": float(p.severity), "message": p.message} for p in patterns])

    def one(x: Column) -> Column:
        p = F.element_at(about, x["k"] + 1)
        return threat(p["kind"], p["severity"], p["message"], name, x["hit"], x["start"], x["end"])

    return F.when(F.size(gates) > 0, F.transform(regex.first_matches(s, gates, [p.pattern for p in patterns]), one)).otherwise(none())


def encodings(s: Column) -> Column:
    found = [
        F.when(text.has_invisible(s), F.array(threat(EA, 0.3, "input contains zero-width or invisible characters that may hide injected content", "heuristic"))),
        F.when(text.is_suspicious(s), F.array(threat(EA, 0.7, "input contains confusable/homoglyph characters that may bypass pattern matching", "heuristic"))),
        F.when(s.rlike(BASE64_RUN), base64_words(s)),
        *[F.when(s.contains(sign) & s.rlike(regex.to_java(p)), escapes(s, p, severity, message)) for (p, severity, message), sign in zip(ESCAPES, ESCAPE_SIGNS, strict=True)],
        F.when(s.rlike(SINGLES) & s.rlike(regex.to_java(SPACED)), spaced_letters(s)),
    ]
    return F.flatten(F.array_compact(F.array(*found)))


def base64_words(s: Column) -> Column:
    """Runs whose plain text has a suspicious word; the first in the list's order is named."""

    def one(hit: Column, a: Column, b: Column) -> Column:
        # through an array of one, so that the run is decoded once and not for each word
        plain = F.array(text.lowered(F.try_validate_utf8(F.try_to_binary(hit, F.lit("base64")).cast("string"))))
        word = F.transform(plain, lambda x: text.first_word(x, PAYLOAD_WORDS))[0]
        return F.when(word.isNotNull(), threat(EA, 0.9, F.concat(F.lit("base64-encoded payload contains suspicious keyword: "), word), "heuristic", hit, a, b))

    return F.array_compact(regex.every(s, BASE64_RUN, one))


def escapes(s: Column, pattern: str, severity: float, message: str) -> Column:
    return regex.every(s, pattern, lambda hit, a, b: threat(EA, severity, message, "heuristic", hit, a, b))


def spaced_letters(s: Column) -> Column:
    hit = F.regexp_substr(s, F.lit(regex.to_java(SPACED)))
    joined = F.replace(hit, F.lit(" "), F.lit(""))
    word = text.first_word(text.lowered(joined), SPACED_WORDS)
    hidden = threat(EA, 0.8, F.concat(F.lit("spaced-out characters detected hiding keyword: "), word), "heuristic", hit)
    plain = threat(EA, 0.6, "spaced-out characters detected, potential obfuscation evasion", "heuristic", hit)
    return F.array_compact(F.array(F.when(word.isNotNull(), hidden).when(F.octet_length(joined) >= 7, plain)))


def contexts(form: Column) -> Column:
    """Contextual rules over the fuzzy form. Gates count: without one, the conditions don't apply."""
    each = constant([dict(zip(THREAT.names, (kind, float(severity), message, "heuristic", "", 0, 0), strict=True)) for kind, severity, message, _, _ in RULES])
    return F.transform(literals.context_numbers(form), lambda k: F.element_at(each, k + 1))


def fuzzy(s: Column, found: Column, compacted: Column) -> Column:
    """Two keywords make a threat, a stronger one if any was disguised."""
    # through an array of one, so that the text is lowered once and not for each keyword
    disguised = F.exists(F.array(text.lowered(s)), lambda raw: F.exists(found, lambda k: k["approximate"] | (compacted.contains(k["keyword"]) & ~raw.contains(k["keyword"]))))
    weak = threat(IO, 0.35, "multiple injection-related keywords present", "heuristic")
    strong = threat(IO, 0.65, "fuzzy match detected multiple injection-related keywords (possible typo evasion)", "heuristic")
    return F.when(F.size(found) >= 2, F.array(F.when(disguised, strong).otherwise(weak))).otherwise(none())


@dataclass
class Heuristic(Guard):
    preset: str = "strict"
    threshold: float = 0.0
    custom: list[Pattern] = field(default_factory=list)
    halt_on_detect: bool = False
    name = "heuristic"

    def patterns(self) -> list[Pattern]:
        """Those at or above the floor: the threshold, or the preset's where it is zero."""
        floor = self.threshold if self.threshold > 0 else FLOORS[self.preset]
        given = [Pattern(p, kind, severity, message) for p, kind, severity, message in PATTERNS]
        return [p for p in [*given, *self.custom] if p.severity >= floor]

    def apply(self, df: DataFrame) -> DataFrame:
        names = df.columns
        # shared columns are made once, below the tests that read them
        df = df.withColumns({"_low": regex.for_gate(F.col("input")), "_form": text.fuzzy_form(F.col("input"))}).withColumn("_compact", F.replace("_form", F.lit(" "), F.lit("")))
        patterns, live = self.patterns(), lambda c: F.when(~F.col("halted"), F.col(c))
        df = df.withColumns({"_words": fuzzy_keywords(live("_form")), "_gates": literals.gated([p.pattern for p in patterns])(live("_low")), "_rules": contexts(live("_form"))})
        s = F.col("input")
        found = F.concat(bank(s, F.col("_gates"), patterns), encodings(s), F.col("_rules"), fuzzy(s, F.col("_words"), F.col("_compact")))
        df = df.withColumn("_found", F.when(F.col("halted"), none()).otherwise(found))
        if self.halt_on_detect:
            # the row stops at its first blocking threat; what follows isn't reported
            at = F.array_position(F.transform("_found", lambda t: t["severity"] >= UNSAFE), True)
            df = df.withColumn("_at", at)
            df = df.withColumn("threats", F.concat("threats", F.when(F.col("_at") > 0, F.slice("_found", F.lit(1), F.col("_at").cast("int"))).otherwise(F.col("_found"))))
            df = df.withColumn("halted", F.col("halted") | (F.col("_at") > 0))
        else:
            df = added(df, F.col("_found"))
        df = metadata(df, {"heuristic_detected": F.when(F.size("_found") > 0, True)})
        return df.select(*[F.col(f"`{c}`") for c in [*names, *(c for c in df.columns if c not in names and not c.startswith("_"))]])
