"""Validation of model output: canary, leaks, forbidden patterns, length, JSON, custom."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import literals, regex, text
from ..rules.leaks import LEAKS
from ..schema import CANARY_LEAK, OUTPUT_VIOLATION, SPL, added, constant, none, threat
from .guard import Guard


PATTERNS = [p for p, _, _ in LEAKS]


def bank(s: Column, open_: Column, patterns: list[str], threats: list[dict]) -> Column:
    """A threat for every match of every pattern, in their order; ``open_`` are the numbers of those that may match (``literals.gated``).

    Patterns are looked up by number, so that the few that match are run, and none is made again for each use of the result.
    """
    java, about = constant([regex.to_java(p) for p in patterns]), constant(threats)
    of = lambda k: F.element_at(java, k + 1)

    def each(k: Column) -> Column:
        a = F.element_at(about, k + 1)
        return regex.every(s, of(k), lambda hit, start, end: threat(a["kind"], a["severity"], a["message"], "output", hit, start, end))

    return F.when(F.size(open_) > 0, F.flatten(F.transform(F.filter(open_, lambda k: F.rlike(s, of(k))), each))).otherwise(none())


def leaks(s: Column, open_: Column) -> Column:
    """A threat for every match of every leak pattern; texts of under ten bytes, trimmed, are not looked at."""
    found = bank(s, open_, PATTERNS, [{"kind": SPL, "severity": v, "message": m} for _, m, v in LEAKS])
    long = F.octet_length(F.regexp_replace(s, rf"^{text.UNICODE_SPACE}+|{text.UNICODE_SPACE}+$", "")) >= 10
    return F.when((F.size(open_) > 0) & long, found).otherwise(none())


def forbidden(s: Column, open_: Column, patterns: list[str]) -> Column:
    return bank(s, open_, patterns, [{"kind": OUTPUT_VIOLATION, "severity": 0.8, "message": f"output matches forbidden pattern: {p}"} for p in patterns]) if patterns else none()


def is_json(s: Column) -> Column:
    """Whether s is one JSON value and nothing else. Wrapping it two ways shuts out what a lenient parser lets pass after a value.

    Needs spark.sql.variant.allowDuplicateKeys to take objects that repeat a key.
    """
    return F.try_parse_json(F.concat(F.lit("["), s, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), s, F.lit("}"))).isNotNull()


@dataclass
class Output(Guard):
    """``validator`` makes, of the text column, a column with the reason for refusal, or null."""

    forbidden_patterns: list[str] = field(default_factory=list)
    max_length: int = 0
    validate_json: bool = False
    validator: Callable[[Column], Column] | None = None
    name = "output"
    is_output = True

    def apply(self, df: DataFrame) -> DataFrame:
        s, found = F.col("input"), []
        if "meta_canary_token" in df.columns:
            token = F.coalesce("meta_canary_token", F.lit(""))
            k = F.instr(text.lowered(s), text.lowered(token))
            a = F.octet_length(F.substring(text.lowered(s), F.lit(1), k - 1))
            hit = F.substring(F.encode(s, "UTF-8"), a + 1, F.octet_length(token)).cast("string")
            found.append(F.when((token != "") & (k > 0), F.array(threat(CANARY_LEAK, 1.0, "canary token detected in LLM output, indicating prompt data exfiltration", self.name, hit, a, a + F.octet_length(token)))))
        df = df.withColumn("_open", literals.gated([*PATTERNS, *self.forbidden_patterns])(regex.for_gate(s)))
        n = len(PATTERNS)
        found += [leaks(s, F.filter("_open", lambda k: k < n)), forbidden(s, F.transform(F.filter("_open", lambda k: k >= n), lambda k: k - n), self.forbidden_patterns)]
        if self.max_length > 0:
            size = F.octet_length(s)
            message = F.format_string(f"output length %d exceeds maximum allowed length {self.max_length}", size)
            found.append(F.when(size > self.max_length, F.array(threat(OUTPUT_VIOLATION, 0.5, message, self.name))))
        if self.validate_json:
            found.append(F.when(~is_json(s), F.array(threat(OUTPUT_VIOLATION, 0.6, "output is not valid JSON", self.name))))
        if self.validator is not None:
            reason = self.validator(s)
            found.append(F.when(reason.isNotNull(), F.array(threat(OUTPUT_VIOLATION, 0.7, F.concat(F.lit("custom validation failed: "), reason), self.name))))
        return added(df, F.flatten(F.array_compact(F.array(*found)))).drop("_open")
