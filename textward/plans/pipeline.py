"""Pipelines: ordered guards as one plan, a verdict for each row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..operators.guard import Guard
from ..schema import META, safe, started

#: Columns of the context that a caller's table may have too; the caller's are kept under another name meanwhile,
#: and so are those with names like the guards' own passing columns and metadata.
CONTEXT, HELD = ("input", "raw_input"), "_held_"


def _clashes(name: str) -> bool:
    return name in CONTEXT or name.startswith(("_", META))


@dataclass
class Pipeline:
    guards: list[Guard] = field(default_factory=list)

    def _run(self, df: DataFrame, outputs: bool) -> DataFrame:
        chain = [g for g in self.guards if g.is_output == outputs]
        for g in chain:
            df = df.transform(g.apply)
        for g in reversed(chain):
            df = df.transform(g.after)
        return df

    def _result(self, df: DataFrame, given: list[str]) -> DataFrame:
        known = [c for c in df.columns if c.startswith(META)]
        meta = F.struct(*[F.col(f"`{c}`").alias(c.removeprefix(META)) for c in known]) if known else F.struct(F.lit(None).cast("string").alias("none"))
        kept = [F.col(f"`{HELD + c if c in self._held(given) else c}`").alias(c) for c in given]
        return df.select(*kept, safe(F.col("threats")).alias("safe"), "threats", F.col("input").alias("output"), meta.alias("metadata"), "trust_level", "halted")

    def _held(self, given: list[str]) -> list[str]:
        """Columns to be kept under another name; guards' keys are read by name and stay."""
        keys = {getattr(g, "key", None) for g in self.guards}
        return [c for c in given if _clashes(c) and c not in keys]

    def analyze(self, df: DataFrame, text: str = "text") -> DataFrame:
        """df with safe, threats, output, metadata, trust_level, halted; df may not have columns of these names."""
        return self._result(self._run(_opened(df, text, self._held(df.columns)), False), df.columns)

    def validate_output(self, df: DataFrame, text: str = "text", metadata: str | None = None) -> DataFrame:
        """The same for model output. ``metadata`` names a struct column with the values of an earlier analysis."""
        held = self._held(df.columns)
        out = _opened(df, text, held)
        if metadata:
            values = F.col(f"`{HELD + metadata if metadata in held else metadata}`")
            out = out.withColumns({META + f: values[f] for f in df.schema[metadata].dataType.names})
        return self._result(self._run(out, True), df.columns)


def _opened(df: DataFrame, text: str, held: list[str]) -> DataFrame:
    if clash := {"safe", "threats", "output", "trust_level", "halted"} & set(df.columns):
        raise ValueError(f"columns to be renamed first: {sorted(clash)}")
    names = {c: HELD + c for c in held}
    return started(df.withColumnsRenamed(names), names.get(text, text))
