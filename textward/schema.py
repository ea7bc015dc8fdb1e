"""Records, enumerations and the columns that guards read and write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .functions.text import fixed

# Threat types.
IO, RM, DI, SPL, EA = "instruction_override", "role_manipulation", "delimiter_injection", "system_prompt_leak", "encoding_attack"
CANARY_LEAK, STRUCTURE_VIOLATION, OUTPUT_VIOLATION, CUSTOM = "canary_leak", "structure_violation", "output_violation", "custom"

# Trust levels in ascending order.
TRUST = ["untrusted", "unknown", "trusted", "system"]
UNTRUSTED, UNKNOWN, TRUSTED, SYSTEM = range(4)

THREAT = StructType(
    [
        StructField("type", StringType()),
        StructField("severity", DoubleType()),
        StructField("message", StringType()),
        StructField("guard", StringType()),
        StructField("match", StringType()),
        StructField("start", IntegerType()),
        StructField("end", IntegerType()),
    ]
)
THREATS = ArrayType(THREAT)
#: A threat of this severity makes a text unsafe.
UNSAFE = 0.5
META = "meta_"


def _constant(value: object) -> str:
    """SQL text of a constant. Strings with signs that parsers read are written as their bytes."""
    if isinstance(value, dict):
        return "named_struct(" + ", ".join(f"'{k}', {_constant(v)}" for k, v in value.items()) + ")"
    if isinstance(value, list):
        return "array(" + ", ".join(map(_constant, value)) + ")"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, str):
        return f"cast(X'{value.encode('utf-8', 'surrogatepass').hex()}' as string)" if set(value) & set("\\'$") else f"'{value}'"
    return str(value)


def constant(value: object) -> Column:
    """A column of one constant: text, number, list of constants, or dict, a struct.

    Tables of constants are parsed at once from one text: made sign by sign, a column each, they took longer than small queries run.
    """
    return F.expr(_constant(value))


def threat(kind: Column | str, severity: Column | float, message: Column | str, guard: str, match: Column | str = "", start: Column | int = 0, end: Column | int = 0) -> Column:
    """One threat; start and end are byte offsets. Plain strings and numbers are literals."""
    values = (kind, severity if isinstance(severity, Column) else float(severity), message, guard, match, start, end)
    if not any(isinstance(v, Column) for v in values):
        return constant(dict(zip(THREAT.names, values, strict=True)))
    typed = [v.cast(f.dataType) if isinstance(v, Column) and not isinstance(f.dataType, StringType) else v if isinstance(v, Column) else F.lit(v) for v, f in zip(values, THREAT.fields, strict=True)]
    return F.struct(*[v.alias(f.name) for v, f in zip(typed, THREAT.fields, strict=True)])


def none() -> Column:
    return F.array().cast(THREATS)


def compact(candidates: list[Column], width: int = 16) -> Column:
    """The candidates that aren't null, in order. Wide lists are cut up, so that generated code stays within limits."""
    if not candidates:
        return none()
    parts = [F.array_compact(F.array(*candidates[k : k + width])) for k in range(0, len(candidates), width)]
    return (parts[0] if len(parts) == 1 else F.concat(*parts)).cast(THREATS)


def trust_name(level: Column) -> Column:
    named = F.lit("invalid")
    for k, name in enumerate(TRUST):
        named = F.when(level == k, name).otherwise(named)
    return named


def started(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns of a fresh context. Null texts are empty."""
    given = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return df.withColumns({"raw_input": given, "input": given, "threats": none(), "halted": F.lit(False), "trust_level": F.lit(UNKNOWN)})


def added(df: DataFrame, found: Column) -> DataFrame:
    """Append threats to the rows that aren't halted."""
    return df.withColumn("threats", F.when(F.col("halted"), F.col("threats")).otherwise(F.concat("threats", found)))


def metadata(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Set metadata of the rows that aren't halted; a value that is null leaves what was there."""
    out = {}
    for name, value in values.items():
        column = META + name
        before = F.col(f"`{column}`") if column in df.columns else F.lit(None)
        out[column] = F.when(F.col("halted"), before).otherwise(F.coalesce(value, before))
    return df.withColumns(out)


def rewritten(df: DataFrame, text: Column) -> DataFrame:
    return df.withColumn("input", F.when(F.col("halted"), F.col("input")).otherwise(text))


def max_severity(threats: Column) -> Column:
    return F.aggregate(threats, F.lit(0.0), lambda a, t: F.greatest(a, t["severity"]))


def has_type(threats: Column, kind: str) -> Column:
    return F.exists(threats, lambda t: t["type"] == kind)


def safe(threats: Column) -> Column:
    return ~F.exists(threats, lambda t: t["severity"] >= UNSAFE)


def error_text(threats: Column) -> Column:
    """How an error that carries the threats reads."""
    one = lambda t: F.format_string("[%s] %s (severity=%s)", t["type"], t["message"], fixed(t["severity"], 2))
    return F.when(F.size(threats) == 0, F.lit("prompt injection detected")).otherwise(F.concat(F.lit("prompt injection detected: "), F.array_join(F.transform(threats, one), "; ")))
