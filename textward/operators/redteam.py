"""Red-team runs and detection metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.pipeline import Pipeline
from ..rules.corpus import CORPUS
from ..schema import DI, EA, IO, RM, SPL

SCHEMA = "category string, name string, input string, expected boolean"
# Categories in the report's order.
CATEGORIES = [IO, RM, DI, SPL, EA]


def corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CORPUS, SCHEMA)


def chosen(attacks: DataFrame, categories: list[str] | None) -> DataFrame:
    """Attacks of the categories, and all benign rows."""
    return attacks if not categories else attacks.where((F.col("category") == "") | F.col("category").isin(categories))


def results(pipeline: Pipeline, attacks: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Each attack with ``detected`` and its threats."""
    return pipeline.analyze(chosen(attacks, categories), "input").select("category", "name", "input", "expected", (~F.col("safe")).alias("detected"), "threats")


def rate(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def summary(found: DataFrame) -> DataFrame:
    e, d = F.col("expected"), F.col("detected")
    counts = found.agg(
        F.count_if(e).alias("total_attacks"), F.count_if(e & d).alias("detected"), F.count_if(e & ~d).alias("missed"), F.count_if(~e & d).alias("false_positives"), F.count_if(~e).alias("benign")
    )
    return counts.select("total_attacks", "detected", "missed", "false_positives", rate(F.col("detected"), F.col("total_attacks")).alias("detection_rate"), rate(F.col("false_positives"), F.col("benign")).alias("false_positive_rate"))


def by_category(found: DataFrame) -> DataFrame:
    d = F.col("detected")
    counts = found.where("expected").groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count_if(d).alias("found"))
    return counts.select("category", "total", F.col("found").alias("detected"), (F.col("total") - F.col("found")).alias("missed"), rate(F.col("found"), F.col("total")).alias("detection_rate"))


def coverage(found: DataFrame) -> DataFrame:
    """Counts by preset and category with their totals, from results that have a ``preset``; missed attacks by name."""
    e, d = F.col("expected"), F.col("detected")
    return found.where(e).rollup("preset", "category").agg(F.count(F.lit(1)).alias("total"), F.count_if(d).alias("detected"), F.array_sort(F.collect_list(F.when(~d, F.col("name")))).alias("missed"))


def confusion(found: DataFrame, label: str = "label", flagged: str = "flagged") -> DataFrame:
    """Counts of the confusion matrix, TPR and FPR."""
    y, p = F.col(label).cast("boolean"), F.col(flagged).cast("boolean")
    c = found.agg(F.count_if(y & p).alias("tp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"))
    return c.select("tp", "fn", "fp", "tn", rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"), rate(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"))


def nearest_rank(column: str, percent: float) -> Column:
    """Aggregate: the value at position ceil(p n) of the sorted ones."""
    return F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY `{column}`)")


def short(df: DataFrame, text: str, most: int = 512) -> DataFrame:
    return df.where(F.octet_length(text) <= most)


def _cut(s: str) -> str:
    raw = s.encode()
    return (raw[:77] + b"...").decode("utf-8", "replace") if len(raw) > 80 else s


def report(found: DataFrame) -> str:
    """The run as text; it collects the summary, the categories, and the rows that went wrong."""
    s = summary(found).first()
    line = "-" * 61
    out = ["=" * 61, "PREFLIGHT RED-TEAM REPORT".center(62).rstrip(), "=" * 61, ""]
    out += [f"Total attacks:      {s.total_attacks}", f"Detected:           {s.detected}", f"Missed:             {s.missed}", f"False positives:    {s.false_positives}"]
    out += [f"Detection rate:     {s.detection_rate:.1%}", f"False positive rate: {s.false_positive_rate:.1%}"]
    parts = {r.category: r for r in by_category(found).collect()}
    if parts:
        out += ["", line, "  Per-Category Breakdown", line]
        for c in [*CATEGORIES, *sorted(set(parts) - set(CATEGORIES))]:
            if r := parts.get(c):
                out += ["", f"  {c:<25}  {r.detected}/{r.total} detected  ({r.detection_rate:.1%})"] + ([f"    Missed: {r.missed}"] if r.missed else [])
    wrong = found.where(F.col("expected") != F.col("detected")).collect()
    for title, rows in (("Missed Attacks", [r for r in wrong if r.expected]), ("False Positives", [r for r in wrong if not r.expected])):
        if rows:
            out += ["", line, f"  {title}", line]
        for k, r in enumerate(rows, 1):
            out += ["", f"  {k}. [{r.category}] {r.name}" if r.expected else f"  {k}. {r.name}", f'     Input: "{_cut(r.input)}"']
            out += [f"     Flagged: [{t.type}] {t.message} (severity={t.severity:.2f})" for t in r.threats if not r.expected]
    if not wrong:
        out += ["", line, "  All attacks detected. No false positives. Looking good!", line]
    return "\n".join([*out, "", "=" * 61, ""])
