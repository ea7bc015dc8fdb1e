"""Task policies: which tasks a text asks for, and which of them the application forbids.

A ``Policy`` is one for all rows. With ``TablePolicy`` each row names its own, and policies are a table (policy, task, allowed,
severity): what a policy forbids are the tasks of its rows that disallow, less those of its rows that allow. The table may be
of any size; it comes down to one row a policy, with at most the known tasks, and Spark sends that round only if it is small.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import literals, text
from ..rules.policies import POLICIES, TASK_RULES, TASKS
from ..schema import THREATS, added, constant, metadata, none, threat
from .guard import Guard


#: All phrases that rules look for in a text's policy form, and in its lower case.
PHRASES = tuple(sorted({p for *_, parts, _ in TASK_RULES for p in parts}))
RAW = sorted({p for *_, raw in TASK_RULES for p in raw})


def _numbers(form: str, given: str, wanted: set[str] | None) -> list[int]:
    """Numbers of the rules that are the first of their task to hold, ascending."""
    found = {x for _, x in literals.automaton(PHRASES).iter(form)} if form else set()
    if "++" in given:  # which all of RAW have
        low = given.replace("İ", "i").replace("Σ", "σ").lower()
        found.update(p for p in RAW if p in low)
    out, seen = [], set()
    for k, (task, _, _, parts, raw) in enumerate(TASK_RULES) if found else ():
        if task not in seen and (wanted is None or task in wanted) and found.issuperset(parts) and found.issuperset(raw):
            seen.add(task)
            out.append(k)
    return out


def asked(given: Column, wanted: set[str] | None = None) -> Column:
    """For each (wanted) task that a text asks for: task, type and phrase of its first rule that holds, in rule order. Null for null texts.

    A text is looked through once, for all phrases. As expressions they were searched one by one, in forms that
    were made anew for most of them, and again for each filter that Spark infers; so the step is marked as one not to be repeated.
    """

    @arrow_udf(ArrayType(IntegerType()))
    def numbers(forms: pa.Array, texts: pa.Array) -> pa.Array:
        each = (None if t is None else _numbers(f, t, wanted) for f, t in zip(forms.to_pylist(), texts.to_pylist(), strict=True))
        return pa.array(each, pa.list_(pa.int32()))

    about = constant([{"task": task, "type": kind, "phrase": phrase} for task, kind, phrase, *_ in TASK_RULES])
    return F.transform(numbers.asNondeterministic()(text.policy_form(given), given), lambda k: F.element_at(about, k + 1))


@dataclass
class Policy(Guard):
    policy_name: str = "context"
    disallowed: list[str] = field(default_factory=list)
    allowed: list[str] = field(default_factory=list)
    severity: float = 0.75
    name = "policy"

    @classmethod
    def named(cls, name: str) -> Policy:
        disallowed, allowed = POLICIES[name]
        return cls(name, list(disallowed), list(allowed))

    def apply(self, df: DataFrame) -> DataFrame:
        forbidden = set(self.disallowed) - set(self.allowed)
        if not forbidden:
            return df
        name, severity = self.policy_name or "context", self.severity or 0.75
        df = df.withColumn("_asked", asked(F.col("input"), forbidden))
        found = F.transform("_asked", lambda t: threat(t["type"], severity, F.concat(F.lit(f"task is disallowed by {name} policy: "), t["task"]), self.name, t["phrase"]))
        any_found = F.size("_asked") > 0
        df = metadata(added(df, found.cast(THREATS)), {"policy_detected": F.when(any_found, True), "policy_name": F.when(any_found, F.lit(name))})
        return df.drop("_asked")


RULES = "policy string, task string, allowed boolean, severity double"


def built_in(spark: SparkSession) -> DataFrame:
    """The built-in policies as a table."""
    rows = [(name, task, k == 1, None) for name, lists in POLICIES.items() for k, each in enumerate(lists) for task in each]
    return spark.createDataFrame(rows, RULES)


def forbidden(policies: DataFrame) -> DataFrame:
    """(policy, tasks, severity): a row for each policy that forbids a known task. The severity is the greatest that its rows name, else null."""
    known = policies.where(F.col("policy").isNotNull() & F.col("task").isin(TASKS)).select("policy", "task", "allowed", "severity")
    allowed = known.where("allowed").select("policy", "task")
    left = known.where("not coalesce(allowed, false)").join(allowed, ["policy", "task"], "left_anti")
    return left.groupBy("policy").agg(F.sort_array(F.collect_set("task")).alias("tasks"), F.max("severity").alias("severity"))


@dataclass
class TablePolicy(Guard):
    """``key`` names the column with each row's policy; ``policies`` is a table as ``RULES`` says.

    Defined results: a null or unknown policy forbids nothing; a task both allowed and disallowed is allowed; a null ``allowed``
    disallows; repeated rows count once; tasks that no rule knows are ignored; a null or zero severity is the guard's; an empty
    table forbids nothing. It also runs on streams, with a table that is not one.
    """

    policies: DataFrame
    key: str = "policy"
    severity: float = 0.75
    name = "policy"

    def apply(self, df: DataFrame) -> DataFrame:
        names = df.columns
        own = [f"_{self.key}_{c}" for c in ("policy", "tasks", "severity", "all", "asked")]  # none of them is the key
        name, banned, severity, every, some = (F.col(f"`{c}`") for c in own)
        table = forbidden(self.policies)
        df = df.join(table.select(*[F.col(c).alias(o) for c, o in zip(table.columns, own, strict=False)]), F.col(f"`{self.key}`") == name, "left")
        df = df.withColumn(own[3], asked(F.when(banned.isNotNull(), F.col("input"))))
        df = df.withColumn(own[4], F.filter(every, lambda t: F.array_contains(banned, t["task"])))
        level = F.when(severity > 0, severity).otherwise(self.severity or 0.75)
        message = F.concat(F.lit("task is disallowed by "), name, F.lit(" policy: "))
        found = F.transform(some, lambda t: threat(t["type"], level, F.concat(message, t["task"]), self.name, t["phrase"]))
        any_found = F.size(some) > 0
        df = metadata(added(df, F.coalesce(found, none())), {"policy_detected": F.when(any_found, True), "policy_name": F.when(any_found, name)})
        return df.select(*[F.col(f"`{c}`") for c in [*names, *(c for c in df.columns if c not in names and not c.startswith("_"))]])
