"""n-gram similarity classifier over a bank of labelled vectors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vectors
from ..functions.text import fixed
from ..rules.seeds import SEEDS
from ..schema import CUSTOM, THREATS, added, constant, metadata, none, threat
from .guard import Guard

DEFAULT = 0.75


@dataclass(frozen=True)
class Vector:
    label: str
    values: tuple[float, ...]
    kind: str = CUSTOM


def seeds() -> list[Vector]:
    return [Vector(label, tuple(vectors.vector(phrase)), kind) for phrase, label, kind in SEEDS]


@dataclass
class Embedding(Guard):
    threshold: float = DEFAULT
    custom: list[Vector] = field(default_factory=list)
    name = "embedding"

    def apply(self, df: DataFrame) -> DataFrame:
        bank, least = [*seeds(), *self.custom], self.threshold or DEFAULT
        df = df.withColumn("_sims", vectors.similarities([list(v.values) for v in bank])(F.when(~F.col("halted"), F.col("input"))))
        about = constant([{"label": v.label, "kind": v.kind or CUSTOM} for v in bank])

        def one(x: Column) -> Column:
            message = F.concat(F.lit("embedding similarity "), fixed(x["sim"], 4), F.lit(' with attack vector "'), x["about"]["label"], F.lit('"'))
            return threat(x["about"]["kind"], x["sim"], message, self.name, F.col("input"), 0, F.octet_length("input"))

        # the few alike enough are looked up, so that the plan doesn't grow with the bank
        near = F.filter(F.zip_with("_sims", about, lambda sim, a: F.struct(sim.alias("sim"), a.alias("about"))), lambda x: x["sim"] >= least)
        df = added(df, F.coalesce(F.transform(near, one).cast(THREATS), none()))
        last = {v.label: k for k, v in enumerate(bank)}  # of equal labels the last one is kept
        sims = F.transform(constant(list(last.values())), lambda k: F.get("_sims", k))
        scores = F.when(F.col("_sims").isNotNull(), F.map_from_arrays(constant(list(last)), sims))
        return metadata(df, {"embedding_scores": scores}).drop("_sims")
