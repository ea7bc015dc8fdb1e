"""Many literals at once: one automaton pass over a text instead of one search a literal.

As expressions, some eight hundred searches made plans that took longer to compile than to run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType

from ..rules.contexts import RULES
from . import regex


@lru_cache(8)
def automaton(literals: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for x in literals:
        a.add_word(x, x)
    a.make_automaton()
    return a


def _literals(rule: tuple) -> set[str]:
    parts = [*rule[3], *(p for c in rule[4] for p in c)]
    return {x for p in parts for x in (p if isinstance(p, tuple) else (p,))}


ALL = tuple(sorted(set().union(*map(_literals, RULES))))


def rules_of(text: str) -> list[int]:
    """Numbers of the contextual rules that hold for a fuzzy form."""
    found = {x for _, x in automaton(ALL).iter(text)} if text else set()
    if not found:
        return []
    has = lambda p: any(x in found for x in p) if isinstance(p, tuple) else p in found
    return [k for k, (_, _, _, gate, conditions) in enumerate(RULES) if (not gate or has(tuple(gate))) and any(all(map(has, c)) for c in conditions)]


@arrow_udf(ArrayType(IntegerType()))
def context_numbers(forms: pa.Array) -> pa.Array:
    return pa.array([rules_of(x.as_py()) for x in forms], pa.list_(pa.int32()))


def gated(patterns: list[str]):
    """A column function: of texts as gates see them, the numbers of the patterns whose gates are all open."""
    of: dict[str, list[int]] = {}
    always, others = [], {}
    for k, p in enumerate(patterns):
        literals = regex.gate(p)
        if not literals:
            always.append(k)
        for x in literals:
            of.setdefault(x, []).append(k)
        others[k] = [frozenset(g) for g in regex.gates(p) if set(g) != set(literals)]
    words = tuple({*of, *(x for groups in others.values() for g in groups for x in g)})

    @arrow_udf(ArrayType(IntegerType()))
    def numbers(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = automaton(words) if words else None

        def open_to(t: str | None) -> list[int]:
            found = {x for _, x in a.iter(t)} if a and t else set()
            some = {*always, *(k for x in found for k in of.get(x, ()))}
            return sorted(k for k in some if not any(g.isdisjoint(found) for g in others[k]))

        for s in texts:
            yield pa.array([open_to(x.as_py()) for x in s], pa.list_(pa.int32()))

    return numbers
