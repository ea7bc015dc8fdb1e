"""Pipelines and attack memory over streams.

Guards without memory are narrow, so a pipeline runs unchanged on a streaming DataFrame. Memory is
ordered state: one store for each value of a key (a tenant; a single value gives one global store),
with the last ``capacity`` signatures and an index of their trigrams. Rows are taken in order of arrival within a batch.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.memory import CAPACITY, THRESHOLD
from ..plans.pipeline import Pipeline


def screened(stream: DataFrame, pipeline: Pipeline, text: str = "text") -> DataFrame:
    return pipeline.analyze(stream, text)


def grams(text: str) -> Counter:
    s = (text or "").translate({0x130: "i", 0x3A3: "σ"}).lower().strip()
    return Counter(s[k : k + 3] for k in range(len(s) - 2))


class Store:
    """The last ``capacity`` signatures, by number, with the numbers of those that have each trigram.

    Equal signatures share one entry, so that copies cost a look into a table. A question adds up the trigrams it shares with
    entries whose sizes allow the threshold, rare trigrams first; past the first n - ceil(t n) + 1 elements no new entry can be like it.
    """

    def __init__(self, threshold: float, capacity: int) -> None:
        self.threshold, self.capacity, self.next = threshold, capacity, 0
        self.rows: dict[int, tuple] = {}
        #: numbers of the rows with a signature, oldest first; what it is; its size; the signatures with a trigram
        self.copies: dict[tuple, deque] = {}
        self.sizes: dict[tuple, int] = {}
        self.having: dict[str, dict[tuple, int]] = {}

    def add(self, text: str, kind: str, severity: float) -> None:
        of = grams(text)
        sign = tuple(sorted(of.items()))
        if sign not in self.copies:
            self.copies[sign], self.sizes[sign] = deque(), sum(of.values())
            for g, n in of.items():
                self.having.setdefault(g, {})[sign] = n
        self.copies[sign].append(self.next)
        self.rows[self.next] = (sign, text, kind, severity)
        self.next += 1
        if len(self.rows) > self.capacity:
            self._forget(self.next - 1 - self.capacity)

    def _forget(self, number: int) -> None:
        sign = self.rows.pop(number)[0]
        self.copies[sign].popleft()
        if self.copies[sign]:
            return
        del self.copies[sign], self.sizes[sign]
        for g, _ in sign:
            del self.having[g][sign]
            if not self.having[g]:
                del self.having[g]

    def best(self, text: str) -> tuple[float, str, float] | None:
        """Likeness, kind and severity of the most similar row; of equals the one stored first."""
        of = grams(text)
        sign, n = tuple(sorted(of.items())), sum(of.values())
        if sign in self.copies:
            return 1.0, *self.rows[self.copies[sign][0]][2:]
        left, shared = n - math.ceil(self.threshold * n - 1e-9) + 1, {}
        for g in sorted(of, key=lambda g: (len(self.having.get(g, ())), g)):
            of_g = self.having.get(g, {})
            if left > 0:
                for other, m in of_g.items():
                    if self.threshold * n - 1e-9 <= self.sizes[other] <= n / self.threshold + 1e-9:
                        shared[other] = shared.get(other, 0) + min(m, of[g])
            else:
                for other in shared:
                    shared[other] += min(of_g.get(other, 0), of[g])
            left -= of[g]
        likes = [(both / (n + self.sizes[other] - both), -self.copies[other][0]) for other, both in shared.items()]
        sim, at = max(likes, default=(0.0, 0))
        return (sim, *self.rows[-at][2:]) if likes and sim >= self.threshold else None


OUT = "tenant string, seq long, matched boolean, similarity double, type string, severity double"
STATE = "texts array<string>, kinds array<string>, severities array<double>"


def remembered(stream: DataFrame, tenant: str = "tenant", order: str = "seq", threshold: float = THRESHOLD, capacity: int = CAPACITY) -> DataFrame:
    """Of rows (tenant, seq, text, stored, kind, severity): the best match among what was stored before each.

    For sessions without RocksDB: a batch reads its keys' whole stores. ``remember.remembered`` reads only what its rows touch.
    ``stored`` says that guards behind the memory found something, ``kind`` and ``severity`` what is
    to be remembered of it.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        store = Store(threshold or THRESHOLD, capacity or CAPACITY)
        for held in zip(*state.get, strict=True) if state.exists else ():
            store.add(*held)
        out = []
        for row in pd.concat(list(parts)).sort_values(order, kind="stable").itertuples(index=False):
            found = store.best(row.text)
            out.append((key[0], getattr(row, order), found is not None, *(found or (None, None, None))))
            if row.stored:
                store.add(row.text, row.kind, float(row.severity))
        yield pd.DataFrame(out, columns=["tenant", "seq", "matched", "similarity", "type", "severity"]).astype({"similarity": "float64", "severity": "float64"})
        state.update(tuple(list(c) for c in zip(*(r[1:] for r in store.rows.values()), strict=True)) or ([], [], []))

    return stream.groupBy(tenant).applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
