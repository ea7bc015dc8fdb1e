"""Attack memory of streams, kept in the state store entry by entry.

For each value of a key (a tenant; a single value gives one global memory) state holds the last ``capacity`` stored rows as a queue, their
different signatures, and postings of trigrams in blocks of a bounded size. A batch reads and writes the entries that its own rows
touch, through a cache that lasts for the batch: its work grows with the batch and not with the store. Rows
older than ``keep`` go by a timer, whether or not new ones come.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.memory import CAPACITY, THRESHOLD

#: Signatures whose postings share a block.
BLOCK = 64
OUT = "tenant string, seq long, matched boolean, similarity double, type string, severity double"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def grams(text: str | None) -> Counter:
    s = (text or "").translate({0x130: "i", 0x3A3: "σ"}).lower().strip()
    return Counter(s[k : k + 3] for k in range(len(s) - 2))


def sign_of(of: Counter) -> str:
    return hashlib.md5("\0".join(f"{g}{n}" for g, n in sorted(of.items())).encode("utf-8", "surrogatepass")).hexdigest()


class Cached:
    """A map state for one batch: entries are read once and written back at the end."""

    def __init__(self, state) -> None:
        self.state, self.held, self.dirty = state, {}, set()

    def get(self, *key):
        if key not in self.held:
            found = self.state.getValue(key)
            self.held[key] = None if found is None else tuple(found)
        return self.held[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        """Set an entry; None removes it."""
        self.held[key] = value
        self.dirty.add(key)

    def flush(self) -> None:
        for key in self.dirty:
            value = self.held[key]
            if value is not None:
                self.state.updateValue(key, value)
            elif self.state.containsKey(key):
                self.state.removeKey(key)


class Index:
    """One key's memory over four map states and a value state.

    rows: number -> (signature, kind, severity, time, number of the next row of this signature or -1).
    signs: signature -> (first and last number of its rows, block, text). grams: trigram -> (signatures that have it, their
    blocks). blocks: (trigram, block) -> signatures and their sizes. clock: next number, oldest number.
    """

    def __init__(self, rows, signs, trigrams, blocks, clock, threshold: float, capacity: int) -> None:
        self.rows, self.signs, self.grams, self.blocks = map(Cached, (rows, signs, trigrams, blocks))
        self.clock, self.threshold, self.capacity = clock, threshold, capacity
        self.next, self.oldest = map(int, clock.get() or (0, 0)) if clock.exists() else (0, 0)

    def flush(self) -> None:
        for c in (self.rows, self.signs, self.grams, self.blocks):
            c.flush()
        self.clock.update((self.next, self.oldest))

    def add(self, text: str | None, kind: str, severity: float, now: int) -> None:
        of, number = grams(text), self.next
        sign = sign_of(of)
        if known := self.signs.get(sign):
            first, last, block, held = known
            self.rows.put((last,), (*self.rows.get(last)[:4], number))
            self.signs.put((sign,), (first, number, block, held))
        else:
            block, size = number // BLOCK, sum(of.values())
            self.signs.put((sign,), (number, number, block, text or ""))
            for g in of:
                count, at = self.grams.get(g) or (0, [])
                in_block, sizes = self.blocks.get(g, block) or ([], [])
                self.blocks.put((g, block), ([*in_block, sign], [*sizes, size]))
                self.grams.put((g,), (count + 1, list(at) if block in at else [*at, block]))
        self.rows.put((number,), (sign, kind, severity, now, -1))
        self.next += 1
        if self.next - self.oldest > self.capacity:
            self.forget()

    def forget(self) -> None:
        """Drop the oldest row, and its signature with the last row of it."""
        sign, _, _, _, after = self.rows.get(self.oldest)
        first, last, block, text = self.signs.get(sign)
        self.rows.put((self.oldest,), None)
        self.oldest += 1
        if after >= 0:
            self.signs.put((sign,), (after, last, block, text))
            return
        self.signs.put((sign,), None)
        for g in grams(text):
            count, at = self.grams.get(g)
            in_block, sizes = self.blocks.get(g, block)
            kept = [(s, n) for s, n in zip(in_block, sizes, strict=True) if s != sign]
            self.blocks.put((g, block), tuple(map(list, zip(*kept, strict=True))) if kept else None)
            left = list(at) if kept else [b for b in at if b != block]
            self.grams.put((g,), (count - 1, left) if count > 1 else None)

    def expire(self, before: int) -> int | None:
        """Drop the rows stored before a time; the time of the oldest row that is left."""
        while self.oldest < self.next:
            at = self.rows.get(self.oldest)[3]
            if at >= before:
                return at
            self.forget()
        return None

    def best(self, text: str | None) -> tuple[float, str, float] | None:
        """Likeness, kind and severity of the most similar row; of equals the one stored first.

        Trigrams are looked up rare ones first; past the first n - ceil(t n) + 1 elements no new signature can be like the text's.
        """
        of = grams(text)
        if known := self.signs.get(sign_of(of)):
            _, kind, severity, _, _ = self.rows.get(known[0])
            return 1.0, kind, severity
        n, t = sum(of.values()), self.threshold
        left, met = n - math.ceil(t * n - 1e-9) + 1, set()
        counts = {g: (self.grams.get(g) or (0, []))[0] for g in of}
        for g in sorted(of, key=lambda g: (counts[g], g)):
            if left <= 0:
                break
            for block in (self.grams.get(g) or (0, []))[1] if counts[g] else []:
                in_block, sizes = self.blocks.get(g, block)
                met.update(s for s, m in zip(in_block, sizes, strict=True) if t * n - 1e-9 <= m <= n / t + 1e-9)
            left -= of[g]
        likes = []
        for s in met:
            first, _, _, held = self.signs.get(s)
            other = grams(held)
            shared = sum((of & other).values())
            likes.append((shared / (n + sum(other.values()) - shared), -first))
        sim, at = max(likes, default=(0.0, 0))
        if not likes or sim < t:
            return None
        _, kind, severity, _, _ = self.rows.get(-at)
        return sim, kind, severity


class Remember(StatefulProcessor):
    """Looks rows up in their key's memory in order, and stores those that are to be stored."""

    def __init__(self, order: str, threshold: float, capacity: int, keep_ms: int | None) -> None:
        self.order, self.threshold, self.capacity, self.keep_ms = order, threshold, capacity, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = [
            handle.getMapState("rows", "number long", "sign string, kind string, severity double, at long, following long"),
            handle.getMapState("signs", "sign string", "first long, last long, block long, text string"),
            handle.getMapState("grams", "gram string", "signs long, blocks array<long>"),
            handle.getMapState("blocks", "gram string, block long", "signs array<string>, sizes array<long>"),
            handle.getValueState("clock", "next long, oldest long"),
        ]

    def _timer(self, oldest: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        if oldest is not None:
            self.handle.registerTimer(oldest + self.keep_ms + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        index, now, out = Index(*self.states, self.threshold, self.capacity), timerValues.getCurrentProcessingTimeInMs(), []
        if self.keep_ms is not None:
            index.expire(now - self.keep_ms)
        for row in pd.concat(list(rows)).sort_values(self.order, kind="stable").itertuples(index=False):
            found = index.best(row.text)
            out.append((key[0], getattr(row, self.order), found is not None, *(found or (None, None, None))))
            if row.stored:
                index.add(row.text, row.kind, float(row.severity), now)
        if self.keep_ms is not None:
            self._timer(index.rows.get(index.oldest)[3] if index.oldest < index.next else None)
        index.flush()
        yield pd.DataFrame(out, columns=["tenant", "seq", "matched", "similarity", "type", "severity"]).astype({"similarity": "float64", "severity": "float64"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        index = Index(*self.states, self.threshold, self.capacity)
        oldest = index.expire(expiredTimerInfo.getExpiryTimeInMs() - self.keep_ms)
        if oldest is not None:
            self.handle.registerTimer(oldest + self.keep_ms + 1)
        index.flush()
        return iter(())

    def close(self) -> None:
        pass


def remembered(stream: DataFrame, tenant: str = "tenant", order: str = "seq", threshold: float = THRESHOLD, capacity: int = CAPACITY, keep_seconds: float | None = None) -> DataFrame:
    """Of rows (tenant, seq, text, stored, kind, severity): the best match among what was stored before each.

    ``stored`` says that guards behind the memory found something, ``kind`` and ``severity`` what is to be remembered of it.
    ``keep_seconds`` is how long it is remembered (None: until ``capacity`` newer ones). Needs the RocksDB state store, by ``PROVIDER``.
    """
    if "RocksDB" not in stream.sparkSession.conf.get(PROVIDER, ""):
        raise ValueError(f"set {PROVIDER} to org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider: state is kept entry by entry")
    keep = None if keep_seconds is None else int(keep_seconds * 1000)
    step = Remember(order, threshold or THRESHOLD, capacity or CAPACITY, keep)
    return stream.groupBy(tenant).transformWithStateInPandas(step, OUT, "append", "processingTime" if keep is not None else "none")
