"""Attack memory: texts like an attack seen before are threats.

A row is learnt if guards behind the memory found something in it, so which rows are stored doesn't
depend on what the memory itself reports, and the whole replay is one ordered self-join: each row
against the last ``capacity`` rows stored before it.

The join is exact (up to equal 64-bit hashes of elements). Elements of a signature are (trigram, occurrence) pairs.
With a capacity a row meets ``capacity`` rows at most, so rows are dealt to stretches of the order, each with the stored
rows in its reach, and there all signatures of like size meet as vectors: of the trigrams counted in ``CELLS`` cells by hash, the products of square
roots add up to no less than what two signatures share, so whatever could be alike is measured (``near``). Its work is rows times
capacity whatever the texts are. For stores beyond ``REACH`` rows two signatures of likeness t or more meet on an element among the rarest
n - ceil(t n) + 1 of each (n its own number of elements) with a filter on sizes (``pairs``), which depends on how common the rarest trigrams are.
Signatures without trigrams are equal to each other. Copies meet once: the join is between different signatures, and a row looks up the first of a signature that is in its reach.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from ..functions.text import UNICODE_SPACE, fixed, fnv1a, lowered
from ..schema import CUSTOM, META, added, metadata, none, threat
from .guard import Guard

THRESHOLD, CAPACITY = 0.8, 10_000


def plain(text: Column) -> Column:
    """The trimmed lower-case text that trigrams are taken of; texts too short for any are empty, and so alike."""
    s = F.regexp_replace(lowered(F.coalesce(text, F.lit(""))), rf"^{UNICODE_SPACE}+|{UNICODE_SPACE}+$", "")
    return F.when(F.char_length(s) >= 3, s).otherwise("")


def hashed(text: Column) -> tuple[Column, Column]:
    """Of the trimmed lower-case text the 64-bit FNV-1a hash, as a signed long, and its number of code points."""
    s = F.regexp_replace(lowered(F.coalesce(text, F.lit(""))), rf"^{UNICODE_SPACE}+|{UNICODE_SPACE}+$", "")
    return fnv1a(s), F.char_length(s)


def signature(text: Column) -> Column:
    """Array of trigrams (with repeats) of the trimmed lower-case text."""
    s = F.regexp_replace(lowered(text), rf"^{UNICODE_SPACE}+|{UNICODE_SPACE}+$", "")
    letters, n = F.split(s, ""), F.char_length(s)
    # three shifted arrays side by side: a lambda that looked into one array would make it anew for each element
    shifted = F.arrays_zip(F.slice(letters, F.lit(1), n - 2).alias("a"), F.slice(letters, F.lit(2), n - 2).alias("b"), F.slice(letters, F.lit(3), n - 2).alias("c"))
    return F.when(n >= 3, F.transform(shifted, lambda g: F.concat(g["a"], g["b"], g["c"]))).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(ArrayType(LongType()))
def elements(texts: pd.Series) -> pd.Series:
    """Each trigram of a plain text with its number among the equal ones, as one long."""
    return texts.map(_elements)


def _elements(text: str) -> np.ndarray:
    """The three code points side by side, mixed with the number; in no order, all different."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code = np.sort(points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:])
    new = np.concatenate((np.ones(min(1, len(code)), bool), code[1:] != code[:-1]))
    start = np.maximum.accumulate(np.where(new, np.arange(len(code)), 0)) if len(code) else np.zeros(0, np.int64)
    nth = (np.arange(len(code)) - start).astype(np.uint64)
    z = code * np.uint64(0x9E3779B97F4A7C15) + nth * np.uint64(0xD1B54A32D192ED03)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return (z ^ z >> np.uint64(31)).view(np.int64)


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of two plain texts: elements that they share over all that either has; 1 for two empty ones."""
    known: dict[str, np.ndarray] = {}  # of this batch: a text is often in several pairs

    def of(t: str) -> np.ndarray:
        if t not in known:
            known[t] = np.sort(_elements(t))
        return known[t]

    def one(s: str, t: str) -> float:
        x, y = of(s), of(t)
        shared = len(np.intersect1d(x, y, assume_unique=True))
        both = len(x) + len(y) - shared
        return shared / both if both else 1.0

    return pd.Series([one(s, t) for s, t in zip(a, b, strict=True)], dtype="float64")


#: Elements whose frequencies the order of prefixes knows; the others are rarer and stand before them.
KNOWN = 1 << 16


def common(each: DataFrame, most: int = KNOWN) -> DataFrame:
    """(element, df) of the ``most`` most frequent in rows (plain), at least twice there: what decides the order of prefixes."""
    counts = each.select(F.explode(elements("plain")).alias("element")).groupBy("element").agg(F.count(F.lit(1)).alias("df"))
    return counts.where("df > 1").orderBy(F.col("df").desc(), "element").limit(most)


def prefix(frequent: Sequence[tuple[int, int]], threshold: float) -> Callable[[Column], Column]:
    """A column function: of a plain text the first n - ceil(threshold n) + 1 elements in the order that is fixed by (element, df) pairs, KNOWN at most.

    Two texts of likeness ``threshold`` or more share one of their prefixes, whatever the order; with common elements last few others do.
    """
    known = np.array(sorted(frequent), np.int64).reshape(-1, 2)

    def one(text: str) -> np.ndarray:
        e = _elements(text)
        at = np.searchsorted(known[:, 0], e)
        df = np.zeros(len(e), np.int64)
        inside = at < len(known)
        hit = known[at[inside], 0] == e[inside]
        df[np.nonzero(inside)[0][hit]] = known[at[inside][hit], 1]
        return e[np.lexsort((e, df))[: len(e) - math.ceil(threshold * len(e) - 1e-9) + 1]] if len(e) else e

    @F.pandas_udf(ArrayType(LongType()))
    def first(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return first


def measured(met: DataFrame, a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(new_id, old_id, similarity) of pairs at or above the threshold; a and b have id, plain."""
    both = met.join(a.select(F.col("id").alias("new_id"), F.col("plain").alias("x")), "new_id").join(b.select(F.col("id").alias("old_id"), F.col("plain").alias("y")), "old_id")
    return both.select("new_id", "old_id", likeness("x", "y").alias("similarity")).where(F.col("similarity") >= threshold)


def size_of(text: Column) -> Column:
    """Number of elements of a plain text."""
    return F.greatest(F.char_length(text) - 2, F.lit(0))


def fits(n: Column, m: Column, threshold: float) -> Column:
    """Whether arrays of n and m elements can be of that likeness."""
    return (n >= F.lit(threshold) * m - 1e-9) & (m >= F.lit(threshold) * n - 1e-9)


def pairs(new: DataFrame, old: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(new_id, old_id, similarity) of the pairs at or above the threshold.

    Both frames have id, plain, first, last, a row for each different text; only those whose ranges overlap are measured.
    What is shuffled: counts of elements, a fifth of each text's elements (at 0.8), and whole texts for the pairs that met.
    The driver gets KNOWN frequencies at most.
    """
    frequent = [(r.element, r.df) for r in common(new.select("plain").unionByName(old.select("plain"))).collect()]
    of = prefix(frequent, threshold)
    each = lambda df: df.select("id", size_of(F.col("plain")).alias("n"), "first", "last", F.explode(of(F.col("plain"))).alias("e"))
    a, b = each(new).alias("a"), each(old).alias("b")
    meets = (F.col("a.e") == F.col("b.e")) & fits(F.col("a.n"), F.col("b.n"), threshold) & (F.col("b.first") <= F.col("a.last")) & (F.col("b.last") >= F.col("a.first"))
    met = a.join(b, meets).select(F.col("a.id").alias("new_id"), F.col("b.id").alias("old_id")).distinct()
    # empty texts are equal: at most one row on each side
    nothing = new.where("plain = ''").select(F.col("id").alias("new_id"), "plain").join(old.where("plain = ''").select(F.col("id").alias("old_id"), "plain"), "plain")
    return measured(met, new, old, threshold).unionByName(nothing.select("new_id", "old_id", F.lit(1.0).alias("similarity")))


#: Cells that trigrams are counted in (a power of two), and vectors that meet those of a stretch at a time.
CELLS, MEETING = 1 << 11, 256
#: Rows of a stretch at least and at most, and the largest capacity whose stretches meet as vectors.
LEAST, MOST, REACH = 512, 2560, 1 << 15
MET = "sign string, old_id string, similarity double"


class Vectors:
    """Plain texts, their numbers of elements, and square roots of the counts of their trigrams by cell. Elements are made of those that are measured."""

    def __init__(self, texts: list[str]):
        self.texts, self.made = texts, {}
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.n = np.maximum(size - 2, 0)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        # those that begin in the last two characters of a text are none; cells are by the upper bits of a product
        z = points[:-2] * np.uint32(0x9E3779B1) ^ points[1:-1] * np.uint32(0x85EBCA77) ^ points[2:] * np.uint32(0xC2B2AE3D)
        z = (z ^ z >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - CELLS.bit_length() + 1)
        row = np.repeat(np.arange(len(texts)), self.n)
        at = np.arange(len(row)) + np.repeat(np.cumsum(size) - size - np.cumsum(self.n) + self.n, self.n)
        counts = np.bincount(row * CELLS + z[at], minlength=len(texts) * CELLS)
        self.roots = np.sqrt(counts.astype(np.float32)).reshape(len(texts), CELLS)

    def elements(self, k: int) -> np.ndarray:
        if k not in self.made:
            self.made[k] = np.sort(_elements(self.texts[k]))
        return self.made[k]


def _meet(a: Vectors, b: Vectors, threshold: float) -> Iterator[tuple[int, int, float]]:
    """(place in a, place in b, similarity) of vectors at or above the threshold; those of a are by ascending numbers of elements."""
    lo, hi = np.searchsorted(a.n, threshold * b.n.min() - 1e-6), np.searchsorted(a.n, b.n.max() / threshold + 1e-6, "right")
    if lo >= hi:
        return
    both = (a.n[lo:hi, None] + b.n[None, :]).astype(np.float32)
    # no pair's true share is above its product; the slack is far above the error of single precision
    maybe = a.roots[lo:hi] @ b.roots.T >= both * (threshold / (1 + threshold) * (1 - 1e-4)) - 0.01
    for i, j in zip(*(k.tolist() for k in np.nonzero(maybe)), strict=True):
        n, m = int(a.n[lo + i]), int(b.n[j])
        if min(n, m) < threshold * max(n, m) - 1e-9:
            continue
        shared = len(np.intersect1d(a.elements(lo + i), b.elements(j), assume_unique=True)) if n and m else 0
        likeness = shared / (n + m - shared) if n + m else 1.0
        if likeness >= threshold:
            yield lo + i, j, likeness


def _met(sides: DataFrame, threshold: float, asked_held: bool) -> DataFrame:
    """(sign, old_id, similarity) of the pairs within a cell, once for each cell. ``sides`` has cell, side, sign, plain: side 0 is held, side 1 is streamed by; ``asked_held``: side 0 asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, signs, texts, held = None, [], [], None
        for b in batches:
            cell, side = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if lo == hi:
                    continue
                if cell[lo] != at:
                    at, signs, texts, held = cell[lo], [], [], None
                if side[lo] == 0:
                    signs += b.column(2).slice(lo, hi - lo).to_pylist()
                    texts += b.column(3).slice(lo, hi - lo).to_pylist()
                    continue
                if not signs:
                    continue
                if held is None:
                    held, texts = Vectors(texts), []
                for k in range(lo, hi, MEETING):
                    size = min(MEETING, hi - k)
                    others = b.column(2).slice(k, size).to_pylist()
                    rows = [(signs[i], others[j], x) for i, j, x in _meet(held, Vectors(b.column(3).slice(k, size).to_pylist()), threshold)]
                    if rows:
                        mine, theirs, x = zip(*rows, strict=True)
                        asks, found = (mine, theirs) if asked_held else (theirs, mine)
                        yield pa.RecordBatch.from_arrays([pa.array(asks, pa.string()), pa.array(found, pa.string()), pa.array(x, pa.float64())], names=["sign", "old_id", "similarity"])

    n = int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sides.select("cell", "side", "sign", "plain").repartition(n, "cell").sortWithinPartitions("cell", "side", F.char_length("plain"))
    return dealt.mapInArrow(run, MET)


def near(new: DataFrame, old: DataFrame, threshold: float, capacity: int) -> DataFrame:
    """(sign, old_id, similarity) of all signatures at or above the threshold that are in reach of each other somewhere (others may come too).

    Both frames have sign, plain, seq, a row for each row; capacity is REACH at most. A stretch's signatures are held, at most MOST
    old ones of them; the old ones in its reach are streamed by.
    """
    step = min(max(-(-capacity // 4), LEAST), MOST)
    stretch = lambda c: F.floor(c / step)
    asks = new.groupBy(stretch(F.col("seq")).alias("cell"), "sign").agg(F.first("plain").alias("plain")).select("cell", F.lit(0).alias("side"), "sign", "plain")
    held = old.groupBy(stretch(F.col("seq")).alias("_from"), "sign").agg(F.first("plain").alias("plain"), F.min("seq").alias("_min"), F.max("seq").alias("_max"))
    cells = F.explode(F.sequence(stretch(F.col("_min") + 1), stretch(F.col("_max") + capacity))).alias("cell")
    return _met(asks.unionByName(held.select(cells, F.lit(1).alias("side"), "sign", "plain")), threshold, True).distinct()


def near_held(new: DataFrame, old: DataFrame, threshold: float) -> DataFrame:
    """The same for different signatures (sign, plain) without order; ``old`` has REACH rows at most and is held by each task."""
    n = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asks = new.select(F.pmod(F.xxhash64("sign"), F.lit(n)).alias("cell"), F.lit(1).alias("side"), "sign", "plain")
    held = old.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("cell"), F.lit(0).alias("side"), "sign", "plain")
    return _met(asks.unionByName(held), threshold, False)


def matches(new: DataFrame, old: DataFrame, threshold: float = THRESHOLD, capacity: int | None = None, held: int | None = None) -> DataFrame:
    """(id, matched, similarity): for each new row the seq of its most similar old row, of equals the one stored first.

    ``old`` has seq, plain; ``new`` has id, plain and, with a capacity, seq: only the ``capacity`` old rows right before it count.
    Without a capacity ``held`` may say how many old rows there are at most. Copies are one text to ``pairs``, so n copies of an attack make n rows and no pairs of each other.
    """
    new, old = new.withColumn("sign", F.md5("plain")), old.withColumn("sign", F.md5("plain"))
    if capacity and capacity <= REACH:
        return in_reach(new, old, near(new, old, threshold, capacity), capacity)
    reach = (F.greatest(F.lit(0), F.col("seq") - capacity), F.col("seq") - 1) if capacity else (F.lit(-(2**62)), F.lit(2**62))
    asked = new.withColumns({"lo": reach[0], "hi": reach[1]}).groupBy(F.col("sign").alias("id")).agg(F.first("plain").alias("plain"), F.min("lo").alias("first"), F.max("hi").alias("last"))
    stored = old.groupBy(F.col("sign").alias("id")).agg(F.first("plain").alias("plain"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    if not capacity and held is not None and held <= REACH:
        like = near_held(asked.select(F.col("id").alias("sign"), "plain"), stored.select(F.col("id").alias("sign"), "plain"), threshold)
    else:
        like = pairs(asked, stored, threshold).withColumnRenamed("new_id", "sign")
    if capacity:
        return in_reach(new, old, like, capacity)
    found = like.join(stored.select(F.col("id").alias("old_id"), F.col("first").alias("at")), "old_id")
    return _chosen(new.select("id", "sign").join(found.groupBy("sign").agg(_best()), "sign"))


def _best() -> Column:
    return F.max(F.struct("similarity", (-F.col("at")).alias("at"))).alias("best")


def _chosen(df: DataFrame) -> DataFrame:
    return df.select("id", (-F.col("best.at")).alias("matched"), F.col("best.similarity").alias("similarity"))


def in_reach(new: DataFrame, old: DataFrame, like: DataFrame, capacity: int) -> DataFrame:
    """(id, matched, similarity) of new rows (id, sign, seq) by the like signatures (sign, old_id, similarity) and old rows (sign, seq).

    The first of a signature's old rows in reach is looked up in stretches of ``capacity`` rows, so that no step sorts all copies in one task.
    """
    asks = like.join(new.select("sign", "seq").distinct(), "sign")
    stretch = F.floor(F.col("at") / capacity)
    points = asks.select("old_id", "seq").distinct().withColumn("at", F.greatest(F.lit(0), F.col("seq") - capacity)).withColumns({"part": stretch, "kept": F.lit(None).cast("long")})
    stored = old.select(F.col("sign").alias("old_id"), F.lit(None).cast("long").alias("seq"), F.col("seq").alias("at")).withColumns({"part": stretch, "kept": F.col("at")})
    after = Window.partitionBy("old_id", "part").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    here = points.unionByName(stored).withColumn("near", F.min("kept").over(after)).where("seq IS NOT NULL")
    heads = stored.groupBy("old_id", (F.col("part") - 1).alias("part")).agg(F.min("at").alias("head"))
    firsts = here.join(heads, ["old_id", "part"], "left").select("old_id", "seq", F.coalesce("near", "head").alias("at")).where("at < seq")
    found = asks.join(firsts, ["old_id", "seq"]).groupBy("sign", "seq").agg(_best())
    return _chosen(new.select("id", "sign", "seq").join(found, ["sign", "seq"]))


def learnt(threats: Column) -> Column:
    """Type and severity that a row is stored with: its first most severe threat; custom if all are of severity 0."""
    start = F.struct(F.lit(CUSTOM).alias("type"), F.lit(0.0).alias("severity"))
    return F.aggregate(threats, start, lambda a, t: F.when(t["severity"] > a["severity"], F.struct(t["type"].alias("type"), t["severity"].alias("severity"))).otherwise(a))


#: Rows that the bounds of ``positions`` are taken from, and its parts.
BOUNDS_OF, PARTS = 4096, 256


def positions(df: DataFrame, order: str, stored: Column, parts: int = PARTS) -> DataFrame:
    """seq: how many rows were stored before each row, by ``order`` (of any type that sorts); a running sum in two steps.

    Parts have about equally many rows, whatever the values: their bounds are quantiles of the BOUNDS_OF different values of least hash.
    """
    some = df.select(F.col(order).alias("v")).where("v IS NOT NULL").distinct().orderBy(F.xxhash64("v")).limit(BOUNDS_OF)
    values = [r.v for r in some.orderBy("v").collect()]
    bounds = values[:: max(1, len(values) // parts)][1:]
    kind = df.schema[order].dataType
    part = F.size(F.filter(F.array(*[F.lit(b).cast(kind) for b in bounds]), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    df = df.withColumn("_part", F.when(F.col(order).isNull(), -1).otherwise(part)).withColumn("_stored", F.when(stored, 1).otherwise(0))
    sums = df.groupBy("_part").agg(F.sum("_stored").alias("_n"))
    before = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    w = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_in", F.coalesce(F.sum("_stored").over(w), F.lit(0))).join(before, "_part")
    return out.withColumn("seq", (F.col("_before") + F.col("_in")).cast("long")).drop("_part", "_stored", "_in", "_before")


def replay(df: DataFrame, key: str, order: str, text: str, stored: Column, kind: Column, severity: Column, threshold: float = THRESHOLD, capacity: int = CAPACITY) -> DataFrame:
    """Rows of df by arrival: key, matched key, similarity, and the stored type and severity."""
    rows = positions(df.select(F.col(key).alias("id"), F.col(order).alias("order"), F.col(text).alias("text"), stored.alias("stored"), kind.alias("kind"), severity.alias("severity")), "order", F.col("stored"))
    rows = rows.withColumn("plain", plain(F.col("text")))
    found = matches(rows.select("id", "plain", "seq"), rows.where("stored").select("seq", "plain"), threshold, capacity)
    stored_rows = rows.where("stored").select(F.col("seq").alias("matched"), F.col("id").alias("old_id"), F.when(F.coalesce("kind", F.lit("")) == "", CUSTOM).otherwise(F.col("kind")).alias("kind"), "severity")
    return found.join(stored_rows, "matched").select(F.col("id").alias(key), F.col("old_id").alias("matched"), "similarity", "kind", "severity")


@dataclass
class Memory(Guard):
    """Match against a given table of signatures (seq, text, type, severity), as a batch's rows arrive together.

    Rows come in with a unique ``key``. ``after`` marks the rows to be learnt; ``learned`` are their new signatures.
    """

    key: str
    store: DataFrame | None = None
    threshold: float = THRESHOLD
    capacity: int = CAPACITY
    order: str | None = None
    _before: str = field(default="_memory_before", repr=False)
    name = "memory"

    def apply(self, df: DataFrame) -> DataFrame:
        threshold = self.threshold or THRESHOLD
        if self.store is not None:
            most = self.capacity or CAPACITY
            old = self.store.orderBy(F.col("seq").desc()).limit(most)
            asked = df.where(~F.col("halted")).select(F.col(self.key).alias("id"), plain(F.col("input")).alias("plain"))
            known = old.select(F.col("seq").alias("matched"), "type", "severity")
            hit = matches(asked, old.select("seq", plain(F.col("text")).alias("plain")), threshold, held=most).join(known, "matched")
            hit = hit.select(F.col("id").alias("_id"), "similarity", F.col("type").alias("_type"), F.col("severity").alias("_severity"))
            df = df.join(hit, F.col(self.key) == F.col("_id"), "left")
            kind = F.when(F.coalesce("_type", F.lit("")) == "", CUSTOM).otherwise(F.col("_type"))
            message = F.format_string("input matches previously seen attack (similarity %s)", fixed(F.col("similarity"), 2))
            df = added(df, F.when(F.col("_id").isNotNull(), F.array(threat(kind, F.col("_severity"), message, self.name, F.col("input"), 0, F.octet_length("input")))).otherwise(none()))
            df = metadata(df, {"memory_matched": F.when(F.col("_id").isNotNull(), True), "memory_similarity": F.col("similarity")}).drop("_id", "_type", "_severity", "similarity")
        return df.withColumn(self._before, F.when(~F.col("halted"), F.size("threats")))

    def after(self, df: DataFrame) -> DataFrame:
        fresh = F.slice("threats", F.col(self._before) + 1, F.size("threats"))
        stores = F.col(self._before).isNotNull() & (F.size("threats") > F.col(self._before))
        values = {f"{META}memory_stored": F.when(stores, True), f"{META}memory_learnt": F.when(stores, learnt(fresh))}
        return df.withColumns(values).drop(self._before)


def learned(df: DataFrame, text: str = "input") -> DataFrame:
    """(text, type, severity) of the rows that a memory marked, to append to its store."""
    return df.where(f"{META}memory_stored").select(F.col(text).alias("text"), F.col(f"{META}memory_learnt.type").alias("type"), F.col(f"{META}memory_learnt.severity").alias("severity"))


def learned_rows(analysed: DataFrame) -> DataFrame:
    """The same of a pipeline's written result, by its metadata."""
    m = F.col("metadata")
    return analysed.where(m["memory_stored"]).select(F.col("output").alias("text"), m["memory_learnt"]["type"].alias("type"), m["memory_learnt"]["severity"].alias("severity"))


__all__ = ["Memory", "common", "elements", "fits", "hashed", "in_reach", "learned", "learned_rows", "learnt", "matches", "measured", "near", "near_held", "pairs", "plain", "positions", "prefix", "replay", "signature", "size_of"]
