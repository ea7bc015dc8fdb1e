"""Toxicity from class-conditional Kneser-Ney models.

Each class has an interpolated Kneser-Ney model of its words, character by character: a character
given the ``ORDER`` - 1 before it in its word, edges marked. The highest order has the class's own discounted counts (of
texts with the word, not of occurrences). What its discounts set free goes to the lower orders, which both classes
share: continuation counts, the number of different characters that were seen before an n-gram, discounted and backed off in the
same way down to equal shares. Rare expressions so get much the same probability from both classes.
A text's score compares its log-likelihoods under the two models, divided by its number of words, and is made a
probability by a logistic curve fitted on labelled texts that the models haven't seen. Words whose likelihoods differ by
less than a margin count as equally likely there (the models keep them): what one text's own rare words say of its class
would drown what expressions of many texts say. The margin is learnt: of ``MARGINS``, the one whose curve has the least log
loss on the same texts, the smaller of equals.

Fitting takes a bounded sample: at most ``per_class`` labelled rows of each class, the first by a
hash of their ids, of texts up to ``MAX_BYTES`` and ``CLASS_BYTES`` in all. Labels whose crc32(doc_id) mod 5 is 0 are never used.
The shared continuation counts are taken over all documents, by Spark; the driver gets those of n-grams that the sample has.

Defined results: a null text is empty; an empty text, or one without words, has the score of a
likelihood ratio of one; very long texts are scored whole; a document with several labels is learnt once for each;
null labels are skipped; with no labels, or of one class only, every score is the share of toxic labels
(0 without any); repeated rows are scored each; an empty table gives no rows; other columns are not
read, or carried through by ``clean``, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import handing_back, written

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
PER_CLASS, MAX_BYTES, CLASS_BYTES = 3000, 1 << 20, 32 << 20
ORDER, DISCOUNT = 4, 0.75
#: In natural logarithms; 0 compares the whole likelihoods.
MARGINS = (0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)
#: Words and n-grams that a worker remembers, and the longest of the words; when full it starts anew.
REMEMBERED, LONGEST = 400_000, 32
#: Stand before and after a word.
_BEGIN, _END = "\x02", "\x03"
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def words(text: str) -> list[str]:
    """Between white space, lower-cased; punctuation around a word is cut off when it is scored."""
    return text.lower().split()


def _grams(word: str) -> list[str]:
    w = _BEGIN * (ORDER - 1) + word + _END
    return [w[k : k + ORDER] for k in range(len(w) - ORDER + 1)]


@dataclass
class Counts:
    """Counts of n-grams of one length, with their sum and number by history."""

    of: dict[str, int] = field(default_factory=dict)
    total: Counter = field(default_factory=Counter)
    kinds: Counter = field(default_factory=Counter)

    def __post_init__(self) -> None:
        for g, n in self.of.items():
            self.total[g[:-1]] += n
            self.kinds[g[:-1]] += 1

    def given(self, gram: str, back: float) -> float:
        """Of the gram's last character after its history: discounted, and the mass set free times ``back``."""
        total = self.total.get(gram[:-1], 0)
        if not total:
            return back
        return (max(self.of.get(gram, 0) - DISCOUNT, 0.0) + DISCOUNT * self.kinds[gram[:-1]] * back) / total


@dataclass
class Model:
    """``own``: the highest order of ordinary and toxic texts; ``shared``: the lower orders, shortest first."""

    own: tuple[Counts, Counts] = field(default_factory=lambda: (Counts(), Counts()))
    shared: list[Counts] = field(default_factory=list)
    slope: float = 0.0
    offset: float = 0.0
    margin: float = 0.0
    ratios: dict[str, float] = field(default_factory=dict)

    def below(self, gram: str) -> float:
        """Shared probability of a gram's last character after what stands before it."""
        p = 1.0 / (len(self.shared[0].of) + 1)
        for n, counts in enumerate(self.shared, 1):
            if n <= len(gram):
                p = counts.given(gram[-n:], p)
        return p

    def probability(self, toxic: int, gram: str) -> float:
        return self.own[toxic].given(gram, self.below(gram[1:]))

    def word(self, raw: str) -> float:
        """Log-likelihood ratio of a word."""
        w = _EDGE.sub("", raw)
        if not w or not self.shared:
            return 0.0
        if len(self.ratios) > REMEMBERED:
            self.ratios.clear()
        out = 0.0
        for g in _grams(w):
            r = self.ratios.get(g)
            if r is None:
                back = self.below(g[1:])
                r = self.ratios[g] = math.log(self.own[1].given(g, back) / self.own[0].given(g, back))
            out += r
        return out

    def ratio(self, text: str | None, known: dict[str, float]) -> float:
        """Log-likelihood ratio a word."""
        found = words(text or "")
        if not found:
            return 0.0
        if len(known) > REMEMBERED:
            known.clear()
        total = 0.0
        for w in found:
            r = known.get(w)
            if r is None:
                r = self.word(w)
                r = r if abs(r) >= self.margin else 0.0
                if len(w) <= LONGEST:
                    known[w] = r
            total += r
        return total / len(found)

    def score(self, ratio: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, self.slope * ratio + self.offset))))


def _counts(texts: list[str]) -> Counter:
    """Of each n-gram of the highest order, in how many texts' words it is, a word counted once a text; equal texts count once."""
    each: Counter = Counter()
    for t in set(texts):
        each.update({w for raw in set(words(t)) if (w := _EDGE.sub("", raw))})
    out: Counter = Counter()
    for w, n in each.items():
        for g in _grams(w):
            out[g] += n
    return out


def lower(grams: set[str]) -> list[Counter]:
    """Continuation counts, shortest first: of each shorter n-gram, how many different characters stand before it."""
    out = []
    for _ in range(ORDER - 1):
        counts = Counter(g[1:] for g in grams)
        out.insert(0, counts)
        grams = set(counts)
    return out


def fit_models(toxic: list[str], ordinary: list[str], continuations: Callable[[set[str]], dict[str, int]] | None = None) -> Model:
    """Both classes. ``continuations`` gives the counts of lower n-grams over a larger collection; else they are the texts' own."""
    own = tuple(_counts(texts) for texts in (ordinary, toxic))
    shared = lower({*own[0], *own[1]})
    if continuations is not None:
        wide = continuations({g for c in shared for g in c})
        shared = [Counter({g: max(n, wide.get(g, 0)) for g, n in c.items()}) for c in shared]
    return Model(tuple(Counts(dict(c)) for c in own), [Counts(dict(c)) for c in shared])


def _curve(ratios: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float, float]:
    """Log loss, slope and offset of a logistic curve by Newton's method with a slight ridge; the rows are weighted to the prior."""
    if len(set(labels.tolist())) < 2:
        return 0.0, 1.0, math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    weight = np.where(labels == 1, prior / labels.mean(), (1 - prior) / (1 - labels.mean()))
    scale = max(float(np.std(ratios)), 1e-9)
    x, w = np.stack([ratios / scale, np.ones(len(ratios))], 1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (weight * (labels - p)) - 0.05 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    z = x @ w
    loss = float((weight * np.logaddexp(0.0, np.where(labels == 1, -z, z))).mean())
    return loss, float(w[0] / scale), float(w[1])


def _calibrate(model: Model, texts: list[tuple[str, int]], prior: float) -> None:
    """The margin and the curve of least log loss on labelled texts."""
    known: dict[str, float] = {}

    def ratios(text: str) -> np.ndarray:
        found = words(text)
        for w in found:
            if w not in known:
                known[w] = model.word(w)
        return np.array([known[w] for w in found] or [0.0])

    each, labels = [ratios(t) for t, _ in texts], np.array([y for _, y in texts])
    curves = [(*_curve(np.array([r[np.abs(r) >= m].sum() / len(r) for r in each]), labels, prior), m) for m in MARGINS]
    _, model.slope, model.offset, model.margin = min(curves, key=lambda c: (round(c[0], 9), c[3]))


def fit(texts: list[tuple[str, int, bool]], prior: float, continuations: Callable[[set[str]], dict[str, int]] | None = None) -> Model:
    """From (text, label, whether it calibrates) and the share of toxic labels. Both classes learn from as many texts."""
    of = {k: sorted((t for t, y, c in texts if y == k and not c), key=lambda t: zlib.crc32(t.encode())) for k in (0, 1)}
    least = min(map(len, of.values()))
    of = {k: t[:least] for k, t in of.items()}
    if not of[0] or not of[1]:
        return Model(offset=math.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    model = fit_models(of[1], of[0], continuations)
    if not model.shared[0].of:  # no words at all
        model.shared = []
    _calibrate(model, [(t, y) for t, y, c in texts if c] or [(t, y) for t, y, _ in texts], prior)
    return model


def continuations(docs: DataFrame, text: str = "text") -> DataFrame:
    """gram, n: continuation counts of all n-grams below the highest order, over all rows of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            grams: set[str] = set()
            for t in b.column(0):
                new = {*words(t.as_py() or "")} - seen
                for raw in new:
                    if w := _EDGE.sub("", raw):
                        grams.update(_grams(w))
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.update(w for w in new if len(w) <= LONGEST)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(grams), pa.string())], names=["gram"])

    grams, out = written(docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(handing_back(run), "gram string").distinct(), "grams"), None
    for _ in range(ORDER - 1):
        counts = grams.groupBy(F.substring("gram", 2, ORDER).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        out = counts if out is None else out.unionByName(counts)
        grams = counts.select("gram")
    return out


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Fit on a bounded sample of the labels; only the chosen ids (at most 2 x per_class) are broadcast."""
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1)).where(fold(F.col("id")) != HELD_OUT)
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    order = [F.xxhash64("id"), "id"]
    chosen = known.where("y = 1").orderBy(*order).limit(per_class).unionByName(known.where("y = 0").orderBy(*order).limit(per_class))
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy(*order, "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = (
        docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
        .where(F.octet_length("text") <= MAX_BYTES)
        .join(F.broadcast(chosen), "id")
        .withColumn("upto", upto)
        .where(F.col("upto") <= CLASS_BYTES)
        .select("id", "text", "y", (fold(F.col("id")) == CALIBRATION).alias("c"))
        .collect()
    )
    rows.sort(key=lambda r: (r.id, r.y, r.text))

    def everywhere(grams: set[str]) -> dict[str, int]:
        asked = spark.createDataFrame([(g,) for g in sorted(grams)], "gram string")
        return {r.gram: r.n for r in continuations(docs, text).join(F.broadcast(asked), "gram").collect()}

    return fit([(r.text, r.y, r.c) for r in rows], toxic / n if n else 0.0, everywhere)


def scored(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df with the score of each text; narrow. The broadcast model's size is bounded by the sample's."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in df.schema.fields if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = replace(shared.value, ratios={}), {}  # what is remembered ends with the task
        for b in batches:
            scores = pa.array([m.score(m.ratio(t.as_py(), known)) for t in b.column(text)], pa.float64())
            yield pa.RecordBatch.from_pydict({n: c for n, c in zip(b.schema.names, b.columns, strict=True) if n != out} | {out: scores})

    return df.mapInArrow(handing_back(run), StructType([*kept, StructField(out, DoubleType())]))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a score below the threshold."""
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return scored(docs, train(docs, labels), out=name).where(F.col(name) < threshold).drop(name)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    return scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), model).select(
        "doc_id", (F.coalesce(fold(F.col("doc_id")), F.lit(1)) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
