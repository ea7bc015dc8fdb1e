"""Hashed n-gram vectors of texts, and their likeness to a bank of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, LongType

SIZE = 256
#: Vectors held at a time.
SOME = 512


def codes(text: str) -> np.ndarray:
    """Code points in lower case, letter by letter."""
    plain = text.replace("İ", "i").replace("Σ", "σ").lower()
    return np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)


def buckets(c: np.ndarray) -> np.ndarray:
    """Bucket of each bigram and trigram: only the lowest bytes of the hash and of the letters count."""
    low = (c & 255).astype(np.int64)
    step = lambda h, x: ((h ^ x) * 147) & 255
    two = step(step(np.int64(197), low[:-1]), low[1:])
    return np.concatenate((step(two, 0), step(two[:-1], low[2:]))) if len(c) >= 2 else np.zeros(0, np.int64)


def vector(text: str) -> np.ndarray:
    """Bucket counts on the unit sphere; zero for texts under two letters."""
    v = np.bincount(buckets(codes(text)), minlength=SIZE).astype(np.float64)
    norm = np.sqrt((v * v).sum())
    return v / norm if norm else v


@pandas_udf(ArrayType(LongType()))
def counts(texts: pd.Series) -> pd.Series:
    """Bucket counts of each text."""
    return texts.map(lambda t: np.bincount(buckets(codes(t or "")), minlength=SIZE))


def similarities(bank: list[list[float]]):
    """A column function: cosine of the text's vector with each vector of the bank (rows of 256; others are unlike anything)."""
    rows = np.array([b if len(b) == SIZE else [0.0] * SIZE for b in bank], np.float64).reshape(-1, SIZE)
    norms = np.sqrt((rows * rows).sum(axis=1))
    unit = np.divide(rows, norms[:, None], out=np.zeros_like(rows), where=norms[:, None] > 0)

    @arrow_udf("array<double>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in texts:
            found = [np.zeros((0, len(unit)))]
            for at in range(0, len(s), SOME):
                v = np.array([vector(t.as_py() or "") for t in s.slice(at, SOME)])
                found.append(v @ unit.T)
            flat = np.concatenate(found)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * len(unit), pa.int32()), pa.array(flat.ravel()))

    return of


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays; 0 for different lengths, no elements or no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot / size).otherwise(0.0)
