"""Quartile bucket digests: locality-sensitive fingerprints of byte texts.

Byte triplets within a sliding window are hashed into buckets; each bucket's count is coded by the
quartile of the text's counts it falls in, two bits a bucket. The header holds the logarithm of the
length and the ratios of the quartiles. The difference of two digests adds up the steps between their
bucket codes (opposite quartiles count double) and their headers, is bounded, and gives a likeness
from 0 to 1.

``neighbours`` also compares each text with the next one, in descending order of ids. Texts are
range-partitioned once; the last text of a partition meets the first of the next in a second,
small step over two rows a partition.

Defined results: a null text is empty; texts under three bytes have no triplets and the digest of
empty buckets, told apart by their length; equal texts have equal digests; null ids come last;
documents with equal ids stand next to each other, by a hash of their texts; a single document is
its own neighbour; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import mixed_numbers, partitions, written

BUCKETS = 256
#: Offsets of the triplets within the window.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: The mean difference of unrelated codes; the bound of the difference score.
BOUND = round(1.625 * BUCKETS)
#: What a text's counts take besides its own bytes, so that a run of many short or empty texts ends too.
ROW_BYTES = 8 * BUCKETS
_TABLES = (mixed_numbers(20240611, len(TRIPLETS) * 3 * 256) >> np.uint64(48)).astype(np.uint16).reshape(len(TRIPLETS), 3, 256)


def digest_many(texts: list[bytes]) -> np.ndarray:
    """Digests as rows of bytes: length, two ratios, then the codes, four buckets a byte."""
    out = np.zeros((len(texts), 3 + BUCKETS // 4), np.uint8)
    if not texts:
        return out
    x = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    counts = np.zeros((len(texts), BUCKETS), np.int64)
    for tables, (a, b, c) in zip(_TABLES, TRIPLETS, strict=True):
        if len(x) <= c:
            continue
        h = tables[0][x[: len(x) - c]] + tables[1][x[b : len(x) - c + b]] + tables[2][x[c:]]
        h = (h * np.uint16(40503) >> np.uint16(8)).astype(np.uint8)
        lo = 0
        for k, hi in enumerate(ends.tolist()):
            if hi - lo > c:
                counts[k] += np.bincount(h[lo : hi - c], minlength=BUCKETS)
            lo = hi
    q = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
    codes = (counts[:, :, None] > q[:, None, :]).sum(axis=2).astype(np.uint8)
    out[:, 0] = [min(255, round(8 * math.log2(len(t) + 1))) for t in texts]
    out[:, 1:3] = np.where(q[:, 2:] > 0, q[:, :2] * 15 // np.maximum(q[:, 2:], 1), 0)
    four = codes.reshape(len(texts), -1, 4)
    out[:, 3:] = four[:, :, 0] << 6 | four[:, :, 1] << 4 | four[:, :, 2] << 2 | four[:, :, 3]
    return out


def _codes(digests: np.ndarray) -> np.ndarray:
    b = digests[:, 3:]
    return np.stack([b >> 6, b >> 4 & 3, b >> 2 & 3, b & 3], axis=2).reshape(len(b), -1).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 for a difference at or above the bound; row by row."""
    steps = np.abs(_codes(a) - _codes(b))
    head = np.abs(a[:, :3].astype(np.int64) - b[:, :3].astype(np.int64))
    score = np.where(steps == 3, 6, steps).sum(axis=1) + np.minimum(head[:, 0] // 2, 12) + np.minimum(head[:, 1:].sum(axis=1), 12)
    return 1.0 - np.minimum(score, BOUND) / BOUND


def fingerprint(text: str | None) -> str:
    return digest_many([(text or "").encode()])[0].tobytes().hex()


def edited(text: str, other: str) -> str:
    """text with its last half (rounded down) replaced by the first as many code points of ``other``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


ROWS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judged(ids: pa.Array, texts: list[str], following: list[str]) -> list[pa.Array]:
    changed = [edited(t, n).encode() for t, n in zip(texts, following, strict=True)]
    raw, nexts = [t.encode() for t in texts], [t.encode() for t in following]
    # a run of texts is digested once: the next text of all but the last is in the run
    own = digest_many([*raw, *nexts[-1:]]) if raw[1:] == nexts[:-1] else None
    d, after = (own[:-1], own[1:]) if own is not None else (digest_many(raw), digest_many(nexts))
    e = digest_many(changed)
    return [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in changed]), *(pa.array([x.tobytes().hex() for x in y], pa.string()) for y in (d, e)), pa.array(likeness(d, e)), pa.array(likeness(d, after))]


def neighbours(df: DataFrame, key: str = "doc_id", text: str = "text", run_bytes: int = 1 << 23) -> DataFrame:
    """Fingerprints of each text and its edited text, and their likeness; see ``edited``."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    names = ["doc_id", *[c.split()[0] for c in ROWS.split(", ")]]
    docs = df.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, first = TaskContext.get().partitionId(), [], 0, True

        def out(cols: list[pa.Array]) -> pa.RecordBatch:
            n = len(cols[0])
            return pa.RecordBatch.from_arrays([*cols, pa.array([part] * n, pa.int32()), *([pa.nulls(n, pa.string())] * 2)], names=[*names, "part", "head", "tail"])

        def edge(doc: pa.Scalar, head: str | None, tail: str | None) -> pa.RecordBatch:
            blank = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([doc.as_py()], doc.type), *blank, pa.array([part], pa.int32()), pa.array([head], pa.string()), pa.array([tail], pa.string())], names=[*names, "part", "head", "tail"])

        for b in batches:
            for doc, t in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if first:
                    yield edge(doc, t, None)
                    first = False
                held.append((doc, t))
                size += len(t) + ROW_BYTES
                if size >= run_bytes and len(held) > 1:
                    texts = [x for _, x in held]
                    yield out(_judged(pa.array([d.as_py() for d, _ in held[:-1]], doc.type), texts[:-1], texts[1:]))
                    held, size = held[-1:], len(t) + ROW_BYTES
        if held:
            texts = [x for _, x in held]
            if len(held) > 1:
                yield out(_judged(pa.array([d.as_py() for d, _ in held[:-1]], held[0][0].type), texts[:-1], texts[1:]))
            yield edge(held[-1][0], None, texts[-1])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(_judged(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()), names=names)

    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    sorted_docs = docs.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    most = written(sorted_docs.mapInArrow(run, f"doc_id {kind}, {ROWS}, part int, head string, tail string"), "digests")
    tails = most.where("tail is not null").select("doc_id", "tail", "part")
    heads = most.where("head is not null").select("head", F.col("part").alias("head_part"))
    # a row for each partition: the partition after it, the first one after the last
    turn = tails.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("head_part"))
    ends = tails.join(turn, "part").join(heads, "head_part").select("doc_id", "tail", "head").mapInArrow(close, f"doc_id {kind}, {ROWS}")
    return most.where("head is null and tail is null").select(*names).unionByName(ends)
