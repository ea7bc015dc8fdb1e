"""Removal of repeated passages by suffix order over the whole collection.

A byte goes if it lies in a ``width``-byte string of the input that also starts in a document with a
smaller id. The collection is too large for one suffix order, so it is dealt out by content:

1. Documents are packed into chunks of some megabytes, written once to the shared folder.
2. Each window of ``width`` bytes has an anchor, the ``ANCHOR``-byte string in it with the least hash.
   Equal windows have equal anchors. Chunks ask the anchors' bins which anchors occur in two documents or
   more, and which document with an equal text has the smallest id; only that one goes on, for all windows of the
   others start in it too. The question has a number of about three bytes an anchor; the answer has one byte.
3. The windows whose anchors are repeated, in runs with the same anchor, go to the anchor's bin as
   strings, each different string once a chunk with its smallest id. Each bin sorts the suffixes of its strings
   by anchor and first ``width`` bytes (``suffixes``), where equal windows are neighbours that share
   ``width`` bytes, and answers each window's smallest id. A string that is alone with its anchor shares no window
   with another string and stays out of the order: its windows' smallest id is its own.
4. Each chunk marks the bytes to remove.

A shuffle partition has several bins, one after the other in a task. Chunks and bins grow with the square root of the
input, so that the messages between them (one for each chunk and bin) keep their size and grow in number as the input does.
The windows of an anchor that is in more than ``HOT`` documents
go out one by one, to bins by their whole content, so that no anchor, common line or group of copies
fills a bin: equal ones have been merged in each chunk, different ones are dealt out. Nothing
is capped or left out. A bin or a chunk is all that a task ever holds.

Defined results: a null text is empty; texts under ``width`` bytes lose nothing; a null id counts as
larger than any other, and like equal ids of repeated rows is not smaller than itself; an
empty table gives no rows; ``spans`` reads only id and text, ``without_repeats`` carries the other columns
through. Removal is by bytes: bytes of a character cut in two are dropped from the text, not from
the counts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import suffixes
from .common import handing_back, mixed_numbers, partitions, text_bytes, written

#: Of a passage that is repeated, a short anchor makes longer and fewer strings, which overlap less.
WIDTH, ANCHOR = 50, 20
#: Least bytes of texts a chunk and a bin, and bytes of all texts that a message between the two stands for.
CHUNK_BYTES, BIN_BYTES, MESSAGE_BYTES = 2 << 20, 2 << 20, 512
CHUNK_DOCUMENTS = 8192
#: From so many documents on, an anchor's windows are dealt out by their whole content.
HOT = 1000
#: Bytes whose anchors are found at a time; their positions have to fit in the hashes' low bits.
_STEP, _LOW = 1 << 16, 21
_NONE = np.iinfo(np.int64).max
_BYTES = mixed_numbers(977, 256) | np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
MESSAGE = "chunk long, kind int, bin int, a binary, b binary, c binary, d binary"
#: Kinds of messages, in the order in which a chunk reads them.
TEXTS, ANCHORS, WINDOWS = 0, 1, 2


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["chunk", "kind", "bin", "a", "b", "c", "d"])


def _squeeze(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def _loose(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def _planes(x: np.ndarray) -> bytes:
    """x with all lowest bytes first, then the next ones: sorted or small numbers so compress in the shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplaned(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(_FACTOR), k, 1 << 64))


def _hashes(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-byte string of x, by doubling."""
    level, size, out, have = _BYTES[x], 1, None, 0
    while True:
        if k & size:
            out = level if out is None else out[: len(out) - size] * _power(size) + level[have : have + len(out) - size]
            have += size
        if have == k:
            break
        level = level[: len(level) - size] * _power(size) + level[size:]
        size *= 2
    out = out[: max(0, len(x) - k + 1)]
    return (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k neighbours."""
    size = 1
    while size * 2 <= k:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (k - size)], x[k - size :]) if k > size else x


@dataclass
class Runs:
    """Runs of windows of one document with one anchor: first and last window, document, hash and place of the anchor."""

    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    anchor: np.ndarray


def runs(x: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> Runs:
    firsts, lasts, docs, anchors = [], [], [], []
    total = len(x)
    # where runs end whatever their anchor: documents begin, and their last windows have begun
    edges = np.unique(np.concatenate((offsets, np.maximum(offsets[1:] - width + 1, offsets[:-1]))))
    low = np.uint64((1 << _LOW) - 1)
    for at in range(0, max(0, total - width + 1), _STEP):
        part = x[at : min(total, at + _STEP + width - 1)]
        n = len(part) - width + 1
        h = _hashes(part, ANCHOR)
        h &= ~low
        h |= np.arange(len(h), dtype=np.uint64)
        best = _least(h, width - ANCHOR + 1)[:n]
        change = np.ones(n, bool)
        np.not_equal(best[1:], best[:-1], out=change[1:])
        lo, hi = np.searchsorted(edges, (at, at + n))
        change[edges[lo:hi] - at] = True
        start = np.flatnonzero(change)
        stop = np.append(start[1:], n) - 1
        doc = np.searchsorted(offsets, start + at, "right") - 1
        good = start + at + width <= offsets[doc + 1]
        start, stop, doc = start[good], stop[good], doc[good]
        firsts.append(start + at)
        lasts.append(stop + at)
        docs.append(doc)
        anchors.append(best[start] >> np.uint64(_LOW))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return Runs(join(firsts, np.int64), join(lasts, np.int64), join(docs, np.int64), join(anchors, np.uint64))


class Chunk:
    """A chunk's documents, and what it asks and is answered. Questions are in a fixed order, so that answers need no keys."""

    def __init__(self, number: int, ids: bytes, offsets: bytes, data: bytes, bins: int, width: int):
        self.number, self.bins, self.width = number, bins, width
        self.ids, self.offsets = np.frombuffer(ids, np.int64), np.frombuffer(offsets, np.int64)
        self.x = np.frombuffer(_loose(data), np.uint8)
        self.runs = runs(self.x, self.offsets, width)
        self.bin = (self.runs.anchor % np.uint64(bins)).astype(np.int64)
        key = (self.bin.astype(np.uint64) << np.uint64(32)) | (self.runs.anchor // np.uint64(bins) & np.uint64(0xFFFFFFFF))
        self.keys, self.of_run = np.unique(key, return_inverse=True)
        self.owners = self.ids.copy()

    def text(self, k: int) -> bytes:
        return self.x[self.offsets[k] : self.offsets[k + 1]].tobytes()

    def _cuts(self) -> Iterator[tuple[int, slice]]:
        """The keys of each bin."""
        b = (self.keys >> np.uint64(32)).astype(np.int64)
        edge = np.concatenate(([0], np.flatnonzero(np.diff(b)) + 1, [len(b)])) if len(b) else [0]
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            yield int(b[lo]), slice(lo, hi)

    def ask_anchors(self) -> Iterator[tuple]:
        """To each bin: its anchors with the number of documents that have them (at most 65535), and digests and ids of texts."""
        pair = np.unique(self.of_run.astype(np.uint64) << np.uint64(32) | self.runs.doc.astype(np.uint64))
        docs = np.minimum(np.bincount((pair >> np.uint64(32)).astype(np.int64), minlength=len(self.keys)), 65535).astype(np.uint16)
        digests = np.array([np.frombuffer(hashlib.blake2b(self.text(k), digest_size=16).digest(), np.uint64) for k in range(len(self.ids))], np.uint64).reshape(-1, 2)
        home = (digests[:, 0] % np.uint64(self.bins)).astype(np.int64)
        # a bin's keys ascend, so that their differences are small
        asked = {b: (_planes(np.diff(self.keys[s].astype(np.uint32), prepend=np.uint32(0))), _planes(docs[s])) for b, s in self._cuts()}
        for b in sorted(set(asked) | set(home.tolist())):
            here = np.flatnonzero(home == b)
            yield (self.number, ANCHORS, b, *asked.get(b, (b"", b"")), digests[here].tobytes(), self.ids[here].tobytes() + here.astype(np.int64).tobytes())

    def hear_anchors(self, answers: list[tuple[int, bytes, bytes]]) -> None:
        """From each bin: 0, 1 (repeated) or 2 (hot) for each anchor; places and owners of texts."""
        self.level = np.zeros(len(self.keys), np.uint8)
        by_bin = {b: np.frombuffer(levels, np.uint8) for b, levels, _ in answers}
        for b, s in self._cuts():
            self.level[s] = by_bin[b]
        for _, _, owners in answers:
            o = np.frombuffer(owners, np.int64).reshape(2, -1)
            self.owners[o[0]] = o[1]

    def strings(self) -> Iterator[tuple[int, dict[bytes, list]]]:
        """For each bin the chunk's different strings: least id, the places where they start, and the number of their anchor (hot ones: of the string)."""
        level = self.level[self.of_run] if len(self.keys) else np.zeros(0, np.uint8)
        go = np.flatnonzero((level > 0) & (self.owners == self.ids)[self.runs.doc])
        raw, out = self.x.tobytes(), {}
        width, bins = self.width, self.bins
        key = (self.keys[self.of_run[go]] & np.uint64(0xFFFFFFFF)).tolist()
        for first, last, doc, home, hot, k in zip(self.runs.first[go].tolist(), self.runs.last[go].tolist(), self.ids[self.runs.doc[go]].tolist(), self.bin[go].tolist(), (level[go] > 1).tolist(), key, strict=True):
            if hot:
                for at in range(first, last + 1):
                    s = raw[at : at + width]
                    h = int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little")
                    self._add(out, h % bins, s, doc, at, h // bins & 0xFFFFFFFF)
            else:
                self._add(out, home, raw[first : last + width], doc, first, k)
        for b in sorted(out):
            yield b, out[b]

    @staticmethod
    def _add(out: dict, b: int, s: bytes, doc: int, at: int, key: int) -> None:
        known = out.setdefault(b, {}).get(s)
        if known is None:
            out[b][s] = [doc, [at], key]
        else:
            known[0] = min(known[0], doc)
            known[1].append(at)

    def ask_windows(self) -> Iterator[tuple]:
        for b, found in self.strings():
            yield (self.number, WINDOWS, b, b"".join(found), np.array([len(s) for s in found], np.uint8).tobytes(), np.array([v[0] for v in found.values()], np.int64).tobytes(), np.array([v[2] for v in found.values()], np.uint32).tobytes())

    def hear_windows(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which bytes to remove."""
        late = np.zeros(len(self.x) + 1, bool)  # windows that start here and in a document with a smaller id
        doc_of = self.ids[np.repeat(np.arange(len(self.ids)), np.diff(self.offsets))] if len(self.x) else np.zeros(0, np.int64)
        for b, found in self.strings():
            least = np.frombuffer(_loose(answers[b]), np.int64)
            n = np.fromiter((len(s) - self.width + 1 for s in found), np.int64, len(found))
            times = np.fromiter((len(places) for _, places, _ in found.values()), np.int64, len(found))
            at = np.array([x for _, places, _ in found.values() for x in places], np.int64)
            first, n = np.repeat(np.cumsum(n) - n, times), np.repeat(n, times)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = np.repeat(at, n) + step
            late[place] = least[np.repeat(first, n) + step] < doc_of[place]
        edge = late.astype(np.int8)
        edge[self.width :] -= late[: -self.width]
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        for k in np.flatnonzero(self.owners < self.ids):
            if self.offsets[k + 1] - self.offsets[k] >= self.width:
                gone[self.offsets[k] : self.offsets[k + 1]] = True
        return gone


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows with equal ``key``, which come together."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _judge_anchors(rows: list[dict]) -> Iterator[tuple]:
    """A bin's answers: how common each anchor is over all chunks, and the least id of each text."""
    keys = np.concatenate([np.cumsum(_unplaned(r["a"], np.uint32), dtype=np.uint32) for r in rows])
    docs = np.concatenate([_unplaned(r["b"], np.uint16) for r in rows])
    order = np.argsort(keys, kind="stable")
    heads = np.flatnonzero(np.diff(keys[order], prepend=keys[order[:1]] + np.uint32(1)) != 0) if len(keys) else np.zeros(0, np.int64)
    levels = np.zeros(len(keys), np.uint8)
    if len(keys):
        n = np.add.reduceat(docs[order].astype(np.int64), heads)
        levels[order] = np.repeat((n >= 2).astype(np.uint8) + (n > HOT), np.diff(np.append(heads, len(keys))))
    texts = np.concatenate([np.frombuffer(r["c"], np.uint64) for r in rows]).reshape(-1, 2)
    ids = [np.frombuffer(r["d"], np.int64).reshape(2, -1) for r in rows]
    owner = np.concatenate([i[0] for i in ids])
    if len(owner):
        _, same = np.unique(texts, axis=0, return_inverse=True)
        low = np.full(same.max() + 1, _NONE)
        np.minimum.at(low, same.ravel(), owner)
        owner = low[same.ravel()]
    k = t = 0
    for r, i in zip(rows, ids, strict=True):
        n, m = len(r["a"]) // 4, i.shape[1]
        yield (r["chunk"], ANCHORS, r["bin"], levels[k : k + n].tobytes(), i[1].tobytes() + owner[t : t + m].tobytes(), None, None)
        k, t = k + n, t + m


def _judge_windows(rows: list[dict], width: int) -> Iterator[tuple]:
    """A bin's answers: the least id of each window of each string."""
    known: dict[bytes, int] = {}
    least: list[int] = []
    anchor: list[int] = []
    asked: list[tuple[int, int, np.ndarray]] = []
    for r in rows:
        raw, at, mine = r["a"], 0, []
        for size, doc, key in zip(r["b"], np.frombuffer(r["c"], np.int64).tolist(), np.frombuffer(r["d"], np.uint32).tolist(), strict=True):
            s = raw[at : at + size]
            at += size
            k = known.setdefault(s, len(least))
            if k == len(least):
                least.append(doc)
                anchor.append(key)
            elif doc < least[k]:
                least[k] = doc
            mine.append(k)
        asked.append((r["chunk"], r["bin"], np.array(mine, np.int64)))
    lengths, low = np.array([len(s) for s in known], np.int64), np.array(least, np.int64)
    text = np.frombuffer(b"".join(known), np.uint8)
    starts = np.cumsum(lengths) - lengths
    known.clear()
    windows = lengths - width + 1
    first = np.cumsum(windows) - windows
    found = np.repeat(low, windows)
    _, of, times = np.unique(np.array(anchor, np.uint32), return_inverse=True, return_counts=True)
    if len(company := np.flatnonzero(times[of] > 1)):
        part, at = suffixes.least_of_equal(text, starts[company], lengths[company], low[company], of[company], width)
        found[np.repeat(first[company] - at[:-1], windows[company]) + np.arange(len(part))] = part
    for chunk, b, mine in asked:
        n = windows[mine]
        yield (chunk, WINDOWS, b, _squeeze(found[np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes()), None, None, None)


def _chunks(df: DataFrame, key: str, text: str, carried: list[str], size: int) -> DataFrame:
    """Packed documents of about ``size`` bytes: a ids, b offsets, c texts, d the carried columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seq, held, have = TaskContext.get().partitionId() << 32, 0, [], [0, 0]

        def pack() -> pa.RecordBatch:
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            x, offsets = text_bytes(b.column(1))
            ids = b.column(0).fill_null(_NONE).to_numpy(zero_copy_only=False).astype(np.int64)
            rest = b.select(b.schema.names[2:])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as w:
                w.write_batch(rest)
            return _messages([(number + seq, TEXTS, None, ids.tobytes(), offsets.astype(np.int64).tobytes(), _squeeze(x.tobytes()), _squeeze(sink.getvalue().to_pybytes()))])

        for b in batches:
            _, offsets = text_bytes(b.column(1))
            lo = 0
            while lo < b.num_rows:
                room = np.searchsorted(offsets, offsets[lo] + size - have[0], "right") - 1
                hi = int(min(max(room, lo + 1), lo + CHUNK_DOCUMENTS - have[1], b.num_rows))
                held.append(b.slice(lo, hi - lo))
                have = [have[0] + int(offsets[hi] - offsets[lo]), have[1] + hi - lo]
                if hi < b.num_rows or have[0] >= size or have[1] >= CHUNK_DOCUMENTS:
                    yield pack()
                    seq, held, have = seq + 1, [], [0, 0]
                lo = hi
        if held:
            yield pack()

    cols = [F.col(f"`{key}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"), *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(carried)]]
    return df.select(*cols).mapInArrow(handing_back(run), MESSAGE)


def _processed(df: DataFrame, key: str, text: str, carried: list[str], width: int, schema: StructType, finish: Callable[[Chunk, np.ndarray, bytes], pa.RecordBatch]) -> DataFrame:
    spark = df.sparkSession
    tasks = partitions(spark)
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    even = math.isqrt(total * MESSAGE_BYTES)
    bins = tasks * max(1, -(-total // (max(BIN_BYTES, even) * tasks)))
    chunks = written(_chunks(df, key, text, carried, max(CHUNK_BYTES, even)), "chunks", "none")

    def opened(rows: list[dict]) -> Chunk:
        return Chunk(rows[0]["chunk"], rows[0]["a"], rows[0]["b"], rows[0]["c"], bins, width)

    def heard(rows: list[dict]) -> Chunk:
        chunk = opened(rows)
        chunk.hear_anchors([(r["bin"], r["a"], r["b"]) for r in rows if r["kind"] == ANCHORS])
        return chunk

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "chunk"):
            yield _messages(list(opened(rows).ask_anchors()))

    def judge_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "bin"):
            yield _messages(list(_judge_anchors(rows)))

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "chunk"):
            if asked := list(heard(rows).ask_windows()):
                yield _messages(asked)

    def judge_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "bin"):
            yield _messages(list(_judge_windows(rows, width)))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "chunk"):
            chunk = heard(rows)
            gone = chunk.hear_windows({r["bin"]: r["a"] for r in rows if r["kind"] == WINDOWS})
            yield finish(chunk, gone, rows[0]["d"])

    def to_bins(asked: DataFrame) -> DataFrame:
        return asked.repartitionById(tasks, F.col("bin") % tasks).sortWithinPartitions("bin", "chunk")

    def to_chunks(found: DataFrame, *answers: DataFrame) -> DataFrame:
        for a in answers:
            found = found.unionByName(a)
        return found.repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind", "bin")

    bare = chunks.withColumn("d", F.lit(None).cast("binary"))
    common = written(to_bins(bare.mapInArrow(handing_back(ask_anchors), MESSAGE)).mapInArrow(handing_back(judge_anchors), MESSAGE), "anchors")
    least = to_bins(to_chunks(bare, common).mapInArrow(handing_back(ask_windows), MESSAGE)).mapInArrow(handing_back(judge_windows), MESSAGE)
    return to_chunks(chunks, common, written(least, "windows")).mapInArrow(handing_back(close), schema)


def spans(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    schema = StructType([StructField("doc_id", LongType()), *[StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")], StructField("kept_sha256", StringType())])

    def finish(chunk: Chunk, gone: np.ndarray, _: bytes) -> pa.RecordBatch:
        out = []
        for k, doc in enumerate(chunk.ids.tolist()):
            lo, hi = chunk.offsets[k], chunk.offsets[k + 1]
            g = gone[lo:hi]
            starts = int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if len(g) else 0
            out.append((None if doc == _NONE else doc, int(hi - lo), int(g.sum()), starts, hashlib.sha256(chunk.x[lo:hi][~g].tobytes()).hexdigest()))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names=schema.names)

    return _processed(df, key, text, [], width, schema, finish)


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars", width: int = WIDTH) -> DataFrame:
    """df with repeated passages removed from ``text``, and ``length`` (if df has it) the new number of characters."""
    names = df.columns
    at, counted = names.index(text), names.index(length) if length in names else -1

    def finish(chunk: Chunk, gone: np.ndarray, rest: bytes) -> pa.RecordBatch:
        table = pa.ipc.open_stream(_loose(rest)).read_all().combine_chunks()
        old = table.column(at).to_pylist()
        new = []
        for k, t in enumerate(old):
            lo, hi = chunk.offsets[k], chunk.offsets[k + 1]
            new.append(t if not gone[lo:hi].any() else chunk.x[lo:hi][~gone[lo:hi]].tobytes().decode("utf-8", "ignore"))
        cols = [table.column(k).combine_chunks() if table.num_rows else table.column(k) for k in range(len(names))]
        cols[at] = pa.array(new, pa.string())
        if counted >= 0:
            cols[counted] = pa.array([c if o == n else len(n) for o, n, c in zip(old, new, table.column(counted).to_pylist(), strict=True)], table.schema.field(counted).type)
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=names)

    return _processed(df, key, text, names, width, df.schema, finish)
