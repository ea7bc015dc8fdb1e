"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits: a bit is 1 if it is set in more than half of the hashes of the document's
word shingles. Two fingerprints are linked when they differ in at most ``radius`` bits.

Covering masks (for radius r, 2^(r+1) - 1 tables): bit i of a fingerprint gets a vector m(i) of
r + 1 bits, and the table of the nonzero vector v keeps the bits with <m(i), v> = 1. The vectors
m(i) of r differing bits span at most r dimensions, so some v is orthogonal to all of them, and the
mask of v drops every differing bit: each pair within the radius collides in some table, always.

Large buckets are refined exactly: the fingerprints of a bucket agree on the bits its mask keeps, so
the same construction over the dropped bits splits it into smaller buckets that still cover each
pair. No bucket is capped. Within a small bucket all distances are taken at once, and only a
spanning forest of its links is kept, so output grows with rows and not with pairs. Connected
components come from minimum labels passed along links, with pointer jumping.

Defined results: a null or empty text has fingerprint zero and is linked like any other; a null
doc_id is never a component_id unless the whole component has none; repeated rows share a
fingerprint and come out once each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, handing_back, ids_sent_round, partitions, written

BITS = 64
SEED = 42
#: Buckets above this size are refined; up to it, distances within the bucket are computed.
SMALL = 512
#: Where a mask keeps this many bits there is little left to split by, and distances are computed at any size.
ENOUGH = 44
#: Documents whose shingles are counted to know common ones, how many of them make one common, and how many are remembered.
SAMPLE, COMMON, REMEMBERED = 8192, 3, 1 << 18
#: Groups of this size that share a shingle are thinned by their first rows before all pairs are judged.
LARGE = 64
#: Pairs in lists that are made at a time.
MEETING = 1 << 18


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of a text: lower-cased A-Z, words between ASCII white space, XXH64 of the shingles."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    else:
        ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
        starts = np.concatenate(([0], ends[:-words] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)
    set_in = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        set_in += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(hashes)).view(">u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(handing_back(run), f"doc_id {kind}, fp long")


def masks(bits: list[int], radius: int, parts: int = 1) -> list[int]:
    """Covering masks over the given bit positions.

    With more than one part the positions are dealt out to the parts; of a pair within the radius
    some part differs in at most radius // parts bits, and that part's masks cover it.
    """
    dims, out = radius // parts + 1, []
    for p in range(parts):
        # spread the nonzero vectors evenly over the positions, so that each mask keeps about half of them
        given = {b: 1 + k % (2**dims - 1) for k, b in enumerate(bits[p::parts])}
        out += [sum(1 << b for b, m in given.items() if (m & v).bit_count() & 1) for v in range(1, 2**dims)]
    return out


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within a bucket of distinct fingerprints: breadth first, one row of distances at a time."""
    if len(fps) == 2:
        return [(0, 1)] if (int(fps[0]) ^ int(fps[1])).bit_count() <= radius else []
    todo, edges = np.arange(len(fps)), []
    while len(todo):
        stack, todo = [todo[0]], todo[1:]
        while stack and len(todo):
            u = stack.pop()
            near = np.bitwise_count(fps[todo] ^ fps[u]) <= radius
            found, todo = todo[near], todo[~near]
            edges += [(int(u), x) for x in found.tolist()]
            stack += found.tolist()
    return edges


def _tables(df: DataFrame, radius: int, parts: int) -> DataFrame:
    """(fp, kept) to (fp, kept, bucket) in each table that covers the bits outside ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            fp, kept = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            for k in np.unique(kept):
                if int(k) not in known:
                    free = [i for i in range(BITS) if not int(k) >> i & 1]
                    known[int(k)] = np.array([int(k) | m for m in masks(free, radius, parts)], np.uint64)
                rows = fp[kept == k]
                for m in known[int(k)]:
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (rows, np.full(len(rows), m), rows & m)], names=["fp", "kept", "bucket"])

    return df.mapInArrow(handing_back(run), "fp long, kept long, bucket long")


def _links(df: DataFrame, radius: int, small: int) -> DataFrame:
    """Buckets to links (u, v); members of buckets above ``small`` come back as (fp, kept) with v null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def out(u: np.ndarray, v: np.ndarray | None, kept: np.ndarray) -> pa.RecordBatch:
            v = pa.nulls(len(u), pa.int64()) if v is None else pa.array(v)
            return pa.RecordBatch.from_arrays([pa.array(u), v, pa.array(kept)], names=["u", "v", "kept"])

        def close(fps: np.ndarray, kept: int, large: bool) -> pa.RecordBatch | None:
            if large:
                return out(fps, None, np.full(len(fps), kept, np.uint64).view(np.int64))
            edges = _forest(fps.view(np.uint64), radius)
            return out(*(fps[[e[i] for e in edges]] for i in (0, 1)), np.full(len(edges), kept, np.uint64).view(np.int64)) if edges else None

        large = False
        for b in batches:
            fp, kept, bucket = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cut = np.flatnonzero((kept[1:] != kept[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            los, his = np.concatenate(([0], cut)), np.append(cut, len(fp))
            alone = his - los == 1  # nothing to link, unless the bucket goes on in another batch
            alone[[0, -1]] = False
            for lo, hi in zip(los[~alone].tolist(), his[~alone].tolist(), strict=True):
                if lo == hi:
                    continue
                if at != (here := (int(kept[lo]) & (1 << BITS) - 1, int(bucket[lo]))):
                    if held and (r := close(np.concatenate(held), at[0], large)):
                        yield r
                    held, at, large = [], here, False
                held.append(fp[lo:hi])
                if at[0].bit_count() < ENOUGH and (large or sum(map(len, held)) > small):  # let the rows of a large bucket through as they come
                    large = True
                    yield close(np.concatenate(held), at[0], True)  # whole as they are: no bucket is held in memory
                    held = []
        if held and (r := close(np.concatenate(held), at[0], large)):
            yield r

    n = partitions(df.sparkSession)
    return df.repartition(n, "kept", "bucket").sortWithinPartitions("kept", "bucket").mapInArrow(handing_back(run), "u long, v long, kept long")


def links(distinct: DataFrame, radius: int = 3, small: int = SMALL, parts: int = 1) -> DataFrame:
    """Links (u, v) that connect all fingerprints within the radius, from distinct fingerprints ``fp``."""
    found, todo = None, distinct.select("fp", F.lit(0).cast("long").alias("kept"))
    while True:
        step = written(_links(_tables(todo, radius, parts), radius, small), "links")
        part = step.where("v is not null").select("u", "v")
        found = part if found is None else found.union(part)
        todo = step.where("v is null").select(F.col("u").alias("fp"), "kept").distinct()
        if not todo.take(1):
            return found


def components(found: DataFrame) -> DataFrame:
    """(node, label): for each linked node the smallest node of its connected component."""
    both = written(found.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*"), "edges")
    step = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("new"), F.col("u").alias("label")), "labels")
    while step.where("new <> label").take(1):
        labels = step.select("node", F.col("new").alias("label"))
        # the least label among the neighbours, then the label of that label
        seen = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("seen"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        after = labels.join(seen, F.col("node") == F.col("u")).select("node", "label", F.least("label", "seen").alias("new"))
        after = written(after.join(up, F.col("new") == F.col("up")).select("node", F.least("new", "up_label").alias("new"), "label"), "labels")
        discard(step)
        step = after
    discard(both)
    return step.select("node", F.col("new").alias("label"))


def grouped(docs: DataFrame, radius: int = 3, parts: int = 1) -> DataFrame:
    """(doc_id, fp) to (doc_id, fp, component_id): the smallest doc_id that links of at most ``radius`` bits reach."""
    distinct = docs.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labels = components(links(distinct.select("fp"), radius, parts=parts))
    known = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("label", "fp").alias("label"), "first")
    heads = known.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = known.join(heads, "label").select("fp", "component_id")
    return docs.join(classes, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3, parts: int = 1) -> DataFrame:
    """doc_id, fp, component_id of each row of df."""
    return grouped(written(fingerprints(df, key, text, words), "fingerprints"), radius, parts)


def _exact(text: str | None, words: int) -> set[bytes]:
    """The word shingles; a text of fewer words is one shingle."""
    t = (text or "").encode().lower().split()
    return {b" ".join(t[k : k + words]) for k in range(max(1, len(t) - words + 1))}


def jaccard(a: str | None, b: str | None, words: int = 5) -> float:
    """Likeness of the sets of word shingles; texts of fewer words are one shingle, no words are equal to no words."""
    x, y = _exact(a, words), _exact(b, words)
    return len(x & y) / len(x | y)


def _shingles(text: str | None, words: int) -> np.ndarray:
    """The different XXH64 hashes of the shingles that ``jaccard`` compares, ascending."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-words] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64))


def _common(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample have, ascending, and in how many. They only order shingles: any sample gives the same pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_shingles(t.as_py(), words).view(np.int64))], names=["h"])

    some = rows.where(F.pmod(F.xxhash64("row"), F.lit(max(1, rows.count() // SAMPLE))) == 0)
    counts = some.select("text").mapInArrow(handing_back(run), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    found = counts.orderBy(F.col("n").desc(), "h").limit(REMEMBERED).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _rest(size: Column | int, similarity: float) -> Column | int:
    """Shingles of a set that are not among its first."""
    if isinstance(size, Column):
        return F.ceil(size * similarity - 1e-9) - 1
    return math.ceil(similarity * size - 1e-9) - 1


def prefixes(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """row, fp, same (equal for equal sets of shingles), size of the set, and its rarest shingles: of a pair with that likeness some are in both.

    A row whose set a smaller row of its batch has, has same, size and firsts null: copies are met where they lie.
    """
    shared = rows.sparkSession.sparkContext.broadcast(_common(rows, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known, often = shared.value
        for b in batches:
            number, fps, same, sizes, firsts = b.column(0).to_pylist(), [], [], [], []
            least: dict[bytes, int] = {}
            for t in b.column(1):
                t = t.as_py()
                fps.append(fingerprint(t))
                h = _shingles(t, words)
                digest = xxhash.xxh128_digest(h.tobytes())
                k = len(same)
                first = least.setdefault(digest, k)
                same.append(digest)
                if first != k and number[first] < number[k]:
                    same[k] = None
                    sizes.append(None)
                    firsts.append(None)
                    continue
                if first != k:
                    least[digest], same[first] = k, None
                    sizes.append(sizes[first])
                    firsts.append(firsts[first])
                    sizes[first] = firsts[first] = None
                    continue
                count = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    count = np.where(known[at] == h, often[at], 0)
                sizes.append(len(h))
                firsts.append(h[np.lexsort((h, count))[: len(h) - _rest(len(h), similarity)]].view(np.int64))
            cols = [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(same, pa.binary()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "fp", "same", "size", "firsts"])

    return rows.select("row", "text").mapInArrow(handing_back(run), "row long, fp long, same binary, size long, firsts array<long>")


def _buckets(members: DataFrame) -> DataFrame:
    """(h, row, size) to (h, row, size, lead, lead_size, place): the least row with the same shingle, and how many come before. Shingles of one row drop out."""
    names = ["h", "row", "size", "lead", "lead_size", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row: whether it has company is known with the next
        for b in batches:
            if not b.num_rows:
                continue
            h, row, size = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if held is not None:
                h, row, size = (np.append(x, y) for x, y in zip(held[:3], (h, row, size), strict=True))
            new = np.append(True, h[1:] != h[:-1])
            heads = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            lead, lead_size, place = row[heads], size[heads], np.arange(len(h)) - heads
            if held is not None:
                lead, lead_size, place = (np.where(heads == 0, x, y) for x, y in ((held[3], lead), (held[4], lead_size), (place + held[5], place)))
            keep = (place > 0) | np.append(~new[1:], False)
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep[:-1]]) for x in (h, row, size, lead, lead_size, place)], names=names)
            held = h[-1], row[-1], size[-1], lead[-1], lead_size[-1], place[-1]
        if held is not None and held[5] > 0:
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in held], names=names)

    n = partitions(members.sparkSession)
    return members.select("h", "row", "size").repartition(n, "h").sortWithinPartitions("h", "row").mapInArrow(handing_back(run), ", ".join(f"{c} long" for c in names))


def _possible(met: DataFrame, similarity: float) -> DataFrame:
    """(lead, lead_size, row, size), one for each shingle that both have among their first, to the pairs (lead, row) that may be alike.

    What one set has in common with the other is among the first of both, or in the rest of the set
    whose first end first. Likeness of t needs t / (1 + t) of both sizes, so that many less the larger
    rest have to be met.
    """
    need = F.ceil((F.col("lead_size") + F.col("size")) * (similarity / (1 + similarity)) - 1e-9)
    rest = _rest(F.greatest("lead_size", "size"), similarity)
    near = F.least("lead_size", "size") >= F.greatest("lead_size", "size") * similarity - 1e-9
    return met.where(near).groupBy("lead", "row", "lead_size", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need - rest).select("lead", "row")


def _all_possible(members: DataFrame, similarity: float) -> DataFrame:
    """(h, row, size) to the pairs (lead, row) of ``_possible`` among all rows that share a shingle.

    Each row of a bucket gets the list of rows before it, so that pairs move as numbers in lists; lists of one row
    come together in one task, which counts and filters them.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # the bucket that may go on
        for b in batches:
            if not b.num_rows:
                continue
            old = len(held[0])
            h, row, size = (np.concatenate((x, b.column(i).to_numpy(zero_copy_only=False))) for i, x in enumerate(held))
            heads = np.maximum.accumulate(np.where(np.append(True, h[1:] != h[:-1]), np.arange(len(h)), 0))
            before = np.cumsum(np.arange(len(h)) - heads)
            cuts = np.searchsorted(before, np.arange(before[old - 1] if old else 0, before[-1] + MEETING, MEETING), "right")
            cuts = np.unique(np.clip([old, *cuts, len(h)], old, len(h))).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                me = np.arange(lo, hi)
                place = me - heads[me]
                you = np.repeat(heads[me] - np.cumsum(place) + place, place) + np.arange(place.sum())
                me = np.repeat(me, place)
                near = np.minimum(size[me], size[you]) >= np.maximum(size[me], size[you]) * similarity - 1e-9
                me, you = me[near], you[near]
                cut = np.flatnonzero(np.diff(me, prepend=-1))
                offsets = pa.array(np.append(cut, len(me)), pa.int32())
                cols = [row[me[cut]], size[me[cut]], *(pa.ListArray.from_arrays(offsets, pa.array(x[you])) for x in (row, size))]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["row", "size", "leads", "lead_sizes"])
            held = [x[heads[-1] :] for x in (h, row, size)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at = of = None

        def done() -> pa.RecordBatch:
            leads, sizes = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            leads, first, n = np.unique(leads, return_index=True, return_counts=True)
            sizes = sizes[first]
            rest = np.ceil(np.maximum(sizes, of) * similarity - 1e-9) - 1
            leads = leads[n >= np.ceil((sizes + of) * (similarity / (1 + similarity)) - 1e-9) - rest]
            return pa.RecordBatch.from_arrays([pa.array(leads), pa.array(np.full(len(leads), at))], names=["lead", "row"])

        for b in batches:
            row, size = (b.column(i).to_pylist() for i in (0, 1))
            values = [b.column(i).values.to_numpy(zero_copy_only=False) for i in (2, 3)]
            ends = b.column(2).offsets.to_pylist()
            for k, r in enumerate(row):
                if held and r != at:
                    yield done()
                    held = []
                at, of = r, size[k]
                held.append(tuple(v[ends[k] : ends[k + 1]] for v in values))
        if held:
            yield done()

    n = partitions(members.sparkSession)
    lists = members.select("h", "row", "size").repartition(n, "h").sortWithinPartitions("h", "row").mapInArrow(handing_back(meet), "row long, size long, leads array<long>, lead_sizes array<long>")
    return lists.repartition(n, "row").sortWithinPartitions("row").mapInArrow(handing_back(count), "lead long, row long")


def _alike(pairs: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (lead, row) whose texts are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, set()
        for b in batches:
            close = []
            for lead, one, other in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if lead != last:
                    last, x = lead, _exact(one.as_py(), words)
                y = _exact(other.as_py(), words)
                close.append(len(x & y) / len(x | y) >= similarity)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["lead", "row"]).filter(pa.array(close, pa.bool_()))

    pairs = written(pairs.distinct(), "pairs")
    asked = written(pairs.select(F.explode(F.array("lead", "row")).alias("row")).distinct(), "asked")
    texts = written(rows.select("row", "text").join(ids_sent_round(asked), "row", "left_semi"), "texts")
    both = pairs.join(texts.select("row", F.col("text").alias("b")), "row").join(texts.select(F.col("row").alias("lead"), F.col("text").alias("a")), "lead")
    out = written(both.select("lead", "row", "a", "b").mapInArrow(handing_back(run), "lead long, row long"), "alike")
    discard(pairs, asked, texts)
    return out


def _losers(edges: DataFrame) -> DataFrame:
    """Of alike pairs (lead, row), lead < row: the rows that are alike to a lesser row that stays."""
    gone = None
    while True:
        stays = edges.select("lead").distinct().join(edges.select(F.col("row").alias("lead")), "lead", "left_anti")
        lost = written(edges.join(stays, "lead", "left_semi").select("row").distinct(), "lost")
        gone = lost if gone is None else gone.union(lost)
        left = edges.join(lost, "row", "left_anti").join(lost.withColumnRenamed("row", "lead"), "lead", "left_anti")
        left = written(left, "edges")
        discard(edges)
        edges = left
        if not edges.take(1):
            return gone


def _later_of_class(near: DataFrame, gone: DataFrame) -> DataFrame:
    """Of classes (lead, row), whose first row is lead: the rows not gone that have a lesser one of their class that isn't gone."""
    left = near.union(near.select("lead", F.col("lead").alias("row")).distinct()).join(gone, "row", "left_anti")
    heads = left.groupBy("lead").agg(F.min("row").alias("head"))
    return left.join(heads, "lead").where("row <> head").select("row")


def _packed(df: DataFrame, key: str, text: str) -> DataFrame:
    """given (all columns of df), text, and row: a number for each row with a key, in the order of keys."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("given")).select("given", F.col("given")[key].alias("key"), F.col("given")[text].cast("string").alias("text"))
    known = packed.where("key is not null")
    if df.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") and not known.groupBy("key").count().where("count > 1").take(1):
        return packed.select("given", "text", F.col("key").cast("long").alias("row"))
    number = F.when(F.col("key").isNotNull(), F.monotonically_increasing_id())
    return written(packed.orderBy("key", F.xxhash64("text")).withColumn("row", number).select("given", "text", "row"), "rows")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, parts: int = 1, words: int = 5, similarity: float = 0.8, classes: bool = False) -> DataFrame:
    """df without near-duplicates: in the order of the key, a row goes if it is alike (word shingles, Jaccard) to one that stays.
    With ``classes``, one row of each class of fingerprints (``grouped`` over all rows) stays of those left: copies whose
    shingles are much the same by number, though their sets differ by more.

    Every alike pair is met. Shingles have one order, rare ones first; two sets of that likeness share
    some of their first (1 - similarity) x size + 1 (prefix filter; exact up to collisions of 64-bit hashes),
    and how many they have to share follows from their sizes (``_possible``).
    Equal sets are judged once. A row that comes first wherever it has such a shingle stays, and rows
    like it go: of those, the rows with fingerprints of three-word shingles within ``radius`` bits and
    the rows with enough shared shingles are asked. That is linear in large groups, and is done again while they
    shrink; of the rows left all pairs with enough shared shingles are judged. Rows are told apart by
    integral keys, or where keys are repeated or of another type by their
    number in the order of keys, so repeated keys are rows like others. Rows with a null key stay.
    """
    whole = _packed(df, key, text)
    rows = whole.where("row is not null").select("row", "text")
    sets = written(prefixes(rows, words, similarity), "prefixes")
    first = written(sets.where("same is not null").groupBy("same").agg(F.min("row").alias("row")).select("row"), "first")
    copies = written(sets.select("row").join(first, "row", "left_anti"), "copies")
    step = written(_buckets(sets.select("row", "size", "firsts").join(first, "row", "left_semi").select(F.explode("firsts").alias("h"), "row", "size")), "buckets")
    prints = written(sets.select(F.col("row").alias("doc_id"), "fp").join(first.select(F.col("row").alias("doc_id")), "doc_id", "left_semi"), "fingerprints")
    discard(sets, first)
    near = grouped(prints, radius, parts).where("doc_id <> component_id").select(F.col("component_id").alias("lead"), F.col("doc_id").alias("row"))
    near, gone = written(near, "near"), copies
    discard(prints)
    proposed = near
    while True:
        leads = written(step.groupBy("row").agg(F.min("lead").alias("lead")).where("row = lead").select("lead"), "leads")
        pairs = _possible(step.where("row <> lead").join(leads, "lead", "left_semi"), similarity)
        if proposed is not None:
            pairs = pairs.union(proposed.join(leads, "lead", "left_semi"))
        alike = _alike(pairs, rows, words, similarity)
        lost = written(alike.select("row").distinct(), "lost")
        gone = gone.union(lost)
        decided = lost.union(leads.select(F.col("lead").alias("row")))
        after = written(_buckets(step.join(decided, "row", "left_anti")), "buckets")
        some = lost.count() >= leads.count()
        discard(step, alike, leads)
        step, proposed = after, None
        most = step.agg(F.max("place")).first()[0]
        if most is None or most < LARGE or not some:
            break
    if most is not None:
        gone = gone.union(_losers(_alike(_all_possible(step, similarity), rows, words, similarity)))
    discard(step)
    gone = written(gone.distinct(), "gone")
    if classes:
        gone = written(gone.union(_later_of_class(near, gone)), "gone")
    discard(near)
    return whole.join(ids_sent_round(gone), "row", "left_anti").select("given.*")
