"""Approximate nearest neighbours by learned partitions.

A tree of partitions is learnt level by level. At each node a sample of its vectors (at most ``SAMPLE``)
gets a graph of near neighbours, the graph is cut into balanced parts that keep neighbours together, and a
small classifier (softmax of a linear map) learns in which parts a vector and its neighbours lie. The classifier deals
out all rows of the node, sampled or not, each to its most probable part. Held-out rows of the sample
say how much probability a query has to open so that the wanted share of its neighbours is in what it opens. Nodes that
still hold over ``LEAF`` rows are split again. Queries go down the same way, to several parts at each node,
and all rows of the leaves that they reach are measured in double precision on the original vectors.

Rows travel in blocks of one node, so that no group is ever gathered: blocks are joined with the node's classifier, and
blocks of queries with blocks of rows. A leaf that can't be split, or that is asked by very many queries, is just more blocks.
Equal vectors are indexed once, with the k + 1 smallest ids: no query can have others of them among its k nearest.

Defined results: vectors that are null, zero or hold null, NaN or infinite components take no part; vectors are compared only with
those of their length; rows of equal id and vector are one row; all rows with a query's id are its own and no candidates of
it; null ids take no part; ties go to the smaller id; a query with under k candidates in reach gets those; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, handing_back, partitions, written

#: Rows of a node that its graph and classifier are learnt from, at most; a quarter of them is held out to set how much is opened.
SAMPLE = 4096
#: Parts of a node, and rows up to which a node is left whole.
PARTS, LEAF = 16, 8192
#: Share of the true neighbours that the opened parts are to hold, over all levels.
TARGET = 0.96
#: Neighbours of each vector in the graph.
DEGREE = 10
#: Levels of the tree, at most: 16^12 nodes.
LEVELS = 12
#: Rows of a block.
BLOCK, ASKS = 4096, 256


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


# the learning of one node, on its sample


def nearest_of(a: np.ndarray, b: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the k rows of b nearest to each row of a; ``own`` is each row's own number in b, which is left out."""
    out, norms = np.zeros((len(a), k), np.int64), (b * b).sum(1)
    for lo in range(0, len(a), 512):
        d = norms - 2 * (a[lo : lo + 512] @ b.T)
        if own is not None:
            d[np.arange(len(d)), own[lo : lo + 512]] = np.inf
        out[lo : lo + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(near: np.ndarray, parts: int, seed: int = 7, rounds: int = 30, slack: float = 1.05) -> np.ndarray:
    """Part of each node of a neighbour graph: moves that keep more edges within parts, best first, while there is room."""
    n, draw = len(near), np.random.default_rng(seed)
    part, room = draw.permutation(n) % parts, int(np.ceil(n / parts * slack))
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    for _ in range(rounds):
        edges = np.bincount(a * parts + part[b], minlength=n * parts).reshape(n, parts) + draw.random((n, parts)) * 0.01
        gains = edges - edges[np.arange(n), part][:, None]
        wish = gains.argmax(1)
        gain, lazy = gains[np.arange(n), wish], draw.random(n) < 0.3  # not all at once, else neighbours swap sides for ever
        sizes, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0.02:
                break
            if not lazy[i] and sizes[wish[i]] < room:
                sizes[part[i]] -= 1
                sizes[wish[i]] += 1
                part[i] = wish[i]
                moved += 1
        if moved < n * 0.002:
            break
    return part


def probabilities(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each part, for each row; ``weights`` has a row for each component and one for the offset."""
    z = x @ weights[:-1] + weights[-1]
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def classifier(x: np.ndarray, wanted: np.ndarray, seed: int = 7, epochs: int = 20, rate: float = 0.02, decay: float = 1e-4) -> np.ndarray:
    """Softmax regression onto distributions over parts, by Adam in batches of 256."""
    x1, draw = np.hstack((x, np.ones((len(x), 1)))), np.random.default_rng(seed)
    w = draw.normal(0, 0.01, (x1.shape[1], wanted.shape[1]))
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for lo in range(0, len(x), 256):
            i = order[lo : lo + 256]
            g = x1[i].T @ (probabilities(x[i], w) - wanted[i]) / len(i) + decay * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def learnt(x: np.ndarray, k: int, parts: int, target: float) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights (for vectors as they are), probability to be opened, and rows of the sample by part: a node's router."""
    n, dim = x.shape
    count = int(np.clip(n // (4 * k), 1, parts))
    if count == 1:
        return np.zeros((dim + 1, 1)), 1.0, np.array([n])
    centre = x.mean(0)
    largest = float(np.abs(x - centre).max()) or 1.0
    scale = largest * (float(np.sqrt((((x - centre) / largest) ** 2).sum(1).mean())) or 1.0)
    x = (x - centre) / scale
    held = np.arange(n) % 4 == 3
    fit = x[~held]
    near = nearest_of(fit, fit, min(DEGREE, len(fit) - 1), np.arange(len(fit)))
    part, one = balanced_parts(near, count), np.eye(count)
    w = classifier(fit, 0.3 * one[part] + 0.7 * one[part[near]].mean(1))
    where = probabilities(x, w).argmax(1)
    # how much is ranked above the part of each true neighbour of a held-out row
    asked = probabilities(x[held], w)
    order = np.argsort(-asked, axis=1, kind="stable")
    ranked, above = np.take_along_axis(asked, order, 1), np.zeros_like(asked)
    np.put_along_axis(above, order, np.cumsum(ranked, 1) - ranked, 1)
    true = where[nearest_of(x[held], x, min(k, n - 1), np.nonzero(held)[0])]
    opened = float(np.quantile(np.take_along_axis(above, true, 1), target)) + 1e-9
    w[:-1] /= scale
    w[-1] -= centre @ w[:-1]
    return w, opened, np.bincount(where, minlength=count)


# blocks: rows of one node, as bytes

BLOCKS = "node string, ids binary, vs binary"
ROUTER = "node string, weights binary, parts int, opened double, sizes binary"


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column as its values and the number of each row's first."""
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (node, id, v) in blocks of at most ``size`` rows of one node. Nothing is shuffled; rows that stand together are packed together."""
    kind = np.float32 if rows.schema["v"].dataType.elementType.simpleString() == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            nodes = b.column(0).dictionary_encode()
            codes, ids = nodes.indices.to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            values, at = _vectors(b.column(2))
            order = np.argsort(codes, kind="stable")
            edges = np.concatenate((np.nonzero(np.diff(codes[order], prepend=-1))[0], [len(order)]))
            out = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                dim = int(at[order[lo] + 1] - at[order[lo]])  # of one node, so of one length
                for a in range(lo, hi, size):
                    i = order[a : min(a + size, hi)]
                    vs = values[(at[i][:, None] + np.arange(dim)).ravel()].astype(kind, copy=False)
                    out.append((nodes.dictionary[int(codes[i[0]])].as_py(), ids[i].astype(np.int64).tobytes(), vs.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.binary(), pa.binary()), strict=True)], names=["node", "ids", "vs"])

    return rows.select("node", "id", "v").mapInArrow(run, BLOCKS)


def _unpacked(ids: bytes, vs: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vs, kind).reshape(len(i), -1)


def routers(rows: DataFrame, opened: DataFrame, nodes: int, total: int, k: int, target: float) -> DataFrame:
    """A router for each node of ``opened``, learnt from a sample of its rows: those of least hash."""
    share = min(1.0, 4.0 * SAMPLE * nodes / max(total, 1))
    some = rows.withColumn("u", F.xxhash64(F.lit(13), F.col("id"))).where(F.col("u") < F.lit(int((share - 0.5) * 2**64) if share < 1 else 2**63 - 1))
    first = some.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("u", "id"))).where(F.col("r") <= SAMPLE).join(opened.select("node"), "node")

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("r").combine_chunks()
        x = _vectors(table.column("v").chunk(0))[0].astype(np.float64).reshape(table.num_rows, -1)
        w, least, sizes = learnt(x, k, PARTS, target)
        return pa.table({"node": [table.column("node")[0].as_py()], "weights": [w.tobytes()], "parts": pa.array([w.shape[1]], pa.int32()), "opened": [least], "sizes": [sizes.astype(np.int64).tobytes()]})

    return first.select("node", "r", "v").groupBy("node").applyInArrow(fit, ROUTER)


def _routed(rows: DataFrame, level: DataFrame, choose: Callable[[np.ndarray, float, np.ndarray], tuple[np.ndarray, np.ndarray]], size: int) -> DataFrame:
    """Rows (node, id, v) one level down, to the parts that ``choose`` finds in their node's probabilities; nodes without a router stay."""
    kind = rows.schema["v"].dataType
    real = np.float32 if kind.elementType.simpleString() == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, ids, vs, weights, parts, opened, sizes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                i, x = _unpacked(ids, vs, real)
                if weights is None:
                    which, names = np.arange(len(i)), [node] * len(i)
                else:
                    p = probabilities(x.astype(np.float64), np.frombuffer(weights, np.float64).reshape(-1, parts))
                    which, part = choose(p, opened, np.frombuffer(sizes, np.int64))
                    names = [f"{node}.{q}" for q in part.tolist()]
                v = x[which]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * x.shape[1]), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(i[which]), lists], names=["node", "id", "v"])

    blocks = packed(rows, size).join(level, "node", "left").select("node", "ids", "vs", "weights", "parts", "opened", "sizes")
    return blocks.mapInArrow(handing_back(run), f"node string, id long, v {kind.simpleString()}")


def _best(p: np.ndarray, opened: float, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(len(p)), p.argmax(1)


def _several(k: int) -> Callable[[np.ndarray, float, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The most probable parts, until those above hold the wanted probability and more than k known rows."""

    def choose(p: np.ndarray, opened: float, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(-p, axis=1, kind="stable")
        ranked = np.take_along_axis(p, order, 1)
        known = sizes[order]
        take = (np.cumsum(ranked, 1) - ranked < opened) | (np.cumsum(known, 1) - known <= k)
        which, rank = np.nonzero(take)
        return which, order[which, rank]

    return choose


def tree(rows: DataFrame, k: int, target: float = TARGET) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (id, v) with their leaf as ``node``, and the routers of each level. The driver gets the number of nodes still to be split, and of their rows."""
    held = written(rows.select(F.size("v").cast("string").alias("node"), "id", "v"), "vectors")
    levels, left = [], target
    while len(levels) < LEVELS:
        sizes = held.groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
        opened = sizes.where(F.col("rows") > LEAF) if levels else sizes
        nodes, total, largest = opened.agg(F.count(F.lit(1)), F.sum("rows"), F.max("rows")).first()
        if not nodes:
            break
        # the levels to come share what the target leaves; parts of twice the mean size are allowed for
        ahead = max(1, int(np.ceil(np.log(max(2 * largest / LEAF, 1.0)) / np.log(PARTS) - 1e-9)))
        now = float(min(0.999, left ** (1 / ahead)))
        left = left / now
        level = written(routers(held, opened, nodes, total, k, now), "routers")
        below = written(_routed(held, level, _best, BLOCK), "vectors")
        discard(held)
        held = below
        levels.append(level)
    return held, levels


def measured(x: np.ndarray, asked: np.ndarray, k: int, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of ``asked`` the numbers and distances of its k nearest rows of x, ties by ids. Products choose, with a margin for their rounding; distances are of the differences."""
    scale = max(float(np.abs(x).max(initial=0)), float(np.abs(asked).max(initial=0))) or 1.0
    a, b = asked / scale, x / scale
    na, nb = (a * a).sum(1), (b * b).sum(1)
    d = na[:, None] + nb - 2 * (a @ b.T)
    k = min(k, len(x))
    last = np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(x) else d.max(1)
    bound = last + 1e-12 * (na + nb.max()) * x.shape[1]
    for row in range(len(asked)):
        near = np.nonzero(d[row] <= bound[row])[0]
        true = np.sqrt(((x[near] - asked[row]) ** 2).sum(1))
        best = np.lexsort((ids[near], true))[:k]
        yield near[best], true[best]


def reached(leaves: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """(query, id, score): the k nearest rows of each block that a query reaches."""
    spark = leaves.sparkSession
    real = np.float32 if leaves.schema["v"].dataType.elementType.simpleString() == "float" else np.float64

    def together(df: DataFrame) -> DataFrame:
        place = ["node", F.xxhash64("id"), "id"]  # of a large leaf, several partitions have a part each
        return df.repartitionByRange(partitions(spark), *place).sortWithinPartitions("node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qids, qs, ids, vs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                (q, asked), (i, x) = _unpacked(qids, qs, real), _unpacked(ids, vs, real)
                found = list(measured(x.astype(np.float64), asked.astype(np.float64), k, i))
                n = [len(near) for near, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q, n)), pa.array(i[np.concatenate([near for near, _ in found])]), pa.array(np.concatenate([s for _, s in found]))], names=["query", "id", "score"]
                )

    questions = packed(together(asks), ASKS).select("node", F.col("ids").alias("qids"), F.col("vs").alias("qs"))
    return questions.join(packed(together(leaves), BLOCK), "node").select("qids", "qs", "ids", "vs").mapInArrow(handing_back(run), "query long, id long, score double")


def _top(df: DataFrame, k: int, *order: str) -> DataFrame:
    """The first k rows of each query; tasks pass on k at most."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def search(df: DataFrame, asked: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``asked`` the k nearest rows of df that the learned partitions lead to. Keys are whole numbers."""
    if df.schema[vector].dataType.elementType.simpleString() != "float":
        df, asked = (x.withColumn(vector, F.col(f"`{vector}`").cast("array<double>")) for x in (df, asked))
    own = lambda x: x.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).distinct()
    copies = own(df).withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    known = written(copies.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0]), "vectors")
    leaves, levels = tree(known.select("id", "v"), k, target)
    queries = written(own(asked), "queries")
    different = written(queries.groupBy("v").agg(F.min("id").alias("id")), "queries")
    asks = different.select(F.size("v").cast("string").alias("node"), "id", "v")
    steps = []
    for level in levels:
        asks = written(_routed(asks, level, _several(k), ASKS), "asks")
        steps.append(asks)
    best = written(_top(reached(leaves, asks, k + 1), k + 1, "score", "id"), "found")
    several = known.where(F.size("ids") > 1).select("id", "ids")
    each = best.join(several, "id", "left").select("query", "score", F.explode(F.coalesce("ids", F.array("id"))).alias("vec_id"))
    # at most (k + 1)^2 rows a query
    answers = each.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    told = queries.withColumnRenamed("id", "query_id").join(different.withColumnRenamed("id", "query"), "v").select("query_id", "query").join(answers, "query")
    mine = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = told.select("query_id", F.posexplode(mine).alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
    out = written(out, "neighbours")
    discard(known, leaves, *levels, queries, different, *steps, best)
    return out
