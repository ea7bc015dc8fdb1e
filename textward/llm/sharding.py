"""Weighted rendezvous (highest-random-weight) sharding of stable record keys.

Every shard draws a pseudo-random number from (key, shard); the row goes to the shard with the
best weighted draw. A draw depends on nothing else, so adding a shard moves only the rows that the
new shard wins, and removing one moves only its own rows. All of it is native Spark SQL.

Defined results: a null key is the key "null" (all null keys share a shard); repeated keys share a
shard and get different slots; a null text has no bytes; an empty table gives no rows; columns of
the input other than those named are carried through untouched by ``rendezvous`` and ignored by
``shard_slots``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Hex digits of a draw: 52 bits, exact in a double.
DIGITS = 13
#: Rows of a shard are numbered within this many hash cells, so that no task sorts a whole shard.
CELLS = 4096


def _key(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def _draw(key: Column, shard: int, weight: float) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(str(shard)))), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    # -ln(u)/w is exponential with rate w: the smallest of them is shard s with probability w_s / sum(w)
    return -F.log(u) / F.lit(float(weight))


def winner(key: Column, weights: Sequence[float]) -> Column:
    """Index of the shard that wins ``key``; shards of weight 0 win nothing."""
    live = [(s, w) for s, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("at least one shard needs a positive weight")
    draws = [F.struct(_draw(_key(key), s, w).alias("d"), F.lit(s).alias("s")) for s, w in live]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["s"]


def rendezvous(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """``df`` with the winning shard of each row; narrow, no shuffle."""
    return df.withColumn(out, winner(F.col(f"`{key}`"), weights))


def shard_slots(df: DataFrame, key: str, text: str, shards: int, weights: Sequence[float] | None = None) -> DataFrame:
    """Shard, gapless slot within the shard, and the shard that the row would have with one shard more.

    Slots follow (cell, key); cell is a hash of the key, so that numbering is two small steps: row
    numbers within a cell, and the running sum of the counts of at most shards x CELLS cells.
    """
    weights = list(weights) if weights else [1.0] * shards
    rows = (
        df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
        .select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
            F.md5(_key(F.col("doc_id"))).alias("h"),
        )
        .withColumn("cell", (F.conv(F.substring("h", 1, 3), 16, 10).cast("int") % CELLS).cast("int"))
        .drop("h")
    )
    d = _draws(F.col("doc_id"), [*weights, weights[-1]])
    rows = rows.withColumn("d", d).withColumn("old", F.least(*[F.col("d")[i] for i in range(shards)]) if shards > 1 else F.col("d")[0])
    rows = rows.withColumn("shard", F.col("old.s")).withColumn("grown_shard", F.least(F.col("old"), F.col("d")[shards])["s"]).drop("d", "old")
    cell = Window.partitionBy("shard", "cell")
    sizes = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    return (
        rows.join(before, ["shard", "cell"])
        .withColumn("r", F.row_number().over(cell.orderBy("doc_id", "size", "text_crc32")))
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("r") - 1).cast("long").alias("slot"), "grown_shard")
    )


def _draws(key: Column, weights: Sequence[float]) -> Column:
    return F.array(*[F.struct(_draw(_key(key), s, w).alias("d"), F.lit(s).alias("s")) for s, w in enumerate(weights)])


def write_shards(df: DataFrame, key: str, weights: Sequence[float], path: str) -> None:
    """Write ``df`` as Parquet with one folder a shard. Rows stay where they are: a task writes to each of its shards, without a shuffle."""
    rendezvous(df, key, weights).write.partitionBy("shard").parquet(path)
