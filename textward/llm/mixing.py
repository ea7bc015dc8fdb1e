"""Mixing sources to target weights by weighted fair queueing.

Documents of each source stand in a fixed pseudo-random order (a hash of the id). A document's
virtual finish time is the tokens of its source up to and with it, over the source's target. All
documents are served in the order of their virtual finish times until the budget is spent; a source
whose target is above its size is served again from its start, up to ``max_epochs`` times.

Defined results: a null text has size 0; a null source is a source of its own, last in the order; a
source without tokens has target 0; documents of size 0 take nothing; repeated rows are told apart
only by order and get the same treatment as any neighbours; an empty table gives no rows; other
columns are carried through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

#: Cells of the per-source order; a source's running sum is taken within one cell at a time.
CELLS = 1024
#: Parts of the virtual time line; the budget's running sum is taken within one part at a time.
SLICES = 2048
#: Rounding of the budget.
SLACK = 1e-6


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and U+0009 to U+000D."""
    t = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " +"))).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and sorts by code point, the null source last."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("b"))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: int) -> DataFrame:
    """sizes(source, source_size) to (source, source_size, target).

    Water-filling: the sources with the least size over weight are capped at max_epochs times their
    size; the others share what is left of the budget by weight. One row for each source.
    """
    by_source = Window.orderBy("source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_source) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "source")
    everything = Window.partitionBy()
    t = (
        t.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("caps", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("rest", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.coalesce("caps", F.lit(0.0))) / F.col("rest"))
        # the first source in the order whose cap reaches the level sets it for all that follow
        .withColumn("final", F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("level").alias("level")))).over(everything)["level"])
    )
    return t.select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("w"))).alias("target"))


def _ordered(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """df as struct column ``row`` with what places each row in its source's order."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).select(
        "row",
        source_key(F.col("row")[source]).alias("source"),
        F.coalesce(F.col("row")[key].cast("string"), F.lit("null")).alias("id"),
        word_count(F.col("row")[text]).alias("size"),
    ).withColumn("h", F.md5("id")).withColumn("cell", F.conv(F.substring("h", 1, 3), 16, 10).cast("int") % CELLS)


def _finish(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows with ``upto``, the tokens of their source up to and with them."""
    place = Window.partitionBy("source", "cell").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("within", F.sum("size").over(place)).join(cells, ["source", "cell"]).withColumn("upto", F.col("before") + F.col("within"))


def _turn(epoch: int) -> Column:
    """What the global order sorts by: first the virtual finish time."""
    at = (F.col("source_size") * F.lit(epoch) + F.col("upto")) / F.col("target")
    return F.struct(at.alias("at"), F.col("source"), F.col("h"), F.col("id"), F.lit(epoch).alias("epoch"), F.col("upto"))


def fair_mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (5, 2, 1), share: float = 1.0, max_epochs: int = 3, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns row (all of df's, or ``columns``), size, source_size, target, epochs (how often the mix takes the row).

    Words are counted once, into a table of keys and sizes; texts are shuffled only if they are asked for.
    What is gathered: sums of cells (sources x CELLS rows, written to the shared folder) and of
    slices (at most 2 x SLICES rows). The driver gets the budget and the last turn that it pays for.
    """
    if columns is not None and text not in columns:
        rows = _ordered(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys((key, source, text, *columns))]), key, source, text)
        rows = written(rows.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in columns])), "sizes")
        lean = rows.drop("row")
    else:
        rows = _ordered(df, key, source, text)
        lean = written(_ordered(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys((key, source, text))]), key, source, text).drop("row"), "sizes")
    sums = written(lean.groupBy("source", "cell").agg(F.sum("size").alias("tokens")), "cells")
    goal = targets(sums.groupBy("source").agg(F.sum("tokens").alias("source_size")), weights, share, max_epochs)
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("cell")) - F.col("tokens")
    cells = written(sums.withColumn("before", before).join(goal, "source").select("source", "cell", "before", "source_size", "target"), "places")
    budget = float(sums.agg(F.sum("tokens")).first()[0] or 0) * share
    # first pass, without the rows' other columns: find the last turn that the budget pays for
    turns = (
        _finish(lean, cells)
        .where((F.col("target") > 0) & (F.col("size") > 0))
        .select("size", F.explode(F.array(*[_turn(e) for e in range(max_epochs)])).alias("turn"))
        .select("turn", "size", F.least(F.floor(F.col("turn.at") * SLICES), F.lit(2 * SLICES)).alias("slice"))
    )
    turns = written(turns, "turns")
    slices = turns.groupBy("slice").agg(F.sum("size").alias("tokens"))
    paid = slices.select("slice", "tokens", (F.sum("tokens").over(Window.orderBy("slice")) - F.col("tokens")).alias("paid"))
    cut = paid.where(F.col("paid") <= budget + SLACK).agg(F.max(F.struct("slice", "paid")).alias("c")).first()["c"]
    no = F.lit(0)
    if cut is None:
        return rows.join(cells, ["source", "cell"]).select("row", "size", "source_size", "target", no.alias("epochs"))
    # earlier slices are paid for whole, later ones not at all; the one between is served in order
    in_turn = Window.partitionBy("slice").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        turns.where(F.col("slice") == cut["slice"])
        .withColumn("spent", F.lit(cut["paid"]) + F.sum("size").over(in_turn))
        .where(F.col("spent") <= budget + SLACK)
        .agg(F.max("turn").alias("last"))
        .first()["last"]
    )
    if last is None:  # not even the first of that slice: all up to the slice before
        last = turns.where(F.col("slice") < cut["slice"]).agg(F.max("turn").alias("last")).first()["last"]
    if last is None:
        return rows.join(cells, ["source", "cell"]).select("row", "size", "source_size", "target", no.alias("epochs"))
    end = F.struct(*[F.lit(last[f]).alias(f) for f in ("at", "source", "h", "id", "epoch", "upto")])
    alive = (F.col("target") > 0) & (F.col("size") > 0)
    epochs = sum((F.when(alive & (_turn(e) <= end), 1).otherwise(0) for e in range(max_epochs)), no)
    return _finish(rows, cells).select("row", "size", "source_size", "target", epochs.cast("int").alias("epochs"))


def mixed(df: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of df as often as it is taken, with df's columns."""
    out = fair_mix(df, **options).where("epochs > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
    return out.select(*[F.col("row")[c].alias(c) for c in df.columns])
