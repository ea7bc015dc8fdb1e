"""How filters interact: every order of them is replayed over all documents.

Each document's verdicts are crossed with the (few, broadcast) orders; a document leaves an order at its
first failing filter. Steps are exploded and counted with partial sums in each task, so that a
shuffle carries parts x orders x steps rows a task and no documents.

Defined results: a null text is empty; a null part is the empty string; a document whose text is also that
of a smaller key is a repeat (keys are compared, so rows of equal keys aren't repeats of each other, and
null keys neither repeat nor are repeated); several labels of a key count if any of them does, labels
without a document and null labels count nothing; repeated rows count each; an empty table gives no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, partitions, written

#: What separates words.
GAP = r"[\x20\x09-\x0D]+"
#: The filter that needs the whole table.
REPEATED = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that need the text alone."""
    words = F.array_remove(F.split(text, GAP, -1), "")
    upper = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": upper * 100 > F.char_length(text) * 2,
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(df: DataFrame, key: str, text: str, part: str, filters: Mapping[str, Column]) -> DataFrame:
    """key, part, sign (a digest of the text) and a boolean for each filter of texts. Narrow; ``filters`` read the column ``text``."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return rows.select("key", "part", F.sha2("text", 256).alias("sign"), *[c.alias(name) for name, c in filters.items()])


def shared_signs(flags: DataFrame) -> DataFrame:
    """(sign, first): the smallest key of each text that several keys have."""
    return flags.groupBy("sign").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("sign", "first")


def with_repeats(flags: DataFrame, shared: DataFrame, name: str = REPEATED) -> DataFrame:
    """Adds whether a smaller key has the same text. ``shared`` is a table of its own: the join then has a shuffle of its own, whose hot partitions Spark can split."""
    return flags.join(shared, "sign", "left").withColumn(name, F.coalesce(F.col("key") > F.col("first"), F.lit(False))).drop("first", "sign")


def with_labels(flags: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds good and toxic: whether a label of the key says so."""
    said = labels.groupBy(F.col(f"`{key}`").alias("key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    return flags.join(said, "key", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})


def replayed(flags: DataFrame, names: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of rows (part, good, toxic, a flag for each of ``names``)."""
    spark = flags.sparkSession
    orders = spark.createDataFrame([("".join(o),) for o in permutations(names)], "filter_order string")
    places = orders.select("filter_order", *[F.instr("filter_order", n).alias(f"at_{n}") for n in names])
    end = len(names) + 1
    fails = F.array(*[F.col(n) for n in names])
    # the step at which each filter would remove the row, past the end if it never does
    steps = [F.when(F.col(n), F.col(f"at_{n}")).otherwise(end) for n in names]
    each = (
        flags.select("part", "good", "toxic", fails.alias("fails"), *names, F.size(F.filter(fails, lambda f: f)).alias("failures"))
        .repartition(partitions(spark))  # a few bytes a row: all cores replay, however few files the flags are in
        .crossJoin(F.broadcast(places))
        .select("part", "good", "toxic", "filter_order", "failures", F.least(*steps).alias("first"), F.posexplode(F.array(*[_fails_at(names, k) for k in range(1, end)])).alias("pos", "failing"))
        .withColumn("step", F.col("pos") + 1)
    )
    here, failing = F.col("first") == F.col("step"), F.col("failing")
    n = lambda c, name: F.count_if(c).alias(name)
    sums = each.groupBy("part", "filter_order", "step").agg(
        n(F.col("first") > F.col("step"), "kept"), n(here, "removed"), n(failing & (F.col("first") < F.col("step")), "redundant"), n(failing & (F.col("failures") == 1), "unique_fails"),
        n(here & F.col("good"), "good_lost"), n(here & F.col("toxic"), "toxic_lost"),
    )
    of_filter = Window.partitionBy("part", F.expr("substring(filter_order, step, 1)"))
    return sums.withColumn("shapley", F.sum("removed").over(of_filter))


def _fails_at(names: str, step: int) -> Column:
    """Whether the row fails the filter that stands at this step."""
    found = F.lit(False)
    for n in names:
        found = found | (F.col(n) & (F.col(f"at_{n}") == step))
    return found


def audited(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", filters: Mapping[str, Column] | None = None) -> DataFrame:
    """The five filters (or those given, and repeats) in all their orders over df. Texts are read once and never shuffled."""
    filters = text_filters(F.col("text")) if filters is None else filters
    lean = written(flagged(df, key, text, part, filters), "flags")
    shared = written(shared_signs(lean), "signs")
    out = written(replayed(with_labels(with_repeats(lean, shared), labels), "".join(filters) + REPEATED), "audit")
    discard(lean, shared)
    return out
