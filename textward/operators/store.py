"""A lasting attack memory: signatures and trigram postings as tables that batches are appended to.

``Store.append`` matches a batch against what was stored before each of its rows, in earlier batches and in its own, and adds what
is to be remembered; many batches give what one ``memory.replay`` of all rows gives. Postings hold each signature's rarest
elements, by a table of frequencies that is fixed until the store is compacted: with one order for both sides any two
signatures of the threshold's likeness share an element of their prefixes, however old the frequencies are. Tables are partitioned by
a hash of the trigram or signature, so that a batch reads the partitions of its own elements and no others.

A batch's files are overwritten if it runs again and count once it is marked; ``compact`` writes a new version beside
the old one, without what is out of reach and with today's frequencies, which counts once it is marked.

Defined results: as ``memory.replay``: texts without trigrams are like each other; null texts are empty; ties go to what was stored
first; rows of equal order stand in any order. An empty batch is a batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import CUSTOM
from .memory import CAPACITY, REACH, THRESHOLD, common, fits, in_reach, measured, near, pairs, plain, positions, prefix, size_of

ROWS = "seq long, id long, sign string, kind string, severity double"
SIGNS = "sign string, plain string, part int"
POSTINGS = "element long, sign string, n int, part int"
ORDER = "element long, df long"
FOUND = "id long, matched long, similarity double, kind string, severity double"


def prefixes(signs: DataFrame, order: DataFrame, threshold: float) -> DataFrame:
    """(element, sign, n): the rarest elements of each signature (sign, plain); two that are like share one of them. ``order`` has KNOWN rows at most."""
    rare = prefix([(r.element, r.df) for r in order.select("element", "df").collect()], threshold)
    return signs.select(F.explode(rare(F.col("plain"))).alias("element"), "sign", size_of(F.col("plain")).alias("n"))


@dataclass
class Store:
    """Signatures under ``path``. Keys and orders of rows are whole numbers; one writer at a time. ``parts`` partitions of postings and of signatures."""

    path: str
    threshold: float = THRESHOLD
    capacity: int = CAPACITY
    parts: int = 64

    def _part(self, *of: str) -> Column:
        return F.pmod(F.xxhash64(*of), F.lit(self.parts)).cast("int").alias("part")

    # where things are

    def _read(self, spark: SparkSession, name: str, schema: str, version: int, batches: list[int], parts: list[int] | None = None) -> DataFrame:
        """A table's rows of these batches: of whole folders, so that nothing else is listed or read."""
        paths = [f"{self.path}/v={version}/{name}/batch={b}" for b in batches]
        if not paths:
            return spark.createDataFrame([], schema)
        df = spark.read.option("basePath", f"{self.path}/v={version}/{name}").schema(schema).parquet(*paths).select(*[c.split()[0] for c in schema.split(", ")])
        return df if parts is None else df.where(F.col("part").isin(parts) if parts else F.lit(False))

    def _write(self, df: DataFrame, name: str, version: int, batch: int, by: str | None = None) -> None:
        w = df.repartition(by).write if by else df.write
        (w.partitionBy(by) if by else w).mode("overwrite").parquet(f"{self.path}/v={version}/{name}/batch={batch}")

    def _kept(self, df: DataFrame, name: str, version: int, batch: int) -> DataFrame:
        """df, written and read back: what several steps of a batch read."""
        self._write(df, name, version, batch)
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.path}/v={version}/{name}/batch={batch}")

    def marks(self, spark: SparkSession) -> list:
        """(version, batch, stored) of each marked batch, oldest first: a row a batch since the last compaction, and one for that."""
        from ..sources.sinks import exists

        at = f"{self.path}/marks"
        rows = spark.read.schema("version int, batch long, stored long").parquet(at).collect() if exists(spark, at) else []
        version = max((r.version for r in rows), default=0)
        return sorted((r for r in rows if r.version == version), key=lambda r: r.batch)

    def _mark(self, spark: SparkSession, version: int, batch: int, stored: int) -> None:
        row = spark.createDataFrame([(version, batch, stored)], "version int, batch long, stored long")
        row.write.mode("overwrite").parquet(f"{self.path}/marks/at={version}_{batch}")

    # what is done

    def append(self, df: DataFrame, batch: int, key: str = "id", order: str = "id", text: str = "text", stored: Column | str = "stored", kind: Column | str = "kind", severity: Column | str = "severity") -> DataFrame:
        """(id, matched, similarity, kind, severity) of the batch's rows that are like a stored one; stores those to be ``stored``.

        Batches are numbered in ascending order, and rows of a batch come after all of those before. A marked batch isn't run again; its result is read.
        """
        spark, marks = df.sparkSession, self.marks(df.sparkSession)
        version, base = (marks[-1].version, marks[-1].stored) if marks else (0, 0)
        batches = [m.batch for m in marks]
        if batch in batches:
            return spark.read.schema(FOUND).parquet(f"{self.path}/v={version}/found/batch={batch}")
        if batches and batch < batches[-1]:
            raise ValueError(f"batch {batch} comes after batch {batches[-1]}")
        col = lambda c: F.col(c) if isinstance(c, str) else c
        given = df.select(F.col(key).alias("id"), F.col(order).alias("order"), F.col(text).alias("text"), col(stored).alias("stored"), col(kind).alias("kind"), col(severity).cast("double").alias("severity"))
        rows = positions(given, "order", F.col("stored")).withColumn("seq", F.col("seq") + base).withColumn("plain", plain(F.col("text")))
        rows = rows.withColumn("sign", F.md5("plain")).withColumn("kind", F.when(F.coalesce("kind", F.lit("")) == "", CUSTOM).otherwise(F.col("kind")))
        rows = self._kept(rows.select("id", "seq", "stored", "sign", "plain", "kind", "severity"), "batches", version, batch)
        fresh, old = rows.where("stored"), self._read(spark, "rows", ROWS, version, batches)
        if not batches:
            self._write(common(fresh.dropDuplicates(["sign"]).select("plain")), "order", version, -1)
        frequencies = self._read(spark, "order", ORDER, version, [-1])
        # a row a signature of the batch; first to last is the stretch of stored rows that its rows reach
        signs = rows.groupBy("sign").agg(F.first("plain").alias("plain"), F.greatest(F.lit(0), F.min("seq") - self.capacity).alias("first"), (F.max("seq") - 1).alias("last"), F.min(F.when(F.col("stored"), F.col("seq"))).alias("from"), F.max(F.when(F.col("stored"), F.col("seq"))).alias("to"))
        signs = self._kept(signs, "asked", version, batch)
        own = signs.where("to IS NOT NULL")
        if self.capacity <= REACH:
            like = near(rows.select("sign", "plain", "seq"), fresh.select("sign", "plain", "seq"), self.threshold, self.capacity)
        else:
            like = self._within(signs, own)
        if batches:  # rows whose reach ends within the batch ask for nothing before it
            reached = old.where(F.col("seq") >= base - self.capacity).select(F.col("sign").alias("old_id")).distinct()
            like = like.unionByName(self._like(signs.where(F.col("first") < base).select("sign", "plain"), reached, frequencies, version, batches)).distinct()
        like = self._kept(like, "like", version, batch)
        known = old.where(F.col("seq") >= base - self.capacity).select("seq", "id", "sign", "kind", "severity").unionByName(fresh.select("seq", "id", "sign", "kind", "severity"))
        found = in_reach(rows.select("id", "sign", "seq"), known.select("sign", "seq"), like, self.capacity)
        told = found.join(known.select(F.col("seq").alias("matched"), F.col("id").alias("old"), "kind", "severity"), "matched")
        self._write(told.select("id", F.col("old").alias("matched"), "similarity", "kind", "severity"), "found", version, batch)
        here = own.select("sign", "plain", self._part("sign"))
        parts = [r.part for r in here.select("part").distinct().collect()]  # self.parts numbers at most
        new = here.join(self._read(spark, "signs", SIGNS, version, batches, parts).select("sign"), "sign", "left_anti")
        self._write(fresh.select("seq", "id", "sign", "kind", "severity"), "rows", version, batch)
        self._write(new, "signs", version, batch, "part")
        added = prefixes(self._read(spark, "signs", SIGNS, version, [batch]), frequencies, self.threshold)
        self._write(added.select("element", "sign", "n", self._part("element")), "postings", version, batch, "part")
        self._mark(spark, version, batch, base + fresh.count())
        return spark.read.schema(FOUND).parquet(f"{self.path}/v={version}/found/batch={batch}")

    def _within(self, signs: DataFrame, own: DataFrame) -> DataFrame:
        """(sign, old_id, similarity) of signatures within the batch, for capacities too large for ``near``."""
        stored = own.select(F.col("sign").alias("id"), "plain", F.col("from").alias("first"), F.col("to").alias("last"))
        within = pairs(signs.select(F.col("sign").alias("id"), "plain", "first", "last"), stored, self.threshold)
        return within.select(F.col("new_id").alias("sign"), "old_id", "similarity")

    def _like(self, asked: DataFrame, reached: DataFrame, frequencies: DataFrame, version: int, batches: list[int]) -> DataFrame:
        """(sign, old_id, similarity) of asked signatures and of the stored ones that are ``reached``: those that meet on an element are measured."""
        spark = asked.sparkSession
        mine = prefixes(asked, frequencies, self.threshold)
        parts = [r.part for r in mine.select(self._part("element")).distinct().collect()]
        theirs = self._read(spark, "postings", POSTINGS, version, batches, parts).select("element", F.col("sign").alias("old_id"), F.col("n").alias("m")).join(reached, "old_id", "left_semi")
        met = mine.join(theirs, "element").where(fits(F.col("n"), F.col("m"), self.threshold)).select(F.col("sign").alias("new_id"), "old_id").distinct()
        parts = [r.part for r in met.select(F.col("old_id").alias("o")).select(self._part("o")).distinct().collect()]
        held = self._read(spark, "signs", SIGNS, version, batches, parts).select(F.col("sign").alias("id"), "plain")
        likes = measured(met, asked.select(F.col("sign").alias("id"), "plain"), held, self.threshold).withColumnRenamed("new_id", "sign")
        nothing = asked.where(F.col("plain") == "").select("sign", F.col("sign").alias("old_id"), F.lit(1.0).alias("similarity"))
        return likes.unionByName(nothing)

    def compact(self, spark: SparkSession) -> None:
        """A new version: rows in reach, their signatures, frequencies of today. Its batches go on where the old ones ended."""
        if not (marks := self.marks(spark)):
            return
        version, batches, base = marks[-1].version, [m.batch for m in marks], marks[-1].stored
        rows = self._read(spark, "rows", ROWS, version, batches).where(F.col("seq") >= base - self.capacity)
        kept = rows.select("sign").distinct()
        signs = self._read(spark, "signs", SIGNS, version, batches).dropDuplicates(["sign"]).join(kept, "sign", "left_semi").select("sign", "plain", "part")
        new, at = version + 1, batches[-1]
        self._write(rows, "rows", new, at)
        self._write(signs, "signs", new, at, "part")
        signs = self._read(spark, "signs", SIGNS, new, [at])
        self._write(common(signs.select("plain")), "order", new, -1)
        order = self._read(spark, "order", ORDER, new, [-1])
        self._write(prefixes(signs, order, self.threshold).select("element", "sign", "n", self._part("element")), "postings", new, at, "part")
        found = spark.read.schema(FOUND).parquet(f"{self.path}/v={version}/found/batch={at}")
        self._write(found, "found", new, at)  # the last batch may be asked for again
        self._mark(spark, new, at, base)
