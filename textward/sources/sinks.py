"""Writers of streams whose batches can be run again.

Each batch has folders of its own, named by source and number, which a second run overwrites; it counts once its mark is
written, after all of its tables. Readers take marked batches only, so that verdicts and what was learnt from them appear
together or not at all. All files are written and read by Spark, on whatever file system the path is.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import judge, memory

#: What else is written of a batch of verdicts: from the table that has been written, so that no guard runs twice.
LEARNT: Mapping[str, Callable[[DataFrame], DataFrame]] = {"signatures": memory.learned_rows}
DECIDED: Mapping[str, Callable[[DataFrame], DataFrame]] = {"decisions": judge.decided}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at ``path``."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


@dataclass
class Batches:
    """For ``foreachBatch``: writes the table ``main`` and those derived from it. ``source`` tells apart streams that share a path."""

    path: str
    derived: Mapping[str, Callable[[DataFrame], DataFrame]]
    main: str = "verdicts"
    source: str = "stream"

    def _at(self, table: str, batch: int) -> str:
        return f"{self.path}/{table}/source={self.source}/batch={batch}"

    def __call__(self, df: DataFrame, batch: int) -> None:
        """Write one batch. A batch that is marked already is left as it is: its stream died between this writer's mark and its own."""
        spark = df.sparkSession
        if exists(spark, self._at("commits", batch)):
            return
        df.write.mode("overwrite").parquet(self._at(self.main, batch))
        written = spark.read.schema(df.schema).parquet(self._at(self.main, batch))
        for name, derive in self.derived.items():
            derive(written).write.mode("overwrite").parquet(self._at(name, batch))
        spark.range(1).select(F.current_timestamp().alias("at")).write.mode("overwrite").parquet(self._at("commits", batch))

    def commits(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/commits")

    def read(self, spark: SparkSession, table: str | None = None) -> DataFrame:
        """A table's rows of the batches that are marked, of all sources, with source and batch."""
        rows = spark.read.parquet(f"{self.path}/{table or self.main}")
        return rows.join(F.broadcast(self.commits(spark).select("source", "batch")), ["source", "batch"], "left_semi")
