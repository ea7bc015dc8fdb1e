"""Readers and writers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

PROMPTS = "input string, category string, name string, expected boolean"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: A usual row group; smaller tables may have fewer row groups than there are cores, and then most scan tasks are empty.
ROW_GROUP = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out evenly to all cores if Spark's estimate of its size is below a row group a core. Larger tables stay as they are: no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * ROW_GROUP else df


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of labelled prompts; the category is the file's name, and empty for benign rows."""
    rows = spark.read.option("multiLine", True).schema(PROMPTS).json(path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json", 1)
    return rows.withColumn("category", F.when(F.col("expected"), stem).otherwise(""))


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of (text, label), label 1 for an injection."""
    return spark.read.option("multiLine", True).schema("text string, label int").json(path)


def write(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; in local mode alone, in one of our own where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textward-"))
        at = spark.sparkContext.getCheckpointDir()
    return f"{at.rstrip('/')}/textward-{name}-{uuid.uuid4().hex}"
