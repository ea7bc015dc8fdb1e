"""What the training-data operators share: scratch tables, Arrow helpers, tokenizer files."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


# a worker lives on after its task: Arrow's memory goes back to the system when it is freed, and isn't kept
pa.set_memory_pool(pa.system_memory_pool())
_LIBC = ctypes.CDLL(None)
if hasattr(_LIBC, "mallopt"):  # glibc: blocks from 1 MB on (option -3) go back when freed; the limit else rises with the blocks in use
    _LIBC.mallopt(-3, 1 << 20)


def handing_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``; at the end of the task its worker gives all freed memory back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _hand_back()

    return wrapped


def _hand_back() -> None:
    gc.collect()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode alone, one of our own where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textward-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/textward-{name}-{uuid.uuid4().hex}"


#: While a table is written: Spark deletes the query's shuffle files when it ends, not when the driver next
#: collects its garbage, and batches of long texts that go to Python stay small.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back. ``discard`` deletes the files."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = {k: spark.conf.get(k) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.option("compression", compression).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``written`` wrote for these tables; nothing may read them afterwards."""
    for t in tables:
        if path := getattr(t, "scratch_path", None):
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of one long each up to which a table of ids is broadcast: 32 MB or so.
SENT_ROUND = 1 << 21


def ids_sent_round(ids: DataFrame) -> DataFrame:
    """A table of distinct ids, marked to be broadcast if it has been counted and is small; else Spark shuffles for the join."""
    return F.broadcast(ids) if ids.count() <= SENT_ROUND else ids


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mixed_numbers(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit numbers that look random (counter mixed by xor-shifts and products); the same on every version of NumPy."""
    z = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary Arrow column as one byte array and offsets; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
        column = column.fill_null(empty)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _unusual_units() -> np.ndarray:
    """UTF-16 units outside printable Basic Latin to Latin Extended-B and plain white space."""
    out = np.ones(1 << 16, bool)
    for lo, hi in ((0x09, 0x0E), (0x20, 0x7F), (0xA0, 0x250)):
        out[lo:hi] = False
    return out


_UNUSUAL = _unusual_units()


def usual(text: str) -> bool:
    """Whether all characters are among those that every Unicode version classifies alike, composed, and lower-cases one by one."""
    return not _UNUSUAL[np.frombuffer(text.encode("utf-16-le"), np.uint16)].any()


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are installed; a default only, every operator takes a path."""
    import public_tokenizers

    return public_tokenizers.path(name)
