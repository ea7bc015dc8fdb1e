"""Token ids in packs of separately compressed documents with a shared zstandard dictionary.

File format: a folder with two Parquet tables. ``dictionary`` has one row: the dictionary's sha256,
its bytes, and the width of an id in bytes. ``packs`` has rows of consecutive documents in ascending
order of their keys: ``part`` and ``seq`` order the packs; ``before`` counts the ids of earlier packs
of the part and ``n_ids`` its own; ``dict_sha256`` names the dictionary; ``doc_ids`` and ``counts``
list the documents and their numbers of ids; ``ends`` is the offset index, the end of each document's
frame in ``data`` (little-endian unsigned 64-bit integers). A frame is the little-endian ids of one
document, compressed alone, so that one short document is read without its neighbours. Parquet
is the container because its writers commit atomically on any file system that Spark knows.

Defined results: a null text has no ids but the end id; null keys come first; documents with equal
keys stand next to each other, by a hash of their texts; an empty table gives an empty folder of
packs; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import partitions, scratch, usual

#: The dictionary is trained on at most so many documents, each of at most so many bytes; this bounds what the driver gets and changes sizes only.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 65_536, 65_536
#: A pack is closed when it has so many bytes or documents.
PACK_BYTES, PACK_DOCUMENTS = 4 << 20, 4096
#: Pieces, and pre-tokens, that a worker remembers; when full it starts anew.
REMEMBERED = 500_000
#: The pre-tokenizer's pattern over normalized text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PACKS = "part int, seq int, before long, n_ids long, dict_sha256 string, first_id long, last_id long, doc_ids array<long>, counts array<long>, ends binary, data binary"


class WordEncoder:
    """The tokenizers library's encoding of lower-case word BPE, remembering words.

    No pre-token holds white space. A text within the usual characters is lower-cased and cut at white
    space here, new pieces are split into pre-tokens, and the library encodes each new pre-token; any
    other text, and any that may hold a special token's string, goes to the library whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.split = regex.compile(PATTERN).findall
        suffix = self.library.model.end_of_word_suffix
        self.ending = np.zeros(self.library.get_vocab_size(), bool)
        self.ending[[i for t, i in self.library.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, pieces: list[str]) -> bool:
        """Encode new pieces; whether others have been forgotten for them. The library gets their new pre-tokens as one text; each ends in a token with the end-of-word suffix."""
        split, words = self.split, self.words
        parts = {p: split(p) for p in pieces}
        new = list({w for ws in parts.values() for w in ws if w not in words})
        if new:
            if len(words) + len(new) > REMEMBERED:
                words.clear()
                new = list({w for ws in parts.values() for w in ws})
            ids = np.array(self.library.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ending[ids]) + 1
            if len(ends) != len(new):
                words.update((w, self._ids(w)) for w in new)
            else:
                raw, at = ids.tobytes(), 0
                for w, end in zip(new, (ends * self.width).tolist(), strict=True):
                    words[w] = raw[at:end]
                    at = end
        if full := len(self.pieces) + len(parts) > REMEMBERED:
            self.pieces.clear()
        self.pieces.update((p, b"".join([words[w] for w in ws])) for p, ws in parts.items())
        return full

    def encode(self, text: str) -> bytes:
        """The ids as little-endian integers of ``width`` bytes."""
        if not usual(text) or any(s in text for s in self.specials):
            return self._ids(text)
        cut, known = text.lower().split(), self.pieces
        if (new := set(cut).difference(known)) and self._learn(list(new)):
            self._learn(list(set(cut)))  # the memory was emptied meanwhile
        return b"".join(map(known.__getitem__, cut))


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; samples too few to train on are the dictionary themselves."""
    import zstandard as zs

    try:
        return zs.train_dictionary(size, samples).as_bytes()
    except (zs.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes):
    import zstandard as zs

    return zs.ZstdCompressionDict(raw) if raw else None


def write_tokens(df: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text", end_id: int | None = 1) -> None:
    """Encode every text, append ``end_id``, and write packs in ascending order of ``key``."""
    import zstandard as zs

    spark = df.sparkSession
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    short = docs.where(F.octet_length("text") <= SAMPLE_BYTES).withColumn("h", F.xxhash64("doc_id", "text"))
    last = short.select("h").orderBy("h").limit(SAMPLE_DOCUMENTS).agg(F.max("h")).first()[0]  # hashes first, so that no task sends texts in vain
    sample = [] if last is None else short.where(F.col("h") <= last).orderBy("h", "doc_id").limit(SAMPLE_DOCUMENTS).select("text").collect()
    encoder = word_encoder(tokenizer)
    tail = b"" if end_id is None else np.array([end_id], encoder.kind).tobytes()
    raw = train_dictionary([encoder.encode(r.text) + tail for r in sample])
    name, width = hashlib.sha256(raw).hexdigest(), encoder.width
    spark.createDataFrame([(name, bytearray(raw), width)], "sha256 string, bytes binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zs.ZstdCompressor(level=3, dict_data=_dictionary(raw)).compress
        e, part = word_encoder(tokenizer), TaskContext.get().partitionId()
        seq = before = size = 0
        ids: list[int | None] = []
        counts: list[int] = []
        frames: list[bytes] = []

        def pack() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in frames]).astype("<u8").tobytes()
            given = [x for x in ids if x is not None]
            row = [part, seq, before, sum(counts), name, min(given, default=None), max(given, default=None), ids, counts, ends, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, KINDS, strict=True)], names=[c.split()[0] for c in PACKS.split(", ")])

        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                serial = e.encode(t.as_py() or "") + tail
                frames.append(squeeze(serial))
                ids.append(doc)
                counts.append(len(serial) // width)
                size += len(frames[-1])
                if size >= PACK_BYTES or len(ids) >= PACK_DOCUMENTS:
                    yield pack()
                    seq, before, size = seq + 1, before + sum(counts), 0
                    ids, counts, frames = [], [], []
        if ids:
            yield pack()

    keys = ["doc_id", F.xxhash64("text")]
    docs.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(run, PACKS).write.option("compression", "none").parquet(f"{path}/packs")


KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, str, bytes, int]:
    d = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(d.bytes)).hexdigest() != d.sha256:
        raise ValueError(f"the dictionary in {path} is damaged")
    return spark.read.schema(PACKS).parquet(f"{path}/packs"), d.sha256, bytes(d.bytes), d.width


def _frames(row: dict, name: str, squeezed) -> Iterator[tuple[int, int | None, bytes]]:
    """Of a pack: position, key and ids of each document."""
    if row["dict_sha256"] != name:
        raise ValueError(f"pack {row['part']}/{row['seq']} was written with another dictionary")
    at = 0
    for k, end in enumerate(np.frombuffer(row["ends"], "<u8").tolist()):
        yield k, row["doc_ids"][k], squeezed(row["data"][at:end])
        at = end


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Each document of the folder: doc_id, start (ids before it), n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    return _read(spark, path, "ids binary", lambda ids: ids, pa.binary())


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """As read_tokens, with ids_crc32 in place of the ids."""
    return _read(spark, path, "ids_crc32 long", zlib.crc32, pa.int64())


def _read(spark: SparkSession, path: str, column: str, made, kind: pa.DataType) -> DataFrame:
    import zstandard as zs

    packs, name, raw, width = _opened(spark, path)
    # a number for each part of the range partitioning
    sums = sorted((r.part, r.n) for r in packs.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base = dict(zip([p for p, _ in sums], np.cumsum([0, *[n for _, n in sums]]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeezed = zs.ZstdDecompressor(dict_data=_dictionary(raw)).decompress
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                docs, counts, out = [], [], []
                for _, doc, serial in _frames(row, name, squeezed):
                    docs.append(doc)
                    counts.append(len(serial) // width)
                    out.append(made(np.frombuffer(serial, f"<u{width}").astype("<u4").tobytes()))
                starts = base[row["part"]] + row["before"] + np.cumsum([0, *counts[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(out, kind)], names=["doc_id", "start", "n_tokens", column.split()[0]])

    return packs.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def fetch(spark: SparkSession, path: str, keys: Iterable[int | None]) -> dict[int | None, list[list[int]]]:
    """The ids of all documents of each of a few keys, in the order of the file; a key without documents has none.

    Only packs that may hold a key are read, and only the frames asked for are decompressed.
    """
    import zstandard as zs

    packs, name, raw, width = _opened(spark, path)
    squeezed = zs.ZstdDecompressor(dict_data=_dictionary(raw)).decompress
    out: dict[int | None, list[list[int]]] = {}
    for k in dict.fromkeys(keys):
        if k is None:
            holds = F.exists("doc_ids", lambda d: d.isNull())
        else:
            holds = (F.col("first_id") <= k) & (F.col("last_id") >= k) & F.array_contains("doc_ids", k)
        out[k] = []
        for r in packs.where(holds).orderBy("part", "seq").toLocalIterator():
            if r.dict_sha256 != name:
                raise ValueError("the pack was written with another dictionary")
            ends = [0, *np.frombuffer(bytes(r.ends), "<u8").tolist()]
            out[k] += [np.frombuffer(squeezed(bytes(r.data)[ends[at] : ends[at + 1]]), f"<u{width}").tolist() for at, d in enumerate(r.doc_ids) if d == k]
    return out


def round_trip(df: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write df's tokens to ``path`` (or a scratch folder) and return the digests read back from there."""
    path = path or scratch(df.sparkSession, "tokens")
    write_tokens(df, tokenizer, path)
    return token_digests(df.sparkSession, path)
