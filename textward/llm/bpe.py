"""Byte-level BPE by dynamic programming over prefixes.

BPE leaves each prefix of a pre-token with one encoding, and so with one last token. The encoder
stores that token for every prefix: an automaton over the vocabulary reports the tokens that end at
each byte, longest first; the one that is compatible with the last token of the prefix before it is
the prefix's last token; following these pointers back from the end gives the ids. Two tokens are
compatible when BPE of their joined bytes gives just the two.

The pre-tokens of a text are found as the tokenizers library finds them: texts within the ranges
of characters that every Unicode version classifies alike are split here, all others by the library's own
pre-tokenizer. Strings of special tokens in a text become their ids, as the library's default has it.

Defined results: a null text is an empty text, with no ids and an empty decoded text; very long
texts are encoded whole; repeated rows are encoded each; an empty table gives no rows; ``encoded``
carries the other columns through. A vocabulary that lacks a byte is refused.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructField, StructType

from .common import handing_back, usual

#: Pre-tokens that a worker remembers; when full it starts anew, which changes no result.
REMEMBERED = 400_000
#: Rows that go out at a time.
ROWS = 128
#: The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte, by the byte-level rule: printable Latin-1 stands for itself, the rest for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class PrefixEncoder:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model, alphabet = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("not a byte-level BPE without normalizer and prefix space")
        raw = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {tuple(bytes(alphabet[c] for c in x) for x in m): k for k, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: b for b, i in raw.items()} | {i: s.encode() for s, i in self.special.items()}
        for s in self.special:
            raw.pop(s.encode(), None)
        if missing := [b for b in range(256) if bytes([b]) not in raw]:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        self.automaton = ahocorasick.Automaton()
        for b, i in raw.items():
            # a token that BPE never makes of its own bytes is no token of any encoding
            if self.merged(b) == [b]:
                self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.library = Tokenizer.from_file(path)
        self.alphabet = str.maketrans({c: chr(b) for c, b in alphabet.items()})
        self.split = regex.compile(PATTERN).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, bytes, bytes, bytes]] = {}

    def merged(self, word: bytes) -> list[bytes]:
        """BPE by its definition: apply the earliest merge until none is left. Only for short strings."""
        parts = [word[k : k + 1] for k in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        if (got := self.fits.get((a, b))) is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            x, y = self.bytes[a], self.bytes[b]
            got = self.fits[a, b] = self.merged(x + y) == [x, y]
        return got

    def pretoken(self, word: bytes) -> list[int]:
        last, start = [-1] * len(word), [0] * len(word)
        compatible, fits = self.compatible, self.fits
        for end, (token, size) in self.automaton.iter(word.decode("latin-1")):
            if last[end] >= 0:
                continue
            before = end - size
            if before < 0:
                last[end] = token
            else:
                ok = fits.get((last[before], token))
                if ok or ok is None and compatible(last[before], token):
                    last[end], start[end] = token, before + 1
        ids, end = [], len(word) - 1
        while end >= 0:
            ids.append(last[end])
            end = start[end] - 1
        return ids[::-1]

    def _word(self, word: str) -> tuple[int, bytes, bytes, bytes]:
        """Of a pre-token: number of ids, ids in decimal each with a comma after it, decoded bytes, ids of 32 bits each."""
        ids = self.pretoken(word.encode())
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        got = self.known[word] = len(ids), "".join(f"{i}," for i in ids).encode(), b"".join([self.bytes[i] for i in ids]), array("i", ids).tobytes()
        return got

    def words(self, text: str) -> list[str]:
        if usual(text):
            return self.split(text)
        library = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [w.translate(self.alphabet).encode("latin-1").decode() for w, _ in library]

    def pieces(self, text: str) -> list[tuple[int, bytes, bytes, bytes]]:
        """The text's pre-tokens and special tokens, encoded."""
        parts = self.specials.split(text) if self.specials and any(s in text for s in self.special) else [text]
        out: list[tuple[int, bytes, bytes, bytes]] = []
        known, word = self.known, self._word
        for k, part in enumerate(parts):
            if k % 2:
                i = self.special[part]
                out.append((1, b"%d," % i, self.bytes[i], array("i", [i]).tobytes()))
            else:
                out += [known.get(w) or word(w) for w in self.words(part)]
        return out

    def encode(self, text: str) -> list[int]:
        return array("i", self.flat(text)[0]).tolist()

    def flat(self, text: str) -> tuple[bytes, str]:
        """The ids, of 32 bits each, and the text that they decode to."""
        found = self.pieces(text)
        return b"".join([p[3] for p in found]), b"".join([p[2] for p in found]).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha256 of the decimal ids, sha256 of the text that the ids decode to."""
        found = self.pieces(text)
        if not found:
            return 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest()
        n, ids, raw, _ = zip(*found, strict=True)
        back = b"".join(raw)
        try:
            back.decode()
        except UnicodeDecodeError:
            back = back.decode("utf-8", "replace").encode()
        return sum(n), hashlib.sha256(b"".join(ids)[:-1]).hexdigest(), hashlib.sha256(back).hexdigest()


@lru_cache(2)
def encoder(path: str) -> PrefixEncoder:
    """One encoder a worker and file."""
    return PrefixEncoder(path)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; narrow, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            rows = [e.digest(t or "") for t in b.column(1).to_pylist()]
            n, ids, back = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(handing_back(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(df: DataFrame, out: str, kind: DataType, source: str, function: Callable) -> DataFrame:
    """df with column ``out`` made of column ``source``, batch by batch."""
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([function(x) for x in b.column(source).to_pylist()], arrow)
            cols = {n: c for n, c in zip(b.schema.names, b.columns, strict=True) if n != out}
            yield pa.RecordBatch.from_pydict(cols | {out: made})

    return df.mapInArrow(handing_back(run), StructType([*[f for f in df.schema.fields if f.name != out], StructField(out, kind)]))


def encoded(df: DataFrame, path: str, text: str = "text", out: str = "ids", exact: str | None = None) -> DataFrame:
    """df with the ids of each text and, if ``exact`` names a column, whether they decode to it; columns of these names are replaced.

    Rows go out a few at a time, their ids as one flat array.
    """
    made = {out: ArrayType(IntegerType())} | ({exact: BooleanType()} if exact else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                flat, ends, same = bytearray(), [0], []
                for t in b.column(text):
                    t = t.as_py() or ""
                    ids, back = e.flat(t)
                    flat += ids
                    ends.append(len(flat) // 4)
                    same.append(back == t if exact else None)
                cols = {n: c for n, c in zip(b.schema.names, b.columns, strict=True) if n not in made}
                cols[out] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if len(flat) else [], pa.int32()))
                if exact:
                    cols[exact] = pa.array(same, pa.bool_())
                yield pa.RecordBatch.from_pydict(cols)

    return df.mapInArrow(handing_back(run), StructType([*[f for f in df.schema.fields if f.name not in made], *[StructField(n, t) for n, t in made.items()]]))


def decoded(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """df with the text of each row of ids; null ids give an empty text."""
    return _mapped(df, out, StringType(), ids, lambda x: encoder(path).decode(x or []))
