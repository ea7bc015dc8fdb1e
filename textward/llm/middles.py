"""Fill-in-middle transformation: a text is cut at two of its units and put together in another order.

Units are the matches of a pattern, left to right; one code point each by default. Two passes over a lazy
match iterator find the cuts: the first counts the units, the second goes on to the two ranks and stops.
Neither keeps what it has passed, so a text needs no memory beyond itself, however many units it has.
The ranks and the form depend on the row's key alone (and on the number of units), so that runs agree.

Defined results: a null text is empty; an empty text, one that holds a marker and a share of all keys
stay plain; a null key is the key "null"; equal keys draw equal numbers; text between two matches
belongs to the unit before it, and text before the first to the first; a pattern that matches nothing has
0 units, and all of the text is suffix; repeated rows are repeated; an empty table gives no rows; other columns are
carried through by ``filled`` unless they have the name of a column that it adds, which is an error.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import handing_back

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: One unit: any code point.
CODE_POINT = r"(?s:.)"
#: Rows of 100 that are transformed, and of these the rows that get the suffix first.
RATE, SPM_RATE = 90, 20
ADDED = ("output", "form", "n", "prefix_chars", "middle_chars")
#: Output bytes after which a batch goes back to Spark.
BATCH = 4 << 20


def units(matcher: re.Pattern, text: str) -> int:
    """First pass: how many matches there are."""
    last = deque(zip(count(1), matcher.finditer(text)), maxlen=1)
    return last[0][0] if last else 0


def cuts(matcher: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: the characters at which unit ``low`` and unit ``high`` (from 0, low <= high) begin; the end if there are no such."""
    ahead = matcher.finditer(text)
    found = next(islice(ahead, low, None), None)
    if found is None:
        first = 0 if low == 0 else len(text)
        return first, first if low == high else len(text)
    first = 0 if low == 0 else found.start()
    if low == high:
        return first, first
    found = next(islice(ahead, high - low - 1, None), None)
    return first, len(text) if found is None else found.start()


def drawn(key: Column, seed: int = 1) -> list[Column]:
    """Four numbers of 32 bits that depend on the key and the seed."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transformed(matcher: re.Pattern, text: str, h1: int, h2: int, h3: int, h4: int, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """output, form, number of units, and the lengths of prefix and middle in characters (None if plain)."""
    n = units(matcher, text)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
        return text, "plain", n, None, None
    a, b = h1 % (n + 1), h2 % (n + 1)
    low, high = cuts(matcher, text, min(a, b), max(a, b))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < spm_rate:
        return "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)), "spm", n, low, high - low
    return "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)), "psm", n, low, high - low


def filled(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = CODE_POINT, seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """df with output, form (plain, psm or spm), n, prefix_chars and middle_chars. Narrow: no shuffle."""
    if clash := set(ADDED) & set(df.columns):
        raise ValueError(f"columns to be renamed first: {sorted(clash)}")
    others = [c for c in df.columns if c != text]
    given = df.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("row"),
        F.col(f"`{text}`").isNull().alias("missing"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("given"), *drawn(F.col(f"`{key}`"), seed),
    )
    made = StructType([*given.schema.fields[:2], *(StructField(c, StringType() if c in ("output", "form") else LongType()) for c in ADDED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = re.compile(unit)
        for b in batches:
            texts, draws = b.column(2), [b.column(k).to_pylist() for k in range(3, 7)]
            at = 0
            while at < b.num_rows:
                out, size, first = [], 0, at
                while at < b.num_rows and size < BATCH:
                    t = texts[at].as_py()
                    out.append(transformed(matcher, t, *(d[at] for d in draws), rate, spm_rate))
                    size += len(t)
                    at += 1
                cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(first, at - first) for k in (0, 1)), *cols], names=["row", "missing", *ADDED])

    done = given.mapInArrow(handing_back(run), made)
    # the text doesn't come back from Python beside the output: where it is asked for, it is rebuilt
    was = F.when(~F.col("missing"), restored(F.col("output"), F.col("form"))).cast(df.schema[text].dataType)
    return done.select(*[(was if c == text else F.col("row")[c]).alias(c) for c in df.columns], *ADDED)


def restored(output: Column, form: Column) -> Column:
    """The text that ``filled`` was given (empty for a null text). Pieces hold no marker, so the three that stand in an output are its own."""
    piece = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(piece[1], piece[3], piece[2]), F.concat(piece[2], piece[3], piece[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the number of units, the form, the lengths of the pieces, and digests of the output and of the text rebuilt from it."""
    done = filled(df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
