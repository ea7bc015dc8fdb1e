"""Approximate keyword search over a text's fuzzy form.

A keyword is found exactly, or approximately: within its edit distance d of a window whose length
differs from it by one at most. Of d + 1 pieces of a keyword at least one stands unchanged in such a
window, so only windows around occurrences of a piece are measured, and of these only such as lack no more than d
letters of the keyword (each letter that is missing is an edit).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

# The keywords; from eight letters on, two edits are allowed, else one.
KEYWORDS = ["ignore", "system", "instructions", "prompt", "override", "disregard", "forget", "pretend", "reveal", "assistant", "previous"]


def allowed(keyword: str) -> int:
    return 2 if len(keyword) >= 8 else 1


@lru_cache(1 << 12)
def within(a: str, b: str, most: int) -> bool:
    """Whether the Levenshtein distance of a and b is at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        low = i
        for j, y in enumerate(b, 1):
            value = min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
            diagonal, row[j] = row[j], value
            low = min(low, value)
        if low > most:
            return False
    return row[-1] <= most


def _pieces(keyword: str) -> list[tuple[int, str]]:
    n, d = len(keyword), allowed(keyword)
    cuts = [n * k // (d + 1) for k in range(d + 2)]
    return [(a, keyword[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _letters(keyword: str) -> list[tuple[str, int]]:
    """The keyword's letters and how often it has them, those rare in texts first."""
    return sorted(Counter(keyword).items(), key=lambda x: -"etaoinsrhldcumfpgwybvkxjqz".find(x[0]))


_PIECES = {k: _pieces(k) for k in KEYWORDS}
_LETTERS = {k: _letters(k) for k in KEYWORDS}


def _lacks(text: str, letters: list[tuple[str, int]], most: int) -> bool:
    """Whether more than ``most`` of these letters are missing from the text."""
    for x, n in letters:
        have = text.count(x)
        if have < n:
            most -= n - have
            if most < 0:
                return True
    return False


def find(text: str, keyword: str) -> int:
    """0: not there, 1: there as it is, 2: there approximately."""
    if keyword in text:
        return 1
    d, n, size = allowed(keyword), len(text), len(keyword)
    letters = _LETTERS.get(keyword) or _letters(keyword)
    tried = set()
    for offset, piece in _PIECES.get(keyword) or _pieces(keyword):
        at = text.find(piece)
        while at >= 0:
            low, high = max(0, at - offset - d), min(n, at - offset + d)
            if not _lacks(text[low : high + size + 1], letters, d):
                for start in range(low, high + 1):
                    for end in range(start + size - 1, min(start + size + 1, n) + 1):
                        if (start, end) not in tried:
                            tried.add((start, end))
                            window = text[start:end]
                            if not _lacks(window, letters, d) and within(window, keyword, d):
                                return 2
            at = text.find(piece, at + 1)
    return 0


FOUND = ArrayType(StructType([StructField("keyword", StringType()), StructField("approximate", BooleanType())]))


@arrow_udf(FOUND)
def fuzzy_keywords(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The keywords found in each fuzzy form, in the order of KEYWORDS."""
    kind = to_arrow_type(FOUND)
    for s in texts:
        yield pa.array([[{"keyword": k, "approximate": f == 2} for k in KEYWORDS if (f := find(t, k))] if (t := x.as_py()) else [] for x in s], kind)
