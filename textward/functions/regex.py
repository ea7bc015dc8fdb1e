"""RE2 expressions on Java's engine, with exact results and a literal gate.

RE2's \\b, \\w and \\s are ASCII, its case folding is Unicode's, and only \\n ends a line. The gate is
a set of literals one of which each match must contain; testing them first, on text lowered
once, spares most texts the expression.
"""

from __future__ import annotations

import re
import warnings

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from ..schema import constant

with warnings.catch_warnings():
    warnings.simplefilter("ignore", DeprecationWarning)
    from re import _constants as sre, _parser as parser

_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def is_valid(pattern: str) -> bool:
    """Whether RE2 takes the pattern: lookaround and backreferences, for instance, are errors. Arrow's RE2 decides."""
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid:
        return False
    return True


def to_java(pattern: str) -> str:
    """The same expression for Java. Leading flags i, m and s are kept."""
    flags = "d"
    if m := re.match(r"\(\?([ims]+)\)", pattern):
        flags += m[1] + ("u" if "i" in m[1] else "")
        pattern = pattern[m.end() :]
    out, k, within = [], 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            e = pattern[k : k + 2]
            k += 2
            if e == r"\b" and not within:
                out.append(_EDGE)
            elif e == r"\s":
                out.append(r"\t\n\f\r " if within else r"[\t\n\f\r ]")
            elif e == r"\S" and not within:
                out.append(r"[^\t\n\f\r ]")
            else:
                out.append(e)
            continue
        within = c == "[" or within and c != "]"
        out.append(c)
        k += 1
    return f"(?{flags})" + "".join(out)


def _needed(items) -> list[str] | None:
    """Literals of which a match contains at least one; None if there is no telling."""
    best, run = None, ""

    def better(found: list[str] | None) -> None:
        nonlocal best
        if found and (best is None or (min(map(len, found)), -len(found)) > (min(map(len, best)), -len(best))):
            best = found

    for op, arg in items:
        if op is sre.LITERAL:
            run += chr(arg)
            continue
        better([run] if run else None)
        run = ""
        if op is sre.SUBPATTERN:
            better(_needed(arg[-1]))
        elif op is sre.BRANCH:
            each = [_needed(b) for b in arg[1]]
            better([x for e in each for x in e] if all(each) else None)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            better(_needed(arg[2]))
    better([run] if run else None)
    return best


def _parsed(pattern: str) -> list:
    """The parsed expression; nothing if it is of a form that only RE2 knows."""
    try:
        return list(parser.parse(re.sub(r"^\(\?[ims]+\)", "", pattern)))
    except re.error:
        return []


def gate(pattern: str) -> list[str]:
    """Lower-case literals, or none where every text has to be tried."""
    found = _needed(_parsed(pattern)) or []
    found = [f.lower() for f in found]
    return found if found and min(map(len, found)) >= 2 else []


def _groups(items) -> list[list[str]]:
    """Lists of literals, of each of which a match contains at least one."""
    out, run = [], ""
    for op, arg in [*items, (None, None)]:
        if op is sre.LITERAL:
            run += chr(arg)
            continue
        if run:
            out.append([run])
        run = ""
        if op is sre.SUBPATTERN:
            out += _groups(arg[-1])
        elif op is sre.BRANCH:
            each = [_needed(b) for b in arg[1]]
            if all(each):
                out.append([x for e in each for x in e])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            out += _groups(arg[2])
    return out


def gates(pattern: str) -> list[list[str]]:
    """Lists of lower-case ASCII literals, of each of which a matching text has one: those of two letters or more, and single signs such as <."""
    found = [[x.lower() for x in g] for g in _groups(_parsed(pattern))]
    return [g for g in found if all(x.isascii() and (len(x) >= 2 or not x.isalnum() and not x.isspace()) for x in g)]


def for_gate(s: Column) -> Column:
    """Text as gates see it: every letter that folds to an ASCII letter is that letter."""
    return F.lower(F.translate(s, "ſİ", "si"))


def matches(s: Column, lowered: Column, pattern: str) -> Column:
    test, literals = s.rlike(to_java(pattern)), gate(pattern)
    if not literals:
        return test
    some = lowered.contains(literals[0])
    for x in literals[1:]:
        some = some | lowered.contains(x)
    return some & test


def first(s: Column, pattern: str) -> tuple[Column, Column, Column]:
    """Text of the first match, and its first byte and the byte after it."""
    java = to_java(pattern)
    hit = F.regexp_substr(s, F.lit(java))
    start = F.octet_length(F.split(s, java, 2)[0])
    return hit, start, start + F.octet_length(hit)


def first_matches(s: Column, numbers: Column, patterns: list[str]) -> Column:
    """(k, hit, start, end) of the first match of each pattern that matches, of those with the given numbers, ascending.

    The pattern is looked up by its number, so that the plan doesn't grow with the patterns.
    """
    java = constant([to_java(p) for p in patterns])
    of = lambda k: F.element_at(java, k + 1)
    found = F.transform(F.filter(numbers, lambda k: F.rlike(s, of(k))), lambda k: F.struct(k.alias("k"), F.regexp_substr(s, of(k)).alias("hit"), F.octet_length(F.split(s, of(k), 2)[0]).alias("start")))
    return F.transform(found, lambda x: F.struct(x["k"].alias("k"), x["hit"].alias("hit"), x["start"].alias("start"), (x["start"] + F.octet_length(x["hit"])).alias("end")))


def every(s: Column, pattern: str | Column, make) -> Column:
    """An array of make(match, start, end) over all matches; offsets are in bytes. A pattern that is a column is Java's already."""
    java = pattern if isinstance(pattern, Column) else F.lit(to_java(pattern))
    hits = F.regexp_extract_all(s, java, F.lit(0))
    parts = F.arrays_zip(F.slice(F.split(s, java, -1), F.lit(1), F.size(hits)).alias("g"), hits.alias("h"))
    nothing = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<hit:string,start:int,end:int>>").alias("found"))

    def step(seen: Column, part: Column) -> Column:
        start = seen["end"] + F.octet_length(part["g"])
        end = start + F.octet_length(part["h"])
        return F.struct(end.alias("end"), F.concat(seen["found"], F.array(F.struct(part["h"].alias("hit"), start.alias("start"), end.alias("end")))).alias("found"))

    found = F.aggregate(parts, nothing, step, lambda seen: seen["found"])
    return F.transform(found, lambda f: make(f["hit"], f["start"], f["end"]))


def joined(s: Column, pattern: str, hits: Column) -> Column:
    """s with its matches replaced by ``hits``, one for each."""
    return F.array_join(F.zip_with(F.split(s, to_java(pattern), -1), F.concat(hits, F.array(F.lit(""))), lambda g, h: F.concat(g, h)), "")
