"""String functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..rules.characters import CONFUSABLES, INVISIBLE, LEET, SUSPICIOUS

_FROM, _TO = "".join(CONFUSABLES), "".join(CONFUSABLES.values())
#: White space as the patterns' dialect has it, and as Unicode has it.
SPACE, UNICODE_SPACE = r"[\t\n\f\r ]", r"[\t\n\x0B\f\r\x{85}\p{Z}]"
_ROT = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm")


def lowered(s: Column) -> Column:
    """Lower case letter by letter: no final sigma, no added dots."""
    return F.lower(F.translate(s, "İΣ", "iσ"))


def without_invisible(s: Column) -> Column:
    return F.translate(s, INVISIBLE, "")


def has_invisible(s: Column) -> Column:
    """Any format character (Unicode category Cf), which all of the invisible ones are."""
    return s.rlike(r"\p{Cf}")


def folded(s: Column) -> Column:
    """Look-alikes read as plain letters and punctuation."""
    return F.translate(s, _FROM, _TO)


def is_suspicious(s: Column) -> Column:
    return F.translate(s, SUSPICIOUS, "") != s


def fuzzy_form(s: Column) -> Column:
    """Leet read as letters, lower case, only letters, digits and spaces; what goes leaves no gap."""
    t = lowered(F.translate(s, *LEET))
    return F.regexp_replace(F.translate(t, "\t\n", "  "), r"[^\p{L}\p{Nd} ]", "")


def compact_form(s: Column) -> Column:
    """As the fuzzy form, without spaces."""
    return F.regexp_replace(lowered(F.translate(s, *LEET)), r"[^\p{L}\p{Nd}]", "")


def policy_form(s: Column) -> Column:
    """Lower-case letters and digits, each other run one space, trimmed."""
    return F.trim(F.regexp_replace(lowered(s), r"[^\p{L}\p{Nd}]+", " "))


def rot13(s: Column) -> Column:
    return F.translate(s, *_ROT)


def base64_text(s: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(s, "UTF-8")), r"[\r\n]", "")


def words(s: Column) -> Column:
    """Between Unicode white space."""
    return F.filter(F.split(s, UNICODE_SPACE + "+"), lambda w: w != "")


def xml_escaped(s: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(char), F.lit(name))
    return s


def contains_all(s: Column, parts: list) -> Column:
    """Every part; of a part that is a tuple, any. Earlier parts are tested first."""
    tests = [contains_any(s, list(p)) if isinstance(p, tuple) else s.contains(p) for p in parts]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def contains_any(s: Column, parts: list[str]) -> Column:
    out = s.contains(parts[0])
    for p in parts[1:]:
        out = out | s.contains(p)
    return out


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, of its exact binary value as printf writes it (0.975 is below 0.975: 0.97); ``format_string`` rounds the shortest decimal instead."""
    # format_number has the tie of its first digit (0.0005 to three) wrong; below one unit the shortest decimal is right
    return F.when(F.abs(x) < 10.0**-digits, F.format_string(f"%.{digits}f", x)).otherwise(F.replace(F.format_number(x, digits), F.lit(","), F.lit("")))


def first_word(s: Column, keywords: list[str]) -> Column:
    """The first keyword, in the list's order, that s contains; null if none."""
    out = F.lit(None).cast("string")
    for k in reversed(keywords):
        out = F.when(s.contains(k), k).otherwise(out)
    return out


def byte_clip(s: Column, most: int) -> Column:
    """At most so many bytes of s, cut between characters."""
    raw = F.encode(s, "UTF-8")
    cut = [F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(4)]
    return F.when(F.octet_length(s) <= most, s).otherwise(F.coalesce(*cut, F.lit("")))


# Start and multiplier of the 64-bit FNV-1a hash, the multiplier without its highest bit (2^40).
FNV_START, FNV_REST = 0xCBF29CE484222325, 0x1B3


def fnv1a(s: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, as a signed long. In two halves of 32 bits, none of whose products overflows a long, also under ANSI."""
    low = F.lit(0xFFFFFFFF)
    # the bytes go along with the halves: a lambda that looked them up outside would make them anew for each place
    half = lambda lo, hi, data: F.struct(lo.alias("lo"), hi.alias("hi"), data.alias("data"))

    def step(h: Column, at: Column) -> Column:
        lo = h["lo"].bitwiseXOR(F.conv(F.hex(F.substring(h["data"], at, F.lit(1))), 16, 10).cast("long"))
        part = lo * F.lit(FNV_REST)
        # times 2^40 is the low half, eight bits up in the high half
        return half(part.bitwiseAND(low), (h["hi"] * F.lit(FNV_REST) + F.shiftright(part, 32) + F.shiftleft(lo, 8)).bitwiseAND(low), h["data"])

    start = half(F.lit(FNV_START & 0xFFFFFFFF).cast("long"), F.lit(FNV_START >> 32).cast("long"), F.encode(s, "UTF-8"))
    places = F.when(F.octet_length(s) > 0, F.sequence(F.lit(1), F.octet_length(s))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda h: F.shiftleft(h["hi"], 32).bitwiseOR(h["lo"]))
