"""Sanitiser: strips invisible characters, folds look-alikes, decodes payloads, deletes patterns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import regex, text
from ..schema import EA, added, metadata, none, rewritten, threat
from .guard import Guard

# Encoded runs.
BASE64_RUN = r"[A-Za-z0-9+/]{32,}={0,3}"
HEX_RUN = r"(?:\\x[0-9A-Fa-f]{2}){4,}"


def base64_plain(run: Column) -> Column:
    """The UTF-8 text of a standard base64 run; null if it isn't one."""
    return F.try_validate_utf8(F.try_to_binary(run, F.lit("base64")).cast("string"))


def hex_plain(run: Column) -> Column:
    return F.try_validate_utf8(F.unhex(F.regexp_replace(run, r"\\x", "")).cast("string"))


ENCODINGS = (("base64", BASE64_RUN, base64_plain), ("hex_escape", HEX_RUN, hex_plain))


def decoded(s: Column, kind: str, run: str, plain: Callable[[Column], Column]) -> Column:
    """For each run: its plain text, or itself if it has none, and the threat if it has."""

    def one(hit: Column, a: Column, b: Column) -> Column:
        found = threat(EA, 0.7, f"encoded payload was decoded and replaced: {kind}", "sanitizer", hit, a, b)
        return F.transform(F.array(plain(hit)), lambda p: F.struct(F.coalesce(p, hit).alias("plain"), F.when(p.isNotNull(), found).alias("threat")))[0]

    return regex.every(s, run, one)


@dataclass
class Sanitizer(Guard):
    normalize: bool = False
    dehomoglyph: bool = False
    strip_zero_width: bool = False
    decode_payloads: bool = False
    strip_patterns: list[str] = field(default_factory=list)
    name = "sanitizer"

    def apply(self, df: DataFrame) -> DataFrame:
        df = metadata(df, {"pre_sanitize": F.col("input")})
        s = F.col("input")
        if self.strip_zero_width or self.normalize:
            plain = text.without_invisible(s)
            df = rewritten(added(df, F.when(plain != s, F.array(threat(EA, 0.3, "input contained zero-width or invisible characters that were stripped", self.name))).otherwise(none())), plain)
        if self.dehomoglyph or self.normalize:
            df = rewritten(added(df, F.when(text.is_suspicious(s), F.array(threat(EA, 0.3, "input contained confusable/homoglyph characters that were normalized", self.name))).otherwise(none())), text.folded(s))
        if self.decode_payloads:
            # a step for each encoding, as a column between the two, so that what one makes isn't made again in the next
            for kind, run, plain in ENCODINGS:
                df = df.withColumn("_hits", F.when(~F.col("halted") & s.rlike(run), decoded(s, kind, run, plain)))
                df = added(df, F.coalesce(F.array_compact(F.transform("_hits", lambda x: x["threat"])), none()))
                df = rewritten(df, F.coalesce(regex.joined(s, run, F.transform("_hits", lambda x: x["plain"])), s)).drop("_hits")
        for p in self.strip_patterns:
            if not regex.is_valid(p):  # an invalid expression strips nothing
                continue
            df = rewritten(df, F.regexp_replace(s, regex.to_java(p), ""))
        return df
