"""Character tables."""

import unicodedata

# Invisible characters.
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\ufeff\u00ad\u2060\u2061\u2062\u2063\u2064\u180e"

# Look-alikes of Latin letters in Cyrillic and Greek, and their readings.
CYRILLIC = ("АаВвСсЕеНнКкМмОоРрТтХхУуЗЅѕІіЈјҮҺ", "AaBbCcEeHhKkMmOoPpTtXxYy3SsIiJjYH")
GREEK = ("ΑαΒβΕεΗηΙιΚκΜΝνΟοΡρΤτΥυΧχΖζ", "AaBBEeHnIiKkMNvOoPpTtYuXxZz")
# Punctuation.
PUNCTUATION = ("‐‑‒–—‘’‚“”„․‥…", "-----'''\"\"\"...")
# Latin letters with strokes or without dots.
LATIN = ("ĐđŁłı", "DdLli")
# Leet readings.
LEET = ("1!|0@4$537+8692", "iiioaassettbggz")


def _accented() -> dict[str, str]:
    """Latin-1 vowels and Latin Extended-A letters (but G and K) with their accents taken off."""
    out = {}
    for code in range(0xC0, 0x180):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and (base in "AEIOUaeiou" if code < 0x100 else base not in "GgKk"):
            out[chr(code)] = base
    return out


def confusables() -> dict[str, str]:
    """Each look-alike and what it is read as: the tables above, accents, and full-width letters."""
    table: dict[str, str] = {}
    for keys, readings in (CYRILLIC, GREEK, LATIN, PUNCTUATION):
        table |= dict(zip(keys, readings, strict=True))
    wide = {chr(c + 0xFEE0): chr(c) for c in (*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1))}
    return table | _accented() | wide


CONFUSABLES = confusables()
#: The look-alikes that ordinary European text doesn't have.
SUSPICIOUS = "".join(c for c in CONFUSABLES if "Α" <= c <= "χ" or "Ѐ" <= c <= "ӿ" or "Ａ" <= c <= "ｚ")
