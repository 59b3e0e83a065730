"""Charsets of bodies that declare none: what is valid where, and how bytes are spread, over the whole body, by built-in functions.

A body is read byte by byte as ISO-8859-1, so that patterns and counts run over it as text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import bound

# For each charset of more bytes a unit, the first that fits counts: what one unit is, and what its frequent
# units start with (kana, hangul syllables, the first level of characters).
UNITS = {
    "shift_jis": (r"[\x00-\x7F\xA1-\xDF]|[\x81-\x9F\xE0-\xFC][\x40-\x7E\x80-\xFC]", r"[\x82\x83][\x40-\xFC]"),
    "euc_jp": (r"[\x00-\x7F]|\x8E[\xA1-\xDF]|\x8F[\xA1-\xFE]{2}|[\xA1-\xFE]{2}", r"[\xA4\xA5][\xA1-\xF6]"),
    "euc_kr": (r"[\x00-\x7F]|[\xA1-\xFE]{2}", r"[\xB0-\xC8][\xA1-\xFE]"),
    "big5": (r"[\x00-\x7F]|[\xA1-\xF9][\x40-\x7E\xA1-\xFE]", r"[\xA4-\xC6][\x40-\x7E]"),
    "gb18030": (r"[\x00-\x7F]|[\x81-\xFE](?:[\x40-\x7E\x80-\xFE]|[0-9][\x81-\xFE][0-9])", r"[\xB0-\xD7][\xA1-\xFE]"),
}
#: How much of the units each of them has to start so, as texts of its language do.
LEAST = {"shift_jis": 0.25, "euc_jp": 0.25, "euc_kr": 0.75, "big5": 0.2, "gb18030": 0.5}


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _rest(text: Column, pattern: str) -> Column:
    """How much is left without what the pattern takes."""
    return F.length(F.regexp_replace(text, pattern, ""))


def _wide(x: Column) -> Column:
    """UTF-16 by where its zero bytes are; null where they are nowhere or everywhere."""

    def of(z: Column) -> Column:
        return F.when(F.length(x) % 2 == 1, None).when((z["odd"] > 2 * z["even"]) & (z["odd"] * 50 >= F.length(x)), "utf-16-le").when((z["even"] > 2 * z["odd"]) & (z["even"] * 50 >= F.length(x)), "utf-16-be")

    evens, odds = F.regexp_replace(x, "(?s)(.).?", "$1"), F.regexp_replace(x, "(?s).(.?)", "$1")
    return bound(F.struct(_count(evens, r"\x00").alias("even"), _count(odds, r"\x00").alias("odd")), of)


def _wide_east(x: Column) -> Column:
    """UTF-16 without zero bytes: one byte of each pair names a block of kana, characters, syllables or full-width forms, the other is any.

    Any byte means control bytes and those of 7F to 9F too, which letters of a Latin text are not: one pair in twenty holds one.
    """
    blocks = r"[\x30\x4E-\x9F\xAC-\xD7\xFF]"

    def of(n: Column) -> Column:
        le = (n["odd"] * 10 >= n["pairs"] * 9) & (n["even"] * 10 < n["pairs"] * 8)
        be = (n["even"] * 10 >= n["pairs"] * 9) & (n["odd"] * 10 < n["pairs"] * 8)
        return F.when((F.length(x) % 2 == 1) | (n["pairs"] < 8) | (n["odd_ones"] * 20 < n["pairs"]), None).when(le, "utf-16-le").when(be, "utf-16-be")

    evens, odds = F.regexp_replace(x, "(?s)(.).?", "$1"), F.regexp_replace(x, "(?s).(.?)", "$1")
    return bound(F.struct(_count(evens, blocks).alias("even"), _count(odds, blocks).alias("odd"), F.floor(F.length(x) / 2).alias("pairs"), _count(x, r"[\x00-\x08\x0B\x0E-\x1F\x7F-\x9F]").alias("odd_ones")), of)


def _latin(x: Column) -> Column:
    """Whether the bytes above 7F are letters within Latin words.

    They are where more than half of them stand alone between ASCII ones.  Else, read as characters of two bytes, hardly any stand three in a
    row, as those of a text in characters do, and they touch ASCII letters or are few beside them.
    """

    def of(marked: Column) -> Column:
        short = F.regexp_replace(marked, "\u0100{3,}", "")
        counts = F.struct(
            _count(marked, "\u0100").alias("all"), _count(short, "\u0100").alias("short"), _count(marked, "\u0100+").alias("runs"),
            _count(marked, "(?<=[A-Za-z])\u0100|\u0100(?=[A-Za-z])").alias("touching"), _count(x, "[A-Za-z]").alias("letters"), _count(x, r"[\x80-\xFF]").alias("high"),
        )
        return bound(counts, lambda n: ((n["all"] - n["short"]) * 5 < n["all"]) & ((n["touching"] * 4 >= n["runs"]) | (n["letters"] > n["high"] * 8)))

    alone = _count(x, r"(?<![\x80-\xFF])[\x80-\xFF](?![\x80-\xFF])") * 2 > _count(x, r"[\x80-\xFF]")
    return alone | bound(F.regexp_replace(x, r"[\x81-\xFE][\x40-\x7E\x80-\xFE]", "\u0100"), of)


def _single(x: Column) -> Column:
    """One byte a letter: Cyrillic and Greek by which half of the upper rows has the small letters, else western or central European."""

    def of(n: Column) -> Column:
        script = (n["high"] > n["low"]) & (n["high"] > 2)
        greek = script & (n["greek"] * 10 >= n["high"] * 9) & (n["accent"] * 50 >= n["high"])
        central = n["central"] * 4 >= n["high"]
        return F.when(script & (n["c_d"] > n["e_f"]), "koi8-r").when(greek, "windows-1253").when(script, "windows-1251").when(central, "iso-8859-2").otherwise("windows-1252")

    counts = {
        "high": r"[\x80-\xFF]", "low": "[A-Za-z]", "c_d": r"[\xC0-\xDF]", "e_f": r"[\xE0-\xFF]",
        "greek": r"[\xB8-\xFE]", "accent": r"[\xDC-\xDF]",
        "central": r"(?<=[a-z\xE0-\xFF])[\xB1\xB3\xB6\xB9\xBC\xBE\xBF]|[\xB1\xB3\xB6\xB9\xBC\xBE\xBF](?=[a-z\xE0-\xFF])|[\xEC\xF8](?=[a-z])|(?<=[a-z])[\xEC\xF8]",
    }
    return bound(F.struct(*(_count(x, p).alias(n) for n, p in counts.items())), of)


def _many(x: Column) -> Column:
    """A charset of more bytes a unit in which all of x is valid and its frequent units are frequent; null if there is none."""

    def share(name: str) -> Column:
        unit, frequent = UNITS[name]
        # Unit after unit, each becomes a mark, a frequent one with its bytes before.
        marked = F.regexp_replace(x, f"({frequent})|{unit}", "$1\u0100")
        both = F.struct(_count(marked, r"[\x00-\xFF]\u0100").alias("frequent"), _rest(x, unit).alias("rest"), _count(x, r"[\x80-\xFF]").alias("high"))
        return bound(both, lambda b: F.when((b["rest"] == 0) & (b["high"] > 0), b["frequent"] * 2 / b["high"]))

    def first(s: Column) -> Column:
        return F.coalesce(*(F.when(s[n] >= LEAST[n], n) for n in UNITS))

    return bound(F.struct(*(share(n).alias(n) for n in UNITS)), first)


def sniffed(body: Column) -> Column:
    """The charset of a body by its bytes alone; utf-8 for ASCII, for an empty body and for what is valid as UTF-8; null for null.

    Order: byte order marks, zero bytes, escape sequences, UTF-8, charsets of more bytes a unit, UTF-16 by its blocks, charsets of one.
    """

    def of(x: Column) -> Column:
        return (
            F.when(x.isNull(), None)
            .when(F.startswith(x, F.lit("ï»¿")), "utf-8").when(F.startswith(x, F.lit("ÿþ")), "utf-16-le").when(F.startswith(x, F.lit("þÿ")), "utf-16-be")
            .when(F.contains(x, F.lit("\x00")), F.coalesce(_wide(x), F.lit("utf-8")))
            .when(F.rlike(x, F.lit(r"\x1B\$[@B]")) & ~F.rlike(x, F.lit(r"[\x80-\xFF]")), "iso2022_jp")
            .when(F.is_valid_utf8(body.cast("string")), "utf-8")
            .otherwise(F.coalesce(F.when(~_latin(x), _many(x)), _wide_east(x), _single(x)))
        )

    return bound(F.decode(body, "ISO-8859-1"), of)
