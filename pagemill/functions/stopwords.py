"""Stop-word statistics of text, in plain Python and as column expressions.

A list is a parameter: read_lists() takes a folder of stopwords-<lang>.txt
files.  Built in are short lists of very common words for four languages.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .htmltree import squeezed

#: ASCII punctuation, which words are counted without.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_STRIP = str.maketrans("", "", PUNCTUATION)

_SHORT = {
    "en": "a about after all also am an and any are as at be because been before but by can could did do does for from had has have he her here him his how i if in into is it its just me more most my no not now of on only or other our out over she should so some such than that the their them then there these they this to under until up very was we were what when where which while who why will with would you your",
    "fr": "a ai au aux avec ce ces cette dans de des du elle elles en est et eux il ils je la le les leur lui ma mais me mes moi mon ne nos notre nous on ou par pas plus pour qu que qui sa se ses son sont sur ta te tes toi ton tu un une vos votre vous y",
    "de": "aber als am an auch auf aus bei bin bis bist da das dass dem den der des die du durch ein eine einem einen einer eines er es für hatte ich ihr ihre im in ist ja kann mit nach nicht noch nur ob oder sehr sich sie sind so über um und uns unter vom von vor war wenn wer wie wir zu zum zur",
    "es": "a al como con de del donde dos el ella ellas ellos en entre era es esa ese esta este fue ha hay la las le les lo los más me mi muy no nos o para pero por que qué se ser si sin sobre son su sus también te tiene tu un una y ya yo",
}


def short_lists() -> dict[str, frozenset[str]]:
    return {lang: frozenset(words.split()) for lang, words in _SHORT.items()}


def read_lists(spark: SparkSession, folder: str) -> dict[str, frozenset[str]]:
    """Lists from stopwords-<lang>.txt files: one word a line, taken as it stands."""
    rows = spark.read.text(folder + "/stopwords-*.txt").select("value", F.regexp_extract(F.input_file_name(), r"stopwords-([a-z]{2,3})\.txt", 1).alias("lang"))
    out: dict[str, set[str]] = {}
    for r in rows.filter(F.length("value") > 0).collect():  # word lists, of bounded size
        out.setdefault(r["lang"], set()).add(r["value"])
    return {k: frozenset(v) for k, v in out.items()}


@dataclass(frozen=True)
class WordStats:
    stop_words: int
    words: int
    found: list[str] = field(default_factory=list)


def count_words(text: str | None, listed: frozenset[str], kind: str = "plain") -> WordStats:
    """Words of text, and those listed.

    kind: plain (punctuation goes, words are cut at single blanks, so neighbouring blanks leave empty words); arabic
    (runs of word characters or of other signs, punctuation kept); korean (every word counts once for each listed word);
    chinese (no segmenter is at hand: each character counts as a word).
    """
    if not text:
        return WordStats(0, 0)
    if kind == "arabic":
        words = re.findall(r"[A-Za-z0-9_']+|[^\sA-Za-z0-9_]+", text)
    elif kind == "chinese":
        words = [c for c in text.translate(_STRIP) if not c.isspace()]
    else:
        words = text.translate(_STRIP).split(" ")
    if kind == "korean":
        return WordStats(len(words) * len(listed), len(words), [])
    found = [w for w in map(str.lower, words) if w in listed]
    return WordStats(len(found), len(words), found)


def stat_columns(text: Column, listed: frozenset[str]) -> tuple[Column, Column]:
    """(words, stop words) of a text column for one list, by built-in functions."""
    bare = F.translate(text, PUNCTUATION, "")
    words = F.split(bare, " ", -1)
    empty = text.isNull() | (text == "")
    stop = F.size(F.filter(words, lambda w: F.lower(w).isin(sorted(listed))))
    return F.when(empty, 0).otherwise(F.size(words)), F.when(empty, 0).otherwise(stop)


def trimmed(text: Column) -> Column:
    """White space runs become one blank; none stays at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x{FEFF}]+", " "))


__all__ = ["PUNCTUATION", "WordStats", "count_words", "read_lists", "short_lists", "squeezed", "stat_columns", "trimmed"]
