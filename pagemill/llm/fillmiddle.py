"""Fill-in-the-middle transformation by a sparse scan for events.

A text is cut into units and two of the unit boundaries split it into prefix,
middle and suffix; the parts are then written in another order behind
sentinels.  One Aho-Corasick automaton passes over the text once.  It knows
the ASCII characters at which the class of characters changes (white space
against the rest) and the sentinels.  Nothing is recorded between two such
events: how many units a gap holds follows from its length, so the events
with the number of units up to each are enough to find the place of the r-th
unit by a binary search and one addition.

Units (FimPlan.units), always left to right over code points:

* chars: every code point is a unit.  A gap of g code points holds g units.
* words: a run of white space is a unit and so is a run of other characters.
* lines: a unit ends behind each line feed; what follows the last one is a
  unit unless it is empty.

Defined results: a null text counts as empty and an empty text stays plain; a
text that holds a sentinel stays plain, as its parts could not be told apart
afterwards.  A null key is hashed as the empty string.  Bytes that are not
UTF-8 become U+FFFD.  Repeated rows give repeated results, an empty table
none.  Other columns of the table are neither read nor returned.  Texts of
any length are scanned whole; a task holds about a megabyte of text, or one
row, at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SENTINEL, _CHANGE = 1, 0
_WHITE = "\t\n\x0b\x0c\r "
#: The characters at which the class changes, by kind of unit.
_CHANGING = {"chars": _WHITE, "words": _WHITE, "lines": "\n"}


@dataclass(frozen=True)
class FimPlan:
    """units: chars, words or lines; shares of 100 by hash: from plain_from on a text stays plain, below spm_below the suffix goes first."""

    units: str = "chars"
    plain_from: int = 90
    spm_below: int = 20
    salt: str = "1:"


def new_automaton(units: str) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in _CHANGING[units]:
        found.add_word(c, _CHANGE)
    for s in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(s, _SENTINEL)
    found.make_automaton()
    return found


@dataclass(frozen=True)
class Units:
    """Where units end.  Behind done[i] units stands place[i]; from there to the next entry every code point is a unit."""

    n: int
    done: np.ndarray
    place: np.ndarray
    sentinel: bool

    def cut(self, rank: int) -> int:
        """The code point behind which rank units have ended."""
        i = int(np.searchsorted(self.done, rank, "right")) - 1
        return int(self.place[i] + rank - self.done[i])


def scan(text: str, units: str, automaton: ahocorasick.Automaton) -> Units:
    """The units of a text from its events; between events only lengths count."""
    events = np.fromiter((2 * at + kind for at, kind in automaton.iter(text)), np.int64)
    at, size = events[events % 2 == _CHANGE] // 2, len(text)
    before = np.diff(at, prepend=-1) - 1  # code points in the gap before each event
    tail = size - 1 - int(at[-1]) if len(at) else size
    if units == "chars":
        place = np.concatenate([[0], np.cumsum(before + 1)])
        done, n = place, int(place[-1]) + tail
    elif units == "lines":
        place = np.concatenate([[0], at + 1, [size] if tail else []]).astype(np.int64)
        done, n = np.arange(len(place)), len(place) - 1
    else:
        fresh = before > 0
        white_ends = at[1:][fresh[1:]] - before[1:][fresh[1:]]  # a run of white space ends where a gap begins
        ends = np.union1d(at[fresh], white_ends)
        if tail and len(at):
            ends = np.union1d(ends, [at[-1] + 1])
        place = np.union1d(ends, [0, size]).astype(np.int64)
        done, n = np.arange(len(place)), len(place) - 1
    return Units(n, done, place, bool((events % 2 == _SENTINEL).any()))


def arranged(text: str, first: int, second: int, form: str) -> str:
    """The text with its parts, cut at two code points, in the order of the form."""
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if form == "spm" else text


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone.

    Parts hold no sentinel, and none can arise across the end of a part, as all begin with a character they have only once.
    """
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def _draw(key: Column, plan: FimPlan, nth: int) -> Column:
    digits = F.sha2(F.concat(F.lit(plan.salt), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digits, 8 * nth - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, plan: FimPlan | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n (units), form (psm, spm or plain), prefix_units, middle_units, prefix_chars, middle_chars, output.

    The four counts are null where the form is plain.  The cuts and the form follow from a hash of the key, so reruns agree.
    """
    plan = plan or FimPlan()
    if plan.units not in _CHANGING:
        raise ValueError(f"units must be one of {', '.join(_CHANGING)}")
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.make_valid_utf8(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text"), *[_draw(F.col(f"`{key}`"), plan, i).alias(f"h{i}") for i in (1, 2, 3, 4)])
    counts = ("prefix_units", "middle_units", "prefix_chars", "middle_chars")
    kind = rows.schema["key"].dataType.simpleString()

    @tb.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = new_automaton(plan.units)
        for whole in batches:
            for lo, hi in tb.row_chunks(whole.column(1)):
                b = whole.slice(lo, hi - lo)
                n, forms, outputs, numbers = [], [], [], []
                for t, h1, h2, h3, h4 in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                    u = scan(t, plan.units, automaton)
                    plain = not t or u.sentinel or h3 % 100 >= plan.plain_from
                    form = "plain" if plain else "spm" if h4 % 100 < plan.spm_below else "psm"
                    lower, upper = sorted((h1 % (u.n + 1), h2 % (u.n + 1)))
                    first, second = u.cut(lower), u.cut(upper)
                    n.append(u.n)
                    forms.append(form)
                    outputs.append(arranged(t, first, second, form))
                    numbers.append((None,) * 4 if plain else (lower, upper - lower, first, second - first))
                each = [pa.array([x[i] for x in numbers], pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), *each, pa.array(outputs, pa.string())], names=["key", "n", "form", *counts, "output"])

    out = rows.mapInArrow(run, f"key {kind}, n long, form string, {', '.join(f'{c} long' for c in counts)}, output string")
    return out.withColumnRenamed("key", key)
