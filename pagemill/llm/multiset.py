"""Document fingerprints by a homomorphic multiset hash over paragraphs.

A paragraph is what stands between line feeds.  Each is hashed to a wide
vector, and the fingerprint of a text is the sum of the vectors of its
paragraphs: the order of paragraphs does not matter, a paragraph is inserted
by adding its vector and deleted by subtracting it.  A vector has two parts:

* EXACT lanes of 64 bits, uniform hashes of the paragraph's bytes, added modulo
  2**64.  Different multisets of paragraphs meet in all of them by chance only.
* LIKE lanes of 16 bits, added modulo 2**16.  Every run of three words of the
  paragraph (all its words, where it has fewer) adds +1 or -1 in one lane; lane
  and sign come from a hash of the run.  The product of two such vectors estimates how
  many runs two texts share, so the likeness of two fingerprints is their cosine
  (0 where it is negative), with an error of about 1 / sqrt(LIKE).

edited() compares each text with one whose end is replaced by the start of
the next text in order of the key.  Only the paragraphs behind the cut change,
so the edited text's fingerprint is made by deletions and insertions alone.

To put each text beside the next one, keys (with a hash of the text for ties)
are dealt into ranges first; then every text goes to its range once, with one
more row per range, the first text of the next range.  A task reads its range
in order and holds two texts and a batch of about a megabyte.

Defined results: a null text counts as empty; an empty text is one empty
paragraph.  Null keys come before all others; rows of one key follow each other by a
hash of their texts, which deals a frequent key over many ranges.  Rows that
agree in key and text are taken one by one and stay in one range.  A single row
follows itself.  Likeness is 1 for equal fingerprints, and 0 where one of two
different ones has no words.  Bytes that are not UTF-8 become U+FFFD.  An empty
table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .storage import discard, stored

EXACT, LIKE = 4, 256
_FEED = 10
_SEEDS = np.random.default_rng(13).integers(1, 2**63, EXACT, dtype=np.uint64)
#: Bytes of text that one range is meant to hold.
RANGE_BYTES = 64 << 20


def _paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all paragraphs, the first paragraph of each row (and one past the last), and the line feeds."""
    rows, feeds = len(offsets) - 1, np.flatnonzero(data == _FEED)
    first = np.arange(rows + 1) + np.searchsorted(feeds, offsets)
    at = np.arange(len(feeds)) + np.searchsorted(offsets, feeds, "right") - 1  # the paragraph that each feed ends
    starts, ends = np.empty(rows + len(feeds), np.int64), np.empty(rows + len(feeds), np.int64)
    starts[first[:-1]], starts[at + 1] = offsets[:-1], feeds + 1
    ends[first[1:] - 1], ends[at] = offsets[1:], feeds
    return starts, ends, first, feeds


def paragraph_sums(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sums of its paragraphs' vectors: uint64 (rows, EXACT) and uint16 (rows, LIKE)."""
    data, offsets = tb.buffers(texts)
    n = len(offsets) - 1
    starts, ends, first, feeds = _paragraphs(data, offsets)
    h = tb.span_hashes(data, starts, ends)
    exact = np.zeros((n, EXACT), np.uint64)
    for lane, seed in enumerate(_SEEDS):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(h ^ seed), dtype=np.uint64)])
        exact[:, lane] = total[first[1:]] - total[first[:-1]]
    starts, ends, by_row = tb.words(data, offsets)
    if not len(starts):
        return exact, np.zeros((n, LIKE), np.uint16)
    h, row = tb.span_hashes(data, starts, ends), tb.row_numbers(by_row)
    paragraph = np.searchsorted(feeds, starts) + row
    begins = np.flatnonzero(np.diff(paragraph, prepend=-1))
    length = np.diff(begins, append=len(paragraph))
    one, two = begins[length == 1], begins[length == 2]
    three = np.flatnonzero(paragraph[:-2] == paragraph[2:])
    run = np.concatenate([tb.mix(h[one] ^ _SEEDS[0]), tb.mix(h[two] * np.uint64(3) + h[two + 1]), tb.windows(h, 3)[three]])
    cell = row[np.concatenate([one, two, three])] * LIKE + (run % np.uint64(LIKE)).astype(np.int64)
    sign = 1.0 - 2.0 * (run >> np.uint64(63)).astype(np.float64)
    like = np.bincount(cell, sign, minlength=n * LIKE).astype(np.int64).reshape(n, LIKE)
    return exact, (like & 0xFFFF).astype(np.uint16)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each pair of fingerprints, 0 to 1."""
    x, y = (v[1].view(np.int16).astype(np.float64) for v in (a, b))
    size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = np.divide((x * y).sum(axis=1), size, out=np.zeros(len(x)), where=size > 0)
    return np.where((a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1), 1.0, np.clip(cosine, 0.0, 1.0))


def hex_digits(fp: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """Fingerprints as text: the lanes in order, high digits first."""
    joined = np.hstack([fp[0].astype(">u8").view(np.uint8), fp[1].astype(">u2").view(np.uint8)])
    return [r.tobytes().hex() for r in joined]


def changed(text: str, following: str) -> tuple[str, str, str]:
    """The text with its last quarter replaced by the start of the following one; the paragraphs that go; those that come."""
    n = len(text)
    k = n // 4
    new = text[: n - k] + following[:k]
    start = text.rfind("\n", 0, n - k) + 1
    return new, text[start:], new[start:]


def plus(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints with the paragraphs of b inserted."""
    return a[0] + b[0], a[1] + b[1]


def minus(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints with the paragraphs of b deleted."""
    return a[0] - b[0], a[1] - b[1]


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    whole = F.make_valid_utf8(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return docs.select(F.col(f"`{key}`").alias("key"), whole.alias("text")).select("key", F.xxhash64("text").alias("h"), "text")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_chars and fingerprint of every text: one pass over the table, no shuffle."""
    rows = _texts(docs, text, key).select("key", "text")

    @tb.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in _chunks(b.column(1)):
                t = b.column(1).slice(lo, hi - lo)
                data, offsets = tb.buffers(t)
                n = tb.sums_by_row((data & 0xC0) != 0x80, offsets)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(hex_digits(paragraph_sums(t)))], names=["key", "n_chars", "fingerprint"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_chars long, fingerprint string").withColumnRenamed("key", key)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about a megabyte of text and 4,096 rows at most."""
    for lo, hi in tb.row_chunks(texts):
        for at in range(lo, hi, 4096):
            yield at, min(at + 4096, hi)


def _order(key: object, h: int) -> tuple:
    return (key is not None, key, h)


def in_ranges(rows: DataFrame) -> tuple[DataFrame, int]:
    """(range, closing, key, h, text): the rows dealt into ranges of (key, h), each closed by the first row of the next, the last by the first of all; and how many ranges.

    The driver holds one key a range: about one for each RANGE_BYTES of text.
    """
    spark = rows.sparkSession
    keys = stored(rows.select("key", "h", F.octet_length("text").cast("long").alias("bytes")), "multiset-keys")
    size = keys.agg(F.sum("bytes")).first()[0] or 0
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    dealt = keys.repartitionByRange(most, F.asc_nulls_first("key"), F.asc("h")).groupBy(F.spark_partition_id().alias("p"))
    firsts = dealt.agg(F.min(F.struct("key", "h")).alias("first")).select("first.*").collect()
    discard(keys)
    firsts = sorted({_order(r["key"], r["h"]) for r in firsts})
    bounds = spark.sparkContext.broadcast(firsts[1:])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = bounds.value
        for b in batches:
            at = [bisect.bisect_right(ranges, _order(k, h)) for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([False] * len(at)), *b.columns], names=["range", "closing", "key", "h", "text"])

    kind = rows.schema["key"].dataType.simpleString()
    table = spark.createDataFrame([((i - 1) % len(firsts), k, h) for i, (_, k, h) in enumerate(firsts)], f"range int, key {kind}, h long") if firsts else None
    out = rows.mapInArrow(deal, f"range int, closing boolean, key {kind}, h long, text string")
    if table is not None:
        first = rows.alias("r").join(F.broadcast(table).alias("b"), F.col("r.key").eqNullSafe(F.col("b.key")) & (F.col("r.h") == F.col("b.h")))
        out = out.unionByName(first.groupBy("b.range").agg(F.min("r.text").alias("text")).select("range", F.lit(True).alias("closing"), F.lit(None).cast(kind).alias("key"), F.lit(0).cast("long").alias("h"), "text"))
    return out, max(1, len(firsts))


def edited(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next text.
    """
    rows = _texts(docs, text, key)
    kind = rows.schema["key"].dataType.simpleString()
    ranged, ranges = in_ranges(rows)

    @tb.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far that waits for the next one: key, text, fingerprint
        for b in batches:
            for lo, hi in _chunks(b.column(2)):
                part = b.slice(lo, hi - lo)
                fp, texts = paragraph_sums(part.column(2)), part.column(2).to_pylist()
                keys, closing = part.column(1), part.column(0).to_pylist()
                if held is not None:
                    texts, closing = [held[1], *texts], [False, *closing]
                    keys = pa.concat_arrays([held[0], keys])
                    fp = np.vstack([held[2][0], fp[0]]), np.vstack([held[2][1], fp[1]])
                last = len(texts) - 1
                held = None if closing[last] else (keys.slice(last), texts[last], (fp[0][last:], fp[1][last:]))
                at = np.array([i for i in range(last) if not closing[i]], np.int64)
                if not len(at):
                    continue
                new, gone, come = zip(*(changed(texts[i], texts[i + 1]) for i in at), strict=True)
                own, following = (fp[0][at], fp[1][at]), (fp[0][at + 1], fp[1][at + 1])
                after = plus(minus(own, paragraph_sums(pa.array(gone, pa.large_string()))), paragraph_sums(pa.array(come, pa.large_string())))
                columns = [
                    keys.take(pa.array(at)),
                    pa.array([len(texts[i]) for i in at], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
                    pa.array(hex_digits(own)),
                    pa.array(hex_digits(after)),
                    pa.array(likeness(own, after)),
                    pa.array(likeness(own, following)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    # Each task has one range; the row that closes it comes last.
    ordered = ranged.repartitionById(ranges, "range").sortWithinPartitions("range", "closing", F.asc_nulls_first("key"), "h").select("closing", "key", "text")
    out = ordered.mapInArrow(run, f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("key", key)
