"""Quality rules by compression bands.

A text is compressed whole and in fixed chunks with zstandard.  The ratio
(raw bytes / compressed bytes) of running prose rises slowly with length, so
each length band has its own lower and upper limit: above the upper one the
text repeats itself, below the lower one it looks random.  Chunks show the
same inside a long text whose whole ratio is still usual.

Defined results: a null or empty text has no words, so the word-count rule
rejects it.  Repeated rows and ties of doc_id are judged row by row.  Texts of
any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import textbytes as tb


@dataclass(frozen=True)
class CompressionBands:
    """Limits of the rule set.

    bands: (smallest length in bytes, lowest ratio, highest ratio) of whole texts, ascending.
    chunk_bytes: size of the fixed chunks; a tail under half of it joins no verdict.
    chunk_low, chunk_high: usual ratios of one chunk.
    bad_chunks: a text with more than this share of unusual chunks is rejected.
    min_words, max_repeat_percent: the word rules.
    """

    bands: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 2.0),
        (256, 1.05, 2.0),
        (512, 1.10, 2.1),
        (1024, 1.15, 2.25),
        (2048, 1.20, 2.32),
        (4096, 1.25, 2.45),
        (8192, 1.25, 2.58),
        (16384, 1.30, 2.75),
        (65536, 1.30, 3.2),
    )
    chunk_bytes: int = 1024
    chunk_low: float = 1.15
    chunk_high: float = 2.4
    bad_chunks: float = 0.25
    min_words: int = 50
    max_repeat_percent: int = 50
    level: int = 3


_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = 10

#: Columns that score_texts adds.
VERDICT_FIELDS = [
    ("n_words", "long"),
    ("word_chars", "long"),
    ("n_symbols", "long"),
    ("n_dup_lines", "long"),
    ("n_repeat_words", "long"),
    ("base_failed", "boolean"),
    ("kept", "boolean"),
    ("ratio", "double"),
    ("bad_chunk_share", "double"),
]


def _repeats(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (row, hash) pairs: whether it occurs twice or more in its row, and whether it occurred earlier there."""
    key = tb.mix(h + tb.mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    many, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:]] = same
    many[order[1:]] = same
    many[order[:-1]] |= same
    return many, later


def _line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all non-empty \\n-split lines."""
    breaks = np.flatnonzero(data == _NEWLINE)
    starts = np.union1d(offsets[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = ends - (data[ends - 1] == _NEWLINE)
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _ratios(data: np.ndarray, offsets: np.ndarray, cfg: CompressionBands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole ratio, share of unusual chunks and verdict of each row."""
    n = len(offsets) - 1
    packer = zstandard.ZstdCompressor(level=cfg.level, write_content_size=False)
    size = np.diff(offsets)
    ratio, bad, ok = np.ones(n), np.zeros(n), np.ones(n, bool)
    band = np.searchsorted([b[0] for b in cfg.bands], size, "right") - 1
    low = np.array([b[1] for b in cfg.bands])[band]
    high = np.array([b[2] for b in cfg.bands])[band]
    view = memoryview(data)
    step = cfg.chunk_bytes
    for i in range(n):
        a, z = int(offsets[i]), int(offsets[i + 1])
        if a == z:
            continue
        ratio[i] = (z - a) / len(packer.compress(view[a:z]))
        if z - a >= 2 * step:
            each = [min(step, z - p) / len(packer.compress(view[p : min(p + step, z)])) for p in range(a, z - step // 2, step)]
            bad[i] = sum(r < cfg.chunk_low or r > cfg.chunk_high for r in each) / len(each)
    ok = (ratio >= low) & (ratio <= high) & (bad <= cfg.bad_chunks)
    return ratio, bad, ok


def score_batch(texts: pa.Array, cfg: CompressionBands) -> dict[str, np.ndarray]:
    parts: list[dict[str, np.ndarray]] = []
    for lo, hi in tb.row_chunks(texts):
        data, offsets = tb.buffers(texts.slice(lo, hi - lo))
        n = hi - lo
        starts, ends, wo = tb.words(data, offsets)
        n_words = np.diff(wo)
        in_word = tb.sums_by_row(ends - starts, wo)
        tail_bytes = tb.sums_by_row((data & 0xC0) == 0x80, offsets)
        h = tb.span_hashes(data, starts, ends)
        rows = tb.row_numbers(wo)
        repeat = np.zeros(n, np.int64)
        if len(h) >= 3:
            tri = tb.windows(h, 3)
            inside = rows[:-2] == rows[2:]
            at = np.flatnonzero(inside)
            many, _ = _repeats(tri[at], rows[at])
            hit = np.zeros(len(h), bool)
            for k in range(3):
                hit[at[many] + k] = True
            repeat = tb.sums_by_row(hit, wo)
        ls, le, lrow = _line_spans(data, offsets)
        with_word = np.searchsorted(starts, le, "left") > np.searchsorted(starts, ls, "left")
        ls, le, lrow = ls[with_word], le[with_word], lrow[with_word]
        _, later = _repeats(tb.span_hashes(data, ls, le), lrow)
        ratio, bad, ok = _ratios(data, offsets, cfg)
        failed = (n_words < cfg.min_words) | (100 * repeat > cfg.max_repeat_percent * n_words)
        parts.append(
            {
                "n_words": n_words.astype(np.int64),
                "word_chars": in_word - tail_bytes,
                "n_symbols": tb.sums_by_row(_SYMBOL[data], offsets),
                "n_dup_lines": np.bincount(lrow[later], minlength=n).astype(np.int64),
                "n_repeat_words": repeat,
                "base_failed": failed,
                "kept": ~failed & ok,
                "ratio": ratio,
                "bad_chunk_share": bad,
            }
        )
    return {k: np.concatenate([p[k] for p in parts]) for k, _ in VERDICT_FIELDS} if parts else {}


def quality_rules(docs: DataFrame, cfg: CompressionBands | None = None, text: str = "text") -> DataFrame:
    """docs with the verdict columns and without the text.

    Columns of docs that bear a verdict column's name are replaced.
    """
    cfg = cfg or CompressionBands()
    named = {k for k, _ in VERDICT_FIELDS}
    rest = [f for f in docs.schema.fields if f.name not in named and f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"{k} {t}" for k, t in VERDICT_FIELDS])
    names = [f.name for f in rest]

    @tb.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = score_batch(b.column(len(names)), cfg)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(v[k]) for k, _ in VERDICT_FIELDS)], names=names + [k for k, _ in VERDICT_FIELDS])

    return docs.select(*[docs[c] for c in [*names, text]]).mapInArrow(run, schema)


def kept_documents(docs: DataFrame, cfg: CompressionBands | None = None, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns as they are."""
    cfg = cfg or CompressionBands()
    at = docs.columns.index(text)

    @tb.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(score_batch(b.column(at), cfg)["kept"]))

    return docs.mapInArrow(run, docs.schema)
