"""Token counts by a unigram segmentation over a trie of distinct pre-tokens.

A pre-token is a word with one blank before it, as bytes.  Its segmentation is
the one with the highest sum of piece scores; ties go to the longer last
piece.  The forward score of a position depends on the prefix up to there
only, so distinct pre-tokens are sorted, which makes them a trie (a node is a
prefix that the row before does not share), and each node is computed once,
all nodes of one depth together.  Terminal counts are kept by word hash, so a
word met again costs a lookup.  A word of over wide_word bytes is a path of its
own, computed from end to end with only the scores of the last positions kept.

The vocabulary is a public byte-level one (a parameter, never copied); its
file has ranks, from which scores follow by Zipf's law: -ln((rank + 1) * H).
All pieces are used.  All single bytes are pieces, so every text has a
segmentation.

Defined results: null and empty texts have no tokens; repeated rows count
each; words of any length are segmented whole; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

U64 = np.uint64
_B = U64(0xC6A4A7935BD1E995)
_B_INV = U64(pow(int(_B), -1, 2**64))
_M = U64(0x9E3779B97F4A7C15)
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@dataclass(frozen=True)
class TokenPlan:
    vocabulary: str = VOCABULARY
    wide_word: int = 512
    kept_words: int = 2_000_000


def read_pieces(plan: TokenPlan) -> dict[bytes, float]:
    with open(plan.vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    norm = math.log(len(ranks)) + 0.5772156649015329
    return {p: -math.log((r + 1) * norm) for p, r in ranks.items()}


def _hash_bytes(piece: bytes) -> int:
    h = 0
    for c in piece:
        h = (h * int(_B) + c + 1) % 2**64
    return h


class Pieces:
    """Scores of pieces by hash and length."""

    def __init__(self, scores: dict[bytes, float]):
        self.longest = max(map(len, scores))
        self.lengths = sorted({len(p) for p in scores}, reverse=True)
        self.by_length = {}
        for k in self.lengths:
            some = sorted((_hash_bytes(p), s) for p, s in scores.items() if len(p) == k)
            h = np.array([x for x, _ in some], np.uint64)
            shift = U64(64 - min(18, max(8, (16 * len(some)).bit_length())))
            seen = np.zeros(1 << (64 - int(shift)), bool)
            seen[((h * _M) >> shift).astype(np.int64)] = True
            self.by_length[k] = (h, np.array([x for _, x in some]), seen, shift)
        self.power = np.full(self.longest + 1, _B, np.uint64)
        self.power[0] = 1
        self.power = np.multiply.accumulate(self.power)

    def find(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that are pieces of k bytes, and their scores."""
        hashes, scores, seen, shift = self.by_length[k]
        at = np.flatnonzero(seen[((h * _M) >> shift).astype(np.int64)])
        if not len(at):
            return at, scores[:0]
        j = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
        true = hashes[j] == h[at]
        return at[true], scores[j[true]]


def segment_path(word: np.ndarray, pieces: Pieces, tile: int = 1 << 16) -> tuple[int, float]:
    """Pieces and score of the best segmentation of one word of any length."""
    n, first = len(word), 0
    best, count = [0.0], [0]  # of the positions from first on
    for t in range(0, n, tile):
        lo, hi = max(0, t - pieces.longest), min(n, t + tile)
        up, down = (np.multiply.accumulate(np.append(U64(1), np.full(hi - lo, base, np.uint64))) for base in (_B, _B_INV))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((word[lo:hi].astype(np.uint64) + U64(1)) * down[:-1], dtype=np.uint64)])
        ends, sizes, scores = [], [], []
        for k in pieces.lengths:
            begin = max(0, t + 1 - k - lo)  # of the first piece that ends behind t
            if begin + k <= hi - lo:
                at, score = pieces.find((total[begin + k :] - total[begin : len(total) - k]) * up[begin + k - 1 : -1], k)
                ends.append(at + begin + k + lo)
                sizes.append(np.full(len(at), k))
                scores.append(score)
        end, size, score = (np.concatenate(x) for x in (ends, sizes, scores))
        order = np.lexsort((-size, end))
        here, top, pick = t, 0.0, 0
        for e, k, s in zip(end[order].tolist(), size[order].tolist(), score[order].tolist(), strict=True):
            if e != here:
                if here > t:
                    best.append(top)
                    count.append(pick)
                here, top, pick = e, -math.inf, 0
            value = best[e - k - first] + s
            if value > top:
                top, pick = value, count[e - k - first] + 1
        best.append(top)
        count.append(pick)
        gone = max(0, len(best) - pieces.longest)
        best, count, first = best[gone:], count[gone:], first + gone
    return count[-1], best[-1]


def segment(matrix: np.ndarray, size: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and score of the best segmentation of each row's first size bytes."""
    n, width = matrix.shape
    order = np.argsort(np.ascontiguousarray(matrix).view(f"S{width}").ravel(), kind="stable")
    m, length = matrix[order], size[order]
    common = np.zeros(n, np.int64)
    if n > 1:
        unlike = m[1:] != m[:-1]
        first = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
        common[1:] = np.minimum(first, np.minimum(length[1:], length[:-1]))
    prefix = np.zeros((width + 1, n), np.uint64)
    best = np.full((width + 1, n), -np.inf)
    count = np.zeros((width + 1, n), np.int32)
    best[0] = 0
    place = np.arange(n)
    for d in range(1, width + 1):
        prefix[d] = prefix[d - 1] * _B + m[:, d - 1].astype(np.uint64) + U64(1)
        rows = np.flatnonzero((common < d) & (d <= length))
        top, pick = np.full(len(rows), -np.inf), np.zeros(len(rows), np.int32)
        for k in (k for k in pieces.lengths if k <= d):
            at, score = pieces.find(prefix[d][rows] - prefix[d - k][rows] * pieces.power[k], k)
            if len(at):
                value = best[d - k][rows[at]] + score
                better = value > top[at]
                at, value = at[better], value[better]
                top[at] = value
                pick[at] = count[d - k][rows[at]] + 1
        best[d][rows], count[d][rows] = top, pick
        source = np.maximum.accumulate(np.where(common < d, place, 0))
        best[d], count[d] = best[d][source], count[d][source]
    out_n, out_s = np.empty(n, np.int64), np.empty(n)
    out_n[order], out_s[order] = count[length, place], best[length, place]
    return out_n, out_s


class Counter:
    """Counts and scores of words, each computed once while it is kept."""

    def __init__(self, plan: TokenPlan, pieces: Pieces):
        self.plan, self.pieces = plan, pieces
        self.hash, self.n, self.score = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, first, inverse = np.unique(tb.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash, h), max(0, len(self.hash) - 1))
        new = np.flatnonzero(self.hash[at] != h) if len(self.hash) else np.arange(len(h))
        if len(new):
            n, score = self._segment(data, starts[first[new]], ends[first[new]])
            if len(self.hash) > self.plan.kept_words:
                self.hash, self.n, self.score = self.hash[:0], self.n[:0], self.score[:0]
                return self.__call__(data, starts, ends) if len(new) < len(h) else self._keep(h[new], n, score, h, inverse)
            return self._keep(h[new], n, score, h, inverse)
        return self.n[at][inverse], self.score[at][inverse]

    def _keep(self, new: np.ndarray, n: np.ndarray, score: np.ndarray, h: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate([self.hash, new])
        order = np.argsort(every)
        self.hash = every[order]
        self.n, self.score = np.concatenate([self.n, n])[order], np.concatenate([self.score, score])[order]
        at = np.searchsorted(self.hash, h)
        return self.n[at][inverse], self.score[at][inverse]

    def _segment(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = ends - starts
        n, score = np.zeros(len(size), np.int64), np.zeros(len(size))
        for i in np.flatnonzero(size > self.plan.wide_word).tolist():
            n[i], score[i] = segment_path(np.append(np.uint8(32), data[starts[i] : ends[i]]), self.pieces)
        low, width = 0, 8
        while low < min(size.max() if len(size) else 0, self.plan.wide_word):
            group = np.flatnonzero((size > low) & (size <= width))
            for part in np.array_split(group, max(1, len(group) * width // 4_000_000)):
                if len(part):
                    at = starts[part][:, None] + np.arange(width)
                    inside = np.arange(width) < size[part][:, None]
                    m = np.zeros((len(part), width + 1), np.uint8)
                    m[:, 0] = 32
                    m[:, 1:] = np.where(inside, data[np.minimum(at, len(data) - 1)], 0)
                    n[part], score[part] = segment(m, size[part] + 1, self.pieces)
            low, width = width, width * 2
        return n, score


def token_counts(docs: DataFrame, plan: TokenPlan | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, n_pretokens, n_tokens, log_score (natural log)."""
    plan = plan or TokenPlan()
    pieces = Pieces(read_pieces(plan))
    # The vocabulary has a fixed size.
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(plan, shared.value)
        for b in batches:
            for lo, hi in tb.row_chunks(b.column(1), 1 << 22):
                data, offsets = tb.buffers(b.column(1).slice(lo, hi - lo))
                starts, ends, wo = tb.words(data, offsets)
                n, score = counter(data, starts, ends)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.diff(wo).astype(np.int64)), pa.array(tb.sums_by_row(n, wo)), pa.array(np.add.reduceat(np.append(score, 0.0), wo[:-1]) * (np.diff(wo) > 0))],
                    names=[key, "n_pretokens", "n_tokens", "log_score"],
                )

    rows = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, n_pretokens long, n_tokens long, log_score double")
