"""Benchmark decontamination by the q-gram lemma.

If a region of a text is within k edits of a benchmark item of m characters,
they share at least m - q + 1 - k*q character q-grams, and all of these lie on
neighbouring diagonals (text position minus item position).  So shared q-grams
are counted in diagonal bands that overlap by half, a band that reaches the
bound is kept, and its region is aligned with the item in a banded edit
distance of all kept bands at once.

The items come in blocks of bounded size; each block's q-gram index is
broadcast and all texts pass over it, so the items may be any number.  Texts
are never shuffled.  Letters are compared in lower case, white space as blanks.

Defined results: null and empty texts match nothing, null and empty items are
skipped; items shorter than q characters match where they occur exactly;
repeated rows and items are matched each by itself; extra columns do not
matter.  Texts of any length are searched whole, long ones in overlapping
parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import U64, frugal, row_chunks

_MULT = U64(0x9E3779B97F4A7C15)
_PAD = np.uint32(0xFFFFFFFF)
_fold: np.ndarray | None = None


@dataclass(frozen=True)
class EditBudget:
    """q: length of the q-grams; rate: edits allowed per item character; block_chars: items in one broadcast index."""

    q: int = 8
    rate: float = 0.08
    block_chars: int = 2_000_000
    part_chars: int = 1 << 19

    def edits(self, m: int) -> int:
        """k for an item of m characters: rate * m, lowered until the lemma still asks for two q-grams."""
        return max(0, min(int(self.rate * m), (m - self.q + 1 - 2) // self.q))


def folded(text: str) -> np.ndarray:
    """Code points of text, one for one, lower-cased and with blanks for white space."""
    global _fold
    if _fold is None:
        table = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x20000):
            low = chr(c).lower()
            if len(low) == 1 and not 0xD800 <= c < 0xE000:
                table[c] = ord(low)
        table[[9, 10, 11, 12, 13, 0xA0]] = 32
        _fold = table
    return _fold[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of each q-gram."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    h, have = codes.astype(np.uint64), 1
    power = int(_MULT)
    for bit in bin(q)[3:]:
        h = h[: len(h) - have] * U64(power) + h[have:]
        have, power = have * 2, power * power % 2**64
        if bit == "1":
            h = h[:-1] * _MULT + codes[have:].astype(np.uint64)[: len(h) - 1]
            have, power = have + 1, power * int(_MULT) % 2**64
    return h * _MULT


@dataclass
class GramIndex:
    """Postings of all q-grams of a block of items."""

    budget: EditBudget
    ids: np.ndarray
    items: list[np.ndarray]
    size: np.ndarray = field(init=False)
    edits: np.ndarray = field(init=False)
    bound: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        q = self.budget.q
        self.size = np.array([len(x) for x in self.items], np.int64)
        self.edits = np.array([self.budget.edits(m) for m in self.size], np.int64)
        self.bound = self.size - q + 1 - self.edits * q
        h = [_grams(x, q) for x in self.items]
        item = np.repeat(np.arange(len(h)), [len(x) for x in h])
        spot = np.concatenate([np.arange(len(x)) for x in h]) if h else np.zeros(0, np.int64)
        every = np.concatenate(h) if h else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.item, self.spot = item[order].astype(np.int32), spot[order].astype(np.int32)
        self.gram, self.first = np.unique(every[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(every)))
        self.bits = max(16, min(26, int(len(self.gram) * 16).bit_length()))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.gram)] = True
        long = self.size >= q
        self.reach = int((self.size + self.edits)[long].max()) if long.any() else 0
        self.least = int(self.bound[long].min()) if long.any() else 0
        self.short = [i for i in range(len(self.items)) if 0 < self.size[i] < q]

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - self.bits)).astype(np.int64)

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text position, item, item position) of shared q-grams, where at least the least bound lies close together."""
        h = _grams(codes, self.budget.q)
        at = np.flatnonzero(self.seen[self._slot(h)])
        if len(at) >= self.least:
            at = _dense(at, self.reach, self.least)
        if not len(at) or not len(self.gram):
            z = np.zeros(0, np.int64)
            return z, z, z
        known = np.minimum(np.searchsorted(self.gram, h[at]), len(self.gram) - 1)
        true = self.gram[known] == h[at]
        at, known = at[true], known[true]
        at, known = (x[keep] for keep in [_dense_mask(at, self.reach, self.least)] for x in (at, known))
        n = self.count[known]
        post = np.repeat(self.first[known] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[post].astype(np.int64), self.spot[post].astype(np.int64)


def _dense_mask(at: np.ndarray, reach: int, least: int) -> np.ndarray:
    """Which of the ascending positions lie with least-1 others in some stretch of reach."""
    n = len(at)
    if n < least:
        return np.zeros(n, bool)
    full = at[least - 1 :] - at[: n - least + 1] <= reach
    edge = np.zeros(n + 1, np.int64)
    start = np.flatnonzero(full)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + least, -1)
    return np.cumsum(edge[:-1]) > 0


def _dense(at: np.ndarray, reach: int, least: int) -> np.ndarray:
    return at[_dense_mask(at, reach, least)]


def _align(codes: np.ndarray, lo: np.ndarray, begin: np.ndarray, stop: np.ndarray, items: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edits, start and end of the best region of each (band, item); band i has the diagonals lo[i] .. lo[i]+width-1, its region lies in begin[i] .. stop[i]."""
    n = len(lo)
    size = np.array([len(x) for x in items])
    m = int(size.max())
    pattern = np.full((n, m), _PAD - 1, np.uint32)
    for i, x in enumerate(items):
        pattern[i, : len(x)] = x
    one, never = np.int64(1) << 32, np.int64(1) << 60
    step = np.arange(width, dtype=np.int64)
    spot = lo[:, None] + step[None, :]
    first, last = begin[:, None], stop[:, None]
    cost = np.where(spot >= first, step, never)  # low part: the diagonal where the region starts
    best, where = np.full(n, never, np.int64), np.zeros(n, np.int64)
    for i in range(m + 1):
        done = np.flatnonzero(size == i)
        if len(done):
            ends = np.where(spot[done] + i <= last[done], cost[done], never)
            where[done] = ends.argmin(axis=1)
            best[done] = ends[np.arange(len(done)), where[done]]
        if i == m:
            break
        text = spot + i
        inside = (text >= first) & (text < last)
        same = inside & (codes[np.where(inside, text, 0)] == pattern[:, i : i + 1])
        new = np.where(inside, cost + np.where(same, 0, one), never)
        np.minimum(new[:, :-1], cost[:, 1:] + one, out=new[:, :-1])
        new -= step * one
        np.minimum.accumulate(new, axis=1, out=new)
        cost = new + step * one
    return best >> 32, lo + (best & (one - 1)), lo + where + size


def find_items(codes: np.ndarray, begin: np.ndarray, stop: np.ndarray, index: GramIndex) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, start, end) of every item found; row i is codes[begin[i]:stop[i]], positions are within the row."""
    at, item, spot = index.hits(codes)
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    if len(at):
        half = index.edits[item] + 1
        row = np.searchsorted(begin, at, "right") - 1
        diagonal = at - spot
        # Each q-gram counts in the two bands over its diagonal, with those of its row only.
        keys = np.concatenate([np.stack([row, item, diagonal // half - shift]) for shift in (0, 1)], axis=1)
        keys = keys[:, np.lexsort(keys[::-1])]
        edge = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        count = np.diff(np.append(edge, keys.shape[1]))
        keep = count >= index.bound[keys[1, edge]]
        rows, which, band = keys[:, edge[keep]]
        half = index.edits[which] + 1
        for k in np.unique(index.edits[which]):  # bands of equal width are aligned together
            g = np.flatnonzero(index.edits[which] == k)
            cells = max(int(index.size[which[g]].max()), 16 * (int(k) + 1))
            for part in np.array_split(g, max(1, len(g) * cells // 500_000)):
                if not len(part):
                    continue
                edits, start, end = _align(codes, band[part] * half[part], begin[rows[part]], stop[rows[part]], [index.items[i] for i in which[part]], int(2 * (k + 1)))
                for r, i, e, s, z in zip(rows[part].tolist(), which[part].tolist(), edits.tolist(), start.tolist(), end.tolist(), strict=True):
                    if e <= k and s < z:
                        value = (e, int(s - begin[r]), int(z - begin[r]))
                        found[r, i] = min(found.get((r, i), value), value)
    if index.short:
        for row in range(len(begin)):
            text = codes[begin[row] : stop[row]].astype("<u4").tobytes()
            for i in index.short:
                want, p = index.items[i].astype("<u4").tobytes(), -1
                while (p := text.find(want, p + 1)) >= 0 and p % 4:
                    pass
                if p >= 0:
                    found[row, i] = (0, p // 4, p // 4 + len(index.items[i]))
    return [(r, i, *v) for (r, i), v in sorted(found.items())]


def match_batch(texts: pa.Array, index: GramIndex) -> list[tuple[int, int, int, int, int]]:
    """find_items over all rows of a batch."""
    out = []
    part, lap = index.budget.part_chars, 2 * index.reach + 64
    for lo, hi in row_chunks(texts, index.budget.part_chars):
        rows = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
        if len(rows) == 1 and len(rows[0]) > part + lap:
            best: dict[int, tuple] = {}
            for p in range(0, len(rows[0]), part):
                codes = folded(rows[0][p : p + part + lap])
                for _, i, e, s, z in find_items(codes, np.array([0]), np.array([len(codes)]), index):
                    best[i] = min(best.get(i, (e, s + p, z + p)), (e, s + p, z + p))
            out += [(lo, i, *v) for i, v in sorted(best.items())]
            continue
        # A pad apart, so no q-gram of an item spans two rows.
        ends = np.cumsum([len(t) + 1 for t in rows])
        codes = folded("\uffff".join(rows) + "\uffff")
        begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        out += [(r + lo, i, e, s, z) for r, i, e, s, z in find_items(codes, begin, ends - 1, index)]
    return out


def item_blocks(bench: DataFrame, budget: EditBudget, key: str, text: str) -> Iterator[GramIndex]:
    """The items as indexes of about block_chars characters each."""
    kind = item_kind(bench, key)
    items = bench.select(F.col(key).cast(kind).alias("id"), F.col(text).alias("text")).filter(F.length("text") > 0)
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // budget.block_chars)
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        rows = sorted(part.collect(), key=lambda r: (r.id is None, r.id or (0 if kind == "long" else ""), r.text))
        ids = [-1 if r.id is None and kind == "long" else r.id for r in rows]
        yield GramIndex(budget, np.array(ids, np.int64 if kind == "long" else object), [folded(r.text) for r in rows])


def item_kind(bench: DataFrame, key: str) -> str:
    """Type of the items' ids in results: long for whole numbers, else string."""
    return "long" if bench.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"


def contamination(docs: DataFrame, bench: DataFrame, budget: EditBudget | None = None, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per text and item found in it: key, item_id, edits, start, end (code points, the best region)."""
    budget = budget or EditBudget()
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    kind = item_kind(bench, item_key)
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, item_id {kind}, edits int, start long, end long"
    result = None
    for index in item_blocks(bench, budget, item_key, item_text):
        shared = spark.sparkContext.broadcast(index)

        @frugal
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                hit = match_batch(b.column(1), index)
                if hit:
                    row, item, edits, start, end = (np.array(x) for x in zip(*hit, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(row)), pa.array(index.ids[item], pa.int64() if kind == "long" else pa.string()), pa.array(edits.astype(np.int32)), pa.array(start), pa.array(end)],
                        names=[key, "item_id", "edits", "start", "end"],
                    )

        part = rows.mapInArrow(run, schema)
        result = part if result is None else result.unionByName(part)
    return spark.createDataFrame([], schema) if result is None else result


def decontaminated(docs: DataFrame, bench: DataFrame, budget: EditBudget | None = None, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs in which no item is found, with all their columns."""
    budget = budget or EditBudget()
    kept, schema, at = docs, docs.schema, docs.columns.index(text)
    for index in item_blocks(bench, budget, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @frugal
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[x[0] for x in match_batch(b.column(at), shared.value)]] = False
                yield b.filter(pa.array(clean))

        kept = kept.mapInArrow(run, schema)
    return kept
