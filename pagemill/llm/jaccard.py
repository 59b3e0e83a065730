"""Exact Jaccard self-join of word n-gram sets by a size-aware heavy-light join.

Sets with equal elements are one class.  Classes meet through keys:

* light sets (at most `boundary` elements) enumerate subsets: two sets that
  are similar share a subset of a size that follows from their sizes, so each
  light set emits all its subsets of those sizes as keys;
* heavy sets scan inverted lists: each emits its first n - ceil(t*n) + 1
  elements in one global order, and two similar sets share one of them.  Light
  sets that are large enough to be similar to a heavy one do so as well.

The boundary is the size up to which enumerating costs less than scanning,
from the measured mean length of a list.  The global order puts frequent
elements last; which are frequent is counted over all texts.  That order is a
cost matter only: any order gives the same links.

A list of up to `small_list` classes yields its pairs at once.  From a longer
one, each class is first paired with two neighbours by size.  In a few rounds
each class is verified against its likeliest partner outside its component;
after that only pairs across components remain, those of long lists compared
in blocks.  Parity sketches, of at least two bits an element, bound the
difference of two sets from below and rule out most pairs that do not link.
So a group of thousands of near copies costs a few links a member.  Every pair
that passes is verified on the exact sets.  No candidate is dropped otherwise.

Defined results: null, empty and word-less texts have no shingles and link
with nothing (their component is their own id); texts with fewer words than n
have their whole sequence as one shingle; a row without id gets its set size
and no component, and links nothing; repeated rows are copies; rows that share
an id but not their text are separate nodes; ids are of any type that has an
order.  Elements are 52-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .names import free_name, row_hash
from .storage import discard, stored

U64 = np.uint64
_MASK = U64((1 << 52) - 1)
_HOT, _SUBSET, _SALT, _SALTED = 52, 53, 54, 62
_BARE = (1 << 54) - 1


@dataclass(frozen=True)
class JaccardPlan:
    """words: n of the n-grams; percent: links have 100 * intersection >= percent * union."""

    words: int = 4
    percent: int = 85
    small_list: int = 16
    frequent: int = 4
    frequent_kept: int = 1 << 20
    salt_from: int = 2048
    block: int = 1024
    counted_at_once: int = 1 << 21
    most_enumerated: int = 24
    broadcast_rows: int = 200_000
    rounds: int = 3
    carried_keys: int = 64

    def overlap(self, a: int, b: int) -> int:
        """Least intersection of linked sets with a and b elements."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def least_partner(self, n: int) -> int:
        return -(-self.percent * n // 100)


@dataclass
class Sets:
    """Distinct shingles of a chunk of rows, each row's in the global order."""

    offsets: np.ndarray
    codes: np.ndarray  # 52-bit hashes
    hot: np.ndarray


class Frequent:
    """The frequent shingles and their counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.counts = codes[order].astype(np.uint64), counts[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.codes >> U64(30)).astype(np.int64)] = True

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.seen[(codes >> U64(30)).astype(np.int64)])
        if not len(at) or not len(self.codes):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        true = self.codes[k] == codes[at]
        return at[true], self.counts[k[true]]


NONE = Frequent(np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingle_sets(texts: pa.Array, plan: JaccardPlan, frequent: Frequent) -> Sets:
    """Sets of at most 2048 rows."""
    data, offsets = tb.buffers(texts)
    data = tb.lower_ascii(data)
    starts, ends, wo = tb.words(data, offsets)
    h = tb.span_hashes(data, starts, ends)
    rows = tb.row_numbers(wo)
    n, count = plan.words, np.diff(wo)
    spot, value = [], []
    full = tb.windows(h, n)
    if len(full):
        inside = rows[: len(full)] == rows[n - 1 :]
        spot.append(rows[: len(full)][inside])
        value.append(full[inside])
    for k in range(1, n):
        few = np.flatnonzero(count == k)
        if len(few):
            v = np.full(len(few), k, np.uint64)
            for j in range(k):
                v = tb.mix(v + h[wo[few] + j])
            spot.append(few)
            value.append(v)
    rows = np.concatenate(spot) if spot else np.zeros(0, np.int64)
    codes = (np.concatenate(value) if value else np.zeros(0, np.uint64)) & _MASK
    key = (rows.astype(np.uint64) << U64(53)) | codes
    at, _ = frequent(codes)
    key[at] |= U64(1 << _HOT)
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    edge = np.searchsorted(key >> U64(53), np.arange(len(texts) + 1, dtype=np.uint64))
    return Sets(edge, key & _MASK, (key >> U64(_HOT)) & U64(1) == 1)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    for lo, hi in tb.row_chunks(texts):
        for a in range(lo, hi, 2048):
            yield a, min(a + 2048, hi)


def _wrapped_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def fingerprints(s: Sets) -> np.ndarray:
    """One number per set, from its elements in any order."""
    n = np.diff(s.offsets).astype(np.uint64)
    return tb.mix(_wrapped_sums(tb.mix(s.codes), s.offsets) + n * U64(0x9E3779B97F4A7C15)).view(np.int64)


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the sketch of a set of n elements: a power of two, at least 2 * n."""
    return np.left_shift(1, np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64))


def sketches(s: Sets, wanted: np.ndarray) -> list[bytes | None]:
    """Parity bits of each wanted set: sets with d unequal elements differ in d bits at most.

    Bit i is the parity of the elements that are i modulo the number of bits, so a sketch folds to half its bits by
    XOR of its halves, and sets of unlike sizes stay comparable.
    """
    n = np.diff(s.offsets)
    bits = sketch_bits(n)
    out: list[bytes | None] = [None] * len(n)
    for size in np.unique(bits[wanted]):
        g = np.flatnonzero((bits == size) & wanted)
        for part in np.array_split(g, max(1, len(g) * int(size) >> 20)):
            if len(part):
                at = np.repeat(s.offsets[part], n[part]) + np.arange(n[part].sum()) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                spot = np.repeat(np.arange(len(part)), n[part]) * size + (s.codes[at] & U64(size - 1)).astype(np.int64)
                odd = (np.bincount(spot, minlength=len(part) * size) & 1).astype(np.uint8).reshape(len(part), size)
                for i, row in zip(part.tolist(), np.packbits(odd, axis=1, bitorder="little"), strict=True):
                    out[i] = row.tobytes()
    return out


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of uint64 words) folded to so many words."""
    while sketch.shape[1] > words:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def subset_sizes(n: int, boundary: int, plan: JaccardPlan) -> list[int]:
    """Sizes of the subsets that a light set of n elements shares with similar light sets."""
    return sorted({plan.overlap(n, m) for m in range(plan.least_partner(n), min(boundary, 100 * n // plan.percent) + 1)})


def choose_boundary(mean_list: float, plan: JaccardPlan) -> int:
    """Largest size up to which a set's subsets are fewer than the list entries it would scan."""
    best = 0
    for n in range(1, plan.most_enumerated + 1):
        enumerate_cost = sum(math.comb(n, c) for c in subset_sizes(n, n, plan))
        scan_cost = (n - plan.least_partner(n) + 1) * mean_list
        if enumerate_cost > scan_cost:
            break
        best = n
    return max(best, 1)


def keys_of(s: Sets, plan: JaccardPlan, boundary: int, frequent: Frequent, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys; rows marked in skip emit none."""
    n = np.diff(s.offsets)
    rows = tb.row_numbers(s.offsets)
    nth = np.arange(len(rows)) - s.offsets[rows]
    lists = (n >= plan.least_partner(boundary + 1)) & ~skip
    take = np.flatnonzero(lists[rows] & (nth < (n - (-(-plan.percent * n // 100)) + 1)[rows]))
    key = s.codes[take] | (s.hot[take].astype(np.uint64) << U64(_HOT))
    hot = np.flatnonzero(s.hot[take])
    at, df = frequent(s.codes[take][hot])
    wide = df >= plan.salt_from
    at, df = hot[at[wide]], df[wide]
    if len(at):  # lists of this length are dealt over salts, by a hash of class and key
        salts = np.minimum(df // (plan.salt_from // 2), 256).astype(np.uint64)
        fp = fingerprints(s).view(np.uint64)
        salt = tb.mix(fp[rows[take][at]] ^ key[at]) % salts
        key[at] |= (salt << U64(_SALT)) | U64(1 << _SALTED)
    out_rows, out_keys = [rows[take]], [key]
    light = np.flatnonzero((n > 0) & (n <= boundary) & ~skip)
    for size in np.unique(n[light]):
        g = light[n[light] == size]
        element = tb.mix(s.codes[s.offsets[g][:, None] + np.arange(size)])
        total = element.sum(axis=1, dtype=np.uint64)
        for c in subset_sizes(int(size), boundary, plan):
            for gone in combinations(range(size), size - c):
                rest = total - element[:, list(gone)].sum(axis=1, dtype=np.uint64) if gone else total
                out_rows.append(g)
                out_keys.append((tb.mix(rest + np.full(1, c, np.uint64) * U64(0x9E3779B97F4A7C15)) & _MASK) | U64(1 << _SUBSET))
    return np.concatenate(out_rows), np.concatenate(out_keys).view(np.int64)


def count_frequent(texts: DataFrame, plan: JaccardPlan) -> tuple[Frequent, float]:
    """The most frequent shingles (a table of bounded size) and the mean length of a list, over all texts."""

    @tb.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
            codes = np.concatenate(parts)
            codes.sort()
            edge = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
            n = np.diff(np.append(edge, len(codes)))
            keep = n > 1
            return pa.RecordBatch.from_arrays([pa.array(np.append(codes[edge[keep]].view(np.int64), -1)), pa.array(np.append(n[keep], len(codes)))], names=["code", "n"])

        held, size = [], 0
        for b in batches:
            for lo, hi in chunks(b.column(0)):
                held.append(shingle_sets(b.column(0).slice(lo, hi - lo), plan, NONE).codes)
                size += len(held[-1])
                if size >= plan.counted_at_once:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    counts = stored(texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "jaccard-frequent")
    total = counts.filter("code = -1").agg(F.sum("n")).first()[0] or 0
    known = counts.filter(f"code <> -1 AND n >= {plan.frequent}")
    squares = known.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
    # The least count that stays, from a histogram: exact up to 4096, in steps of 1/64 octave from there.
    step = F.when(F.col("n") <= 4096, F.col("n").cast("double")).otherwise(F.floor(F.log2("n") * 64) + 4096.0 - 768.0)
    least, kept = None, 0
    for r in known.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("codes"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():
        kept += r["codes"]
        if kept > plan.frequent_kept:
            break
        least = r["n"]
    top = known.filter(F.col("n") >= least).toArrow() if least else None
    discard(counts)
    if top is None:
        return NONE, 1 + squares / max(1, total)
    return Frequent(top.column("code").to_numpy().view(np.uint64), top.column("n").to_numpy()), 1 + squares / max(1, total)


def describe(docs: DataFrame, plan: JaccardPlan, frequent: Frequent, boundary: int, key: str, text: str) -> DataFrame:
    """(doc_id, copy, n, fp, sketch, keys) of every row, stored; copy is a hash of the text; of equal sets in a batch, one that has an id has keys and sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    @tb.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for b in batches:
            done: set[int] = set()
            for lo, hi in chunks(b.column(1)):
                s = shingle_sets(b.column(1).slice(lo, hi - lo), plan, frequent)
                n, fp = np.diff(s.offsets), fingerprints(s)
                skip = np.ones(len(n), bool)
                named = np.flatnonzero(b.column(0).slice(lo, hi - lo).is_valid().to_numpy(zero_copy_only=False) & (n > 0))
                _, first = np.unique(fp[named], return_index=True)
                fresh = [i for i in named[first].tolist() if int(fp[i]) not in done]
                skip[fresh] = False
                done.update(fp[fresh].tolist())
                rows, keys = keys_of(s, plan, boundary, frequent, skip)
                order = np.argsort(rows, kind="stable")
                edge = np.searchsorted(rows[order], np.arange(len(n) + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(n), pa.array(fp), pa.array(sketches(s, ~skip), pa.binary()), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(keys[order]))],
                    names=["doc_id", "copy", "n", "fp", "sketch", "keys"],
                )

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("copy"))
    out = stored(rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, copy long, n long, fp long, sketch binary, keys array<long>"), "jaccard-described")
    shared.destroy()
    return out


def _close(key: np.ndarray, n: np.ndarray, fp: np.ndarray, plan: JaccardPlan, cut: bool) -> list[tuple[np.ndarray, ...]]:
    """Rows (key, x, nx, y, ny) of whole lists, sorted by (key, n, fp): pairs, and with y null the members of long lists."""
    once = np.append(True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1]))
    key, n, fp = key[once], n[once], fp[once]
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(edge, len(key)))
    group = np.repeat(np.arange(len(edge)), size)
    salted = (key >> _SALTED) & 1 == 1
    long = (size > plan.small_list)[group] | salted | cut
    out = []

    def pairs(i: np.ndarray, j: np.ndarray) -> None:
        ok = (100 * n[j] >= plan.percent * n[i]) & (i != j)
        i, j = i[ok], j[ok]
        out.append((key[i], fp[i], n[i], fp[j], n[j], np.ones(len(i), bool)))

    for d in range(1, plan.small_list):
        i = np.arange(d, len(key))
        i = i[(group[i] == group[i - d]) & (~long[i] | (d == 1))]
        if not len(i):
            break
        pairs(i, i - d)
    i = np.flatnonzero(long)
    if len(i):
        pairs(i, np.searchsorted(group * (1 << 40) + n, group[i] * (1 << 40) + -(-plan.percent * n[i] // 100)))
        out.append((key[i], fp[i], n[i], fp[i], n[i], np.zeros(len(i), bool)))
    return out


def meet(described: DataFrame, plan: JaccardPlan) -> DataFrame:
    """(key, x, nx, y, ny, pair): candidate pairs (pair true) and members of long lists (pair false)."""

    @tb.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        cut = False

        def batch_of(parts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["key", "x", "nx", "y", "ny", "pair"])

        for b in batches:
            held = [np.concatenate([a, c.to_numpy()]) for a, c in zip(held, b.columns, strict=True)]
            if not len(held[0]):
                continue
            stop = int(np.searchsorted(held[0], held[0][-1]))
            overfull = stop == 0 and len(held[0]) > 1 << 19
            if overfull:  # one list beyond a task's share: its parts are compared by blocks later on
                stop = len(held[0])
            if stop:
                parts = _close(*[a[:stop] for a in held], plan, cut or overfull)
                cut = overfull
                held = [a[stop:] for a in held]
                if parts:
                    yield batch_of(parts)
        if len(held[0]):
            parts = _close(*held, plan, cut)
            if parts:
                yield batch_of(parts)

    postings = described.select(F.explode("keys").alias("key"), "n", "fp")
    return postings.repartition("key").sortWithinPartitions("key", "n", "fp").mapInArrow(run, "key long, x long, nx long, y long, ny long, pair boolean")


def _compare_blocks(members: DataFrame, plan: JaccardPlan) -> DataFrame:
    """Pairs (x, y) of different components within one list that pass the size and bitmap bounds.

    members: (key, x, n, component, sketch).  A list's largest component is not compared with itself: its members are
    cut into blocks of about plan.block, the others too, and every block of others is compared in a task's memory with
    every block.  So a list of m near copies and few others costs some copies of m rows, not of m * m / plan.block.  Two
    sets often share many lists: each carries its smallest keys, and a pair is given by the list of the smallest key that
    both carry, or by any list where they carry none alike.
    """
    carried = members.groupBy("x").agg(F.slice(F.sort_array(F.collect_set("key")), 1, plan.carried_keys).alias("carried"))
    members = members.join(carried, "x")
    by_component = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    sizes = by_component.groupBy("key").agg(F.sum("m").alias("all"), F.max(F.struct("m", "component")).alias("top")).filter("all > top.m")

    def blocks(of: Column) -> Column:
        return F.ceil(of / plan.block).cast("int")

    sizes = sizes.select("key", F.col("top.component").alias("top"), blocks(F.col("top.m")).alias("top_blocks"), blocks(F.col("all") - F.col("top.m")).alias("blocks"))
    in_top, spot = F.col("component") == F.col("top"), F.xxhash64("x", F.lit(5))
    m = members.join(sizes, "key").withColumn("mine", F.when(in_top, F.col("blocks") + F.pmod(spot, F.col("top_blocks"))).otherwise(F.pmod(spot, F.col("blocks"))).cast("int"))
    last = F.when(in_top, F.col("blocks")).otherwise(F.col("blocks") + F.col("top_blocks")) - 1
    other = m.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    cell = other.withColumn("a", F.least("mine", "other")).withColumn("b", F.greatest("mine", "other"))

    def run(table: pa.Table) -> pa.Table:
        x, n, c = (table.column(k).to_numpy() for k in ("x", "n", "component"))
        mine, a, b = (table.column(k).to_numpy() for k in ("mine", "a", "b"))
        sketch = [v.as_py() for v in table.column("sketch")]
        here, carried = table.column("key")[0].as_py(), table.column("carried").combine_chunks()
        words = np.array([len(v) // 8 for v in sketch])
        left, right = np.flatnonzero(mine == a), np.flatnonzero(mine == b)
        xs, ys = [x[:0]], [x[:0]]
        # Sketches by width; a set and one similar to it differ by one width at most.
        by_width = {w: np.stack([np.frombuffer(sketch[i], np.uint64) for i in np.flatnonzero(words == w)]) for w in np.unique(words)}
        place = np.zeros(len(x), np.int64)
        for w in by_width:
            place[words == w] = np.arange((words == w).sum())
        for u in by_width:
            for v in (u // 2, u, 2 * u):
                if v not in by_width:
                    continue
                low = min(u, v)
                p_sketch, q_sketch = folded(by_width[u], low), folded(by_width[v], low)
                lu, rv = left[words[left] == u], right[words[right] == v]
                for part in np.array_split(lu, max(1, len(lu) * len(rv) // 200_000)):
                    p, q = n[part][:, None], n[rv][None, :]
                    ok = (c[part][:, None] != c[rv][None, :]) & (100 * np.minimum(p, q) >= plan.percent * np.maximum(p, q))
                    if a[0] == b[0]:
                        ok &= x[part][:, None] < x[rv][None, :]
                    i, j = np.nonzero(ok)
                    for at in np.array_split(np.arange(len(i)), max(1, len(i) * low // 500_000)):
                        s, t = part[i[at]], rv[j[at]]
                        need = -(-plan.percent * (n[s] + n[t]) // (100 + plan.percent))
                        unlike = np.bitwise_count(p_sketch[place[s]] ^ q_sketch[place[t]]).sum(axis=1)
                        near = np.flatnonzero(unlike <= n[s] + n[t] - 2 * need)
                        own = [min(set(carried[i].as_py()).intersection(carried[j].as_py()), default=here) == here for i, j in zip(s[near].tolist(), t[near].tolist(), strict=True)]
                        near = near[np.array(own, bool)]
                        xs.append(x[s[near]])
                        ys.append(x[t[near]])
        x, y = np.concatenate(xs), np.concatenate(ys)
        tb.release()
        return pa.table({"x": np.minimum(x, y), "y": np.maximum(x, y)})

    got = cell.select("key", "a", "b", "mine", "x", "n", "component", "sketch", "carried").groupBy("key", "a", "b").applyInArrow(run, "x long, y long")
    return got.distinct()


def _bounded(pairs: DataFrame, classes: DataFrame, plan: JaccardPlan) -> DataFrame:
    """pairs (x, nx, y, ny, keys) of classes whose sketches do not rule out a link, as (x, y, keys)."""

    @tb.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            nx, ny = b.column(3).to_numpy(), b.column(4).to_numpy()
            room = nx + ny - 2 * -(-plan.percent * (nx + ny) // (100 + plan.percent))
            for i, (p, q, most) in enumerate(zip(b.column(5), b.column(6), room.tolist(), strict=True)):
                p, q = p.as_py(), q.as_py()
                p, q = (p, q) if len(p) >= len(q) else (q, p)
                long, bits = int.from_bytes(p, "little"), 8 * len(q)
                if len(p) > len(q):
                    for k in range(len(p) // len(q) - 1, 0, -1):
                        long ^= (long >> (k * bits)) & ((1 << bits) - 1)
                    long &= (1 << bits) - 1
                keep[i] = (long ^ int.from_bytes(q, "little")).bit_count() <= most
            yield b.select([0, 1, 2]).filter(pa.array(keep))

    c = classes.select("fp", "sketch")
    both = pairs.join(c.toDF("x", "sx"), "x").join(c.toDF("y", "sy"), "y")
    return both.select("x", "y", "keys", "nx", "ny", "sx", "sy").mapInArrow(run, "x long, y long, keys long")


def _sets_of(docs: DataFrame, wanted: DataFrame, few: bool, plan: JaccardPlan, key: str, text: str) -> DataFrame:
    """(fp, set) of the wanted (rep, fp)."""

    @tb.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in chunks(b.column(1)):
                s = shingle_sets(b.column(1).slice(lo, hi - lo), plan, NONE)
                sets = pa.ListArray.from_arrays(pa.array(s.offsets.astype(np.int32)), pa.array(s.codes.view(np.int64)))
                same = pa.array(fingerprints(s) == b.column(0).slice(lo, hi - lo).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), sets], names=["fp", "set"]).filter(same)

    rows = docs.select(F.col(key).alias("rep"), F.col(text).alias("text")).join(F.broadcast(wanted) if few else wanted, "rep")
    return rows.select("fp", "text").mapInArrow(run, "fp long, set array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, plan: JaccardPlan, key: str, text: str) -> DataFrame:
    """(u, v) of the pairs (x, y of classes) that are linked, stored."""
    ids = pairs.select(F.col("x").alias("fp")).unionByName(pairs.select(F.col("y").alias("fp"))).distinct()
    wanted = stored(classes.join(ids, "fp", "left_semi").select("rep", "fp"), "jaccard-wanted")
    n = wanted.count()
    sets = stored(_sets_of(docs, wanted, n <= plan.broadcast_rows, plan, key, text), "jaccard-sets")
    # Rows repeated with id and text would verify a pair once for each.
    once = sets if sets.count() == n else sets.dropDuplicates(["fp"])
    a = once.select(F.col("fp").alias("x"), F.col("set").alias("p"))
    b = once.select(F.col("fp").alias("y"), F.col("set").alias("q"))
    both = F.size(F.array_intersect("p", "q"))
    linked = 100 * both >= plan.percent * (F.size("p") + F.size("q") - both)
    out = stored(pairs.join(a, "x").join(b, "y").filter(linked).select(F.col("x").alias("u"), F.col("y").alias("v")), "jaccard-links")
    discard(wanted, sets)
    return out


def _across(pairs: DataFrame, group: DataFrame) -> DataFrame:
    """pairs whose ends are in different components, with these as cx and cy."""
    gx, gy = group.toDF("x", "cx"), group.toDF("y", "cy")
    joined = pairs.join(gx, "x", "left").join(gy, "y", "left").withColumns({"cx": F.coalesce("cx", "x"), "cy": F.coalesce("cy", "y")})
    return joined.filter("cx <> cy")


def _likeliest(pairs: DataFrame) -> DataFrame:
    """For each class its pair with the most shared keys."""
    ends = pairs.select("x", "y", "keys", F.col("x").alias("of")).unionByName(pairs.select("x", "y", "keys", F.col("y").alias("of")))
    return ends.groupBy("of").agg(F.max(F.struct("keys", "x", "y")).alias("b")).select("b.x", "b.y").distinct()


def _components(docs: DataFrame, plan: JaccardPlan, key: str, text: str) -> DataFrame:
    """(key, copy, n, fp, label, component) per row of docs; a set is a node of the link graph, label names its component, whose smallest id is component."""
    spark = docs.sparkSession
    frequent, mean_list = count_frequent(docs.select(F.col(text).alias("text")), plan)
    boundary = choose_boundary(mean_list, plan)
    described = describe(docs, plan, frequent, boundary, key, text)
    alive = described.filter("n > 0 AND doc_id IS NOT NULL")
    classes = alive.groupBy("fp", "n").agg(F.min("doc_id").alias("rep"), F.max("sketch").alias("sketch"))
    classes = stored(classes, "jaccard-classes")
    met = stored(meet(alive, plan), "jaccard-met")

    # Pairs of classes, with the number of keys they share.
    low, high = (f(*(F.struct(F.col(v).alias("fp"), F.col(f"n{v}").alias("n")) for v in "xy")) for f in (F.least, F.greatest))
    found = met.filter("pair").select(low.alias("p"), high.alias("q"))
    found = found.groupBy("p", "q").agg(F.count(F.lit(1)).alias("keys")).select(F.col("p.fp").alias("x"), F.col("p.n").alias("nx"), F.col("q.fp").alias("y"), F.col("q.n").alias("ny"), "keys")
    pairs = stored(_bounded(found, classes, plan), "jaccard-pairs")

    # Each class is tried with its likeliest partner outside its component, a few times over.
    group = spark.createDataFrame([], "node long, component long")
    for _ in range(plan.rounds):
        tried = stored(_likeliest(pairs), "jaccard-tried")
        if tried.isEmpty():
            break
        old, group = group, _joined(group, _verified(tried, docs, classes, plan, key, text))
        left, pairs = pairs, stored(_across(pairs.join(tried, ["x", "y"], "left_anti"), group).select("x", "y", "keys"), "jaccard-pairs")
        discard(old, left, tried)

    # What is left: all pairs whose ends are still apart, and the members of long lists.
    members = met.filter("NOT pair").select(F.col("key").bitwiseAND(F.lit(_BARE)).alias("key"), F.col("x").alias("fp"), F.col("nx").alias("n")).distinct()
    members = members.join(classes.drop("n"), "fp").join(group.withColumnRenamed("node", "fp"), "fp", "left")
    members = members.select("key", F.col("fp").alias("x"), "n", F.coalesce("component", "fp").alias("component"), "sketch")
    more = _compare_blocks(members, plan)
    rest = stored(pairs.select("x", "y").unionByName(more).distinct(), "jaccard-open")
    discard(met, pairs)
    if not rest.isEmpty():
        old, group = group, _joined(group, _verified(rest, docs, classes, plan, key, text))
        discard(old)
    discard(rest)
    labelled = classes.join(group.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component"))
    named = stored(labelled.join(least, "label").select("fp", "label", "component"), "jaccard-named")
    discard(group, classes)
    return described.select("doc_id", "copy", "n", "fp").join(named, "fp", "left").select(F.col("doc_id").alias(key), "copy", "n", "fp", "label", "component")


def similar_components(docs: DataFrame, plan: JaccardPlan | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) per row of docs; component_id is the smallest id reachable by links."""
    rows = _components(docs, plan or JaccardPlan(), key, text)
    mine = F.when(F.col("n") == 0, F.col(key)).otherwise(F.when(F.col(key).isNotNull(), F.col("component")))
    return rows.select(key, F.col("n").alias("n_shingles"), mine.alias("component_id"))


def _joined(group: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after more links."""
    out = stored(components(group.toDF("u", "v").unionByName(links)), "jaccard-groups")
    discard(links)
    return out


def one_of_each(docs: DataFrame, plan: JaccardPlan | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: one with the smallest id, of those one with the smallest hash of its text and then of its row.

    Rows without id or shingles all stay.  Rows that share an id but are not linked are of different components.
    """
    copy = free_name(docs, "_copy")
    rows = _components(docs, plan or JaccardPlan(), key, text).select(F.col(key).alias("id"), F.col("copy"), "n", "label").filter(F.col("id").isNotNull())
    first = rows.filter("n > 0").groupBy("label").agg(F.min(F.struct("id", "copy")).alias("b")).select("b.id", "b.copy")
    bare = rows.filter("n = 0").select("id", "copy").distinct()
    again = stored(rows.filter("n > 0").groupBy("id", "copy").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").join(first, ["id", "copy"], "left_semi").select("id", "copy"), "jaccard-again")
    named = docs.withColumn(copy, F.xxhash64(text))

    kept = named.join(first.unionByName(bare).toDF(key, copy), [key, copy], "left_semi")
    if not again.isEmpty():  # rows repeated with id and text
        repeated = again.toDF(key, copy)
        once = kept.join(repeated, [key, copy], "left_semi").groupBy(F.col(key), F.col(copy)).agg(F.min_by(F.struct(*docs.columns), row_hash(docs)).alias("r"))
        kept = kept.join(repeated, [key, copy], "left_anti").select(*docs.columns).unionByName(once.select("r.*"))
    return kept.select(*docs.columns).unionByName(docs.filter(F.col(key).isNull()))
