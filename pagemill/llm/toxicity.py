"""Toxicity: boosted trees over dense text features, with isotonic calibration.

The labelled training rows (at most train_rows, those of the rarer class first
and then the first by a hash of their id) are dealt into folds class by class,
in the order of another hash, so that each fold has its share of both.  A lexicon of words and word
beginnings with high log-odds is counted; the features of a fold's texts come
from the lexicon of the other folds, so words are weighed on texts that did
not suggest them.  The trees are grown on all folds but the last, on which
their margin is calibrated; scores then use the lexicon of all folds.  Inputs
of a score come from the text alone.

Defined results: a null text is empty and is scored like any text, from
features that are all 0; labels that are null or of unknown ids are not
learned from; an id labelled twice counts as toxic if either says so; without
labels of both kinds every score is the training rate (0 without labels);
repeated rows are scored each; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import boosting
from . import textbytes as tb

U64 = np.uint64

# Common insults, and words of the second person.
INSULTS = "idiot stupid moron loser trash scum pathetic disgusting worthless clown dumb fool jerk imbecile idiota imbécile crétin estúpido dummkopf trottel".split()
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie usted ustedes tú ti vosotros".split()


@dataclass(frozen=True)
class ToxicityPlan:
    """train_rows: most labelled rows learned from; lexicon_size: most lexicon entries, a bound on features; the others shape lexicon, features and folds."""

    train_rows: int = 24_000
    lexicon_size: int = 8_192
    least_toxic_docs: int = 3
    least_log_odds: float = 2.5
    prefix_lengths: tuple[int, ...] = (4, 5, 6)
    near: int = 5
    folds: int = 5
    trees: int = 80
    depth: int = 3
    threshold: float = 0.3


_CORE = np.zeros(256, bool)
_CORE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457@$!", b"oieastasi", strict=True):
    _LEET[_a] = _b


def _lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters, byte for byte."""
    out = tb.lower_ascii(data).copy()
    if len(out) > 1:
        tail = out[1:]
        tail[(data[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 0x20
    return out


@dataclass
class Parsed:
    """Words of a batch without their outer punctuation."""

    data: np.ndarray
    low: np.ndarray
    offsets: np.ndarray
    word_offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    core_starts: np.ndarray
    core_ends: np.ndarray
    rows: np.ndarray
    whole: np.ndarray
    prefixes: list[tuple[np.ndarray, np.ndarray]]  # word numbers and hashes, by length


def parse(data: np.ndarray, offsets: np.ndarray, plan: ToxicityPlan) -> Parsed:
    low = _lowered(data)
    starts, ends, wo = tb.words(data, offsets)
    core = np.flatnonzero(_CORE[data])
    a, z = np.searchsorted(core, starts), np.searchsorted(core, ends)
    some = z > a
    cs, ce = starts.copy(), starts.copy()
    cs[some], ce[some] = core[a[some]], core[z[some] - 1] + 1
    whole = tb.span_hashes(low, cs, ce)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    first, last = np.searchsorted(heads, cs), np.searchsorted(heads, ce)
    prefixes = []
    for k in plan.prefix_lengths:
        long = np.flatnonzero(last - first > k)
        prefixes.append((long, tb.span_hashes(low, cs[long], heads[first[long] + k]) ^ U64(k)))
    return Parsed(data, low, offsets, wo, starts, ends, cs, ce, tb.row_numbers(wo), whole, prefixes)


class Lexicon:
    """Weights of hashes, found fast."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order].astype(np.uint64), weights[order].astype(np.float64)
        self.seen = np.zeros(1 << 18, bool)
        self.seen[(self.hashes >> U64(46)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that are listed, and their weights."""
        at = np.flatnonzero(self.seen[(h >> U64(46)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return at[:0], np.zeros(0)
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        true = self.hashes[k] == h[at]
        return at[true], self.weights[k[true]]


def _given(words: list[str]) -> Lexicon:
    h = np.array([tb.hash_word(w.encode()) for w in words], np.uint64)
    return Lexicon(h, np.ones(len(h)))


FEATURES = [
    "log_words", "learned_rate", "learned_sum", "learned_max", "beginning_rate", "beginning_sum", "beginning_max", "insult_rate", "insults",
    "unmasked_insults", "second_person", "near_second_person", "capitals", "shouted", "signs", "exclaims", "questions", "digits_inside", "signs_inside", "word_length",
]


def features(p: Parsed, learned: Lexicon, plan: ToxicityPlan) -> np.ndarray:
    n = len(p.offsets) - 1
    words = np.diff(p.word_offsets).astype(float)
    chars = np.diff(p.offsets).astype(float)
    per_word, per_char = np.maximum(words, 1), np.maximum(chars, 1)
    out = np.zeros((n, len(FEATURES)))
    hit_words = []

    def add(column: int, at: np.ndarray, weight: np.ndarray) -> None:
        rows = p.rows[at]
        out[:, column] = np.bincount(rows, minlength=n) / per_word
        out[:, column + 1] = np.bincount(rows, weight, n)
        np.maximum.at(out[:, column + 2], rows, weight)

    at, weight = learned(p.whole)
    hit_words.append(at)
    add(1, at, weight)
    at, weight = (np.concatenate(x) for x in zip(*[(lambda a, w, long=long: (long[a], w))(*learned(h)) for long, h in p.prefixes], strict=True))
    hit_words.append(at)
    add(4, at, weight)
    insults = _given(INSULTS)
    at, _ = insults(p.whole)
    hit_words.append(at)
    out[:, 7] = np.bincount(p.rows[at], minlength=n) / per_word
    out[:, 8] = np.bincount(p.rows[at], minlength=n)
    size = p.core_ends - p.core_starts
    digits, signs = (np.concatenate([[0], np.cumsum(t[p.data])]) for t in (_DIGIT, _SIGN))
    letters = np.concatenate([[0], np.cumsum(_ALPHA[p.data])])
    inner_digits = digits[p.core_ends] - digits[p.core_starts]
    inner_signs = signs[p.core_ends] - signs[p.core_starts]
    inner_letters = letters[p.core_ends] - letters[p.core_starts]
    masked = np.flatnonzero((inner_digits + inner_signs > 0) & (inner_letters > 0) & (size < 40))
    if len(masked):
        plain = _LEET[p.low]
        at, _ = insults(tb.span_hashes(plain, p.core_starts[masked], p.core_ends[masked]))
        out[:, 9] = np.bincount(p.rows[masked[at]], minlength=n)
        hit_words.append(masked[at])
    second, _ = _given(SECOND_PERSON)(p.whole)
    out[:, 10] = np.bincount(p.rows[second], minlength=n) / per_word
    hits = np.unique(np.concatenate(hit_words)).astype(np.int64)
    if len(second) and len(hits):
        k = np.searchsorted(second, hits)
        gap = np.full(len(hits), np.inf)
        for other in (np.maximum(k - 1, 0), np.minimum(k, len(second) - 1)):
            same = p.rows[second[other]] == p.rows[hits]
            gap = np.where(same, np.minimum(gap, np.abs(second[other] - hits)), gap)
        out[:, 11] = np.bincount(p.rows[hits[gap <= plan.near]], minlength=n)
    uppers = np.concatenate([[0], np.cumsum(_UPPER[p.data])])
    out[:, 0] = np.log1p(words)
    out[:, 12] = (uppers[p.offsets[1:]] - uppers[p.offsets[:-1]]) / np.maximum(letters[p.offsets[1:]] - letters[p.offsets[:-1]], 1)
    shouted = (uppers[p.core_ends] - uppers[p.core_starts] == size) & (size > 2)
    out[:, 13] = tb.sums_by_row(shouted, p.word_offsets) / per_word
    out[:, 14] = (signs[p.offsets[1:]] - signs[p.offsets[:-1]]) / per_char
    for column, sign in ((15, 33), (16, 63)):
        out[:, column] = tb.sums_by_row(p.data == sign, p.offsets) / per_char
    out[:, 17] = np.bincount(p.rows[(inner_digits > 0) & (inner_letters > 0)], minlength=n) / per_word
    out[:, 18] = np.bincount(p.rows[(inner_signs > 0) & (inner_letters > 0)], minlength=n) / per_word
    out[:, 19] = tb.sums_by_row(size, p.word_offsets) / per_word
    return out


def batch_features(texts: pa.Array, learned: Lexicon, plan: ToxicityPlan) -> np.ndarray:
    parts = [features(parse(*tb.buffers(texts.slice(lo, hi - lo)), plan), learned, plan) for lo, hi in tb.row_chunks(texts, 1 << 21)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Model:
    plan: ToxicityPlan
    learned: Lexicon
    trees: boosting.Trees | None
    calibrate: boosting.Isotonic | None
    rate: float

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.rate)
        return np.clip(self.calibrate(self.trees.margin(batch_features(texts, self.learned, self.plan))), 0, 1)


def held_out(key: Column, of: int = 4, remainder: int = 2) -> Column:
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % of) == remainder


def fit(docs: DataFrame, labels: DataFrame, plan: ToxicityPlan, key: str, text: str, label: str) -> Model:
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter("key IS NOT NULL AND label IS NOT NULL")
    known = known.filter(~held_out(F.col("key"))).groupBy("key").agg(F.max("label").alias("label"))
    known = known.select("key", (F.col("label") == 1).cast("int").alias("label")).join(docs.select(F.col(key).alias("key")), "key", "left_semi")
    sides = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rare = int(sides.get(1, 0) <= sides.get(0, 0))
    # At least half of the rows go to the commoner class, or all it has.
    fewer = min(sides.get(rare, 0), max(plan.train_rows // 2, plan.train_rows - sides.get(1 - rare, 0)))
    bound = {rare: fewer, 1 - rare: plan.train_rows - fewer}
    parts = [known.filter(F.col("label") == side).orderBy(F.xxhash64("key", F.lit(1)), "key").limit(n) for side, n in bound.items()]
    chosen = parts[0].unionByName(parts[1])
    # train_rows bounds what is broadcast and numbered here.
    dealt = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("key", F.lit(2)), "key"))
    chosen = chosen.withColumn("fold", ((dealt - 1) % plan.folds).cast("int"))
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    # An id that several rows bear gives one text, so no more rows than chosen ids are learned from.
    rows = found.groupBy("key").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label", "fold")).alias("r")).select("key", "r.text", "r.label", "r.fold")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = 2 * b.column(2).to_numpy(zero_copy_only=False).astype(np.int64) + (b.column(1).to_numpy(zero_copy_only=False) == 1)
            for lo, hi in tb.row_chunks(b.column(0), 1 << 21):
                p = parse(*tb.buffers(b.column(0).slice(lo, hi - lo)), plan)
                spots = np.concatenate([p.rows, *[p.rows[long] for long, _ in p.prefixes]])
                h = np.concatenate([p.whole, *[x for _, x in p.prefixes]])
                once = np.unique(np.stack([h, spots.astype(np.uint64)], axis=1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
                cell = np.stack([once[:, 0], kind[lo + once[:, 1].astype(np.int64)].astype(np.uint64)], axis=1)
                cell, n = np.unique(cell, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell[:, 0].view(np.int64)), pa.array(cell[:, 1].astype(np.int32)), pa.array(n)], names=["h", "kind", "n"])

    spark = docs.sparkSession
    size = {r["label"]: r["n"] for r in rows.groupBy((F.col("label") == 1).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    # Of all labelled training rows, not only of those that are learned from.
    rate = sides.get(1, 0) / sum(sides.values()) if sides else 0.0
    empty = Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    if not (size.get(1, 0) and size.get(0, 0)):
        return Model(plan, empty, None, None, rate)
    cells = rows.select("text", "label", "fold").mapInArrow(count, "h long, kind int, n long").groupBy("h")
    counts = cells.agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(2 * plan.folds)])
    toxic, clean = (sum((F.col(f"n{2 * f + side}") for f in range(plan.folds)), F.lit(0)) for side in (1, 0))
    odds = F.log((F.col("toxic") + 0.5) / (size[1] + 1)) - F.log((F.col("clean") + 0.5) / (size[0] + 1))
    listed = counts.withColumns({"toxic": toxic, "clean": clean}).filter(F.col("toxic") >= plan.least_toxic_docs).withColumn("odds", odds)
    # A lexicon of bounded size is part of the model.
    lexicon = listed.filter(F.col("odds") >= plan.least_log_odds).orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "h").limit(plan.lexicon_size).toArrow()
    h = lexicon.column("h").to_numpy().view(np.uint64)
    each = np.stack([lexicon.column(f"n{k}").to_numpy() for k in range(2 * plan.folds)], axis=1)

    def lexicon_without(fold: int | None) -> Lexicon:
        use = [f for f in range(plan.folds) if f != fold]
        part = len(use) / plan.folds
        nt, nc = each[:, [2 * f + 1 for f in use]].sum(axis=1), each[:, [2 * f for f in use]].sum(axis=1)
        odds = np.log((nt + 0.5) / (size[1] * part + 1)) - np.log((nc + 0.5) / (size[0] * part + 1))
        keep = (nt >= plan.least_toxic_docs * part) & (odds >= plan.least_log_odds)
        return Lexicon(h[keep], odds[keep])

    shared = spark.sparkContext.broadcast(([lexicon_without(f) for f in range(plan.folds)], plan))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_fold, plan = shared.value
        for b in batches:
            fold = b.column(1).to_numpy(zero_copy_only=False)
            for f in np.unique(fold):
                part = b.filter(pa.array(fold == f))
                x = batch_features(part.column(2), by_fold[f], plan)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "fold", "x"])

    got = rows.select("label", "fold", "text").mapInArrow(measure, "label int, fold int, x array<double>").toArrow()
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y, fold = (got.column("label").to_numpy() == 1).astype(float), got.column("fold").to_numpy()
    grow, check = fold < plan.folds - 1, fold == plan.folds - 1
    if len(np.unique(y[check])) < 2:  # under one row a fold of a class
        check[:] = True
    trees = boosting.boost(x[grow], y[grow], plan.trees, plan.depth)
    calibrate = boosting.isotonic(trees.margin(x[check]), y[check])
    # Back from the shares of the classes among the chosen rows to those among all.
    up, down = (sides[side] / min(sides[side], bound[side]) for side in (1, 0))
    calibrate.value = calibrate.value * up / (calibrate.value * up + (1 - calibrate.value) * down)
    return Model(plan, lexicon_without(None), trees, calibrate, rate)


def toxicity(docs: DataFrame, labels: DataFrame, plan: ToxicityPlan | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Per row of docs: key, held_out, score, predicted."""
    plan = plan or ToxicityPlan()
    model = fit(docs, labels, plan, key, text, label)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = shared.value.score(b.column(2))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= plan.threshold).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    rows = docs.select(F.col(key).alias(key), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int")
