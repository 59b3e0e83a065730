"""LM scoring: a causal self-attention model on subword ids, and a word unigram base.

A token is a word or the end of a text.  A word's vector is the sum of the
embeddings of its subword ids.  From overlapping windows of such vectors the
network predicts the class of the next token: the most frequent words and the
end are classes of their own, the other words share classes by their first
subword id.  Which first ids go together follows from what stands before them
in the corpus, by k-means.  A token's probability is that of its class by the
network, times its share of the class by the smoothed counts of the corpus.
Each token is scored once, with at least half a window before it.

All training texts are counted, and the network learns from every window of
all of them, in rounds.  A round's texts are dealt by a hash into shards of
about shard_tokens tokens, each in an order of its own; one task goes over a
shard by Adam, and the weights and moments that come out are averaged by the number
of tokens learned from, for the next round to start with.  So what is learned
depends on the texts alone and not on files, splits or partitions, and a task's share
of it does not shrink as the table grows.

Base counts of the most frequent words are broadcast (a table of bounded
size); the other words of each text are joined with the full counts.

Defined results: a null text is empty and has one token, the end; repeated
rows are scored each; without training texts all counts are 0, every token is
in one class of its kind and the base is 0; texts and words of any length are
encoded and scored whole.  Rows that agree in key and text are in one shard.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention
from . import textbytes as tb
from .storage import stored
from .tokencount import VOCABULARY

LOG10 = float(np.log(10.0))
#: A word boundary as the public byte-level vocabularies cut text.
_SPLIT = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"

#: White space other than that which ends a word.
_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@dataclass(frozen=True)
class LmPlan:
    """own_inputs, shared_inputs: rows of the embedding for frequent ids by rank, and for the others by hash; own_classes, shared_classes: of words; batch, rate: of the learning; rounds: eighths of the texts in each; head_words: size of the broadcast count table."""

    vocabulary: str = VOCABULARY
    own_inputs: int = 4096
    shared_inputs: int = 1024
    contexts: int = 32
    own_classes: int = 31
    shared_classes: int = 32
    head_words: int = 1 << 18
    batch: int = 512
    rate: float = 4e-3
    rounds: tuple[int, ...] = (1, 2, 5)
    shard_tokens: int = 400_000
    kept_words: int = 600_000

    @property
    def inputs(self) -> int:
        return self.own_inputs + self.shared_inputs

    def row_of(self, ids: np.ndarray) -> np.ndarray:
        """Row of the embedding, and kind of a word that begins with this id."""
        return np.where(ids < self.own_inputs, ids, self.own_inputs + ids % self.shared_inputs)


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def read_ranks(plan: LmPlan) -> dict[bytes, int]:
    with open(plan.vocabulary, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Embedding rows of the subword ids of words; the first words met are kept, the others are encoded each time, all at once."""

    def __init__(self, plan: LmPlan, ranks: dict[bytes, int]):
        import tiktoken

        self.plan = plan
        self.bpe = tiktoken.Encoding("words", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.blank = np.zeros(max(ranks.values()) + 1, bool)
        self.blank[[r for p, r in ranks.items() if p.startswith(b" ")]] = True
        self.hashes, self.words = np.zeros(0, np.uint64), attention.Words(np.zeros(0, np.int64), np.zeros(1, np.int64))

    def ids_of(self, word: bytes) -> list[int]:
        return self.bpe.encode_ordinary(" " + word.decode("utf-8", "replace"))

    def _encode(self, words: list[bytes]) -> attention.Words:
        """A word is encoded behind a blank; as words hold none, the ids that begin with one tell where words begin."""
        text = b" ".join(words).decode("utf-8", "replace")
        odd = [i for i, x in enumerate(words) if _SPACE.search(x.decode("utf-8", "replace"))] if _SPACE.search(text) else []
        if odd:  # words that would run into the next one's blank
            lists = [self.ids_of(words[i]) for i in odd]
            plain = sorted(set(range(len(words))) - set(odd))
            rest = self._encode([words[i] for i in plain]) if plain else attention.Words(np.zeros(0, np.int64), np.zeros(1, np.int64))
            ids = np.concatenate([rest.ids, self.plan.row_of(np.array([i for x in lists for i in x], np.int64))])
            return attention.Words(ids, np.concatenate([rest.offsets, rest.offsets[-1] + np.cumsum([len(x) for x in lists])])).take(np.argsort(np.array(plain + odd)))
        ids = np.array(self.bpe.encode_ordinary(" " + text), np.int64)
        return attention.Words(self.plan.row_of(ids), np.append(np.flatnonzero(self.blank[ids]), len(ids)))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> attention.Words:
        """The words at these spans; hashes are theirs, ascending."""
        known = np.zeros(len(hashes), bool)
        if len(self.hashes):
            k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[k] == hashes
        new = np.flatnonzero(~known)
        if not len(new):
            return self.words.take(k)
        fresh = self._encode([data[a:z].tobytes() for a, z in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        if not len(self.hashes):
            both, place = fresh, np.arange(len(hashes))
        else:
            both = attention.Words(np.concatenate([self.words.ids, fresh.ids]), np.concatenate([self.words.offsets, self.words.offsets[-1] + fresh.offsets[1:]]))
            place = k.copy()
            place[new] = len(self.hashes) + np.arange(len(new))
        if len(self.hashes) < self.plan.kept_words:
            every = np.concatenate([self.hashes, hashes[new]])
            order = np.argsort(every, kind="stable")  # two sorted runs
            self.hashes, self.words = every[order], both.take(order)
        return both.take(place)


_encoders: dict[LmPlan, Encoder] = {}


def encoder_for(plan: LmPlan, ranks: Broadcast) -> Encoder:
    """The encoder of this worker, which keeps its words from task to task."""
    if plan not in _encoders:
        _encoders.clear()
        _encoders[plan] = Encoder(plan, ranks.value)
    return _encoders[plan]


@dataclass
class Encoded:
    """Of some rows: distinct words (hash, ids, kind by the first id), which of them stands at each place, and where each row's words begin."""

    hashes: np.ndarray
    words: attention.Words
    kind: np.ndarray
    at: np.ndarray
    word_offsets: np.ndarray

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the rows, each row with its end (-1) last, and their offsets."""
        offsets = self.word_offsets + np.arange(len(self.word_offsets))
        out = np.full(len(self.at) + len(offsets) - 1, -1, np.int64)
        keep = np.ones(len(out), bool)
        keep[offsets[1:] - 1] = False
        out[keep] = self.at
        return out, offsets


def encoded(texts: pa.Array, encoder: Encoder) -> Encoded:
    data, offsets = tb.buffers(texts)
    data = tb.lower_ascii(data)
    starts, ends, wo = tb.words(data, offsets)
    h, first, at = tb.distinct(tb.span_hashes(data, starts, ends))
    words = encoder(data, starts[first], ends[first], h)
    return Encoded(h, words, words.ids[words.offsets[:-1]] if len(h) else np.zeros(0, np.int64), at, wo)


def windows(tokens: np.ndarray, offsets: np.ndarray, s: attention.Shape, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, targets) of windows that have every token as target once: the tokens before each position (begin, and begin + 1 for padding), and places in tokens, -1 past the row's end."""
    n = np.diff(offsets)
    count = -(-n // s.scored)
    row = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    size, base = n[row][:, None], offsets[:-1][row][:, None]
    target = nth[:, None] * s.scored + np.arange(s.scored)
    target = np.where(target < size, target + base, -1)
    place = (nth * s.scored + s.scored - s.window)[:, None] + np.arange(s.window) - 1  # of the token before each position
    x = tokens[np.clip(place + base, 0, max(0, len(tokens) - 1))] if len(tokens) else place
    x = np.where((place >= 0) & (place < size - 1), x, begin + 1)
    x[place == -1] = begin
    return x, target


@dataclass
class Classes:
    """own: hashes of the words that are classes of their own, ascending, and own_class; by_kind: class of the other words; end: class of the end; size: log10 of a class's counts and words, what a shared class divides a count + 1 by."""

    own: np.ndarray
    own_class: np.ndarray
    by_kind: np.ndarray
    end: int
    size: np.ndarray

    def of(self, e: Encoded) -> np.ndarray:
        """Class of each distinct word."""
        out = self.by_kind[e.kind]
        if len(self.own):
            k = np.minimum(np.searchsorted(self.own, e.hashes), len(self.own) - 1)
            hit = self.own[k] == e.hashes
            out[hit] = self.own_class[k[hit]]
        return out


def grouped(profile: np.ndarray, mass: np.ndarray, groups: int, rounds: int = 20) -> np.ndarray:
    """k-means of the rows of profile by the square roots of their shares, weighed by mass; rows without mass go where most mass is."""
    some = np.flatnonzero(mass > 0)
    out = np.zeros(len(mass), np.int64)
    if not len(some):
        return out
    x = np.sqrt(profile[some] / np.maximum(profile[some].sum(axis=1, keepdims=True), 1))
    m = mass[some].astype(float)
    centers = [x[int(m.argmax())]]
    gap = ((x - centers[0]) ** 2).sum(axis=1)
    for _ in range(min(groups, len(some)) - 1):  # the next center is where most is left unexplained
        centers.append(x[int((gap * m).argmax())])
        gap = np.minimum(gap, ((x - centers[-1]) ** 2).sum(axis=1))
    c = np.array(centers)
    for _ in range(rounds):
        near = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(len(c)):
            mine = near == g
            if mine.any():
                c[g] = (x[mine] * m[mine, None]).sum(axis=0) / m[mine].sum()
    out[:] = np.bincount(near, m).argmax()
    out[some] = near
    return out


def build(plan: LmPlan, frequent: tuple[np.ndarray, np.ndarray, np.ndarray], by_kind: dict[int, tuple[int, int]], profile: np.ndarray, ends: int) -> tuple[Classes, np.ndarray]:
    """Classes and their starting bias, from the most frequent words (hash, count, kind), tokens and words of each kind, and what stands before kinds."""
    own, count, kind = (a[: plan.own_classes] for a in frequent)
    tokens, words = np.zeros(plan.inputs, np.int64), np.zeros(plan.inputs, np.int64)
    for k, (n, v) in by_kind.items():
        tokens[k], words[k] = n, v
    np.subtract.at(tokens, kind, count)
    np.subtract.at(words, kind, 1)
    group = plan.own_classes + grouped(profile, tokens, plan.shared_classes)
    end = plan.own_classes + plan.shared_classes
    mass, distinct = np.bincount(group, tokens, end + 1), np.bincount(group, words, end + 1)
    size = np.log10(mass + distinct + 1)
    total = mass.copy()
    total[: len(count)], total[end] = count, ends
    bias = np.log(total + 0.5) - np.log((total + 0.5).sum())
    order = np.argsort(own)
    return Classes(own[order], order, group, end, size), bias


class Model:
    def __init__(self, shape: attention.Shape, weights: attention.Weights, classes: Classes):
        self.shape, self.weights, self.classes = shape, weights, classes

    def class_logs(self, e: Encoded, step: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of the class of each token of the rows (ends included) by the network, the tokens' offsets, and the class of each distinct word."""
        tokens, offsets = e.tokens()
        mine = self.classes.of(e)
        goal = np.append(mine, self.classes.end)[tokens]
        x, target = windows(tokens, offsets, self.shape, len(e.words))
        vectors, each, blank = e.words.vectors(self.weights), np.zeros(target.shape, np.float32), x == len(e.words) + 1
        wanted = goal[np.maximum(target, 0)] if len(goal) else target
        for i in range(0, len(x), step):
            c = attention.forward(self.weights, self.shape, vectors.take(x[i : i + step], axis=0), blank[i : i + step])
            each[i : i + step] = attention.logs(c, wanted[i : i + step].ravel()).reshape(-1, self.shape.scored)
        out = np.zeros(len(tokens))
        out[target[target >= 0]] = each[target >= 0]
        return out / LOG10, offsets, mine


def starting(weights: attention.Weights) -> dict[str, np.ndarray]:
    """The state of a learning that begins: weights, their two moments and the number of steps."""
    zero = {f"{m} {k}": np.zeros_like(v) for k, v in weights.items() for m in ("first", "second")}
    return {f"weight {k}": v for k, v in weights.items()} | zero | {"step": np.zeros(1, np.float32)}


def weights_of(state: dict[str, np.ndarray], what: str = "weight") -> attention.Weights:
    return {k.partition(" ")[2]: v for k, v in state.items() if k.startswith(what + " ")}


def learned(rows: DataFrame, start: dict[str, np.ndarray], shape: attention.Shape, classes: Classes, plan: LmPlan, ranks: Broadcast, shards: int) -> tuple[dict[str, np.ndarray], int]:
    """The state after every window of all texts of rows (key, text, copy) in so many shards, averaged, and the number of tokens learned from."""
    shared = rows.sparkSession.sparkContext.broadcast((start, classes))
    pieces, fan = 64, 64
    whole = attention.Shape(shape.inputs, shape.classes, shape.width, shape.heads, shape.hidden, shape.window, shape.window)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tb.reuse_memory()
        start, classes = shared.value
        encoder, adam, seen = encoder_for(plan, ranks), attention.Adam(weights_of(start)), 0
        adam.first, adam.second = ({k: v.copy() for k, v in weights_of(start, m).items()} for m in ("first", "second"))
        adam.step = round(float(start["step"][0]))
        r = np.random.default_rng(7)
        for b in batches:
            for lo, hi in tb.row_chunks(b.column(0), 1 << 22):
                e = encoded(b.column(0).slice(lo, hi - lo), encoder)
                tokens, offsets = e.tokens()
                x, target = windows(tokens, offsets, whole, len(e.words))
                goal = np.append(np.append(classes.of(e), classes.end)[tokens], -1)[target]
                order, i = r.permutation(len(x)), 0
                while i < len(x):
                    pick = order[i : i + (plan.batch if adam.step >= 100 else plan.batch // 8)]  # small steps first
                    adam(whole, e.words, x[pick], goal[pick], plan.rate / np.sqrt(1 + adam.step / 200))
                    i += len(pick)
                seen += len(tokens)
        if seen:
            state = {f"{m} {k}": v for m, w in (("weight", adam.weights), ("first", adam.first), ("second", adam.second)) for k, v in w.items()}
            parts = np.array_split((attention.flat(state | {"step": np.array([adam.step], np.float32)}) * seen).astype(np.float32), pieces)
            at, n = (pa.array(np.full(pieces, v, np.int64)) for v in (TaskContext.get().partitionId(), seen))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(pieces, dtype=np.int32)), at, n, pa.array([x.tobytes() for x in parts], pa.binary())], names=["piece", "at", "n", "w"])

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        total = np.sum([np.frombuffer(w, np.float32) for w in t.column("w").to_pylist()], axis=0, dtype=np.float64).astype(np.float32)
        return pa.table({"piece": t.column("piece")[:1], "at": pa.array([t.column("at")[0].as_py() // fan]), "n": pa.array([sum(t.column("n").to_pylist())]), "w": pa.array([total.tobytes()], pa.binary())})

    kind = "piece int, at long, n long, w binary"
    # Partition and order of a text follow from the text and its key.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("copy", "key", F.lit(31)), F.lit(shards)).cast("int")).repartitionById(shards, "shard").sortWithinPartitions("copy", "key").select("text")
    sums = dealt.mapInArrow(learn, kind).groupBy("piece", F.expr(f"at div {fan}")).applyInArrow(add, kind)  # so no group holds the weights of all shards
    got = sums.groupBy("piece").applyInArrow(add, kind).collect()
    shared.destroy()
    if not got:
        return start, 0
    total = np.concatenate([np.frombuffer(r["w"], np.float32) for r in sorted(got, key=lambda r: r["piece"])]).astype(np.float64)
    return attention.shaped(total / got[0]["n"], start), got[0]["n"]


def counted(texts: DataFrame, plan: LmPlan, ranks: Broadcast) -> DataFrame:
    """(what, code, n, kind), stored: words (0: hash, count, kind of the word), kinds by what stands before them (1: kind * contexts + context), texts (2)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tb.reuse_memory()
        encoder, rows = encoder_for(plan, ranks), 0
        before = np.zeros(plan.inputs * plan.contexts, np.int64)

        def out(what: int, code: np.ndarray, n: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(code), what, np.int32)), pa.array(code), pa.array(n), pa.array(kind.astype(np.int32))], names=["what", "code", "n", "kind"])

        for b in batches:
            hashes, ns, kinds = [], [], []
            for lo, hi in tb.row_chunks(b.column(0), 1 << 22):
                e = encoded(b.column(0).slice(lo, hi - lo), encoder)
                hashes.append(e.hashes)
                ns.append(np.bincount(e.at, minlength=len(e.hashes)))
                kinds.append(e.kind)
                context = np.full(len(e.at), plan.contexts - 1)
                context[1:] = e.kind[e.at[:-1]] % (plan.contexts - 1)
                context[np.minimum(e.word_offsets[:-1], max(0, len(e.at) - 1))[np.diff(e.word_offsets) > 0]] = plan.contexts - 1
                before += np.bincount(e.kind[e.at] * plan.contexts + context, minlength=len(before))
                rows += hi - lo
            h, first, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            if len(h):
                yield out(0, h.view(np.int64), np.bincount(inverse, np.concatenate(ns)).astype(np.int64), np.concatenate(kinds)[first])
        some = np.flatnonzero(before)
        yield out(1, some, before[some], np.zeros(len(some)))
        yield out(2, np.zeros(1, np.int64), np.array([rows]), np.zeros(1))

    rows = texts.mapInArrow(count, "what int, code long, n long, kind int")
    return stored(rows.groupBy("what", "code").agg(F.sum("n").alias("n"), F.max("kind").alias("kind")), "lm-counts")


def most_frequent(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, count, kind) of the words from the least count on with which at most `most` words have it, most frequent first."""
    step = F.when(F.col("n") <= 4096, F.col("n").cast("double")).otherwise(F.floor(F.log2("n") * 64) + 4096.0 - 768.0)
    least, kept = None, 0
    for r in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():
        kept += r["words"]
        if kept > most:
            break
        least = r["n"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = words.filter(F.col("n") >= least).toArrow()
    h, n, kind = head.column("code").to_numpy().view(np.uint64), head.column("n").to_numpy(), head.column("kind").to_numpy().astype(np.int64)
    order = np.lexsort((h, -n))
    return h[order], n[order], kind[order]


@dataclass
class Fitted:
    """The model; counts of all words as a table (code, n) and of the most frequent ones, by ascending hash; tokens, distinct tokens and texts learned from."""

    model: Model
    words: DataFrame
    head_code: np.ndarray
    head_n: np.ndarray
    n_all: int
    v_all: int
    ends: int


def fit(train: DataFrame, plan: LmPlan, ranks: Broadcast) -> Fitted:
    """What is learned from train (key, text, copy)."""
    counts = counted(train.select("text"), plan, ranks)
    words = counts.filter("what = 0").select("code", "n", "kind")
    ends = counts.filter("what = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    by_kind = {r["kind"]: (r["n"], r["v"]) for r in words.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}  # at most one row for each kind
    profile = np.zeros(plan.inputs * plan.contexts)
    before = counts.filter("what = 1").select("code", "n").toArrow()  # at most one row for each kind and context
    profile[before.column("code").to_numpy()] = before.column("n").to_numpy()
    frequent = most_frequent(words, plan.head_words)
    classes, bias = build(plan, frequent, by_kind, profile.reshape(plan.inputs, plan.contexts), ends)
    shape = attention.Shape(inputs=plan.inputs + 1, classes=classes.end + 1)
    weights = attention.new_weights(shape, bias)
    n_all, v_all = sum(n for n, _ in by_kind.values()) + ends, sum(v for _, v in by_kind.values()) + (1 if ends else 0)
    state, eighth, done = starting(weights), F.pmod(F.xxhash64("copy", "key"), F.lit(sum(plan.rounds))), 0
    for share in plan.rounds if n_all else ():
        shards = max(1, round(n_all * share / sum(plan.rounds) / plan.shard_tokens))
        state, _ = learned(train.filter(eighth.between(done, done + share - 1)), state, shape, classes, plan, ranks, shards)
        done += share
    order = np.argsort(frequent[0])
    return Fitted(Model(shape, weights_of(state), classes), words.select("code", "n"), frequent[0][order], frequent[1][order], n_all, v_all, ends)


def rows_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"), F.xxhash64(text).alias("copy"))


def lm_scores(docs: DataFrame, plan: LmPlan | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    plan = plan or LmPlan()
    context = docs.sparkSession.sparkContext
    rows = rows_of(docs, key, text)
    ranks = context.broadcast(read_ranks(plan))  # the vocabulary has a fixed size
    fitted = fit(rows.filter(~F.col("held_out")), plan, ranks)
    ends, size_log = fitted.ends, float(np.log10(fitted.n_all + fitted.v_all + 1)) if fitted.ends else 0.0
    shared = context.broadcast((fitted.model, fitted.head_code, fitted.head_n))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, held_out boolean, copy long, n_tokens long, known long, base double, score double, codes array<long>"
    scored = stored(rows.select("key", "held_out", "copy", "text").mapInArrow(scorer(shared, ranks, plan, ends), schema), "lm-scored")
    for b in (shared, ranks):
        b.destroy()
    # Words outside the head table: their counts come by a join, once for rows that repeat an id and a text.
    tails = scored.filter(F.size("codes") > 0).select("key", "copy", "codes")
    if not tails.groupBy("key", "copy").count().filter("count > 1").isEmpty():
        tails = tails.dropDuplicates(["key", "copy"])
    tails = tails.select("key", "copy", F.explode("codes").alias("code"))
    found = tails.join(fitted.words, "code").groupBy("key", "copy").agg(F.count("n").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("extra"))
    s, f = scored.drop("codes").alias("s"), found.alias("f")
    both = s.join(f, (F.col("s.copy").eqNullSafe(F.col("f.copy"))) & F.col("s.key").eqNullSafe(F.col("f.key")), "left")
    extra = F.coalesce("f.extra", F.lit(0.0))
    return both.select(
        F.col("s.key").alias(key),
        "s.held_out",
        "s.n_tokens",
        (F.col("s.known") + F.coalesce("f.more", F.lit(0))).alias("n_known"),
        F.lit(int(fitted.n_all)).cast("long").alias("train_tokens"),
        (F.col("s.base") + extra - F.col("s.n_tokens") * F.lit(size_log) if ends else F.lit(0.0)).alias("base_score"),
        (F.col("s.score") + extra).alias("score"),
    )


def scorer(shared: Broadcast, ranks: Broadcast, plan: LmPlan, ends: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (key, held_out, copy, text): sums over the words of the head table, and the hashes of the others.

    A word that is a class of its own adds its class's log; another one also log10(count + 1) less the log of its class's
    size, of which the count's part is added where the counts are.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tb.reuse_memory()
        model, head_code, head_n = shared.value
        encoder, classes = encoder_for(plan, ranks), model.classes
        for b in batches:
            for lo, hi in tb.row_chunks(b.column(3), 1 << 22):
                e = encoded(b.column(3).slice(lo, hi - lo), encoder)
                wo = e.word_offsets
                logs, offsets, mine = model.class_logs(e)
                k = np.minimum(np.searchsorted(head_code, e.hashes), max(0, len(head_code) - 1))
                common = head_code[k] == e.hashes if len(head_code) else np.zeros(len(e.hashes), bool)
                base = np.where(common, np.log10((head_n[k] if len(head_n) else 0) + 1.0), 0.0)
                within = np.where(mine < plan.own_classes, 0.0, base - classes.size[mine])
                rest = np.flatnonzero(~common[e.at])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(i).slice(lo, hi - lo) for i in range(3)),
                        pa.array((np.diff(wo) + 1).astype(np.int64)),
                        pa.array(tb.sums_by_row(common[e.at], wo) + int(ends > 0)),
                        pa.array(tb.sums_by_row(base[e.at], wo) + float(np.log10(ends + 1))),
                        pa.array(tb.sums_by_row(logs, offsets) + tb.sums_by_row(within[e.at], wo)),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(rest, wo).astype(np.int32)), pa.array(e.hashes[e.at[rest]].view(np.int64))),
                    ],
                    names=["key", "held_out", "copy", "n_tokens", "known", "base", "score", "codes"],
                )

    return score
