"""A small causal self-attention model in numpy: one layer over the vectors of words, trained with Adam."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np


@dataclass(frozen=True)
class Shape:
    """inputs: embedded ids, the last of which stands for the begin of a text; classes: outputs; window: context; scored: last positions of a window that count."""

    inputs: int
    classes: int
    width: int = 16
    heads: int = 1
    hidden: int = 32
    window: int = 32
    scored: int = 16


Weights = dict[str, np.ndarray]
#: Logits stay within this of 0, so that softmax needs no pass for the largest.
LARGEST = 60.0


def new_weights(s: Shape, bias: np.ndarray, seed: int = 5) -> Weights:
    """Drawn weights; the classes come out as bias says until something is learned."""
    r = np.random.default_rng(seed)
    d, f = s.width, s.hidden

    def draw(*size: int, scale: float) -> np.ndarray:
        return (r.standard_normal(size) * scale).astype(np.float32)

    return {
        "embed": draw(s.inputs, d, scale=0.3), "place": draw(s.window, d, scale=0.1),
        "qkv": draw(d, 3 * d, scale=d**-0.5), "wo": draw(d, d, scale=0.5 * d**-0.5),
        "w1": draw(d, f, scale=d**-0.5), "b1": np.zeros(f, np.float32), "w2": draw(f, d, scale=0.5 * f**-0.5), "b2": np.zeros(d, np.float32),
        "out": np.zeros((d, s.classes), np.float32), "bias": bias.astype(np.float32),
    }


class Words:
    """Subword ids of some words: word i has ids[offsets[i]:offsets[i+1]], at least one."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray):
        self.ids, self.offsets = ids, offsets
        self.scale = (1 / np.sqrt(np.maximum(np.diff(offsets), 1))).astype(np.float32)[:, None]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def take(self, which: np.ndarray) -> Words:
        size = np.diff(self.offsets)[which]
        offsets = np.concatenate([[0], np.cumsum(size)])
        return Words(self.ids[np.repeat(self.offsets[which] - offsets[:-1], size) + np.arange(offsets[-1])], offsets)

    def vectors(self, w: Weights) -> np.ndarray:
        """Vectors of the words, then that of the begin and that of padding (zeros)."""
        embed = w["embed"]
        out = np.zeros((len(self) + 2, embed.shape[1]), embed.dtype)
        if len(self):
            size = np.diff(self.offsets)
            order = np.argsort(-size, kind="stable")
            longer, begin = np.cumsum(np.bincount(size)[::-1])[::-1], self.offsets[:-1][order]  # longer[k]: words of k ids or more
            steps = max(1, int((longer >= 16).sum()) - 1)  # fewer words are longer than this: their further ids are added word by word
            total = embed.take(self.ids[begin], axis=0)
            for k in range(1, steps):
                total[: longer[k + 1]] += embed.take(self.ids[begin[: longer[k + 1]] + k], axis=0)
            for i in range(int((size > steps).sum())):
                more = embed[self.ids[begin[i] + steps : begin[i] + size[order[i]]]]
                total[i] = np.add.reduce(np.concatenate([total[i][None], more]))  # in order too, so that no sum depends on the other words
            out[order] = total
            out[:-2] *= self.scale
        out[-2] = embed[-1]
        return out

    def spread(self, dv: np.ndarray, rows: int) -> np.ndarray:
        """Gradient of the embedding from that of the vectors."""
        out = added(self.ids, np.repeat(dv[:-2] * self.scale, np.diff(self.offsets), axis=0), rows)
        out[-1] += dv[-2]
        return out


def added(at: np.ndarray, values: np.ndarray, rows: int, step: int = 1 << 16) -> np.ndarray:
    """Sums of the rows of values by their place at, in double precision within; step bounds the memory."""
    d = values.shape[1]
    out = np.zeros(rows * d)
    for i in range(0, len(at), step):
        out += np.bincount((at[i : i + step, None] * d + np.arange(d)).ravel(), values[i : i + step].ravel(), rows * d)
    return out.reshape(rows, d).astype(values.dtype)


@lru_cache(8)
def _mask(s: Shape) -> np.ndarray:
    """What hides later positions: position i of the scored ones sees positions up to window - scored + i."""
    return np.where(np.arange(s.window)[None, :] > np.arange(s.window - s.scored, s.window)[:, None], np.float32(-1e9), np.float32(0))


@lru_cache(32)
def _ones(n: int, kind: np.dtype) -> np.ndarray:
    return np.ones(n, kind)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, as a product: numpy sums short rows slowly."""
    return (x.reshape(-1, x.shape[-1]) @ _ones(x.shape[-1], x.dtype)).reshape(x.shape[:-1])


def forward(w: Weights, s: Shape, v: np.ndarray, blank: np.ndarray) -> dict[str, np.ndarray]:
    """Logits y of the classes, with e and total of their softmax, at the scored positions of each window; v: (windows, window, width), blank marks padding.

    Attention is kept as a, not yet divided by its sums: rows of o are divided instead, being shorter.
    """
    b, t, d, n, dh = len(v), s.window, s.width, s.heads, s.width // s.heads
    h = (v + w["place"]).reshape(-1, d)
    if s.scored == t:
        hq, p = h, h @ w["qkv"]
        q, ku = p[:, :d], p.reshape(b, t, 3, n, dh)[:, :, 1:]
    else:
        hq = np.ascontiguousarray(h.reshape(b, t, d)[:, t - s.scored :]).reshape(-1, d)
        q, ku = hq @ w["qkv"][:, :d], (h @ w["qkv"][:, d:]).reshape(b, t, 2, n, dh)
    q = (q * q.dtype.type(dh**-0.5)).reshape(b, s.scored, n, dh).transpose(0, 2, 1, 3)
    k, u = ku[:, :, 0].transpose(0, 2, 3, 1), ku[:, :, 1].transpose(0, 2, 1, 3)
    a = np.matmul(q, k)
    np.clip(a, -LARGEST, LARGEST, out=a)
    a += _mask(s)
    if blank.any():
        some = np.flatnonzero(blank.any(axis=1))
        a[some] += np.where(blank[some], np.float32(-1e9), np.float32(0))[:, None, None, :]
    np.exp(a, out=a)
    share = 1 / _sums(a)
    o = np.matmul(a, u)
    o *= share[..., None]
    o = o.transpose(0, 2, 1, 3).reshape(-1, d)
    r = o @ w["wo"]
    r += hq
    f = r @ w["w1"]
    f += w["b1"]
    np.maximum(f, 0, out=f)
    z = f @ w["w2"]
    z += r
    z += w["b2"]
    y = z @ w["out"]
    y += w["bias"]
    np.clip(y, -LARGEST, LARGEST, out=y)
    e = np.exp(y)
    return {"y": y, "e": e, "total": _sums(e), "h": h, "hq": hq, "q": q, "k": k, "u": u, "a": a, "share": share, "o": o, "r": r, "f": f, "z": z}


def logs(c: dict[str, np.ndarray], goal: np.ndarray) -> np.ndarray:
    """Log probability of the goal class of each scored position."""
    return c["y"][np.arange(len(goal)), goal] - np.log(c["total"])


def gradients(w: Weights, s: Shape, v: np.ndarray, blank: np.ndarray, target: np.ndarray) -> tuple[float, Weights, np.ndarray]:
    """Mean loss over the scored positions with a target (others have -1), its gradients, and that of v."""
    c = forward(w, s, v, blank)
    b, t, d, n, dh = len(v), s.window, s.width, s.heads, s.width // s.heads
    goal = target.reshape(-1)
    real = goal >= 0
    count = max(1, int(real.sum()))
    loss = -float(logs(c, np.maximum(goal, 0))[real].sum()) / count
    dy = c["e"]
    dy *= (real / (c["total"] * count)).astype(dy.dtype)[:, None]
    dy.reshape(-1)[np.flatnonzero(real) * s.classes + goal[real]] -= dy.dtype.type(1 / count)
    ones = _ones(len(dy), dy.dtype)
    g: Weights = {"out": c["z"].T @ dy, "bias": ones @ dy}
    dz = dy @ w["out"].T
    g["w2"], g["b2"] = c["f"].T @ dz, ones @ dz
    du = dz @ w["w2"].T
    du *= c["f"] > 0
    g["w1"], g["b1"] = c["r"].T @ du, ones @ du
    dr = du @ w["w1"].T
    dr += dz
    g["wo"] = c["o"].T @ dr
    do = (dr @ w["wo"].T).reshape(b, s.scored, n, dh)
    do *= c["share"].transpose(0, 2, 1)[..., None]
    level = _sums(do * c["o"].reshape(do.shape)).transpose(0, 2, 1)
    do = do.transpose(0, 2, 1, 3)
    da = np.matmul(do, c["u"].transpose(0, 1, 3, 2))
    da -= level[..., None]
    da *= c["a"]
    dq = np.matmul(da, c["k"].transpose(0, 1, 3, 2)).transpose(0, 2, 1, 3)
    dk = np.matmul(da.transpose(0, 1, 3, 2), c["q"]).transpose(0, 2, 1, 3)
    dv = np.matmul(c["a"].transpose(0, 1, 3, 2), do).transpose(0, 2, 1, 3)
    scale = dr.dtype.type(dh**-0.5)
    if s.scored == t:
        dp = np.empty((b, t, 3, n, dh), dr.dtype)
        np.multiply(dq, scale, out=dp[:, :, 0])
        dp[:, :, 1], dp[:, :, 2] = dk, dv
        dp = dp.reshape(-1, 3 * d)
        g["qkv"] = c["h"].T @ dp
        dr += dp @ w["qkv"].T
        dh_all = dr.reshape(b, t, d)
    else:
        dq, dkv = dq.reshape(-1, d) * scale, np.concatenate([dk.reshape(-1, d), dv.reshape(-1, d)], axis=1)
        g["qkv"] = np.concatenate([c["hq"].T @ dq, c["h"].T @ dkv], axis=1)
        dh_all = (dkv @ w["qkv"][:, d:].T).reshape(b, t, d)
        dr += dq @ w["qkv"][:, :d].T
        dh_all[:, t - s.scored :] += dr.reshape(b, s.scored, d)
    g["place"] = (_ones(b, dy.dtype) @ dh_all.reshape(b, -1)).reshape(t, d)
    return loss, g, dh_all


class Adam:
    """Weights and their moments, moved one batch of windows at a time."""

    def __init__(self, weights: Weights, part: int = 16):
        self.part = part
        self.weights, self.step = {k: v.copy() for k, v in weights.items()}, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))

    def __call__(self, s: Shape, words: Words, x: np.ndarray, target: np.ndarray, rate: float) -> float:
        """Loss before the move; x: places in words of each window's inputs, len(words) for the begin, one more for padding."""
        place = np.zeros(len(words) + 2, np.int64)
        place[x] = 1
        used = np.flatnonzero(place[: len(words)])
        some = words.take(used)
        place[used], place[len(words) :] = np.arange(len(used)), (len(used), len(used) + 1)
        vectors, at, blank = some.vectors(self.weights), place[x], x > len(words)
        g: Weights = {}
        loss, real, flat = 0.0, max(1, int((target >= 0).sum())), np.empty((x.size, s.width), np.float32)
        for i in range(0, len(x), self.part):  # parts that stay in the processor's cache
            some_at, goal = at[i : i + self.part], target[i : i + self.part]
            share = np.float32(max(1, int((goal >= 0).sum())) / real)
            part, more, dv = gradients(self.weights, s, vectors.take(some_at, axis=0), blank[i : i + self.part], goal)
            np.multiply(dv.reshape(-1, s.width), share, out=flat[i * s.window : (i + len(goal)) * s.window])
            loss += part * float(share)
            g = {k: v * share + g[k] if g else v * share for k, v in more.items()}
        g["embed"] = some.spread(added(at.ravel(), flat, len(some) + 2), s.inputs)
        self.step += 1
        size = float(np.sqrt(sum(float(np.vdot(v, v)) for v in g.values())))
        scale = np.float32(min(1.0, 1.0 / max(size, 1e-9)))
        now = rate * min(1, self.step / 40) / (1 - 0.9**self.step)
        root = np.float32((1 - 0.98**self.step) ** -0.5)
        for k, v in g.items():
            v *= scale
            first, second = self.first[k], self.second[k]
            first *= np.float32(0.9)
            first += np.float32(0.1) * v
            v *= v
            v *= np.float32(0.02)
            second *= np.float32(0.98)
            second += v
            low = np.sqrt(second, out=v)
            low *= root
            low += np.float32(1e-8)
            np.divide(first, low, out=low)
            low *= np.float32(now)
            self.weights[k] -= low
        return loss


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)]).astype(np.float64)


def shaped(values: np.ndarray, like: Weights) -> Weights:
    """Weights of the shapes of like from flat()."""
    edge = np.cumsum([0] + [like[k].size for k in sorted(like)])
    return {k: values[a:z].reshape(like[k].shape).astype(np.float32) for k, a, z in zip(sorted(like), edge, edge[1:], strict=False)}
