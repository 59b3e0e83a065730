"""Features, a boosting step and the calibration of the toxicity model against plain versions."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import boosting, toxicity
from pagemill.llm import textbytes as tb

PLAN = toxicity.ToxicityPlan()
LEET = dict(zip("013457@$!", "oieastasi", strict=True))


def lowered(text: str) -> str:
    return "".join(c.lower() if (c.isascii() or "À" <= c <= "Þ") and c != "×" else c for c in text)


def inner(word: str) -> str:
    keep = [i for i, c in enumerate(word) if ord(c) >= 128 or c.isalnum()]
    return word[keep[0] : keep[-1] + 1] if keep else ""


def plain_features(text: str, wholes: dict[str, float], beginnings: dict[str, float]) -> list[float]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    raw = text.encode()
    n, size = max(len(words), 1), max(len(raw), 1)

    def count(part: str, kind: str) -> int:
        b = part.encode()
        return {
            "digit": sum(48 <= x < 58 for x in b), "upper": sum(65 <= x < 91 for x in b), "letter": sum(x >= 128 or chr(x).isalpha() for x in b),
            "sign": sum(33 <= x < 127 and not chr(x).isalnum() for x in b),
        }[kind]

    learned, begun, hits, second = [], [], set(), []
    insults = unmasked = shouted = digits = signs = length = 0
    for i, w in enumerate(words):
        core = inner(w)
        low = lowered(core)
        if low in wholes:
            learned.append(wholes[low])
            hits.add(i)
        for k in PLAN.prefix_lengths:
            if len(low) > k and low[:k] in beginnings and len(low[:k]) == k:
                begun.append(beginnings[low[:k]])
                hits.add(i)
        if low in toxicity.INSULTS:
            insults += 1
            hits.add(i)
        letters, bytes_ = count(core, "letter"), len(core.encode())
        if (count(core, "digit") or count(core, "sign")) and letters and bytes_ < 40 and "".join(LEET.get(c, c) for c in low) in toxicity.INSULTS:
            unmasked += 1
            hits.add(i)
        if low in toxicity.SECOND_PERSON:
            second.append(i)
        shouted += count(core, "upper") == bytes_ and bytes_ > 2
        digits += bool(count(core, "digit") and letters)
        signs += bool(count(core, "sign") and letters)
        length += bytes_
    near = sum(any(abs(i - s) <= PLAN.near for s in second) for i in hits)
    return [
        math.log1p(len(words)), len(learned) / n, sum(learned), max([0.0, *learned]), len(begun) / n, sum(begun), max([0.0, *begun]), insults / n, insults, unmasked, len(second) / n, near,
        count(text, "upper") / max(count(text, "letter"), 1), shouted / n, count(text, "sign") / size, raw.count(b"!") / size, raw.count(b"?") / size, digits / n, signs / n, length / n,
    ]


def test_features_of_texts():
    r = random.Random(17)
    pool = ["you", "YOU!", "idiot", "1d10t", "IDIOT?!", "st*pid", "stup1d", "(moron)", "É", "ÉTÉ", "crétin", "CRÉTIN", "x×y", "vlarnish", "vlarnable", "---", "a1b2", "don't", "12", "stone", "日本語の本文", "tú", "Ihr", "m0r0n" * 9]
    texts = ["", " ", *(r.choice([" ", "\n", "  "]).join(r.choice(pool) for _ in range(r.randrange(1, 40))) for _ in range(200)), None]
    wholes, beginnings = {"stone": 2.75, "a1b2": 3.5, "日本語の本文": 4.0}, {"vlar": 3.0, "vlarn": 2.5, "日本語の": 5.0}
    hashes = [tb.hash_word(w.encode()) for w in wholes] + [tb.hash_word(w.encode()) ^ len(w) for w in beginnings]
    learned = toxicity.Lexicon(np.array(hashes, np.uint64), np.array([*wholes.values(), *beginnings.values()]))
    got = toxicity.batch_features(pa.array(texts), learned, PLAN)
    for t, row in zip(texts, got, strict=True):
        assert row == pytest.approx(plain_features(t or "", wholes, beginnings)), t


def test_one_step_of_boosting():
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(300, 4)), 1)
    y = ((x[:, 2] > 0.4) ^ (r.random(300) < 0.1)).astype(float)
    t = boosting.boost(x, y, trees=1, depth=1)
    start = math.log(y.mean() / (1 - y.mean()))
    g, h = y - y.mean(), np.full(300, y.mean() * (1 - y.mean()))

    def worth(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + 2.0)

    best = max(
        ((worth(x[:, j] <= e) + worth(x[:, j] > e), j, e) for j in range(4) for e in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 49)[1:-1])) if 8 <= (x[:, j] <= e).sum() <= 292),
        key=lambda v: (round(v[0], 9), -v[1], -v[2]),
    )
    assert (t.feature[0, 0], t.threshold[0, 0], t.start) == (best[1], best[2], pytest.approx(start))
    for side, rows in enumerate((x[:, best[1]] <= best[2], x[:, best[1]] > best[2])):
        assert t.leaf[0, side] == pytest.approx(0.15 * g[rows].sum() / (h[rows].sum() + 2.0))
    assert t.margin(x) == pytest.approx(start + np.where(x[:, best[1]] <= best[2], t.leaf[0, 0], t.leaf[0, 1]))


def test_isotonic_fit_by_its_definition():
    r = np.random.default_rng(6)
    m = np.sort(r.normal(size=60))
    y = (r.random(60) < 1 / (1 + np.exp(-2 * m))).astype(float)
    # The fit at i is the largest, over starts up to i, of the least mean of a run from there to i or beyond.
    fit = [max(min(y[a : z + 1].mean() for z in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    pools = [[k for k in range(60) if abs(fit[k] - v) < 1e-12] for v in sorted(set(np.round(fit, 12)))]
    got = boosting.isotonic(m, y)
    assert got.at == pytest.approx([m[p].mean() for p in pools])
    assert got.value == pytest.approx(np.maximum.accumulate([(y[p].sum() + y.mean()) / (len(p) + 1) for p in pools]))
