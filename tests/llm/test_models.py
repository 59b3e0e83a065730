"""Toxicity and LM scores: exact counts against plain Python, gradients, held-out accuracy."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from pagemill.llm import attention, boosting, lmscore, toxicity
from pagemill.llm import textbytes as tb


def test_attention_gradients():
    s = attention.Shape(inputs=20, classes=7, width=8, heads=2, hidden=6, window=8, scored=4)
    r = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in attention.new_weights(s, np.zeros(7)).items()}
    words = attention.Words(r.integers(0, 19, 30), np.array([0, 1, 4, 6, 11, 20, 30]))
    words.scale = words.scale.astype(np.float64)
    x, t = r.integers(0, 7, (5, 8)), r.integers(-1, 7, (5, 4))
    x[0, :4] = 7

    def loss():
        return attention.gradients(w, s, words.vectors(w)[x], x == 7, t)

    _, g, dv = loss()
    by_word = np.zeros((8, 8))
    np.add.at(by_word, x.ravel(), dv.reshape(-1, 8))
    g["embed"] = words.spread(by_word, 20)
    for k in w:
        for _ in range(4):
            i = tuple(int(r.integers(0, n)) for n in w[k].shape)
            w[k][i] += 1e-5
            up = loss()[0]
            w[k][i] -= 2e-5
            down = loss()[0]
            w[k][i] += 1e-5
            assert (up - down) / 2e-5 == pytest.approx(g[k][i], rel=1e-3, abs=1e-8)


def test_adam_in_parts_is_adam():
    s = attention.Shape(inputs=30, classes=5, window=8, scored=8)
    r = np.random.default_rng(3)
    start = attention.new_weights(s, np.zeros(5))
    words = attention.Words(r.integers(0, 29, 40), np.arange(0, 41, 4))
    x, t = r.integers(0, 10, (20, 8)), r.integers(-1, 5, (20, 8))
    x[:3, 4:], x[4, 0] = 11, 10
    whole, parts = attention.Adam(start, 100), attention.Adam(start, 3)
    for _ in range(3):
        assert whole(s, words, x, t, 1e-2) == pytest.approx(parts(s, words, x, t, 1e-2), rel=1e-4)
    assert all(np.allclose(whole.weights[k], parts.weights[k], atol=2e-3) for k in start)


class Counted(dict):
    """Weights that count how often each is read."""

    def __init__(self, w):
        super().__init__(w)
        self.reads = collections.Counter()

    def __getitem__(self, k):
        self.reads[k] += 1
        return super().__getitem__(k)


@pytest.mark.parametrize("scored", [8, 4])
def test_attention_projects_each_position_once(scored):
    s = attention.Shape(inputs=20, classes=7, width=8, heads=2, hidden=6, window=8, scored=scored)
    r = np.random.default_rng(1)
    w = Counted(attention.new_weights(s, np.zeros(7)))
    attention.forward(w, s, r.standard_normal((3, 8, 8)).astype(np.float32), np.zeros((3, 8), bool))
    assert w.reads["qkv"] == (1 if scored == 8 else 2)  # queries, keys and values were each a product of all three before


def test_attention_gradients_of_whole_windows():
    s = attention.Shape(inputs=20, classes=7, width=8, heads=2, hidden=6, window=8, scored=8)
    r = np.random.default_rng(2)
    w = {k: v.astype(np.float64) for k, v in attention.new_weights(s, r.standard_normal(7)).items()}
    w["out"] = r.standard_normal(w["out"].shape)
    v, blank, t = r.standard_normal((5, 8, 8)), np.zeros((5, 8), bool), r.integers(-1, 7, (5, 8))
    blank[1, 5:], blank[3, 1:3] = True, True
    _, g, dv = attention.gradients(w, s, v, blank, t)
    for values, slope in [*((w[k], g[k]) for k in w if k != "embed"), (v, dv)]:
        for _ in range(6):
            i = tuple(int(r.integers(0, n)) for n in values.shape)
            values[i] += 1e-5
            up = attention.gradients(w, s, v, blank, t)[0]
            values[i] -= 2e-5
            down = attention.gradients(w, s, v, blank, t)[0]
            values[i] += 1e-5
            assert (up - down) / 2e-5 == pytest.approx(slope[i], rel=1e-3, abs=1e-8)


@pytest.mark.parametrize("sizes", [[1], [3, 1], [1] * 40 + [5000, 2, 70] + [4] * 30, list(range(1, 60))])
def test_vectors_and_their_gradient_sum_the_ids_of_each_word(sizes):
    r = np.random.default_rng(4)
    words, w = attention.Words(r.integers(0, 19, sum(sizes)), np.cumsum([0, *sizes])), {"embed": r.standard_normal((20, 8))}
    got, dv = words.vectors(w), r.standard_normal((len(sizes) + 2, 8))
    edges, slope = words.offsets, np.zeros((20, 8))
    for i, n in enumerate(sizes):
        ids = words.ids[edges[i] : edges[i + 1]]
        assert got[i] == pytest.approx(w["embed"][ids].sum(axis=0) / math.sqrt(n), rel=1e-5, abs=1e-6)
        np.add.at(slope, ids, dv[i] / math.sqrt(n))
    assert (got[-2] == w["embed"][-1]).all() and not got[-1].any()
    single = {"embed": w["embed"].astype(np.float32)}  # the same to the last bit, whatever the other words
    alone = [attention.Words(words.ids[a:z], np.array([0, z - a])).vectors(single)[0] for a, z in zip(edges, edges[1:], strict=False)]
    assert (words.vectors(single)[:-2] == np.array(alone)).all()
    slope[-1] += dv[-2]
    assert np.allclose(words.spread(dv, 20), slope, rtol=1e-5, atol=1e-5)
    assert np.allclose(attention.added(words.ids, w["embed"][words.ids], 20, step=7), attention.added(words.ids, w["embed"][words.ids], 20))


def test_distinct_hashes_are_those_of_unique():
    r = np.random.default_rng(6)
    low = r.integers(0, 40, 900).astype(np.uint64) | np.uint64(0xABCDEF0000000000)  # agree in their upper bits: sorted by np.unique
    for h in (np.zeros(0, np.uint64), np.array([7], np.uint64), tb.mix(r.integers(0, 300, 5000).astype(np.uint64)), low, np.concatenate([low, tb.mix(low)])):
        for got, want in zip(tb.distinct(h), np.unique(h, return_index=True, return_inverse=True), strict=True):
            assert (got == want).all() and len(got) == len(want)


def test_windows_score_each_token_once():
    s = attention.Shape(inputs=103, classes=4, window=8, scored=4)
    tokens, offsets = np.arange(30) % 100, np.array([0, 1, 2, 14, 30])
    tokens[offsets[1:] - 1] = -1
    x, target = lmscore.windows(tokens, offsets, s, 200)
    assert sorted(target[target >= 0].tolist()) == list(range(30))
    for w, t in zip(x, target, strict=True):
        for k, at in enumerate(t):
            if at >= 0:
                row = np.searchsorted(offsets, at, "right") - 1
                seen = [200, *tokens[offsets[row] : at].tolist()]
                want = [201] * 8 + seen
                assert w[: 5 + k].tolist() == want[len(want) - 5 - k :]


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lm_rows(texts):
    rows = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), None]) for i, t in texts]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    return rows, held, collections.Counter(w for i, ws in rows if not held[i] for w in ws)


def test_lm_scores(spark, docs, texts):
    plan = lmscore.LmPlan(head_words=40)
    got = collections.defaultdict(list)
    for r in lmscore.lm_scores(docs, plan).collect():
        got[r.doc_id].append(r)
    rows, held, c = _lm_rows([*texts, (None, "no id here")])
    n, v = sum(c.values()), len(c)
    assert sum(map(len, got.values())) == len(rows)
    for i, ws in rows:
        r = got[i][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0


def _plain_log(w, s, vectors, goal):
    """log10 probability of class goal after these vectors, the last of a window, in float64."""
    h = np.array(vectors) + w["place"][-len(vectors) :]
    q, k, u = (h @ m for m in np.split(w["qkv"], 3, axis=1))
    q = q[-1]
    a = np.exp(np.clip(k @ q / math.sqrt(s.width), -attention.LARGEST, attention.LARGEST))
    r = h[-1] + (a / a.sum()) @ u @ w["wo"]
    y = (r + np.maximum(r @ w["w1"] + w["b1"], 0) @ w["w2"] + w["b2"]) @ w["out"] + w["bias"]
    y = np.clip(y, -attention.LARGEST, attention.LARGEST)
    return math.log10(math.exp(y[goal]) / np.exp(y).sum())


def test_lm_score_by_brute_force(spark, docs, texts):
    plan, context = lmscore.LmPlan(head_words=40), spark.sparkContext
    ranks = lmscore.read_ranks(plan)
    rows = lmscore.rows_of(docs, "doc_id", "text")
    fitted = lmscore.fit(rows.filter("NOT held_out"), plan, context.broadcast(ranks))
    got = {r.doc_id: r.score for r in lmscore.lm_scores(docs, plan).collect()}
    model, encoder = fitted.model, lmscore.Encoder(plan, ranks)
    s, cl = model.shape, model.classes
    w = {k: x.astype(np.float64) for k, x in model.weights.items()}
    rows, _, c = _lm_rows([*texts, (None, "no id here")])
    ids = {x: plan.row_of(np.array(encoder.ids_of(x.encode()))).tolist() for x in {x for _, ws in rows for x in ws if x is not None}}
    own = dict(zip(cl.own.tolist(), cl.own_class.tolist(), strict=True))
    class_of = {x: own.get(tb.hash_word(x.encode()), int(cl.by_kind[k[0]])) for x, k in ids.items()} | {None: cl.end}
    tokens, words = collections.Counter(), collections.Counter()
    for x, n in c.items():
        tokens[class_of[x]] += n
        words[class_of[x]] += 1
    assert len(own) >= 20 and sum(x >= plan.own_classes for x in set(class_of.values())) > 4
    for i, ws in rows:
        if len(ws) < 2000:
            vectors = [w["embed"][-1]] + [w["embed"][ids[x]].sum(axis=0) / math.sqrt(len(ids[x])) for x in ws[:-1]]
            want = 0.0
            for k, x in enumerate(ws):
                # Token k is the (k % scored)-th of its window's scored ones; the window reaches back to its first position.
                reach = s.window - s.scored + k % s.scored + 1
                near = vectors[max(0, k + 1 - reach) : k + 1]
                place = dict(w, place=w["place"][:reach])
                want += _plain_log(place, s, near, class_of[x])
                if class_of[x] >= plan.own_classes and x is not None:
                    want += math.log10((c[x] + 1) / (tokens[class_of[x]] + words[class_of[x]] + 1))
            assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_words_encoded_at_once_and_kept():
    plan = lmscore.LmPlan(kept_words=30)
    ranks = lmscore.read_ranks(plan)
    encoder = lmscore.Encoder(plan, ranks)
    r = random.Random(9)
    for n in (1, 20, 60, 60, 60):
        words = sorted({"".join(r.choice("abé日 \xa012.,-'A") for _ in range(r.randrange(1, 9))).replace(" ", "") or "x" for _ in range(n)} | ({"y" * 700, "é" * 400} if n == 20 else set()))
        data = np.frombuffer("".join(words).encode(), np.uint8)
        ends = np.cumsum([len(x.encode()) for x in words])
        h = tb.span_hashes(data, ends - [len(x.encode()) for x in words], ends)
        order = np.argsort(h)
        got = encoder(data, (ends - [len(x.encode()) for x in words])[order], ends[order], h[order])
        for i, k in enumerate(order.tolist()):
            assert got.ids[got.offsets[i] : got.offsets[i + 1]].tolist() == plan.row_of(np.array(encoder.ids_of(words[k].encode()))).tolist()


def test_the_model_beats_the_base_on_held_out_texts(spark):
    # Two languages with the same counts: only what stands before tells which words may come.
    r = random.Random(4)
    langs = [[" ".join("".join(r.choice(x) for _ in range(2)) for _ in range(1)) for _ in range(300)] for x in (["ka", "lo", "mi", "tu"], ["sch", "ber", "ung", "ein"])]
    docs = spark.createDataFrame([(i, " ".join(r.choice(langs[i % 2]) for _ in range(150))) for i in range(600)], "doc_id long, text string")
    rows = [x for x in lmscore.lm_scores(docs, lmscore.LmPlan(batch=16)).collect() if x.held_out]  # small batches, as the corpus is small
    assert sum(x.score for x in rows) > sum(x.base_score + 0.15 * x.n_tokens for x in rows)


def test_lm_scores_do_not_depend_on_the_split(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["ka", "lo", "mi", "tu", "bera", "x" * r.randrange(1, 700)]) for _ in range(r.randrange(80)))) for i in range(300)]
    docs, plan = spark.createDataFrame(rows, "doc_id long, text string"), lmscore.LmPlan(batch=16, shard_tokens=2000)
    got = [{x.doc_id: x.score for x in lmscore.lm_scores(docs.repartition(n, "text"), plan).collect()} for n in (1, 4, 16)]
    assert got[0] == pytest.approx(got[1], rel=1e-9) and got[0] == pytest.approx(got[2], rel=1e-9)


def test_lm_without_training_texts(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = lmscore.lm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string"), lmscore.LmPlan()).collect()
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and math.isfinite(r.score)
    assert lmscore.lm_scores(spark.createDataFrame([], "doc_id long, text string"), lmscore.LmPlan()).count() == 0


def test_boosting_and_calibration():
    r = np.random.default_rng(1)
    x = r.standard_normal((4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    t = boosting.boost(x[:3000], y[:3000], trees=60)
    m = t.margin(x[3000:])
    assert ((m > 0) == (y[3000:] == 1)).mean() > 0.95
    f = boosting.isotonic(m, y[3000:])
    assert (np.diff(f(np.sort(m))) >= 0).all() and 0 <= f(m).min() and f(m).max() <= 1


@pytest.fixture(scope="module")
def labelled():
    r = random.Random(3)
    words = ["stone", "river", "lamp", "you", "green", "walk", "table", "seven", "cloud"]
    rows = []
    for i in range(1500):
        w = [r.choice(words) for _ in range(r.randrange(5, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(r.randrange(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(["Grobl" + r.choice("abcdefgh"), "vlarn!", "idiot"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_on_held_out_texts(spark, labelled):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in labelled] + [(5000, None, "x"), (5001, "", "x"), (0, labelled[0][1], "x"), (None, "stone", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled] + [(1, None), (None, 1), (9999, 1), (2, labelled[2][2])], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {i: y for i, _, y in labelled}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    empty = [r.score for r in got if r.doc_id in (5000, 5001)]
    assert empty[0] == empty[1]
    # Labels of held-out texts are not looked at.
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    assert sorted(map(str, toxicity.toxicity(docs, flipped).collect())) == sorted(map(str, got))


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_lm_learns_from_every_token(spark, docs, texts):
    plan = lmscore.LmPlan()
    rows = lmscore.rows_of(docs, "doc_id", "text")
    ranks = spark.sparkContext.broadcast(lmscore.read_ranks(plan))
    classes, bias = lmscore.build(plan, (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)), {}, np.zeros((plan.inputs, plan.contexts)), 0)
    shape = attention.Shape(inputs=plan.inputs + 1, classes=classes.end + 1)
    start = lmscore.starting(attention.new_weights(shape, bias))
    weights, n = lmscore.learned(rows, start, shape, classes, plan, ranks, 3)
    assert n == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1 for _, t in [*texts, (None, "no id here")])
    assert {k: v.shape for k, v in weights.items()} == {k: v.shape for k, v in start.items()}
    assert all((v == attention.shaped(attention.flat(start), start)[k]).all() for k, v in start.items())


def test_toxicity_with_ten_toxic_labels(spark, labelled):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    toxic = [i for i, _, y in labelled if y and not held(i)][:10]
    labels = [(i, 1) for i in toxic] + [(i, 0) for i, _, y in labelled if not y and not held(i)][:80]
    docs, labels = spark.createDataFrame([(i, t) for i, t, _ in labelled], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = {i: y for i, _, y in labelled}
    for plan in (toxicity.ToxicityPlan(), toxicity.ToxicityPlan(train_rows=40)):
        rows = [r for r in toxicity.toxicity(docs, labels, plan).collect() if r.held_out]
        mean = [np.mean([r.score for r in rows if truth[r.doc_id] == side]) for side in (0, 1)]
        assert mean[1] > mean[0] + 0.1
        assert sum(r.predicted for r in rows if truth[r.doc_id]) > 0.4 * sum(truth[r.doc_id] for r in rows)


def test_an_empty_span_at_the_end(monkeypatch):
    # A word of signs only has an empty core, which may stand last in a batch.
    monkeypatch.setattr(tb, "_CACHE", {})
    data = np.full(100_000, 97, np.uint8)
    h = tb.span_hashes(data, np.array([0, 100_000]), np.array([3, 100_000]))
    assert h[0] == tb.hash_word(b"aaa") and h[1] == tb.hash_word(b"")


def test_toxicity_sends_no_more_rows_than_its_bound(spark):
    toxic = lambda i: int(i % 3 == 0)
    docs = spark.createDataFrame([(i % 40, f"{'vlarn' if toxic(i % 40) else 'stone'} number {i}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, toxic(i)) for i in range(40)], "doc_id long, toxic int")
    plan, seen = toxicity.ToxicityPlan(train_rows=20), []
    boost = toxicity.boosting.boost

    def counting(x, *rest):
        seen.append(len(x))
        return boost(x, *rest)

    toxicity.boosting.boost = counting
    try:
        assert toxicity.toxicity(docs, labels, plan).count() == 4000
    finally:
        toxicity.boosting.boost = boost
    assert seen and sum(seen) <= 20


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from pagemill.llm import storage

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        storage.shared_dir(cluster)
