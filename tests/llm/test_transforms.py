"""Fill-in-the-middle, whitening and multiset fingerprints against plain Python."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm import fillmiddle, multiset, whitening

UNITS = {"chars": r"(?s).", "words": r"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "lines": r"[^\n]*\n|[^\n]+"}
ODD = ["", " ", "a", " a", "a ", "a b", "\n", "\n\na\n", "é ü\t\t日本 x\ny", "<P> here", "x <S", "<M>", "a<S>b", "<<P", "\x1c  z", "x" * 300 + " " * 50 + "\n" * 9 + "y"]


@pytest.mark.parametrize("units", list(UNITS))
def test_units_of_a_scan(units):
    automaton, r = fillmiddle.new_automaton(units), random.Random(2)
    for t in [*ODD, *("".join(r.choice("ab \n\té<SPM>") for _ in range(r.randrange(40))) for _ in range(300))]:
        parts = re.findall(UNITS[units], t)
        u = fillmiddle.scan(t, units, automaton)
        assert (u.n, u.sentinel) == (len(parts), any(s in t for s in ("<P>", "<S>", "<M>")))
        assert [u.cut(i) for i in range(u.n + 1)] == [sum(map(len, parts[:i])) for i in range(u.n + 1)]


@pytest.mark.parametrize("units", list(UNITS))
def test_fill_in_middle(docs, texts, spark, units):
    extra = spark.createDataFrame([(1000 + i, t, "s", "en", 1, 1, "k") for i, t in enumerate(ODD * 8)], docs.schema)
    rows = fillmiddle.fill_in_middle(docs.unionAll(extra), fillmiddle.FimPlan(units=units)).withColumn("back", fillmiddle.restored(F.col("output"), F.col("form"))).collect()
    want, seen = [], set()
    for key, t in [*texts, *((1000 + i, t) for i, t in enumerate(ODD * 8)), (None, "no id here")]:
        t = t or ""
        digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
        h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
        parts = re.findall(UNITS[units], t)
        a, b = sorted((h[0] % (len(parts) + 1), h[1] % (len(parts) + 1)))
        p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
        if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
            want.append((key, len(parts), "plain", None, None, None, None, t, t))
        else:
            form = "spm" if h[3] % 100 < 20 else "psm"
            out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
            want.append((key, len(parts), form, a, b - a, len(p), len(m), out, t))
        seen.add(want[-1][2])
    by = lambda r: (r[0] is None, r[0] or 0, r[7])
    assert sorted(map(tuple, rows), key=by) == sorted(want, key=by)
    assert seen == {"plain", "psm", "spm"}
    assert fillmiddle.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_takes_a_key_of_any_kind(spark):
    rows = spark.createDataFrame([("one two", "b", 1), (None, None, 2)], "text string, output string, key int")
    got = {r.output: r for r in fillmiddle.fill_in_middle(rows, key="key").selectExpr("key AS output", "n").collect()}
    assert (got[1].n, got[2].n) == (7, 0)


def plain_whitening(rows):
    """rows: (key, vector). n, deviations, whitened by key and component up to sign, explained."""
    fine = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = {k: np.array([math.floor(64 * float(c)) + 1_000_000 for c in v], object) for k, v in fine}
    fit = np.array(sorted({tuple(x) for x in xs.values()}), object)
    n, total = len(fit), fit.sum(axis=0)
    centred = (fit * n - total).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return n, total, values[order], vectors[:, order], xs


def test_whitening(spark):
    r = np.random.default_rng(3)
    mixing = r.normal(size=(20, 20))
    base = (r.normal(size=(400, 20)) @ mixing).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(1000 + i, base[0]) for i in range(600)]
    odd = [(2000, None), (2001, [None] + [0.0] * 19), (2002, [float("nan")] + [0.0] * 19), (2003, [float("inf")] + [0.0] * 19), (None, base[1]), (2004, [1.0, 2.0]), (2005, []), (2006, [3e38] * 20), (5, base[5])]
    table = spark.createDataFrame([(k, v, 1, 2.0) for k, v in rows + odd], "vec_id long, embedding array<float>, component int, whitened double").repartition(7)
    got = whitening.whitened(table).collect()
    n, total, values, vectors, xs = plain_whitening(rows)
    assert len(got) == 16 * (len(rows) + 2) and n == 400
    sign = {}
    for g in got:
        if g.vec_id is None:
            continue
        x = xs[g.vec_id]
        assert g.n == n and g.deviation == g.deviation_exact == int(((n * x - total) ** 2).sum())
        want = float((n * x - total).astype(float) / n @ vectors[:, g.component - 1]) / math.sqrt(values[g.component - 1])
        s = sign.setdefault(g.component, 1.0 if want * g.whitened > 0 else -1.0) if abs(want) > 1e-6 else sign.get(g.component, 1.0)
        assert g.whitened == pytest.approx(s * want, rel=1e-6, abs=1e-9)
        assert g.explained == pytest.approx(values[g.component - 1] / values.sum(), rel=1e-9)
        assert g.identity_error < 1e-9 and g.identity_error == got[0].identity_error
    assert {g.component for g in got} == set(range(1, 17)) and len({g.vec_id for g in got}) == len(rows) + 1


def test_whitening_without_variance_and_without_rows(spark):
    kind = "vec_id long, embedding array<float>"
    flat = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0, 2.0]), (2, [2.0, 4.0, 2.0]), (3, [3.0, 6.0, 2.0])], kind)).collect()
    assert [r.whitened is None for r in sorted(flat, key=lambda r: (r.vec_id, r.component))] == [False, True, True] * 3
    assert all(r.identity_error < 1e-9 for r in flat)
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])], kind)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 2
    for empty in ([], [(1, None), (2, [float("nan")])]):
        assert whitening.whitened(spark.createDataFrame(empty, kind)).count() == 0


def test_deviations_beyond_a_long():
    x = np.array([[2**40, 0, 5], [1, 2, 3]])
    n, sums = 10**9 + 7, [2**60 + 11, 7, -5]
    assert whitening.deviations(x, n, sums) == [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.deviations(x[1:], 5, [3, 4, 5]) == [(5 - 3) ** 2 + (10 - 4) ** 2 + (15 - 5) ** 2]


def plain_vector(paragraph: str):
    """The vector of one paragraph, by itself."""
    exact, like = multiset.paragraph_sums(pa.array([paragraph]))
    return exact[0], like[0]


def test_fingerprints_are_sums_over_paragraphs(texts):
    r = random.Random(6)
    samples = [t or "" for _, t in texts][::3] + ["a\n\nb c\n", "\n", "", "b c d e\nb c d e\na"]
    exact, like = multiset.paragraph_sums(pa.array(samples))
    for i, t in enumerate(samples):
        parts = t.split("\n")
        each = [plain_vector(p) for p in parts]
        assert (exact[i] == sum((e[0] for e in each[1:]), each[0][0])).all() and (like[i] == sum((e[1] for e in each[1:]), each[0][1])).all()
        r.shuffle(parts)
        again = multiset.paragraph_sums(pa.array(["\n".join(parts)]))
        assert (again[0][0] == exact[i]).all() and (again[1][0] == like[i]).all()
    keys = {hashlib.sha256("\0".join(sorted(t.split("\n"))).encode()).digest(): x for t, x in zip(samples, multiset.hex_digits((exact, like)), strict=True)}
    assert len(set(keys.values())) == len(keys)


def test_likeness_follows_the_shared_part():
    r = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    for share in (0.2, 0.5, 0.8):
        errors = []
        for _ in range(30):
            a = [r.choice(words) for _ in range(600)]
            b = a[: int(600 * share)] + [r.choice(words) for _ in range(600 - int(600 * share))]
            x, y = (multiset.paragraph_sums(pa.array([" ".join(t)])) for t in (a, b))
            errors.append(multiset.likeness(x, y)[0] - share)
        assert abs(np.mean(errors)) < 0.05 and np.abs(errors).max() < 0.25


@pytest.mark.parametrize("per_range", [1 << 12, 64 << 20])
def test_edited(docs, texts, spark, monkeypatch, per_range):
    monkeypatch.setattr(multiset, "RANGE_BYTES", per_range)
    rows = [*texts, (None, "no id here"), (None, None), *((77, f"same key {i}\nend {i}") for i in range(50)), (12345, "repeated\nrow"), (12345, "repeated\nrow")]
    table = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, h int, closing string").repartition(5)
    ordered = [(r.doc_id, r.text or "") for r in table.orderBy(F.asc_nulls_first("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    want = []
    for (key, t), (_, following) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        k = len(t) // 4
        new = t[: len(t) - k] + following[:k]
        fp = [multiset.paragraph_sums(pa.array([x])) for x in (t, new, following)]
        own, after = (multiset.hex_digits(x)[0] for x in fp[:2])
        want.append((key, len(t), hashlib.sha256(new.encode()).hexdigest(), own, after, float(multiset.likeness(fp[0], fp[1])[0]), float(multiset.likeness(fp[0], fp[2])[0])))
    by = lambda r: (r[0] is None, r[0] or 0, r[2], r[3], r[6])
    got = multiset.edited(table)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for g, w in zip(sorted(map(tuple, got.collect()), key=by), sorted(want, key=by), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:])
    alone = {(r.doc_id, r.fingerprint) for r in multiset.fingerprints(table).collect()}
    assert alone == {(w[0], w[3]) for w in want}


def test_edited_small_tables(spark):
    kind = "doc_id string, text string"
    assert multiset.edited(spark.createDataFrame([], kind)).count() == 0
    one = multiset.edited(spark.createDataFrame([("a", "x y\nz w")], kind)).first()
    assert (one.n_chars, one.near_next, one.edited_sha256) == (7, 1.0, hashlib.sha256(b"x y\nz x").hexdigest())
    empty = multiset.edited(spark.createDataFrame([("a", ""), ("b", None)], kind)).collect()
    assert [(r.near_edited, r.near_next) for r in empty] == [(1.0, 1.0)] * 2
