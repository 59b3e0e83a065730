"""Quality rules, token counts, mixing, secrets and licenses against plain Python."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import licenses, mixing, quality, secrets, tokencount

WORD = r"[^\x20\x09-\x0D]+"


def test_quality(docs, texts):
    got = collections.defaultdict(list)
    for r in quality.quality_rules(docs).collect():
        got[r.doc_id].append(r)
    assert quality.quality_rules(docs).columns.count("kept") == 1
    for i, t in texts:
        t = t or ""
        w = re.findall(WORD, t)
        three = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        r = got[i][0]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    assert len(got[3]) == 2 and got[0][0].ratio > 1.5


def test_quality_bands_reject_noise_and_repetition(spark):
    r = random.Random(1)
    noise = " ".join("".join(chr(r.randrange(33, 0x2FF)) for _ in range(9)) for _ in range(400))
    same = " ".join(f"{i % 7} alpha beta gamma {i % 11}" for i in range(900))
    rows = {x.doc_id: x for x in quality.quality_rules(spark.createDataFrame([(1, noise), (2, same)], "doc_id long, text string")).collect()}
    assert not rows[2].kept and rows[2].ratio > 5
    assert rows[1].ratio < 1.6


def test_quality_of_nothing(docs):
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_token_counts(docs, texts):
    pieces = tokencount.read_pieces(tokencount.TokenPlan())

    def best(w: bytes):
        score, n = [0.0] + [-1e300] * len(w), [0] * (len(w) + 1)
        for d in range(1, len(w) + 1):
            for k in range(min(d, 128), 0, -1):
                s = pieces.get(w[d - k : d])
                if s is not None and score[d - k] + s > score[d]:
                    score[d], n[d] = score[d - k] + s, n[d - k] + 1
        return n[-1], score[-1]

    got = {r.doc_id: r for r in tokencount.token_counts(docs).collect()}
    memo: dict = {}
    for i, t in texts:
        parts = re.findall(WORD.encode(), (t or "").encode())
        each = [memo[p] if p in memo else memo.setdefault(p, best(b" " + p)) for p in parts]
        assert (got[i].n_pretokens, got[i].n_tokens) == (len(parts), sum(n for n, _ in each))
        assert got[i].log_score == pytest.approx(sum(s for _, s in each))


@pytest.mark.parametrize("tile", [7, 130, 1 << 16])
def test_a_long_word_is_one_pre_token(tile):
    pieces = tokencount.Pieces(tokencount.read_pieces(tokencount.TokenPlan()))
    r = random.Random(4)
    for word in ("-" * 700, "=" * 64 + "thethe" * 100, "".join(r.choice("abct é") for _ in range(600)).replace(" ", ""), "https://" + "x/" * 300):
        b = np.frombuffer(b" " + word.encode(), np.uint8)
        n, score = tokencount.segment(b[None, :], np.array([len(b)]), pieces)
        assert tokencount.segment_path(b, pieces, tile) == (n[0], pytest.approx(score[0]))


def test_mix(docs):
    rows = mixing.mix_sources(docs, mixing.MixPlan()).collect()
    assert len(rows) == docs.count()
    size = collections.Counter()
    for r in rows:
        size[r.source] += r.size
    total = sum(size.values())
    names = sorted(s for s in size if s is not None) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:  # share, cap, share the rest again
        left = 1.5 * total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in over}
        open_ -= over
    taken = collections.Counter()
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in names)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    made = mixing.mixed(docs)
    assert made.count() == sum(r.copies for r in rows) and made.columns == [*docs.columns, "copy"]
    assert mixing.mix_sources(docs.limit(0)).count() == 0


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _spans(t: str):
    s = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    s += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(s)


def test_secrets(spark):
    r = random.Random(3)
    bits = ["password=", "Token : '", "api_key=", "secret=short ", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, " é\U0001f389 ", "abcdefgh12", "\n", "\x01", "\x02x", "'", "passwdtoken=secret=longvalue99"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 14))) for _ in range(150)] + [None, "", "password=12345678 " * 5000, "ghp_" + "a1B2" * 10]
    docs = spark.createDataFrame([(i % 140, t, "x") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, found string")
    rows, ledger, findings = secrets.secret_scan(docs)
    got = collections.Counter()
    for x in rows.select("doc_id", secrets.span_digest(F.col("found"), True).alias("s")).collect():
        got[x.doc_id, x.s or ""] += 1
    want = collections.Counter((i % 140, ",".join(f"{k}:{a}:{z}" for a, _, z, k in _spans(t or ""))) for i, t in enumerate([*texts, texts[0]]))
    assert got == want
    # A second run over the same blobs scans none of them and reports the same.
    again, ledger2, _ = secrets.secret_scan(docs, ledger, findings)
    assert secrets.unseen_blobs(docs, ledger, "text", "doc_id", secrets.rule_version()).count() == 0
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    assert ledger2.count() == ledger.count() == len({hashlib.sha256((t or "").encode()).hexdigest() for t in texts})
    clean = {x.doc_id: x.text for x in secrets.redacted(docs, findings).filter("doc_id = 13").collect()}
    assert all(not _spans(t or "") for t in clean.values())
    # Other rules: each row once, by those rules only, and the blobs are scanned for them.
    more = (*secrets.RULES, secrets.Rule("emoji", "\U0001f389+"))
    assert secrets.unseen_blobs(docs, ledger, "text", "doc_id", secrets.rule_version(more)).count() == ledger.count()
    other, ledger3, findings3 = secrets.secret_scan(docs, ledger, findings, more)
    plain, _, _ = secrets.secret_scan(docs, rules=more)
    assert sorted(map(str, other.collect())) == sorted(map(str, plain.collect())) and other.count() == docs.count()
    assert ledger3.count() == 2 * ledger.count()
    back, _, _ = secrets.secret_scan(docs, ledger3, findings3)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


@pytest.mark.parametrize("most", [200_000, 0])
def test_redaction_keeps_other_columns(spark, most):
    rows = [(1, "a password=12345678 b", 5, "x", 1.5), (2, None, 6, "y", None), (3, "", None, None, 2.0), (1, "a password=12345678 b", 5, "x", 1.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _found int, _blob string, _Salt double")
    _, _, findings = secrets.secret_scan(docs)
    got = secrets.redacted(docs, findings, most_broadcast=most)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, t and t.replace("password=12345678", "[assign]"), *x) for i, t, *x in rows], key=str)


def test_kept_documents_keep_their_columns(spark):
    r = random.Random(8)
    texts = [" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n)) for n in (30, 60, 90, 400)] + [None, "same " * 200]
    docs = spark.createDataFrame([(i, t, 1, "own", {"a": i}) for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string, m map<string,int>")
    verdict = quality.quality_rules(docs.select("doc_id", "text"))
    got = quality.kept_documents(docs)
    assert got.schema == docs.schema
    want = sorted(r.doc_id for r in verdict.filter("kept").collect())
    assert sorted(r.doc_id for r in got.collect()) == want != [] and {r["n_words"] for r in got.collect()} == {1}


def test_verdict_of_compression(docs, texts):
    import zstandard

    cfg = quality.CompressionBands()
    size = lambda b: len(zstandard.ZstdCompressor(level=cfg.level, write_content_size=False).compress(b))
    for r in quality.quality_rules(docs.filter("doc_id IS NOT NULL")).collect():
        b = (dict(texts)[r.doc_id] or "").encode()
        ratio = len(b) / size(b) if b else 1.0
        low, high = next((lo, hi) for least, lo, hi in reversed(cfg.bands) if len(b) >= least)
        parts = [b[k : k + cfg.chunk_bytes] for k in range(0, len(b), cfg.chunk_bytes)]
        parts = [p for k, p in enumerate(parts) if k * cfg.chunk_bytes < len(b) - cfg.chunk_bytes // 2] if len(b) >= 2 * cfg.chunk_bytes else []
        bad = sum(not cfg.chunk_low <= len(p) / size(p) <= cfg.chunk_high for p in parts) / len(parts) if parts else 0.0
        assert (r.ratio, r.bad_chunk_share) == (pytest.approx(ratio), pytest.approx(bad))
        assert r.kept == (not r.base_failed and low <= ratio <= high and bad <= cfg.bad_chunks)


def test_mix_of_rows_with_one_size_and_key(spark):
    rows = [(1, f"{w} b c", "s", 9) for w in ("x", "y", "z", "u")] + [(2, "k l", "t", 1), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    got = [sorted(map(str, mixing.mixed(docs.repartition(n)).collect())) for n in (1, 3)]
    assert got[0] == got[1] and mixing.mixed(docs).columns == ["doc_id", "text", "source", "copy", "copy_"]


def test_licenses(spark, docs):
    lines = licenses.TEMPLATES
    r = random.Random(5)

    def words(t):
        return re.sub(r"[^\w]+|_", " ", (t or "").lower()).split()

    rows = []
    for i in range(40):
        name = r.choice(list(lines))
        w = lines[name].split()
        if i % 3 == 0 and len(w) > 12:
            w[r.randrange(len(w))] = "changed"
        if i % 5 == 0:
            w = w[: len(w) // 2]
        rows.append((i, "before that " * r.randrange(0, 30) + " ".join(w) + " and after" * r.randrange(0, 30)))
    rows += [(50, None), (51, ""), (52, "MIT License"), (53, lines["mit-notice"]), (53, lines["mit-notice"])]
    got = {(x.doc_id, x.template): x.containment for x in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def sh(w):
        return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]

    want = {}
    for i, t in rows:
        d = sh(words(t))
        for name, line in lines.items():
            s = set(sh(words(line)))
            stride = max(1, len(s) // 4)
            share = max((len(s & set(d[k : k + len(s) + stride - 1])) / len(s) for k in range(0, max(1, len(d)), stride)), default=0)
            if share >= 0.8:
                want[i, name] = share
    assert set(got) == set(want)
    assert got == pytest.approx(want)
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_hash_arithmetic_wraps_quietly():
    from pagemill.llm import textbytes as tb

    with np.errstate(all="raise"):
        assert tb.hash_word(b"abc") != tb.hash_word(b"acb")


def test_licenses_with_one_word_changed(spark):
    plan, r = licenses.LicensePlan(), random.Random(6)
    rows, want = [], {}
    for name, text in licenses.TEMPLATES.items():
        words = re.findall(r"[^\W_]+", text.lower())
        whole = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        for k in range(len(words)):
            changed = [*words[:k], "qqq", *words[k + 1 :]]
            share = len(whole & {tuple(changed[i : i + 5]) for i in range(len(changed) - 4)}) / len(whole) if whole else 0
            for _ in range(12 if share >= plan.containment else 0):
                around = [[f"w{r.randrange(10**6)}" for _ in range(r.randrange(0, 40))] for _ in range(2)]
                want[len(rows), name] = share
                rows.append((len(rows), " ".join([*around[0], *changed, *around[1]])))
    got = {(x.doc_id, x.template): x.containment for x in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want and all(got.get(k, 0) == pytest.approx(v) for k, v in want.items()), len([k for k in want if k not in got])
