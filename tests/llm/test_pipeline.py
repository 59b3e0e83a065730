"""Each stage of the pipeline, on what the stage before kept, equals a plain version of its rule."""

import collections
import hashlib
import math
import random
import re

import pytest
import zstandard
from test_matching import _components, _distance
from test_texts import WORD

from pagemill.llm import decontaminate, quality, secrets

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def _syllables(r, n):
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ru", "ten", "sar", "é", "qu", "in", "ost"]) for _ in range(r.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(21)
    bench = [(i, _syllables(r, 25)) for i in range(4)] + [(9, None), (10, "")]
    base = [_syllables(r, r.randrange(60, 160)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(10)]  # copies
    rows += [(200 + i, base[i].replace(" ", "  ", 3) + " end" + str(i)) for i in range(8)]  # near copies
    rows += [(300 + i, f"{_syllables(r, 40)}\n{bench[i % 4][1][i % 3 :]} {_syllables(r, 30)}") for i in range(8)]  # passages of the benchmark
    rows += [(400 + i, f"{_syllables(r, 60)} password=abcd123456{i} {_syllables(r, 20)} AKIA{'ABCD1234' * 2}") for i in range(8)]
    rows += [(500, None), (501, ""), (502, "few words"), (503, "same again " * 300), (3, base[3]), (4, base[5] + " other"), (None, base[6]), (None, _syllables(r, 70))]
    docs = [(i, t, "en", None if k % 9 == 0 else f"s{k % 4}", len(t or ""), k, "own") for k, (i, t) in enumerate(rows)]
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, copy int, _blob string").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, [t for _, t in bench if t]


def _kept(t):
    t, cfg = t or "", quality.CompressionBands()
    w = re.findall(WORD, t)
    three = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
    if len(w) < 50 or 100 * len(covered) > 50 * len(w):
        return False
    size = lambda b: len(zstandard.ZstdCompressor(level=cfg.level, write_content_size=False).compress(b))
    b = t.encode()
    low, high = next((lo, hi) for least, lo, hi in reversed(cfg.bands) if len(b) >= least)
    parts = [b[k : k + 1024] for k in range(0, len(b) - 512, 1024)] if len(b) >= 2048 else []
    bad = sum(not cfg.chunk_low <= len(p) / size(p) <= cfg.chunk_high for p in parts)
    return low <= len(b) / size(b) <= high and bad <= cfg.bad_chunks * len(parts)


def _clean(t):
    spans = []
    for rank, rule in enumerate(secrets.RULES):
        spans += [(m.start(), rank, m.end(), rule.kind) for m in re.finditer(rule.pattern, t) if len(m[rule.value_group] or "") >= rule.value_least]
    out, at = "", 0
    for a, _, z, kind in sorted(spans):
        if a >= at:
            out += t[at:a] + f"[{kind}]"
        at = max(at, z)
    return out + t[at:]


def _mixed(rows):
    """Copies taken of each (doc_id, size, source): targets by weight with caps, then systematic sampling along sizes."""
    size = lambda t: len(re.findall(WORD, t or ""))
    digits = lambda v, n: int(hashlib.md5(f"{'' if v is None else v}/10".encode()).hexdigest()[:n], 16)
    per = collections.Counter()
    for x in rows:
        per[x.source] += size(x.text)
    names = sorted((s for s in per if s is not None)) + [None] * (None in per)
    weight, target, open_ = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, {}, set(names)
    while open_:
        left = 1.5 * sum(per.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * per[s]}
        target |= {s: 2.0 * per[s] for s in over} if over else share
        open_ = open_ - over if over else set()

    def place(x):
        n = size(x.text)
        octave = len(bin(n)) - 2
        return 16 * octave + 16 * n // (1 << (octave - 1)), digits(x.doc_id, 4) % 64, n, x.doc_id is not None, x.doc_id or 0

    taken = collections.Counter()
    for s in names:
        rate, offset = target[s] / per[s] if per[s] else 0.0, digits(s, 12) / 16.0**12
        for k, x in enumerate(sorted((x for x in rows if x.source == s), key=place), 1):
            taken[x.doc_id, size(x.text), s] += math.floor(offset + k * rate) - math.floor(offset + (k - 1) * rate)
    return +taken


def test_stages(spark, tables):
    where, bench = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, where)
        seen.append(docs.collect())
        docs = spark.createDataFrame(seen[-1], docs.schema)
        assert docs.columns == (columns if name != "mix" else [*columns, "copy_"])
    rows, quality_kept, near, clean, secret, mix = seen
    assert sorted(map(str, quality_kept)) == sorted(map(str, (x for x in rows if _kept(x.text))))

    # One of each component stays: the smallest id; rows without id all stay.
    named = [(k, x.text) for k, x in enumerate(sorted((x for x in quality_kept if x.doc_id is not None), key=lambda x: x.doc_id))]
    order = sorted((x for x in quality_kept if x.doc_id is not None), key=lambda x: x.doc_id)
    firsts = {c for _, _, c in _components(named, 5, 80)}
    want = [order[k].doc_id for k in firsts] + [None] * sum(x.doc_id is None for x in quality_kept)
    assert sorted(map(str, (x.doc_id for x in near))) == sorted(map(str, want)) and {str(x) for x in near} <= {str(x) for x in quality_kept}

    budget = decontaminate.EditBudget()
    hit = lambda t: any(_distance(b.lower(), t.lower().replace("\n", " ")) <= budget.edits(len(b)) for b in bench)
    assert sorted(map(str, clean)) == sorted(map(str, (x for x in near if not hit(x.text)))) and len(clean) < len(near)

    want = [(x.doc_id, _clean(x.text), x.lang, x.source, len(_clean(x.text)), x["copy"], x["_blob"]) for x in clean]
    assert sorted(map(str, map(tuple, secret))) == sorted(map(str, want)) and any("[assign]" in x.text for x in secret)

    got = collections.Counter((x.doc_id, len(re.findall(WORD, x.text)), x.source) for x in mix)
    assert got == _mixed(secret)
    assert sorted(map(str, corpus_pipeline.run(spark, where).collect())) == sorted(map(str, mix))


def test_stages_of_nothing(spark, tables, tmp_path):
    where, _ = tables
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{where}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
