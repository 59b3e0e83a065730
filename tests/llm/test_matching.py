"""Jaccard join, decontamination and WARC archives against plain Python."""

import base64
import hashlib
import random
import re

import pytest

from pagemill.llm import decontaminate, jaccard, warc
from pagemill.llm.components import components


def _components(rows, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return {(d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize(("n", "percent", "small", "salt"), [(4, 85, 16, 2048), (4, 85, 3, 4), (5, 80, 16, 2048), (1, 60, 3, 2048)])
def test_jaccard(docs, texts, n, percent, small, salt):
    plan = jaccard.JaccardPlan(words=n, percent=percent, small_list=small, salt_from=salt, block=16)
    got = jaccard.similar_components(docs, plan).collect()
    assert len(got) == docs.count()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == _components(texts, n, percent)
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_small_sets_meet_by_subsets(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.sample("abcdefghijklmnopq", r.randrange(1, 17)))) for i in range(150)]
    plan = jaccard.JaccardPlan(words=1, percent=85)
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), plan).collect()
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == _components(rows, 1, 85)


def test_one_of_each(docs, texts):
    groups = {c for _, _, c in _components(texts, 5, 80)}
    got = [r.doc_id for r in jaccard.one_of_each(docs, jaccard.JaccardPlan(words=5, percent=80)).collect()]
    assert sorted(x for x in got if x is not None) == sorted(groups) and got.count(None) == 1
    assert jaccard.similar_components(docs.limit(0)).count() == 0


def _near(r, text, k):
    w = text.split(" ")
    w[k] = "new" + str(r.randrange(10**6))
    return " ".join(w)


def test_copies_of_a_row_without_id_are_linked(spark):
    r = random.Random(5)
    text = " ".join(str(r.randrange(1000)) for _ in range(120))
    rows = [(None, text), (7, text), (3, _near(r, text, 60)), (9, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {x.doc_id: x.component_id for x in jaccard.similar_components(docs).collect()}
    assert got == {None: None, 7: 3, 3: 3, 9: 3}


def test_one_of_each_by_text(spark):
    r = random.Random(6)
    a, b, c = (" ".join(str(r.randrange(1000)) for _ in range(120)) for _ in range(3))
    rows = [("5", a), ("5", b), ("5", b), ("4", _near(r, b, 50)), ("8", c), ("9", c + " "), ("1", ""), ("1", None), ("2", ""), (None, a), (None, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id string, text string, _copy int")
    got = jaccard.one_of_each(docs, jaccard.JaccardPlan(words=5, percent=80))
    assert got.columns == docs.columns
    want = [("5", a), ("4", rows[3][1]), ("8", c), ("1", ""), ("1", None), ("2", ""), (None, a), (None, None)]
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=str) == sorted(want, key=str)


def test_a_list_with_one_large_component(spark):
    # Near copies that share a passage with a few texts of their own: blocks compare the few with all, not all with all.
    r = random.Random(8)
    passage = " ".join(str(r.randrange(10**6)) for _ in range(20))
    base = passage + " " + " ".join(str(r.randrange(10**6)) for _ in range(100))
    rows = [(i, _near(r, base, 40 + i % 70)) for i in range(60)]
    rows += [(100 + i, passage + " " + " ".join(str(r.randrange(10**6)) for _ in range(2 + i))) for i in range(25)]
    plan = jaccard.JaccardPlan(small_list=2, salt_from=8, block=4, rounds=1)
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), plan).collect()
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == _components(rows, 4, 85)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def _distance(item, text):
    """Least edits of item to a stretch of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, x in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != x), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_decontamination(spark, docs):
    r = random.Random(11)

    def prose(n):
        return " ".join("".join(r.choice("abcdefé") for _ in range(r.randrange(2, 8))) for _ in range(n))

    items = [(i, prose(r.randrange(12, 40))) for i in range(12)] + [(50, "short"), (51, None), (52, ""), (0, prose(20))]
    rows = []
    for i in range(60):
        _, t = items[r.randrange(12)]
        t = list(t)
        for _ in range(r.randrange(0, max(1, len(t) // 6))):
            k, how = r.randrange(len(t)), r.randrange(3)
            t[k : k + 1] = {0: ["z"], 1: [], 2: [t[k], "z"]}[how]
        rows.append((i, f"{prose(r.randrange(0, 30))} {''.join(t).upper() if i % 7 == 0 else ''.join(t)}\n{prose(r.randrange(0, 30))}"))
    rows += [(100, None), (101, ""), (102, "a short one"), (5, rows[5][1])]
    budget = decontaminate.EditBudget()
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id, x.edits) for x in decontaminate.contamination(d, b, budget).collect()}
    blocks = {(x.doc_id, x.item_id, x.edits) for x in decontaminate.contamination(d, b, decontaminate.EditBudget(block_chars=300, part_chars=256)).collect()}
    want = set()
    for i, t in rows:
        for j, item in items:
            if item:
                e = _distance(item.lower(), (t or "").lower().replace("\n", " "))
                if e <= (budget.edits(len(item)) if len(item) >= budget.q else 0):
                    want.add((i, j, e))
    assert got == want == blocks
    hit = {i for i, _, _ in want}
    kept = decontaminate.decontaminated(d, b, budget)
    assert kept.columns == d.columns and sorted(x.doc_id for x in kept.collect()) == sorted(i for i, _ in rows if i not in hit)
    assert decontaminate.contamination(docs, b.limit(0)).count() == 0 and decontaminate.contamination(docs.limit(0), b).count() == 0


def test_an_item_cut_at_the_start_or_end_of_a_text(spark):
    r = random.Random(13)
    item = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(50))
    budget = decontaminate.EditBudget()
    k = budget.edits(len(item))
    rows = [(i, item[i:]) for i in range(1, k + 4)] + [(100 + i, item[: len(item) - i]) for i in range(1, k + 4)] + [(200 + i, "zz " + item[i:]) for i in range(1, k + 1)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {x.doc_id: (x.edits, x.start, x.end) for x in decontaminate.contamination(docs, bench, budget).collect()}
    want = {i: _distance(item, t) for i, t in rows}
    assert {i: e for i, (e, _, _) in got.items()} == {i: e for i, e in want.items() if e <= k}
    assert all(0 <= s < z <= len(dict(rows)[i]) for i, (_, s, z) in got.items())


def test_warc_round_trip(spark):
    pages = [(3, "http://a.b/x", "hi\r\n\r\nWARC/1.1"), (1, "https://www.A.b:80/X#f", None), (2, None, ""), (5, "u", "hi\r\n\r\nWARC/1.1"), (3, "http://a.b/x", "hi\r\n\r\nWARC/1.1"), (None, "q", "solo"), (7, "é", "solo"), (9, "é", "é日" * 9000)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, record_type string")
    got = warc.archive_pages(df).collect()
    assert len(got) == len(pages)
    seen, want = {}, []
    for p, _, h in sorted(pages, key=lambda x: (x[0] is None, x[0] or 0)):
        raw = (h or "").encode()
        first = seen.setdefault(raw, len(want))
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first == len(want) else "revisit", None if first == len(want) else want[first][0]))
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))
    order = [(r.url_key, r["at"], r.page_id is None, r.page_id or 0) for r in sorted(got, key=lambda r: (r.merge_range, r.merge_pos))]
    assert order == sorted(order)
    assert warc.archive_pages(df.limit(0)).count() == 0
    least = {(r.page_id, r.record_type) for r in warc.archive_pages(df, least_bytes=10).collect()}
    assert (2, "response") in least and (7, "response") in least and (5, "revisit") in least


def test_archives_of_odd_urls_and_sizes(spark, tmp_path):
    r = random.Random(12)
    pages = [(i, f"http://h{r.randrange(9)}.org/" + r.choice(["", "\n", "a\r\nb", "\nz"]) + str(r.randrange(50)), "é" * r.choice([5, 40_000, 600_000]) + str(i)) for i in range(50)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(warc.archive_pages(df, path=f"file://{tmp_path}/odd").collect(), key=lambda x: (x.merge_range, x.merge_pos))
    order = [(x.url_key, x["at"], x.page_id) for x in got]
    assert order == sorted(order) and {x.page_id: x.payload_bytes for x in got} == {i: len(h.encode()) for i, _, h in pages}
    assert all(x.stat().st_size < 80 << 20 for x in (tmp_path / "odd").glob("part-*"))


def test_payloads_come_back_whole(spark, tmp_path):
    r = random.Random(4)
    pages = [(i, f"http://h{i % 3}.org/{i}", "".join(chr(r.choice([13, 10, 65, 233, 0x1F389])) for _ in range(r.randrange(0, 400)))) for i in range(60)]
    where = f"file://{tmp_path}/warc"
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), where, file_bytes=7 << 16)
    got = {x.page_id: bytes(x.payload).decode() for x in warc.read_index(spark, where, payloads=True).filter("record_type = 'response'").collect()}
    assert got == {i: h for i, _, h in pages if i in got} and len(got) == len({h for _, _, h in pages})


def test_loser_tree():
    r = random.Random(9)
    for k in range(1, 9):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


def test_a_broken_archive_raises():
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))


def test_benchmark_ids_of_any_kind(spark):
    item = "the quick brown fox jumps over the lazy dog near the old stone bridge at noon while seven grey geese fly south"
    docs = spark.createDataFrame([(1, f"so {item} it is"), (2, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([("gsm-1", item), (None, None)], "item_id string, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()] == [(1, "gsm-1")]
    assert [r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()] == [2]
