import hashlib
import hmac
import io
import random
import struct
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from pagemill.functions import policy
from pagemill.operators import admission, export, pages, usage
from pagemill.sources import logs, web


def test_summary_of_a_small_log(spark):
    rows = [
        ("2026-05-10T01:00:00", "pageview", "a", "desktop", None, None), ("2026-05-10T02:00:00", "extract", "a", "desktop", 90, "ok"), ("2026-05-10T03:00:00", "export", "b", "mobile", None, None),
        ("2026-05-09T01:00:00", "extract", "a", "desktop", 800, "robots"), ("2026-05-09T01:10:00", "extract", None, None, 20, "ok"), ("2026-05-09T01:20:00", "pageview", "z", "bot", None, None),
        ("2026-04-01T01:20:00", "pageview", "old", "mobile", None, None),
    ]
    e = usage.complete(spark.createDataFrame(rows, "t string, type string, v string, dev string, ms long, outcome string"))
    span = usage.Span(date(2026, 5, 10), 7)
    t = usage.totals(e, span).first()
    assert (t.eventCount, t.pageviews, t.extractions, t.extractionsOk, t.exports, t.visitors) == (5, 1, 3, 2, 1, 3)
    assert {r.day: r.visitors for r in usage.daily(e, span).collect()} == {date(2026, 5, d): {10: 2, 9: 1}.get(d, 0) for d in range(4, 11)}
    d = usage.durations(e, span).first()
    assert (d.p50, d.p95, d.avg, d.samples) == (90, 800, 303, 3)
    f = usage.funnel(e, span).first()
    assert (f.visited, f.extracted, f.exported) == (3, 2, 1)
    assert {(r.dimension, r.key): r.n for r in usage.breakdowns(e, span).collect()}["outcomes", "ok"] == 2


def test_visitor_hash_is_hmac(spark):
    made = spark.createDataFrame([("s%alt", "1.2.3.4", "UA é")], "s string, ip string, ua string").select(usage.visitor_hash(F.col("s"), F.col("ip"), F.col("ua"))).first()[0]
    assert made == hmac.new(b"s%alt", "1.2.3.4|UA é".encode(), hashlib.sha256).hexdigest()[:16]


def test_limiter_against_a_loop(spark):
    r = random.Random(1)
    rows = [(i, f"k{r.randrange(3)}", r.randrange(400)) for i in range(300)]
    got = {x.id: x.allowed for x in admission.rate_limited(spark.createDataFrame(rows, "id long, k string, at long"), "k", "at", "id", 5, 50).collect()}
    held: dict = {}
    for i, k, t in sorted(rows, key=lambda x: (x[2], x[0])):
        held[k] = [x for x in held.get(k, []) if t - x < 50] + [t]
        assert got[i] == (len(held[k]) <= 5)


def test_redeem_locks_after_failures(spark):
    invites = spark.createDataFrame([("a", 1, "h", False, 10**9)], "email string, sent_ms long, invite_hash string, used boolean, expires_ms long")
    attempts = [("a", "x", t) for t in range(5)] + [("a", "h", 10), ("a", "h", 900_010), ("b", "h", 1)]
    got = {(r.email, r.at_ms): r.result for r in admission.redeemed(spark.createDataFrame(attempts, "email string, code_hash string, at_ms long"), invites).collect()}
    assert got["a", 4] == "wrong" and got["a", 10] == "locked" and got["a", 900_010] == "ok" and got["b", 1] == "unknown"


@pytest.mark.parametrize(("text", "path", "allowed"), [
    ("User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/b/c", True), ("User-agent: *\nDisallow: /", "/x", False), ("User-agent: me\nUser-agent: *\nDisallow:", "/x", True),
    ("User-agent: *\nDisallow: /\nUser-agent: me", "/x", True), ("User-agent: *\nDisallow: /*.pdf$", "/a.pdf", False), ("User-agent: *\nDisallow: /*.pdf$", "/a.pdf?x", True), ("User-agent: *\nDisallow: /a+b # c", "/a+b", False), ("", "/", True),
])
def test_robots(spark, text, path, allowed):
    rows = spark.createDataFrame([(text, path)], "t string, p string")
    assert rows.select(policy.path_allowed(policy.parse_robots(F.col("t"), F.lit("me")), F.col("p"))).first()[0] == allowed


def test_addresses(spark):
    v4 = {"8.8.8.8": False, "10.1.2.3": True, "172.32.0.1": False, "1.2.3": True, "256.1.1.1": True, "224.0.0.1": True, "100.63.255.255": False, "": True, "198.19.1.1": True}
    got = spark.createDataFrame([(k,) for k in v4], "ip string").select("ip", policy.ipv4_blocked(F.col("ip")).alias("b")).collect()
    assert {r.ip: r.b for r in got} == v4
    v6 = {"::1": True, "fe80::1%eth0": True, "2606:4700::1": False, "::ffff:10.0.0.1": True, "::ffff:8.8.8.8": False, "64:ff9b::808:808": False, "64:ff9b::a00:1": True, "2002:a00:1::": True, "2001:db8::": True, "x": True, "fdaa::3": True,
          "::": True, "::8.8.8.8": True, "2001:0:1::": True, "1:2:3:4:5:6:7": True, "1:2:3:4:5:6:7:8": False, "1::2::3": True, "1:2:3:4:5:6:7::": False, ":1:2:3:4:5:6:7": True, "::ffff:1.2.3.256": True, "2606:4700::8.8.8.8": False, "ff02::1": True, "12345::": True, "": True, None: True}
    got = spark.createDataFrame([(k,) for k in v6], "ip string").select("ip", policy.ipv6_blocked(F.col("ip")).alias("b")).collect()
    assert {r.ip: r.b for r in got} == v6


def test_urls_that_may_not_be_fetched(spark):
    want = {
        "http://a.org/": None, "https://A.org:443/x?y#z": None, "http://exa_mple.example.org/": None, "http://a.org:8080/": "port", "ftp://a.org/": "scheme", "mailto:a@b": "scheme", "x": "invalid", "": "invalid", None: "invalid",
        "http://u:p@a.org/": "credentials", "http://@a.org/": "credentials", "http://[::1]/x": "address", "http://[2606:4700::1]/x": None, "http://[::ffff:7f00:1]:80/": "address", "http://127.0.0.1/": "address", "http://127.1/": "address",
        "http://2130706433/": "address", "http://0x7f.0.0.1/": "address", "http://0177.0.0.1/": "address", "http://8.8.8.8/": None, "http://134744072/": None, "http://256.1.1.1/": "invalid", "http://1.2.3.4.5/": "invalid", "http://10.0.0.1./": "address",
        "http://printer/": "host", "http://a.internal/": "host", "http://localhost./": "host", "http://x.localhost/": "host", "http://1.2.3.org/": None, "http://a b/": "invalid",
    }
    got = spark.createDataFrame([(k,) for k in want], "u string").select("u", policy.url_problem(F.col("u")).alias("p")).collect()
    assert {r.u: r.p for r in got} == want


def test_redirects_meet_the_guard_and_robots_on_every_hop(spark):
    def row(url, status, location, body=b"secret", at=5):
        return (url, status, location, "text/html", body, None, None, at)

    responses = [
        row("http://a.org/", 302, "http://[::1]/x"), row("http://[::1]/x", 200, None), row("http://b.org/", 302, "/no/1"), row("http://b.org/no/1", 200, None), row("http://c.org/", 301, "p"), row("http://c.org/p", 200, None, b"fine"),
        row("http://c.org/p", 200, None, b"older", 1), row("http://c.org/", 404, None, b"", 1), row("http://d.org/", 200, None), row("http://e.org/", 200, None), row("http://e.org/", 200, None),
    ]
    table = spark.createDataFrame(responses, "url string, status int, location string, content_type string, body binary, error_class string, error_message string, fetched_ms long")
    said = spark.createDataFrame([("http://a.org", 404, None, 90), ("http://b.org", 200, "User-agent: *\nDisallow: /no/", 90), ("http://c.org", 404, None, 90), ("http://e.org", 404, None, 90)], "origin string, status int, body string, fetched_ms long")
    urls = spark.createDataFrame([(f"http://{x}.org/",) for x in "abcdee"], "url string")
    got = sorted((r.url, r.html, r.fetch_error_kind) for r in web.fetched_pages(urls, table, robots=policy.robots_table(said, "me"), now_ms=F.lit(100)).collect())
    assert got == [("http://a.org/", None, "blocked-url"), ("http://b.org/", None, "robots"), ("http://c.org/", "fine", None), ("http://d.org/", None, "robots"), ("http://e.org/", "secret", None), ("http://e.org/", "secret", None)]
    free = {r.url: r.html for r in web.fetched_pages(urls, table).collect()}
    assert (free["http://a.org/"], free["http://b.org/"], free["http://d.org/"]) == (None, "secret", "secret")


def test_fetch_options(spark):
    rows = [("member", None, None, None, None), ("member", 5.0, "fr", False, False), ("anon", 1e9, "FR", True, True), ("owner", float("nan"), "eng", None, None), (None, 2000.0, "de\n", None, True)]
    table = spark.createDataFrame(rows, "tier string, ms double, lang string, meta boolean, img boolean")
    got = [tuple(r)[:4] + (r.pageBytes,) for r in table.select(policy.fetch_options(*map(F.col, table.columns)).alias("o")).select("o.*").collect()]
    assert got == [(True, True, "en", 12000.0, 5_000_000), (False, False, "fr", 1000.0, 5_000_000), (False, True, "en", 12000.0, 3_000_000), (False, True, "en", 12000.0, 5_000_000), (False, True, "en", 2000.0, 3_000_000)]


NULLS = [(1, "a", 10, None, 1), (2, "a", None, "anon", 1), (3, None, 11, "anon", 1), (4, "a", 12, None, 1), (5, "a", 13, None, 1), (None, None, None, None, None), (6, None, 86_400_010, "anon", 1), (7, "a", 12, None, 1)]


def test_no_request_is_lost_to_nulls(spark):
    r = spark.createDataFrame([(*x, 0, 0, 0) for x in NULLS], "id long, k string, at long, tier string, running int, _slot int, own int, day int")
    limited = admission.rate_limited(r, "k", "at", "id", 2, 100)
    assert limited.columns == [*r.columns, "hits", "allowed"]
    assert {x.id: (x.hits, x.allowed) for x in limited.collect()} == {1: (1, True), 4: (2, True), 7: (3, False), 5: (4, False), 2: (None, True), 3: (1, True), None: (None, True), 6: (1, True)}
    capped = admission.daily_capped(r, "at", "id", 2)
    assert {x.id: (x.used, x.within_cap) for x in capped.collect()} == {1: (1, True), 4: (2, True), 7: (3, False), 5: (4, False), 2: (None, True), 3: (1, True), None: (None, True), 6: (1, True)}
    done = {x.id: x.decision for x in admission.admitted(r, "k", "at", "id", 3, 100, F.col("id") != 6, 2).collect()}
    assert done == {1: "run", 4: "run", 7: "capped", 5: "limited", 2: "run", 3: "run", None: "invalid", 6: "invalid"}
    runs = admission.too_many_at_once(r.withColumn("end", F.when(F.col("id") < 4, F.col("at") + 2)), "at", "end", 2)
    assert {x.id: (x.running, x.busy) for x in runs.collect()} == {1: (1, False), 3: (2, False), 4: (3, True), 7: (3, True), 5: (3, True), 2: (None, False), None: (None, False), 6: (4, True)}
    assert runs.columns.count("running") == 1


def test_file_names(spark):
    names = {"a/b:c": "a-b-c", "  x \t y. ": "x - y", "": "article", "...": "article", "日本": "日本", "x" * 200: "x" * 120}
    got = spark.createDataFrame([(k,) for k in names], "t string").select("t", export.file_name(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == names


def test_zip_round_trip(spark):
    items = spark.createDataFrame([(1, i, n, bytearray(n.encode())) for i, n in enumerate(["a.txt", "a.txt", "a (2).txt", "é.txt"])], "g int, o int, name string, content binary")
    row = export.zipped(items, "g", "o").first()
    with zipfile.ZipFile(io.BytesIO(bytes(row.zip))) as z:
        assert z.testzip() is None
        assert z.namelist() == ["a.txt", "a (2).txt", "a (2) (2).txt", "é.txt"]
    with pytest.raises(Exception, match="2 items at most"):
        export.zipped(items, "g", "o", most=2).collect()


def test_json_is_indented(spark):
    assert spark.createDataFrame([('{"a":[1],"b":"é"}',)], "j string").select(export.pretty_json(F.col("j"))).first()[0] == '{\n  "a": [\n    1\n  ],\n  "b": "é"\n}'


def test_failed_fetch_of_events_raises(spark):
    with pytest.raises(Exception, match="no page for u"):
        pages.extract_events(spark.createDataFrame([(1, "u", None)], "page_id long, url string, html string")).collect()


def test_null_and_empty_pages(spark):
    p = spark.createDataFrame([(1, None, None), (2, None, ""), (3, "x", "<p>"), (None, "http://a.org", "<title>T</title>")], "page_id long, url string, html string")
    got = {r.page_id: (r.title, r.domain) for r in pages.extract_articles(p).collect()}
    assert got == {2: ("", None), 3: ("", None), None: ("T", "a.org")}
    assert pages.html_nodes(p.limit(0)).count() == 0


def test_event_log_round_trip(spark, tmp_path):
    where = str(tmp_path / "log")
    e = spark.createDataFrame([(datetime(2026, 5, 10, 1), "pageview"), (datetime(2026, 5, 9, 1), "extract"), (datetime(2026, 1, 1), "boot")], "t timestamp, type string")
    logs.append_events(e, where)
    broken = next((tmp_path / "log" / "day=2026-05-10").glob("part-*"))
    (broken.parent / "part-x.json").write_text('{"t": "2026-05-10T05:00:00Z", "type": "boot"}\n\n{broken\n')
    got = logs.read_events(spark, where, date(2026, 5, 10), 2)
    assert sorted(r.type for r in got.collect()) == ["boot", "extract", "pageview"]
    assert logs.drop_old_days(spark, where, date(2026, 5, 10), 90) == ["2026-01-01"]


def test_picture_headers():
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 3, 4)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 5, 6) + b"\x00" * 8
    assert web.image_header(png) == ("png", 3, 4)
    assert web.image_header(jpeg) == ("jpeg", 6, 5)
    assert web.image_header(b"GIF89a" + struct.pack("<HH", 7, 8)) == ("gif", 7, 8)
    assert web.image_header(b"nothing") is None
