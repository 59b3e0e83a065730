"""A crawl of a server on this machine: every hop meets the guard and robots.txt, every refusal is a row."""

import socket
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from pagemill.sources import crawl, web

NOW = 1_800_000_000_000
SITES = {
    "a.org/robots.txt": (200, {}, b"User-agent: *\nDisallow: /private\nDisallow: /also\nAllow: /private/open\n"),
    "a.org/ok": (200, {"Content-Type": "text/html"}, b"<p>fine</p>"),
    "a.org/latin": (200, {"Content-Type": "text/html; charset=windows-1252"}, "<p>café – €</p>".encode("cp1252")),
    "a.org/to": (302, {"Location": "http://b.org/end"}, b""),
    "a.org/same": (301, {"Location": "/ok"}, b""),
    "a.org/loop": (302, {"Location": "/loop2"}, b""),
    "a.org/loop2": (302, {"Location": "/loop"}, b""),
    "a.org/inner": (302, {"Location": "http://[::1]/x"}, b""),
    "a.org/metadata": (302, {"Location": "http://169.254.169.254/latest"}, b""),
    "a.org/hidden": (302, {"Location": "/private/1"}, b""),
    "a.org/private/1": (200, {}, b"secret"),
    "a.org/private/open": (200, {}, b"open"),
    "a.org/gone": (404, {}, b"no"),
    "a.org/declared": (200, {}, b"x" * 6000),
    "a.org/undeclared": (200, {"chunked": "1"}, b"x" * 6000),
    "a.org/slow": (200, {"slow": "1"}, b"late"),
    "b.org/end": (200, {}, b"end"),
    "c.org/robots.txt": (503, {}, b""),
    "c.org/page": (200, {}, b"page"),
    "d.org/robots.txt": (302, {"Location": "http://a.org/robots.txt"}, b""),
    "d.org/also": (200, {}, b"also"),
    "d.org/free": (200, {}, b"free"),
}


@pytest.fixture
def server():
    seen: Counter = Counter()

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_GET(self):
            name = self.headers["Host"] + self.path
            seen[name] += 1
            status, headers, body = SITES.get(name, (404, {}, b""))
            if "slow" in headers:
                time.sleep(3)
            self.send_response(status)
            for k in ("Content-Type", "Location"):
                if k in headers:
                    self.send_header(k, headers[k])
            if "chunked" in headers:
                self.send_header("Transfer-Encoding", "chunked")
                body = b"%x\r\n%s\r\n0\r\n\r\n" % (len(body), body)
            else:
                self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            try:
                self.wfile.write(body)
            except OSError:
                pass  # the other side left

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s.server_address[1], seen
    s.shutdown()


def _plan(port, **more):
    return crawl.FetchPlan(max_bytes=5000, timeout_ms=1000, tasks=3, addresses=tuple((f"{h}.org", "127.0.0.1", port) for h in "abcd"), **more)


def _pages(spark, urls, plan, folder, known=None):
    table = spark.createDataFrame([(u,) for u in urls], "url string")
    responses, robots = crawl.crawled(table, f"file://{folder}", plan, known, NOW)
    pages = web.fetched_pages(table, responses, plan.max_bytes, plan.redirects, robots, F.lit(NOW))
    return {r.url: (r.final_url, r.html, r.fetch_error) for r in pages.collect()}, responses, robots


def test_hops_guard_and_robots(spark, tmp_path, server):
    port, seen = server
    names = ["ok", "latin", "to", "same", "loop", "inner", "metadata", "hidden", "private/1", "private/open", "gone", "declared", "undeclared", "slow"]
    urls = [f"http://a.org/{n}" for n in names] + ["http://c.org/page", "http://d.org/also", "http://d.org/free", "http://10.0.0.1/", "ftp://a.org/x", "http://u:p@a.org/", "http://a.org:8080/", "no url", None]
    got, responses, robots = _pages(spark, urls, _plan(port), tmp_path / "one")
    a = "http://a.org/"
    assert got[a + "ok"] == (a + "ok", "<p>fine</p>", None)
    assert got[a + "latin"][1] == "<p>café – €</p>"
    assert got[a + "to"] == ("http://b.org/end", "end", None)
    assert got[a + "same"] == (a + "ok", "<p>fine</p>", None)
    assert got[a + "private/open"][1] == "open" and got["http://d.org/free"][1] == "free"
    assert got[a + "loop"][1:] == (None, "too many redirects")
    assert got[a + "gone"][1:] == (None, "HTTP 404")
    assert got[a + "declared"][1:] == got[a + "undeclared"][1:] == (None, "page too large")
    assert got[a + "slow"][1] is None and "timed out" in got[a + "slow"][2]
    for name in ("inner", "metadata"):
        assert got[a + name][1:] == (None, "address not allowed: address")
    for url in (a + "hidden", a + "private/1", "http://c.org/page", "http://d.org/also"):
        assert got[url][1] is None and "robots.txt" in got[url][2], url
    for url, why in (("http://10.0.0.1/", "address"), ("ftp://a.org/x", "scheme"), ("http://u:p@a.org/", "credentials"), ("http://a.org:8080/", "port"), ("no url", "invalid")):
        assert got[url][1:] == (None, f"address not allowed: {why}")
    assert set(got) == set(urls)
    # What may not be fetched was never asked for, and what was fetched was asked for once.
    assert not {"a.org/private/1", "c.org/page", "d.org/also"} & set(seen)
    assert {k: n for k, n in seen.items() if n > 1} in ({}, {"a.org/robots.txt": 2})  # once for itself, once as the end of d.org's
    assert {r.origin: r.verdict for r in robots.collect()} == {"http://a.org": "rules", "http://b.org": "allow-all", "http://c.org": "disallow-all", "http://d.org": "rules"}
    assert responses.filter("url = 'http://a.org/ok'").count() == 1


def test_robots_of_an_earlier_crawl(spark, tmp_path, server):
    port, seen = server
    _, _, robots = _pages(spark, ["http://a.org/ok"], _plan(port), tmp_path / "one")
    got, _, again = _pages(spark, ["http://a.org/ok", "http://a.org/private/1"], _plan(port), tmp_path / "two", robots)
    assert got["http://a.org/ok"][1] == "<p>fine</p>" and got["http://a.org/private/1"][1] is None
    assert seen["a.org/robots.txt"] == 1 and again.count() == 1
    old = robots.withColumn("expires_ms", F.lit(NOW).cast("long"))
    _pages(spark, ["http://a.org/ok"], _plan(port), tmp_path / "three", old)
    assert seen["a.org/robots.txt"] == 2


def test_nothing_to_fetch(spark, tmp_path):
    responses, robots = crawl.crawled(spark.createDataFrame([(None,)], "url string"), f"file://{tmp_path}/none")
    assert responses.count() == robots.count() == 0


def test_names_that_lead_inside(monkeypatch):
    for inside in ("10.0.0.1", "127.0.0.1", "169.254.169.254", "::1", "fe80::1%eth0", "fd00::2"):
        monkeypatch.setattr(socket, "getaddrinfo", lambda *_a, inside=inside, **_k: [(0, 0, 0, "", ("93.184.216.34", 80)), (0, 0, 0, "", (inside, 80))])
        with pytest.raises(crawl.BlockedUrlError):
            crawl._socket("rebind.org", 80, 1, crawl.FetchPlan())


def test_budget_of_all_hops(spark, server):
    port, seen = server
    rows = spark.createDataFrame([("http://a.org/ok", 20_000), ("http://a.org/gone", 0)], "url string, spent_ms long")
    got = {r.url: r for r in crawl.visited(rows, _plan(port)).collect()}
    assert got["http://a.org/ok"].error_class == "TimeoutError" and got["http://a.org/ok"].spent_ms == 20_000
    assert got["http://a.org/gone"].status == 404 and "a.org/ok" not in seen
