"""Fetching a table of URLs: hops as jobs, the guard and robots.txt as expressions and joins, and only the visit itself in Python.

`crawled` writes what each hop brings as Parquet, so a lost executor costs the visits of its tasks and nothing that is written; a
task that runs anew visits its URLs again.  `web.fetched_pages` then makes pages of the responses.
"""

from __future__ import annotations

import http.client
import ipaddress
import socket
import ssl
import time
from collections.abc import Iterator
from dataclasses import dataclass, replace
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import links
from ..functions.policy import origin, product_token, robots_checked, robots_table, url_problem
from . import web

RESPONSE = "url string, status int, location string, content_type string, body binary, error_class string, error_message string, fetched_ms long, spent_ms long"
_KINDS = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}
_ARROW = pa.schema([(n, _KINDS[t]) for n, t in (f.split() for f in RESPONSE.split(", "))])
ROBOTS = "origin string, verdict string, rules array<struct<allow:boolean,pattern:string>>, expires_ms long"


@dataclass(frozen=True)
class FetchPlan:
    """agent names the caller; a host's URLs go to at most `lanes` tasks of `tasks` (None: the session's shuffle partitions), each of
    which waits pause_ms between visits to one host.  budget_ms is for a page with all its hops, timeout_ms for a visit.
    addresses gives hosts a fixed address and port, as a hosts file does; those are not looked up and not checked.
    """

    agent: str = "pagemill/1.0"
    timeout_ms: int = 12_000
    budget_ms: int = 20_000
    max_bytes: int = 5_000_000
    redirects: int = 5
    lanes: int = 4
    tasks: int | None = None
    pause_ms: int = 0
    addresses: tuple[tuple[str, str, int], ...] = ()


class BlockedUrlError(Exception):
    """The name leads to an address that is not public."""


class ResponseTooLargeError(Exception):
    """The body is over the limit, as declared or as read."""


def _socket(host: str, port: int, seconds: float, plan: FetchPlan) -> socket.socket:
    """A connection to the very address that was checked: a name can't lead elsewhere between check and visit."""
    for name, address, its_port in plan.addresses:
        if name == host:
            return socket.create_connection((address, its_port), seconds)
    found = [i[4][0] for i in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)]
    if not found or not all(ipaddress.ip_address(a.partition("%")[0]).is_global for a in found):
        raise BlockedUrlError("address not allowed: address")
    return socket.create_connection((found[0], port), seconds)


def _visit(url: str, ms: int, plan: FetchPlan) -> dict:
    """One request without following it anywhere; raises what goes wrong."""
    until = time.monotonic() + ms / 1000
    parts = urlsplit(links.normal_url(url) or url)
    secure, host = parts.scheme == "https", parts.hostname or ""
    sock = _socket(host, parts.port or (443 if secure else 80), ms / 1000, plan)
    with sock if not secure else ssl.create_default_context().wrap_socket(sock, server_hostname=host) as s:
        asked = http.client.HTTPConnection(host, timeout=ms / 1000)
        asked.sock = s
        path = (parts.path or "/") + ("?" + parts.query if parts.query else "")
        asked.request("GET", path, headers={"User-Agent": plan.agent, "Accept-Encoding": "identity", "Connection": "close"})
        with asked.getresponse() as r:
            said = {"status": r.status, "location": r.getheader("Location"), "content_type": r.getheader("Content-Type")}
            if not 200 <= r.status < 300:
                return said
            if r.length is not None and r.length > plan.max_bytes:
                raise ResponseTooLargeError("page too large")
            body = bytearray()
            while True:
                left = until - time.monotonic()
                if left <= 0:
                    raise TimeoutError("timed out")
                s.settimeout(left)
                piece = r.read1(65_536)
                if not piece:
                    return said | {"body": bytes(body)}
                body += piece
                if len(body) > plan.max_bytes:
                    raise ResponseTooLargeError("page too large")


def visited(urls: DataFrame, plan: FetchPlan) -> DataFrame:
    """A response a row of urls (url, spent_ms); every failure is a row as well.  URLs go out as they are: guard them before."""
    spark = urls.sparkSession
    tasks = plan.tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, float] = {}
        for b in batches:
            for row in b.to_pylist():
                host, left = links.host_of(row["url"]) or "", plan.budget_ms - row["spent_ms"]
                wait = last.get(host, 0.0) + plan.pause_ms / 1000 - time.monotonic()
                if wait > 0:
                    time.sleep(wait)
                began = time.monotonic()
                made = dict.fromkeys(_ARROW.names) | {"url": row["url"]}
                try:
                    if left <= 0:
                        raise TimeoutError("no time is left for this page")
                    made |= _visit(row["url"], min(left, plan.timeout_ms), plan)
                except Exception as e:  # whatever goes wrong out there is a row, not the end of a job
                    made |= {"error_class": type(e).__name__, "error_message": str(e)}
                if len(last) >= 10_000:
                    last.clear()
                last[host] = time.monotonic()
                made |= {"fetched_ms": int(time.time() * 1000), "spent_ms": row["spent_ms"] + int((last[host] - began) * 1000)}
                yield pa.RecordBatch.from_pylist([made], _ARROW)  # a body at a time

    lane = F.pmod(F.xxhash64("url"), F.lit(plan.lanes))
    dealt = urls.select("url", F.col("spent_ms").cast("long").alias("spent_ms")).repartition(tasks, F.coalesce(links.host(F.col("url")), F.lit("")), lane)
    return dealt.mapInArrow(run, RESPONSE)


def _hops(todo: DataFrame, folder: str, plan: FetchPlan, known: DataFrame | None, now: Column, respect: bool) -> tuple[DataFrame, DataFrame | None]:
    """Responses to URLs and to all they redirect to, each URL visited once, and the table of robots.txt with what was missing."""
    spark = todo.sparkSession
    done, robots = spark.createDataFrame([], RESPONSE), known
    for hop in range(plan.redirects + 1):
        fit = todo.filter(url_problem(F.col("url")).isNull())
        if respect:
            robots = _with_robots(fit, f"{folder}/robots-{hop}", plan, robots, now)
            fit = robots_checked(fit, robots, now).filter("robots = 'allowed'")
        path = f"{folder}/responses-{hop}"
        visited(fit.select("url", "spent_ms"), plan).write.parquet(path)
        got = spark.read.schema(RESPONSE).parquet(path)
        done = done.unionByName(got)
        leads = got.filter(F.col("status").isin(*web.REDIRECTS) & F.col("location").isNotNull())
        ahead = leads.select(web.next_url(F.col("url"), F.col("location")).alias("url"), "spent_ms").filter("url IS NOT NULL")
        todo = ahead.groupBy("url").agg(F.min("spent_ms").alias("spent_ms")).join(done.select("url"), "url", "left_anti")
        if todo.isEmpty():
            break
    return done, robots


def _with_robots(urls: DataFrame, folder: str, plan: FetchPlan, known: DataFrame | None, now: Column) -> DataFrame:
    """known with fresh entries for origins that it lacks or that ran out; robots.txt itself may redirect, under the guard alone.

    Fixed values: robots.txt may take 5 seconds and 500,000 bytes; one that can't be had forbids all.
    """
    spark = urls.sparkSession
    valid = spark.createDataFrame([], ROBOTS) if known is None else known.filter(F.col("expires_ms") > now)
    lacking = urls.select(origin(F.col("url")).alias("origin")).distinct().join(valid.select("origin"), "origin", "left_anti")
    lacking = lacking.withColumn("url", F.concat("origin", F.lit("/robots.txt"))).withColumn("spent_ms", F.lit(0))
    own = replace(plan, max_bytes=500_000, timeout_ms=min(plan.timeout_ms, 5_000), budget_ms=min(plan.timeout_ms, 5_000))
    lacking.write.parquet(f"{folder}/asked")
    asked = spark.read.parquet(f"{folder}/asked")
    if asked.isEmpty():
        return valid
    responses, _ = _hops(asked, folder, own, None, now, respect=False)
    found = web.followed(asked, responses, plan.redirects).select(F.col("url").alias("asked"), "status", "body", "error_class")
    fresh = asked.join(found, F.col("url") == F.col("asked")).withColumn("fetched_ms", now).select(
        "origin", F.when(F.col("error_class").isNull(), F.col("status")).alias("status"), F.make_valid_utf8(F.col("body").cast("string")).alias("body"), "fetched_ms"
    )
    token = spark.range(1).select(product_token(F.lit(plan.agent)).alias("t")).first().t
    valid.select(*_names()).unionByName(robots_table(fresh, token).select(*_names())).write.parquet(f"{folder}/table")
    return spark.read.schema(ROBOTS).parquet(f"{folder}/table")


def _names() -> list[str]:
    return [f.split()[0] for f in ROBOTS.split(", ")]


def crawled(urls: DataFrame, folder: str, plan: FetchPlan = FetchPlan(), known: DataFrame | None = None, now_ms: int | None = None, respect_robots: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Responses and robots.txt table of a table of URLs, both in a new folder that all executors share.

    Each distinct URL and each target of a redirect is visited once, and only where its form, the address its name leads to and its
    origin's robots.txt allow it; known is the table of an earlier crawl, of which entries in time are not asked for again.  Give
    `web.fetched_pages` the URLs, both tables and the same now_ms: every refusal is a row there.  Null URLs are left out; an
    empty table visits nothing.
    """
    now = F.lit(int(time.time() * 1000) if now_ms is None else now_ms).cast("long")
    start = urls.filter("url IS NOT NULL").select("url").distinct().withColumn("spent_ms", F.lit(0).cast("long"))
    return _hops(start, folder.rstrip("/"), plan, known, now, respect_robots)
