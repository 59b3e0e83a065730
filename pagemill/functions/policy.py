"""Rules about what may be fetched: robots.txt, addresses, hosts; and what a failure means."""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import links
from .markup import bound
from .names import free_names

RULES = T.ArrayType(T.StructType([T.StructField("allow", T.BooleanType()), T.StructField("pattern", T.StringType())]))
#: Statuses by which sites commonly refuse programs.
BLOCKING = (401, 403, 406, 429, 451)
# Address ranges that are not public.
IPV4_BLOCKS = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/3".split()
_V4 = [ipaddress.ip_network(x) for x in IPV4_BLOCKS]


def product_token(agent: Column) -> Column:
    return F.lower(F.regexp_extract(agent, r"^[^\s/]*", 0))


def robots_rules(text: str | None, token: str, most_lines: int = 5000) -> list[dict]:
    """Rules of the groups for token, or of the * groups where none names it."""
    groups: list[tuple[set[str], list[dict]]] = []
    for line in re.split(r"\r?\n", text or "")[:most_lines]:
        name, colon, value = line.partition("#")[0].strip().partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if not groups or groups[-1][1]:
                groups.append((set(), []))
            groups[-1][0].add(value.lower())
        elif name in ("allow", "disallow"):
            if not groups:
                groups.append((set(), []))
            groups[-1][1].append({"allow": name == "allow", "pattern": value if value or name == "allow" else None})
    named = any(token in agents for agents, _ in groups)
    wanted = token if named else "*"
    return [r for agents, rules in groups if wanted in agents for r in rules if r["pattern"] is not None]


def parse_robots(text: Column, token: Column) -> Column:
    """array<struct<allow, pattern>> of a robots.txt column."""

    @F.pandas_udf(RULES)
    def rules(texts: pd.Series, tokens: pd.Series) -> pd.Series:
        return pd.Series([robots_rules(t, k) for t, k in zip(texts, tokens, strict=True)], dtype=object)

    return rules(text, token)


def _rule_regex(pattern: Column) -> Column:
    """The anchored expression of a rule: * is anything, a last $ is the end."""
    ends = F.endswith(pattern, F.lit("$"))
    body = F.regexp_replace(pattern, r"\$$", "")
    escaped = F.regexp_replace(F.regexp_replace(body, r"([.+?^$\{\}()|\[\]\\])", r"\\$1"), r"\*", ".*")
    return F.concat(F.lit("^"), escaped, F.when(ends, "$").otherwise(""))


def path_allowed(rules: Column, path: Column) -> Column:
    """Whether the rule with the longest matching pattern allows path; allowed rules win ties, and no match allows."""
    fits = F.filter(rules, lambda r: F.regexp(path, _rule_regex(r["pattern"])))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


def robots_verdict(status: Column) -> Column:
    """What a robots.txt response means: rules, allow-all or disallow-all (429, server errors and no answer)."""
    return F.when(status.between(200, 299), "rules").when((status == 429) | (status >= 500) | status.isNull(), "disallow-all").otherwise("allow-all")


def robots_ttl_seconds(verdict: Column) -> Column:
    return F.when(verdict == "disallow-all", 60).otherwise(3600)


def origin(url: Column) -> Column:
    """scheme://host:port of a URL, as its robots.txt is kept under it."""
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))


def robots_table(responses: DataFrame, token: str) -> DataFrame:
    """(origin, verdict, rules, expires_ms) from robots.txt responses (origin, status, body, fetched_ms); the latest of an origin counts.

    Each distinct text is parsed once.
    """
    last = responses.groupBy("origin").agg(F.max_by(F.struct("status", "body", "fetched_ms"), "fetched_ms").alias("r")).select("origin", "r.*")
    last = last.withColumn("verdict", robots_verdict(F.col("status")))
    parsed = last.filter("verdict = 'rules'").select("body").distinct().withColumn("rules", parse_robots(F.col("body"), F.lit(token)))
    joined = last.alias("l").join(parsed.alias("p"), F.col("l.body").eqNullSafe(F.col("p.body")) & (F.col("verdict") == "rules"), "left")
    return joined.select("origin", "verdict", "rules", (F.col("fetched_ms") + 1000 * robots_ttl_seconds(F.col("verdict"))).alias("expires_ms"))


def robots_checked(urls: DataFrame, table: DataFrame, now_ms: Column, url: str = "url") -> DataFrame:
    """urls with robots: allowed, disallowed, or fetch where the origin's robots.txt is missing or out of date."""
    own, verdict, rules, expires = free_names(urls, "origin_of", "verdict", "rules", "expires")
    rows = urls.withColumn(own, origin(F.col(url)))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^#]*)", 1)
    path = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    t = table.select(F.col("origin").alias(own), F.col("verdict").alias(verdict), F.col("rules").alias(rules), F.col("expires_ms").alias(expires))
    said = (
        F.when(F.col(verdict).isNull() | (F.col(expires) <= now_ms), "fetch").when(F.col(verdict) == "allow-all", "allowed")
        .when((F.col(verdict) == "rules") & path_allowed(F.col(rules), path), "allowed").otherwise("disallowed")
    )
    kept = [c for c in urls.columns if c != "robots"]
    return rows.join(t, own, "left").withColumn("robots", said).select(*kept, "robots")


def _v4_blocked(number: Column) -> Column:
    """Whether an IPv4 address, as a number, is not public."""
    inside = F.lit(False)
    for net in _V4:
        inside = inside | number.between(int(net.network_address), int(net.broadcast_address))
    return inside


def ipv4_blocked(ip: Column) -> Column:
    """Whether an IPv4 address is malformed or not public."""
    parts = F.split(ip, r"\.", -1)
    well = F.rlike(ip, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$")) & F.forall(parts, lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + F.coalesce(p.try_cast("long"), F.lit(0)))
    return F.when(~F.coalesce(well, F.lit(False)), True).otherwise(_v4_blocked(number))


def ipv6_groups(ip: Column) -> Column:
    """The eight 16-bit numbers of an IPv6 address, with :: and a dotted tail where there are; null if it is malformed."""
    text = F.lower(F.regexp_replace(ip, "%.*$", ""))

    def hexed(v: Column) -> Column:
        tail = F.regexp_extract(v, r":(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1)
        four = F.transform(F.split(tail, r"\."), lambda x: x.try_cast("int"))
        pairs = F.concat(F.lower(F.hex(F.get(four, F.lit(0)) * 256 + F.get(four, F.lit(1)))), F.lit(":"), F.lower(F.hex(F.get(four, F.lit(2)) * 256 + F.get(four, F.lit(3)))))
        return F.when(tail == "", v).when(F.forall(four, lambda x: x <= 255), F.concat(F.substr(v, F.lit(1), F.length(v) - F.length(tail)), pairs))

    def parted(v: Column) -> Column:
        halves = F.split(v, "::")
        none = F.array().cast("array<string>")
        head = F.when(F.get(halves, F.lit(0)) == "", none).otherwise(F.split(F.get(halves, F.lit(0)), ":"))
        rest = F.when(F.coalesce(F.get(halves, F.lit(1)), F.lit("")) == "", none).otherwise(F.split(F.get(halves, F.lit(1)), ":"))
        missing = 8 - F.size(head) - F.size(rest)
        fits = F.when(F.size(halves) == 1, missing == 0).when(F.size(halves) == 2, missing >= 1).otherwise(False)
        return F.when(fits, F.concat(head, F.array_repeat(F.lit("0"), missing), rest))

    groups = bound(bound(text, hexed), parted)
    return bound(groups, lambda g: F.when(F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.transform(g, lambda x: F.conv(x, 16, 10).cast("int"))))


def ipv6_blocked(ip: Column) -> Column:
    """Whether an IPv6 address is malformed or not public; addresses that carry an IPv4 one count as that one."""

    def of(g: Column) -> Column:
        def all_zero(upto: int) -> Column:
            return F.forall(F.slice(g, 1, upto), lambda x: x == 0)

        tunnel = g[0] == 0x2002
        carries = tunnel | (all_zero(5) & (g[5] == 0xFFFF)) | ((g[0] == 0x64) & (g[1] == 0xFF9B) & F.forall(F.slice(g, 3, 4), lambda x: x == 0))
        carried = F.when(tunnel, g[1].cast("long") * 65_536 + g[2]).otherwise(g[6].cast("long") * 65_536 + g[7])
        return (
            F.when(g.isNull(), True)
            .when(all_zero(6) | (g[0].bitwiseAND(0xFFC0) == 0xFE80) | (g[0].bitwiseAND(0xFE00) == 0xFC00) | (g[0].bitwiseAND(0xFF00) == 0xFF00), True)
            .when(carries, bound(carried, _v4_blocked))
            .otherwise((g[0] == 0x2001) & g[1].isin(0, 0xDB8))
        )

    return bound(ipv6_groups(ip), of)


def _host_number(name: Column) -> Column:
    """The IPv4 address that browsers read in a host of one to four numbers (decimal, 0x or octal), -1 for a broken one; null for a name."""

    def one(p: Column) -> Column:
        return (
            F.when(p.rlike("^0x[0-9a-f]{0,8}$"), F.conv(F.concat(F.lit("0"), F.substr(p, F.lit(3))), 16, 10).cast("long")).when(p.rlike("^0[0-7]{0,15}$"), F.conv(p, 8, 10).cast("long"))
            .when(p.rlike("^[1-9]\\d{0,11}$"), p.try_cast("long"))
        )

    def of(parts: Column) -> Column:
        n, values = F.size(parts), F.transform(parts, one)
        head = F.aggregate(F.slice(values, 1, n - 1), F.lit(0).cast("long"), lambda acc, v: acc * 256 + v)
        last, room = F.element_at(values, -1), F.pow(F.lit(256), 5 - n).cast("long")
        well = (n <= 4) & F.forall(F.slice(values, 1, n - 1), lambda v: F.coalesce(v <= 255, F.lit(False))) & F.coalesce(last < room, F.lit(False))
        return F.when(F.element_at(parts, -1).rlike("^(?:\\d+|0x[0-9a-f]*)$"), F.when(well, head * room + last).otherwise(-1))

    return bound(F.split(name, r"\."), of)


def url_problem(url: Column) -> Column:
    """Why a URL may not be fetched, by its form alone; null if it may.  Addresses count in every form in which browsers read them."""

    def of(p: Column) -> Column:
        scheme, host, authority = p["scheme"], p["host"], p["authority"]
        port = F.regexp_extract(authority, r":(\d*)$", 1)
        name = F.regexp_replace(host, r"\.$", "")
        inside = ~F.contains(name, F.lit(".")) | F.rlike(name, F.lit(r"(^|\.)localhost$|\.internal$|\.local$"))
        return (
            F.when(scheme.isNull() | (scheme.isin("http", "https") & host.isNull()), "invalid")
            .when(~scheme.isin("http", "https"), "scheme")
            .when(F.contains(authority, F.lit("@")), "credentials")
            .when(~port.isin("", "80", "443"), "port")
            .when(F.startswith(name, F.lit("[")), F.when(ipv6_blocked(F.regexp_replace(name, r"[\[\]]", "")), "address"))
            .otherwise(bound(_host_number(name), lambda n: F.when(n == -1, "invalid").when(n.isNotNull(), F.when(_v4_blocked(n), "address")).when(inside, "host")))
        )

    authority = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*:[/\\\\]{2}([^/\\\\?#]*)", 1)
    return bound(F.struct(links.scheme(url).alias("scheme"), links.host(url).alias("host"), authority.alias("authority")), of)


def on_list(host: Column, domains: Column) -> Column:
    """Whether host is one of the domains (an array) or below one."""
    h = F.lower(host)
    return F.exists(domains, lambda d: (h == d) | F.endswith(h, F.concat(F.lit("."), d)))


def listed_hosts(rows: DataFrame, host: str, domains: DataFrame) -> DataFrame:
    """rows with `listed`: whether a table of domains (any size) has the host or a domain above it; an equi-join on the host's suffixes."""
    parts = F.split(F.lower(F.col(host)), r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = rows.select(host).distinct()
    hit = hosts.select(host, F.explode(suffix).alias("domain")).join(domains.select(F.lower("domain").alias("domain")).distinct(), "domain", "left_semi").select(host).distinct()
    return rows.join(hit.withColumn("listed", F.lit(True)), host, "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


# What a sentence on a failure has to say.
BLOCKS = "blocking automated tools"
PASSING = "temporary server-side issue"
REJECTS = "deliberate rejection"
UNREACHED = "couldn't be reached"
SLOW = "took too long"
ALLOWED_ONLY = "only fetches pages a site's robots.txt allows"
TOO_LARGE = "size limit"


def failure_text(kind: Column, error: Column, timed_out: Column) -> Column:
    """A sentence on why an extraction failed; null if it did not.  What went wrong with the fetch goes before a time-out."""
    status = F.nullif(F.regexp_extract(error, r"^HTTP (\d+)", 1), F.lit("")).try_cast("int")
    code = F.concat(F.lit(" (HTTP "), status.cast("string"), F.lit(")."))
    reason = (
        F.when(status.isin(*BLOCKING), F.concat(F.lit(f"The site is {BLOCKS}"), code))
        .when(status >= 500, F.concat(F.lit(f"The site has a {PASSING}"), code))
        .when(status.isNotNull(), F.concat(F.lit(f"The site's answer is a {REJECTS}"), code))
        .otherwise(F.concat(F.lit(f"The site {UNREACHED} ("), error, F.lit(").")))
    )
    return (
        F.when(kind == "robots", F.concat(F.lit("Extraction declined. "), error, F.lit(f" This engine {ALLOWED_ONLY}.")))
        .when(kind == "blocked-url", F.concat(F.lit("Extraction refused. "), error))
        .when(kind == "too-large", F.lit(f"Extraction refused. The page is over the {TOO_LARGE}."))
        .when(error.isNotNull() & (error != ""), F.concat(F.lit("Extraction failed. "), reason))
        .when(timed_out, F.lit(f"Extraction failed. The page {SLOW} to process."))
    )


def fetch_error_kind(exception: Column, status: Column) -> Column:
    """robots, blocked-url, too-large or null, from the class of what was raised."""
    return F.when(exception == "RobotsDisallowedError", "robots").when(exception == "BlockedUrlError", "blocked-url").when(exception == "ResponseTooLargeError", "too-large")


def fetch_error(exception: Column, message: Column, status: Column, reason: Column) -> Column:
    """Text of a fetch error: HTTP status and reason of a bad answer, else the message; null if all went well."""
    bad = status.isNotNull() & ~status.between(200, 299)
    return F.when(bad, F.trim(F.concat_ws(" ", F.lit("HTTP"), status.cast("string"), reason))).when(exception.isNotNull(), F.coalesce(F.nullif(message, F.lit("")), F.lit("network error")))


# What requests of each tier may cost: largest page in bytes.
PAGE_BYTES = {"anon": 3_000_000, "member": 5_000_000, "owner": 5_000_000}


def fetch_options(tier: Column, timeout_ms: Column, language: Column, use_meta_language: Column, images: Column) -> Column:
    """What a request may ask for, within what its tier allows: a struct of all options of a fetch.

    Missing or odd wishes get the default: all of the time, English, the page's own language, images for members.
    """
    wish = timeout_ms.cast("double")
    most = F.lit(PAGE_BYTES["anon"])
    for name, size in PAGE_BYTES.items():
        most = F.when(tier == name, size).otherwise(most)
    finite = wish.isNotNull() & ~F.isnan(wish) & (F.abs(wish) < float("inf"))
    return F.struct(
        (F.coalesce(tier == "member", F.lit(False)) & F.coalesce(images, F.lit(True))).alias("images"),
        F.coalesce(use_meta_language, F.lit(True)).alias("useMetaLanguage"),
        F.when(F.rlike(language, F.lit(r"^[a-z]{2}\z")), language).otherwise("en").alias("language"),
        F.when(finite, F.least(F.greatest(wish, F.lit(1000.0)), F.lit(12_000.0))).otherwise(12_000.0).alias("timeoutMs"),
        F.lit(20_000).alias("overallMs"),
        most.alias("pageBytes"),
        F.lit(8_000_000).alias("imageBytes"),
        F.lit(5).alias("redirects"),
        F.lit(True).alias("robots"),
    )
