"""URL parts and resolution as browsers do them, for ordinary http(s) URLs."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import markup

_ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_PORTS = {"http": "80", "https": "443", "ftp": "21"}
_SAFE = "%!$&'()*+,;=:@/~-._[]?|^`{}\\"


def normal_url(url: str) -> str | None:
    """The URL with lower-case scheme and host, no default port and a path; null if it has no host."""
    try:
        p = urlsplit(url.strip())
        port = p.port
    except ValueError:
        return None
    if p.scheme not in _PORTS or not p.hostname:
        return None
    host = p.hostname.lower()
    try:
        host = host if host.isascii() else host.encode("idna").decode()
    except UnicodeError:
        return None
    user = p.netloc.rpartition("@")[0]
    net = (user + "@" if user else "") + (f"[{host}]" if ":" in host else host) + (f":{port}" if port and str(port) != _PORTS[p.scheme] else "")
    tail = ("?" + quote(p.query, _SAFE) if p.query else "") + ("#" + quote(p.fragment, _SAFE) if p.fragment else "")
    return f"{p.scheme}://{net}{quote(p.path.replace(chr(92), '/'), _SAFE.replace('?', '').replace('`', '')) or '/'}{tail}"


def host_of(url: str | None) -> str | None:
    made = normal_url(url) if url else None
    return urlsplit(made).hostname if made else None


def resolved(href: str, base: str) -> str | None:
    """href as an absolute URL, taken from base where it is relative; null where neither gives one."""
    own = normal_url(href)
    if own:
        return own
    root = normal_url(base) if base else None
    if not root or (_ABSOLUTE.match(href) and not href.lower().startswith(("http:", "https:"))):
        return None
    return normal_url(urljoin(root, href.strip()))


def host(url: Column) -> Column:
    """Lower-cased host of a URL column as browsers read it, null if there is none; names in other scripts stay as written."""
    said = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*+:[/\\\\]{2}(?:[^/\\\\?#]*@)?(\[[0-9A-Fa-f:.]++\]|[^\s/\\\\?#:@<>\[\]^|%]++)(?=[:/\\\\?#]|\z)", 1))
    return F.nullif(said, F.lit(""))


def scheme(url: Column) -> Column:
    """Lower-cased scheme of an absolute URL column, null without one."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(""))


def _quoted(path: Column) -> Column:
    """A path or query with what may not stand in a URL in percent signs."""
    one = F.transform(F.split(path, ""), lambda c: F.when(c.rlike(r"[^!-~]|[\"<>`]"), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c))
    return F.when(path.rlike(r"[^!-~]|[\"<>`]"), F.array_join(one, "")).otherwise(path)


def _walked(path: Column) -> Column:
    """A path without its steps . and .. ."""
    parts = F.slice(F.split(F.regexp_replace(path, r"/(\.{1,2})\z", "/$1/"), "/"), 2, 2**30)
    back = F.reduce(parts, F.array().cast("array<string>"), lambda s, p: F.when(p == ".", s).when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array_append(s, p)))
    return F.when(path.rlike(r"/\.{1,2}(?:/|\z)"), F.concat(F.lit("/"), F.array_join(back, "/"))).otherwise(path)


_PORT = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(?:\[[^\]]*\]|[^/?#:]*)(:\d+)?"


def _origin(url: Column, its_scheme: Column, its_host: Column) -> Column:
    """Scheme, host and port, without the port that is usual."""
    port = F.regexp_replace(F.regexp_extract(url, _PORT, 1), F.when(its_scheme == "http", "^:80$").otherwise("^:443$"), F.lit(""))
    return F.concat(its_scheme, F.lit("://"), its_host, port)


def resolve(href: Column, base: Column) -> Column:
    """href as an absolute http(s) URL by built-in functions, taken from an http(s) base where it is relative; null where neither gives one."""

    def at_base(p: Column, said: Column, own: Column, tail: Column) -> Column:
        path, query = F.regexp_extract(p["base"], r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), F.regexp_extract(p["base"], r"^[^?#]*(\?[^#]*)", 1)
        path = F.when(path == "", "/").otherwise(path)
        other = F.concat(F.lit("http:"), said)
        return (
            F.when(F.startswith(said, F.lit("//")), F.concat(p["scheme"], F.lit("://"), host(other), _quoted(_walked(F.regexp_replace(F.regexp_replace(own, r"^//[^/]*", ""), "^$", "/"))), _quoted(tail)))
            .when(F.startswith(said, F.lit("/")), F.concat(p["origin"], _quoted(_walked(own)), _quoted(tail)))
            .when((said == "") | F.startswith(said, F.lit("#")), F.concat(p["origin"], path, query, _quoted(said)))
            .when(F.startswith(said, F.lit("?")), F.concat(p["origin"], path, _quoted(said)))
            .otherwise(F.concat(p["origin"], _quoted(_walked(F.concat(F.regexp_extract(path, r"(?s)^(.*/)", 1), own))), _quoted(tail)))
        )

    def of(p: Column) -> Column:
        said = p["said"]
        own, tail = F.regexp_extract(said, r"(?s)^([^?#]*)", 1), F.regexp_extract(said, r"(?s)^[^?#]*(.*)", 1)
        path = F.regexp_extract(said, r"(?s)^[A-Za-z]+:/*[^/?#]*([^?#]*)", 1)
        whole = F.concat(_origin(said, scheme(said), host(said)), _quoted(_walked(F.when(path == "", "/").otherwise(path))), _quoted(tail))
        return F.when(scheme(said).isin("http", "https") & host(said).isNotNull(), whole).when(scheme(said).isNull() & p["origin"].isNotNull(), at_base(p, said, own, tail))

    at = F.trim(base)
    parts = markup.bound(
        F.struct(F.regexp_replace(F.trim(href), r"[\t\n\r]", "").alias("said"), at.alias("base"), scheme(at).alias("scheme"), host(at).alias("host")),
        lambda p: F.struct(p["said"].alias("said"), p["base"].alias("base"), p["scheme"].alias("scheme"), F.when(p["scheme"].isin("http", "https"), _origin(p["base"], p["scheme"], p["host"])).alias("origin")),
    )
    return markup.bound(parts, of)


def bare_host(url: Column, most: int = 80) -> Column:
    """host without a leading www., at most so many characters."""
    return F.substring(F.regexp_replace(host(url), r"^www\.", ""), 1, most)


def referrer_host(ref: Column, own: Column) -> Column:
    """Host of an http(s) referrer other than the own host, with a dot and at most 60 characters; else null."""
    h = F.regexp_replace(host(ref), r"^www\.", "")
    mine = F.regexp_replace(F.regexp_replace(F.lower(own), r":\d+$", ""), r"^www\.", "")
    web = scheme(ref).isin("http", "https")
    return F.when(web & F.contains(h, F.lit(".")) & (F.length(h) <= 60) & (F.coalesce(mine, F.lit("")) != h), h)
