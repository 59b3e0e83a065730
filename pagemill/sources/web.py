"""Fetched pages: a table of responses stands for the network, or a data source that fetches.

responses: (url, status, location, content_type, body binary, error_class, error_message).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import links
from ..functions.charsets import sniffed
from ..functions.names import free_names
from ..functions.policy import fetch_error, fetch_error_kind, robots_checked, url_problem

REDIRECTS = (301, 302, 303, 307, 308)
_NO_LEAVE = "robots.txt of "


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of text files: one a line, trimmed, empty ones left out."""
    return spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> ''")


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of local or remote files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def next_url(at: Column, location: Column) -> Column:
    """Where a redirect leads: location as it is, or taken from the present URL where it is relative; null where neither gives a URL."""
    return F.when(links.scheme(location).isNotNull(), location).otherwise(links.resolve(location, at))


def latest_responses(responses: DataFrame) -> DataFrame:
    """One response a URL: the latest by fetched_ms where the table has that, and of equal ones the same one each time."""
    small = [F.col(c) for c in ("status", "location", "content_type", "error_class", "error_message")]
    order = [F.desc_nulls_last("fetched_ms")] if "fetched_ms" in responses.columns else []
    nth = F.row_number().over(Window.partitionBy("url").orderBy(*order, F.xxhash64(*small), F.xxhash64("body")))
    (place,) = free_names(responses, "place")
    return responses.withColumn(place, nth).filter(F.col(place) == 1).drop(place)


def _with_fault(rows: DataFrame, at: str, name: str, robots: DataFrame | None, now_ms: Column) -> DataFrame:
    """rows with a column that says why the URL in another one may not be fetched; null where it may, or where there is no URL."""
    (problem,) = free_names(rows, "problem")
    rows = rows.withColumn(problem, F.when(F.col(at).isNotNull(), url_problem(F.col(at))))
    fault = F.when(F.col(problem).isNotNull(), F.concat(F.lit("address not allowed: "), F.col(problem)))
    if robots is not None:
        rows = robots_checked(rows, robots, now_ms, at)
        fault = fault.when(F.col(at).isNotNull() & (F.col("robots") != "allowed"), F.concat(F.lit(_NO_LEAVE), F.coalesce(links.host(F.col(at)), F.lit("?")), F.lit(" does not allow this page.")))
    return rows.withColumn(name, fault).drop(problem, "robots")


def followed(urls: DataFrame, responses: DataFrame, most: int = 5, robots: DataFrame | None = None, now_ms: Column | None = None) -> DataFrame:
    """(url, final_url, status, body, content_type, error_class, error_message) after at most `most` redirects.

    A URL that may not be fetched, the first or any that a redirect leads to, is a blocked one; more than `most` redirects
    are a plain error.  With robots (a robots_table) each hop also needs the leave of its origin; one whose robots.txt is missing
    or out of date gives none.  A URL with several responses has its latest; repeated URLs give a row each.  Where a response leads,
    and whether one may go there, is worked out once a response; then the hops are joins on URLs alone, and bodies come in at the end.
    """
    one, now = latest_responses(responses), now_ms if now_ms is not None else F.unix_millis(F.current_timestamp())
    hops = one.select(F.col("url").alias("look"), F.when(F.col("status").isin(*REDIRECTS) & F.col("location").isNotNull(), F.coalesce(next_url(F.col("url"), F.col("location")), F.lit(""))).alias("next"))
    hops = _with_fault(hops.filter("next IS NOT NULL"), "next", "next_fault", robots, now)
    state = _with_fault(urls.select("url", F.col("url").alias("at")), "at", "fault", robots, now)
    for hop in range(most + 1):
        # A URL that may not be fetched looks up a name of its own that no response has.
        look = F.when(F.col("fault").isNull(), F.col("at")).otherwise(F.concat(F.lit("#"), F.col("url")))
        got, goes = state.withColumn("look", look).join(hops, "look", "left"), F.col("next").isNotNull()
        at, fault = (F.col("next"), F.col("next_fault")) if hop < most else (F.col("at"), F.lit("too many redirects"))
        state = got.select("url", F.when(goes, at).otherwise(F.col("at")).alias("at"), F.when(goes, fault).otherwise(F.col("fault")).alias("fault"))
    found = state.withColumn("look", F.when(F.col("fault").isNull(), F.col("at")).otherwise(F.concat(F.lit("#"), F.col("url"))))
    found = found.join(one.select(F.col("url").alias("look"), "status", "content_type", "body", "error_class", "error_message"), "look", "left")
    kind = F.when(F.col("fault") == "too many redirects", "TooManyRedirectsError").when(F.startswith("fault", F.lit(_NO_LEAVE)), "RobotsDisallowedError").when(F.col("fault").isNotNull(), "BlockedUrlError").otherwise(F.col("error_class"))
    return found.select("url", F.col("at").alias("final_url"), "status", "content_type", "body", kind.alias("error_class"), F.coalesce("fault", "error_message").alias("error_message"))


def within_size(rows: DataFrame, most_bytes: int = 5_000_000) -> DataFrame:
    """Bodies over the limit become an error of that kind."""
    over = F.octet_length("body") > most_bytes
    return rows.withColumns(
        {
            "error_class": F.when(over, "ResponseTooLargeError").otherwise(F.col("error_class")),
            "error_message": F.when(over, "page too large").otherwise(F.col("error_message")),
            "body": F.when(over, F.lit(None).cast("binary")).otherwise(F.col("body")),
        }
    )


_META = re.compile(rb"<meta[^>]+charset=[\"']?\s*([\w-]+)", re.I)


def decoded(body: Column, content_type: Column, guess: Column | None = None) -> Column:
    """Text of a response: by the charset of its type, else by its own meta tag, else by the guess, else UTF-8; what cannot be decoded is read as UTF-8."""

    @F.pandas_udf("string")
    def text(bodies: pd.Series, types: pd.Series, guesses: pd.Series) -> pd.Series:
        def one(b: bytes | None, t: str | None, guess: str | None) -> str | None:
            if b is None:
                return None
            said = re.search(r"charset=[\"']?([\w-]+)", t or "", re.I)
            inner = _META.search(b[:4096])
            name = said[1] if said else inner[1].decode() if inner else guess or "utf-8"
            try:
                return b.decode(name).removeprefix("\ufeff")
            except (LookupError, UnicodeDecodeError):
                return b.decode("utf-8", "replace")

        return pd.Series([one(b, t, g) for b, t, g in zip(bodies, types, guesses, strict=True)], dtype=object)

    # What is named UTF-8 and valid is text as it stands; Python gets the other bodies alone, as its batches hold thousands.
    guess = F.lit(None).cast("string") if guess is None else guess
    head = F.decode(F.substring(body, 1, 4096), "ISO-8859-1")
    said = F.nullif(F.regexp_extract(content_type, r"(?iU)charset=[\"']?([\w-]+)", 1), F.lit(""))
    inner = F.nullif(F.regexp_extract(head, r"(?i)<meta[^>]+charset=[\"']?\s*([\w-]+)", 1), F.lit(""))
    plain = F.coalesce(F.lower(F.coalesce(said, inner, guess, F.lit("utf-8"))).isin("utf-8", "utf8") & F.is_valid_utf8(body.cast("string")), F.lit(False))
    own = F.regexp_replace(F.when(plain, body.cast("string")), r"\A\x{FEFF}", "")
    return F.coalesce(own, text(F.when(~plain, body), content_type, guess))


def with_text(rows: DataFrame, name: str = "html", body: str = "body", content_type: str = "content_type") -> DataFrame:
    """rows with the text of their bodies; where the type declares no charset and the body has no meta tag, its bytes decide."""
    (guess,) = free_names(rows.withColumn(name, F.lit(None)), "guess")
    declared = F.coalesce(F.rlike(content_type, F.lit("(?i)charset=")), F.lit(False))
    guessed = rows.withColumn(guess, F.when(~declared, sniffed(F.col(body))))
    # Named twice, so that the guess stays a column of its own: inside a Python function's arguments its nested lambdas are not worked out.
    return guessed.withColumn(name, decoded(F.col(body), F.col(content_type), F.when(F.col(guess).isNotNull(), F.col(guess)))).drop(guess)


def fetched_pages(urls: DataFrame, responses: DataFrame, most_bytes: int = 5_000_000, redirects: int = 5, robots: DataFrame | None = None, now_ms: Column | None = None) -> DataFrame:
    """(url, final_url, html, fetch_error, fetch_error_kind): html is null where the fetch failed."""
    rows = within_size(followed(urls, responses, redirects, robots, now_ms), most_bytes)
    exception = F.when(F.col("status").isNull() & F.col("error_class").isNull(), "NetworkError").otherwise(F.col("error_class"))
    error = fetch_error(exception, F.col("error_message"), F.col("status"), F.lit(None).cast("string"))
    rows = rows.withColumns({"fetch_error": error, "fetch_error_kind": fetch_error_kind(exception, F.col("status"))})
    good = rows.withColumn("body", F.when(F.col("fetch_error").isNull(), F.col("body")))
    return with_text(good).select("url", "final_url", "html", "fetch_error", "fetch_error_kind")


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.timeout = float(options.get("timeout_ms", "12000")) / 1000
        self.most = int(options.get("max_bytes", "5000000"))
        self.agent = options.get("user_agent", "pagemill")

    def partitions(self) -> list[_Part]:
        return [_Part(self.urls[i : i + 8]) for i in range(0, len(self.urls), 8)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        import urllib.error
        import urllib.request

        class Stay(urllib.request.HTTPRedirectHandler):
            def redirect_request(self, *_: object) -> None:
                return None

        get = urllib.request.build_opener(Stay)
        for url in partition.urls:
            request = urllib.request.Request(url, headers={"User-Agent": self.agent})
            try:
                with get.open(request, timeout=self.timeout) as r:
                    body = r.read(self.most + 1)
                    yield (url, r.status, None, r.headers.get("Content-Type"), body, None, None)
            except urllib.error.HTTPError as e:
                yield (url, e.code, e.headers.get("Location"), e.headers.get("Content-Type"), None, None, None)
            except Exception as e:  # any failure of the network is a row
                yield (url, None, None, None, None, type(e).__name__, str(e))


class HttpSource(DataSource):
    """spark.read.format("pagemill_http").option("urls", "...").load(): one response row a URL, redirects not followed."""

    @classmethod
    def name(cls) -> str:
        return "pagemill_http"

    def schema(self) -> str:
        return "url string, status int, location string, content_type string, body binary, error_class string, error_message string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


# -- pictures


def image_header(data: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) of a PNG, GIF, JPEG, WebP or BMP file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return ("png", *struct.unpack(">II", data[16:24]))
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return ("gif", *struct.unpack("<HH", data[6:10]))
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return ("bmp", w, abs(h))
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return ("webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"))
        if data[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", data[26:30])
            return ("webp", w & 0x3FFF, h & 0x3FFF)
        n = int.from_bytes(data[21:25], "little")
        return ("webp", 1 + (n & 0x3FFF), 1 + ((n >> 14) & 0x3FFF))
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            kind = data[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return ("jpeg", w, h)
            at += 2 if kind in (0xFF, 0x01) or 0xD0 <= kind <= 0xD8 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def image_catalog(images: DataFrame) -> DataFrame:
    """(src, bytes, width, height, ext) of (src, content); pictures that cannot be read are left out."""

    @F.pandas_udf("struct<format:string,width:int,height:int>")
    def header(contents: pd.Series) -> pd.DataFrame:
        found = [image_header(bytes(c)) if c is not None else None for c in contents]
        return pd.DataFrame({"format": [f and f[0] for f in found], "width": [f and f[1] for f in found], "height": [f and f[2] for f in found]})

    ext = F.when(F.col("h.format") == "jpeg", ".jpg").otherwise(F.concat(F.lit("."), F.col("h.format")))
    rows = images.select("src", F.octet_length("content").cast("long").alias("bytes"), header("content").alias("h"))
    return rows.filter("h.format IS NOT NULL").select("src", "bytes", F.col("h.width").alias("width"), F.col("h.height").alias("height"), ext.alias("ext"))
