"""Usage summaries of an event log: daily series, totals, breakdowns, percentiles, funnel.

An event has t (timestamp), type, v (visitor hash) and whatever of DIMENSIONS and measures it carries.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Kinds of events, and which of them make a visit.
VISIT_TYPES = ("pageview", "extract", "export")
#: name of a breakdown -> (column, condition, most rows)
BREAKDOWNS: dict[str, tuple[str, str, int]] = {
    "pages": ("path", "type = 'pageview'", 10),
    "referrers": ("ref", "type = 'pageview'", 10),
    "devices": ("dev", "type = 'pageview'", 10),
    "browsers": ("br", "type = 'pageview'", 10),
    "oses": ("os", "type = 'pageview'", 10),
    "languages": ("lang", "type = 'pageview'", 10),
    "viewports": ("vw", "type = 'pageview'", 6),
    "colorSchemes": ("cs", "type = 'pageview'", 2),
    "extractionsByTier": ("tier", "type = 'extract'", 10),
    "modes": ("mode", "type = 'extract'", 10),
    "outcomes": ("outcome", "type = 'extract'", 10),
    "hosts": ("host", "type = 'extract' AND outcome = 'ok'", 10),
    "refusedHosts": ("host", "type = 'extract' AND outcome IN ('robots', 'blocking')", 10),
    "wantedHosts": ("host", "type = 'extract' AND outcome = 'demo-only'", 10),
}
FIELDS = {"t": "timestamp", "ms": "long"} | dict.fromkeys("type tier v path ref dev br os lang vw cs host mode outcome fmt".split(), "string")


@dataclass(frozen=True)
class Span:
    """The last `days` UTC days up to `today`."""

    today: date
    days: int = 30


def complete(events: DataFrame) -> DataFrame:
    """events with every field of FIELDS (null where it has none) and day."""
    have = set(events.columns)
    rows = events.select(*[(F.col(k) if k in have else F.lit(None)).cast(kind).alias(k) for k, kind in FIELDS.items()])
    return rows.withColumn("day", F.to_date("t"))


def in_span(events: DataFrame, span: Span) -> DataFrame:
    last = F.lit(span.today)
    return events.filter((F.col("day") > F.date_sub(last, span.days)) & (F.col("day") <= last) & ~F.col("dev").eqNullSafe("bot"))


def _visitors(condition: Column) -> Column:
    return F.count_distinct(F.when(condition & (F.col("v") != ""), F.col("v")))


def daily(events: DataFrame, span: Span) -> DataFrame:
    """(day, visitors, pageviews, extractions) of every day of the span, zeros included."""
    spark: SparkSession = events.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(span.today), span.days - 1), F.lit(span.today))).alias("day"))
    got = in_span(events, span).groupBy("day").agg(
        _visitors(F.col("type").isin(*VISIT_TYPES)).alias("visitors"),
        F.count_if(F.col("type") == "pageview").alias("pageviews"),
        F.count_if(F.col("type") == "extract").alias("extractions"),
    )
    return days.join(F.broadcast(got), "day", "left").na.fill(0)  # at most one row a day of the span


def totals(events: DataFrame, span: Span) -> DataFrame:
    """One row of counters; visitors is the sum of the days' distinct ones."""
    kinds = {"pageviews": "pageview", "extractions": "extract", "exports": "export", "rateLimited": "ratelimit", "capReached": "cap", "busy": "busy", "boots": "boot", "accessRequests": "access_request", "invites": "invite", "redemptions": "redeem", "logins": "login"}
    rows = in_span(events, span)
    counts = rows.agg(
        F.count(F.lit(1)).alias("eventCount"),
        *[F.count_if(F.col("type") == k).alias(n) for n, k in kinds.items()],
        F.count_if((F.col("type") == "extract") & (F.col("outcome") == "ok")).alias("extractionsOk"),
    )
    visits = rows.groupBy("day").agg(_visitors(F.col("type").isin(*VISIT_TYPES)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("visitors"))
    return counts.crossJoin(visits)  # one row each


def breakdowns(events: DataFrame, span: Span) -> DataFrame:
    """(dimension, key, n, place) of all breakdowns in one pass: most frequent first, ties by key."""
    items = [F.when(F.expr(cond), F.struct(F.lit(name).alias("dimension"), F.col(column).alias("key"), F.lit(most).alias("most"))) for name, (column, cond, most) in BREAKDOWNS.items()]
    counted = in_span(events, span).select(F.explode(F.array_compact(F.array(*items))).alias("i")).select("i.*").filter("key <> ''").groupBy("dimension", "key", "most").count()
    # Counts are one row a key by now; each dimension is ranked among them.
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("count"), "key"))
    return counted.withColumn("place", place).filter("place <= most").select("dimension", "key", F.col("count").alias("n"), "place")


def tally(rows: DataFrame, column: str, most: int = 10) -> DataFrame:
    """(key, n): the most frequent values that are not empty, ties by key."""
    return rows.filter(F.col(column) != "").groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(most)


def durations(events: DataFrame, span: Span) -> DataFrame:
    """(p50, p95, avg, samples): nearest-rank percentiles and rounded mean of ms over extractions."""
    rows = in_span(events, span).filter("type = 'extract' AND ms IS NOT NULL")
    return rows.agg(
        F.expr("cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY ms) AS bigint)").alias("p50"),
        F.expr("cast(percentile_disc(0.95) WITHIN GROUP (ORDER BY ms) AS bigint)").alias("p95"),
        F.floor(F.avg("ms") + 0.5).alias("avg"),
        F.count("ms").alias("samples"),
    )


def funnel(events: DataFrame, span: Span) -> DataFrame:
    """(visited, extracted, exported): sums of the days' distinct visitors of each step."""
    per_day = in_span(events, span).groupBy("day").agg(
        _visitors(F.col("type").isin(*VISIT_TYPES)).alias("a"), _visitors(F.col("type") == "extract").alias("b"), _visitors(F.col("type") == "export").alias("c")
    )
    return per_day.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in (("a", "visited"), ("b", "extracted"), ("c", "exported"))])


def retained(events: DataFrame, today: date, days: int = 90) -> DataFrame:
    """Events that a purge of days older than `days` keeps."""
    return events.filter(F.col("day") >= F.date_sub(F.lit(today), days))


# -- facts of a request


def user_agent(ua: Column) -> Column:
    """struct(dev, br, os) of a user-agent string."""

    def has(pattern: str) -> Column:
        return F.rlike(F.coalesce(ua, F.lit("")), F.lit("(?i)" + pattern))

    def first(*cases: tuple[str, str]) -> Column:
        out = F.lit("other")
        for pattern, name in reversed(cases):
            out = F.when(has(pattern), name).otherwise(out)
        return out

    # What marks programs, devices, browsers and systems, in order of precedence.
    bot = (F.coalesce(ua, F.lit("")) == "") | has(r"bot|crawl|spider|slurp|facebookexternalhit|preview|monitor|uptime|curl/|wget|python-requests|httpclient|headless|lighthouse|pingdom|go-http|axios|node-fetch|okhttp|java/")
    dev = F.when(bot, "bot").when(has(r"ipad|tablet|(android(?!.*mobile))"), "tablet").when(has(r"mobi|iphone|ipod|android.*mobile"), "mobile").otherwise("desktop")
    br = first((r"edg(e|a|ios)?/", "Edge"), (r"opr/|opera", "Opera"), (r"samsungbrowser", "Samsung Internet"), (r"fxios|firefox", "Firefox"), (r"crios|chrome|chromium", "Chrome"), (r"safari", "Safari"))
    os = first((r"iphone|ipad|ipod", "iOS"), (r"android", "Android"), (r"windows", "Windows"), (r"cros", "ChromeOS"), (r"mac os x|macintosh", "macOS"), (r"linux|x11", "Linux"))
    return F.struct(dev.alias("dev"), F.when(bot, "other").otherwise(br).alias("br"), F.when(bot, "other").otherwise(os).alias("os"))


def viewport(width: Column) -> Column:
    """Bucket of a width in pixels; null if it is none."""
    w = width.cast("double")
    ok = w.isNotNull() & ~F.isnan(w) & (w > 0) & (w <= 20000)
    return F.when(~ok, F.lit(None).cast("string")).when(w < 480, "<480").when(w < 768, "480-767").when(w < 1024, "768-1023").when(w < 1440, "1024-1439").otherwise("1440+")


def primary_language(header: Column) -> Column:
    found = F.lower(F.regexp_extract(header, r"(?i)^\s*([a-z]{2,3})(?:[-_;,]|$)", 1))
    return F.nullif(found, F.lit(""))


#: Paths that are told apart; all others are "other".
PATHS = ("/", "/about", "/author", "/terms", "/privacy", "/login", "/request-access", "/redeem", "/account")


def normal_path(path: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"/+$", "")
    cut = F.when(cut == "", "/").otherwise(cut)
    return F.when(cut.isin(*PATHS), cut).otherwise("other")


def outcome(error_kind: Column, status: Column, timed_out: Column) -> Column:
    """What became of a fetch, by the first that applies."""
    return (
        F.when(error_kind.isin("robots", "demo-only", "blocked-url", "too-large", "network"), error_kind)
        .when(status.isin(401, 403, 406, 429, 451), "blocking")
        .when(status.isNotNull() & ((status < 200) | (status >= 300)), "http-error")
        .when(timed_out, "timeout")
        .otherwise("ok")
    )


def visitor_hash(salt: Column, ip: Column, ua: Column) -> Column:
    """First 16 hex digits of HMAC-SHA256(salt, ip|ua); salt has at most 64 bytes and is renewed every day."""
    block = F.rpad(F.hex(salt.cast("binary")), 128, "0")

    def keyed(pad: int, message: Column) -> Column:
        # XOR of a hex string with a byte repeated: digit by digit, by a translation of the sixteen digits.
        hi, lo = pad >> 4, pad & 15
        digits = "0123456789ABCDEF"
        high = F.translate(F.regexp_replace(block, "(.).", "$1"), digits, "".join(digits[i ^ hi] for i in range(16)))
        low = F.translate(F.regexp_replace(block, ".(.)", "$1"), digits, "".join(digits[i ^ lo] for i in range(16)))
        key = F.array_join(F.zip_with(F.split(high, "(?!^)"), F.split(low, "(?!^)"), lambda a, b: F.concat(a, b)), "")
        return F.sha2(F.concat(F.unhex(key), message), 256)

    inner = keyed(0x36, F.concat_ws("|", ip, ua).cast("binary"))
    return F.substring(keyed(0x5C, F.unhex(inner)), 1, 16)
