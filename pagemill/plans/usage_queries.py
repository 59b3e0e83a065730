"""Queries over the events table, read as a usage log, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy
from ..operators import access, admission, intake, usage

SPAN = usage.Span(date(2024, 1, 30), 14)
# How the table's event types read as usage events.
KINDS = {"view": "pageview", "click": "extract", "purchase": "export", "error": "ratelimit", "signup": "login"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"

#: The usage log in SQL; `ms` is the value in hundredths.
LOG = f"""
WITH log AS (
  SELECT event_id, ts AS t, CAST(ts AS DATE) AS day, {_CASE} AS type, CAST(user_id AS VARCHAR) AS v, CAST(floor(value * 100) AS BIGINT) AS ms,
         CASE WHEN user_id % 11 = 0 THEN 'bot' WHEN user_id % 3 = 0 THEN 'mobile' ELSE 'desktop' END AS dev,
         '/' || CAST(user_id % 13 AS VARCHAR) AS path,
         CASE event_id % 5 WHEN 0 THEN 'robots' WHEN 1 THEN 'blocking' WHEN 2 THEN 'demo-only' ELSE 'ok' END AS outcome,
         'h' || CAST(event_id % 23 AS VARCHAR) || '.org' AS host,
         CASE WHEN user_id % 7 = 0 THEN 'member' ELSE 'anon' END AS tier,
         CASE WHEN event_id % 3 <> 0 THEN 'r' || CAST(event_id % 17 AS VARCHAR) || '.example.org' END AS ref,
         'b' || CAST(user_id % 5 AS VARCHAR) AS br, 'o' || CAST(user_id % 4 AS VARCHAR) AS os, 'l' || CAST(event_id % 12 AS VARCHAR) AS lang,
         CASE event_id % 8 WHEN 0 THEN '' ELSE 'w' || CAST(event_id % 8 AS VARCHAR) END AS vw,
         CASE user_id % 3 WHEN 0 THEN 'dark' WHEN 1 THEN 'light' END AS cs, CASE WHEN event_id % 6 = 0 THEN 'paste' ELSE 'url' END AS mode
  FROM events),
spanned AS (SELECT * FROM log WHERE day > DATE '2024-01-30' - 14 AND day <= DATE '2024-01-30' AND dev IS DISTINCT FROM 'bot')
"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    u, i = F.col("user_id"), F.col("event_id")
    rows = e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("t"),
        F.try_element_at(kind, F.col("event_type")).alias("type"),
        u.cast("string").alias("v"),
        F.floor(F.col("value") * 100).alias("ms"),
        F.when(u % 11 == 0, "bot").when(u % 3 == 0, "mobile").otherwise("desktop").alias("dev"),
        F.concat(F.lit("/"), (u % 13).cast("string")).alias("path"),
        F.when(i % 5 == 0, "robots").when(i % 5 == 1, "blocking").when(i % 5 == 2, "demo-only").otherwise("ok").alias("outcome"),
        F.concat(F.lit("h"), (i % 23).cast("string"), F.lit(".org")).alias("host"),
        F.when(u % 7 == 0, "member").otherwise("anon").alias("tier"),
        F.when(i % 3 != 0, F.concat(F.lit("r"), (i % 17).cast("string"), F.lit(".example.org"))).alias("ref"),
        F.concat(F.lit("b"), (u % 5).cast("string")).alias("br"),
        F.concat(F.lit("o"), (u % 4).cast("string")).alias("os"),
        F.concat(F.lit("l"), (i % 12).cast("string")).alias("lang"),
        F.when(i % 8 == 0, "").otherwise(F.concat(F.lit("w"), (i % 8).cast("string"))).alias("vw"),
        F.when(u % 3 == 0, "dark").when(u % 3 == 1, "light").alias("cs"),
        F.when(i % 6 == 0, "paste").otherwise("url").alias("mode"),
    )
    return usage.complete(rows)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.when(F.col("user_id") % 7 == 0, "member").otherwise("anon").alias("tier"))


_REQ = "WITH r AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS at_ms, CASE WHEN user_id % 7 = 0 THEN 'member' ELSE 'anon' END AS tier FROM events)"
_V = "count(DISTINCT CASE WHEN type IN ('pageview', 'extract', 'export') THEN v END)"


def _breakdown_sql() -> str:
    parts = []
    for name, (column, cond, most) in usage.BREAKDOWNS.items():
        parts.append(f"SELECT '{name}' AS dimension, {column} AS key, {most} AS most, count(*) AS n FROM spanned WHERE {cond} AND {column} <> '' GROUP BY 2")
    return LOG + ", c AS (" + " UNION ALL ".join(parts) + "), p AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, key) AS place FROM c) SELECT dimension, key, n, CAST(place AS INT) AS place FROM p WHERE place <= most"


def events_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir).withColumn("end_ms", F.col("at_ms") + 60_000 * (1 + F.col("user_id") % 9))
    r = admission.too_many_at_once(r, "at_ms", "end_ms", 3)
    done = admission.admitted(r, "user_id", "at_ms", "event_id", 2, 6 * 3_600_000, F.col("event_id") % 4 != 0, 25, busy=F.col("busy"))
    return done.select("event_id", "decision")


def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = admission.rate_limited(requests(spark, sf_dir), "user_id", "at_ms", "event_id", 2, 6 * 3_600_000)
    return r.select("event_id", "hits", "allowed")


def _tier_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = admission.tier_limits(requests(spark, sf_dir))
    return r.groupBy("tier", "max_hits", "daily_cap").agg(F.count(F.lit(1)).alias("n"))


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = admission.daily_capped(requests(spark, sf_dir), "at_ms", "event_id", 40)
    return r.select("event_id", F.col("used").cast("long").alias("used"), "within_cap")


def _busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir).withColumn("end_ms", F.col("at_ms") + 60_000 * (1 + F.col("user_id") % 9))
    return admission.too_many_at_once(r, "at_ms", "end_ms", 2).select("event_id", F.col("running").cast("long").alias("running"), "busy")


def _kept_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir).select(F.col("user_id").cast("string").alias("email"), "at_ms")
    return admission.stored_requests(r).filter("kept").groupBy("email").agg(F.count(F.lit(1)).alias("n"), F.min("at_ms").alias("first_ms"))


def _removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir).select(F.col("user_id").cast("string").alias("email"), "event_id")
    gone = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'signup' AND user_id % 3 = 0").select(F.col("user_id").cast("string").alias("email"))
    return admission.without_member({"requests": r}, gone)["requests"]


def _purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = F.when(F.col("tier") == "member", 20).otherwise(5)
    return admission.purged(requests(spark, sf_dir), 1_706_659_200_000, F.col("at_ms"), keep).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


#: Browsers of the log's users, one of them a program.
BROWSERS = ("Mozilla/5.0 (Windows NT 10.0) Chrome/120.0", "Mozilla/5.0 (iPhone) Safari/604.1", "curl/8.0", "Mozilla/5.0 (X11; Linux x86_64) Firefox/121.0", "Mozilla/5.0 (iPad) Safari/604.1")


def _request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as requests: addresses shared by users, some owners, members, programs and people who opted out."""
    u, i = F.col("user_id"), F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.col("ts").cast("timestamp").alias("t"), F.when(F.col("event_type") == "view", "pageview").otherwise(F.col("event_type")).alias("type"), F.concat(F.lit("10.0.0."), (u % 40).cast("string")).alias("ip"),
        F.element_at(F.array(*map(F.lit, BROWSERS)), (u % len(BROWSERS) + 1).cast("int")).alias("ua"), (u % 29 == 0).alias("owner"), (u % 7 == 0).alias("member"), F.when(i % 13 == 0, "1").alias("dnt"), F.when(i % 17 == 0, "1").otherwise("0").alias("gpc"),
        F.when(i % 2 == 0, "/about?x").otherwise("/no").alias("path"), F.concat(F.lit("https://www.h"), (i % 5).cast("string"), F.lit(".org/")).alias("referrer"), F.lit("h3.org").alias("host"),
        F.concat(F.substring("event_type", 1, 2), F.lit("-X")).alias("language"), (F.col("value") * 10).alias("width"), (u % 3 == 0).alias("dark"), (u % 2 == 0).alias("touch"),
    )


def _tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the log is recorded; days of even number have a salt."""
    r = _request_log(spark, sf_dir)
    salts = r.select(F.to_date("t").alias("day")).distinct().filter("day(day) % 2 = 0").withColumn("salt", F.date_format("day", "yyyyMMdd"))
    e = intake.tracked(r, salts, "event_id", 4, 6 * 3_600_000)
    return e.select("event_id", "type", "tier", "dev", "br", "path", "ref", "lang", "vw", "cs", "touch", "v")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as requests for access: some by programs that fill every field, without leave or with odd addresses."""
    u, i = F.col("user_id"), F.col("event_id")
    r = requests(spark, sf_dir).select(
        "event_id", "at_ms", F.concat(F.lit("10.0.0."), (u % 40).cast("string")).alias("ip"), F.when(i % 19 == 0, "nobody").otherwise(F.concat(F.lit("u"), u.cast("string"), F.lit("@Example.org "))).alias("email"),
        F.when(i % 11 == 0, "http://x").when(i % 11 == 1, " ").alias("website"), F.when(i % 5 > 0, "1").alias("agree"),
    )
    return intake.access_requests(r, "event_id", 2, 6 * 3_600_000, 20).select("event_id", "decision")


def _options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event's user may ask of a fetch: the value as a time, the type's first letters as a language."""
    u = F.col("user_id")
    tier = F.when(u % 7 == 0, "member").when(u % 7 == 1, "owner").otherwise("anon")
    lang = F.when(u % 2 == 0, F.substring("event_type", 1, 2)).when(u % 3 == 0, "ENG")
    images = F.when(u % 5 == 0, F.lit(False)).when(u % 5 == 1, F.lit(True))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", policy.fetch_options(tier, F.when(u % 9 > 0, F.col("value") * 60), lang, u % 4 > 0, images).alias("o")).select("event_id", "o.images", "o.useMetaLanguage", "o.language", "o.timeoutMs", F.col("o.pageBytes").cast("long").alias("pageBytes"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        "event_id",
        usage.viewport(F.col("value") * 20 - 100).alias("vw"),
        usage.normal_path(F.concat(F.element_at(F.array(*map(F.lit, ["/about", "/x", "", "/login/"])), (F.col("event_id") % 4 + 1).cast("int")), F.lit("?q=1"))).alias("path"),
        usage.primary_language(F.element_at(F.array(*map(F.lit, ["en-US,fr;q=0.8", " DE", "123", "eng_x", "english"])), (F.col("event_id") % 5 + 1).cast("int"))).alias("lang"),
        usage.outcome(F.when(F.col("user_id") % 5 == 0, "robots"), F.when(F.col("user_id") % 3 == 0, F.lit(403)).when(F.col("user_id") % 3 == 1, F.lit(500)), F.col("event_id") % 2 == 0).alias("outcome"),
    )


AGENTS = (
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605 (KHTML, like Gecko) Version/17.0 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537 Chrome/120 Mobile Safari/537",
    "Mozilla/5.0 (Linux; Android 13; SM-X700) AppleWebKit/537 SamsungBrowser/23 Chrome/115 Safari/537",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537 Chrome/120 Safari/537 Edg/120.0",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (X11; CrOS x86_64 14541) AppleWebKit/537 Chrome/119 Safari/537",
    "Opera/9.80 (Macintosh; Intel Mac OS X 10.6) Presto/2.12",
    "Googlebot/2.1 (+http://www.google.com/bot.html)",
    "",
)
_AGENT_FACTS = [
    ("mobile", "Safari", "iOS"), ("mobile", "Chrome", "Android"), ("tablet", "Samsung Internet", "Android"), ("desktop", "Edge", "Windows"), ("desktop", "Firefox", "Linux"),
    ("desktop", "Chrome", "ChromeOS"), ("desktop", "Opera", "macOS"), ("bot", "other", "other"), ("bot", "other", "other"),
]


def _agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ua = usage.user_agent(F.element_at(F.array(*map(F.lit, AGENTS)), (F.col("event_id") % len(AGENTS) + 1).cast("int")))
    return e.select(ua.alias("a")).groupBy("a.dev", "a.br", "a.os").agg(F.count(F.lit(1)).alias("n"))


def _agents_sql() -> str:
    rows = ", ".join(f"({i}, '{d}', '{b}', '{o}')" for i, (d, b, o) in enumerate(_AGENT_FACTS))
    return f"SELECT dev, br, os, count(*) AS n FROM events JOIN (VALUES {rows}) AS a(i, dev, br, os) ON event_id % {len(AGENTS)} = i GROUP BY ALL"


#: What the events do as actions on the way in, by their number.
WAYS = (*("touch",) * 3, *("extract",) * 2, *("redeem",) * 4, "ask", "ask", "decline", "approve", "invite", "accept", "sign_out", "remove", "peek")
#: A log of days stands for one of months here, with a lock of two days.
DOORS = access.Terms(touch_ms=admission.DAY_MS, lock_ms=2 * admission.DAY_MS)


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as actions of persons, with one of two codes and one of four versions of the terms."""
    i = F.col("event_id")
    way = F.element_at(F.array(*map(F.lit, WAYS)), (i * 7 % len(WAYS) + 1).cast("int"))
    email = F.concat(F.lit("u"), (F.col("user_id") % 1000).cast("string"), F.lit("@example.org"))
    return requests(spark, sf_dir).select(email.alias("email"), (F.col("at_ms") * 8).alias("at_ms"), "event_id", way.alias("action"), F.concat(F.lit("c"), (i % 2).cast("string")).alias("detail"), F.concat(F.lit("v"), (i % 4).cast("string")).alias("version"))


def _access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.acted(access_log(spark, sf_dir), "event_id", DOORS).drop("at_ms")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.standings(access.acted(access_log(spark, sf_dir), "event_id", DOORS), "event_id")


def _access_sql() -> str:
    """The same rules action by action in a recursive query: lapses, then the result, then the standing."""
    d = DOORS
    ways = ", ".join(f"'{w}'" for w in WAYS)
    return f"""
WITH RECURSIVE a AS (
  SELECT *, row_number() OVER (PARTITION BY email ORDER BY at_ms, event_id) AS rn FROM (
    SELECT 'u' || user_id % 1000 || '@example.org' AS email, epoch_us(ts) // 1000 * 8 AS at_ms, event_id, list_extract([{ways}], event_id * 7 % {len(WAYS)} + 1) AS action,
      'c' || event_id % 2 AS detail, 'v' || event_id % 4 AS version FROM events)
), s AS (
  SELECT email, 0::BIGINT AS rn, 0::BIGINT AS at_ms, NULL::BIGINT AS event_id, NULL::VARCHAR AS action, NULL::VARCHAR AS result, NULL::VARCHAR AS status, 0::BIGINT AS epoch, 0::BIGINT AS extractions, false AS pending, NULL::BIGINT AS seen_ms,
    NULL::VARCHAR AS terms, NULL::VARCHAR AS code, 0::BIGINT AS expires, NULL::BIGINT AS asked, 0::BIGINT AS failures, 0::BIGINT AS failed, 0::BIGINT AS locked, NULL::BIGINT AS touched FROM (SELECT DISTINCT email FROM a)
  UNION ALL
  SELECT email, rn, at_ms, event_id, action, result,
    CASE WHEN action = 'remove' THEN NULL WHEN result = 'ok' THEN 'active' WHEN result IN ('approved', 'invited') THEN coalesce(status, 'invited') ELSE status END,
    CASE WHEN action = 'remove' THEN 0 WHEN result = 'signed-out' THEN epoch + 1 ELSE epoch END,
    CASE WHEN action = 'remove' THEN 0 WHEN result = 'counted' THEN extractions + 1 ELSE extractions END,
    CASE WHEN result = 'taken' THEN true WHEN action IN ('remove', 'decline', 'approve') THEN false ELSE open END,
    CASE WHEN action = 'remove' THEN NULL WHEN result IN ('seen', 'counted') THEN at_ms ELSE seen_ms END,
    CASE WHEN action = 'remove' THEN NULL WHEN result = 'ok' THEN version WHEN result = 'accepted' THEN detail ELSE terms END,
    CASE WHEN action = 'remove' OR result = 'ok' THEN NULL WHEN result IN ('approved', 'invited') THEN detail ELSE code END,
    CASE WHEN result IN ('approved', 'invited') THEN at_ms + {d.invite_ms} ELSE expires END,
    CASE WHEN action = 'remove' THEN NULL WHEN result = 'taken' THEN at_ms WHEN pending AND NOT open THEN NULL ELSE asked END,
    CASE WHEN result = 'ok' THEN 0 WHEN result <> 'invalid' THEN bad WHEN bad + 1 >= {d.most_failures} THEN 0 ELSE bad + 1 END,
    CASE WHEN result = 'invalid' THEN at_ms ELSE failed END,
    CASE WHEN result = 'ok' THEN 0 WHEN result <> 'invalid' THEN locked WHEN bad + 1 >= {d.most_failures} THEN at_ms + {d.lock_ms} ELSE 0 END,
    CASE WHEN result IN ('seen', 'unknown') AND action = 'touch' THEN at_ms ELSE touched END
  FROM (SELECT *, CASE
      WHEN action = 'ask' THEN CASE WHEN open OR (NOT pending AND at_ms - asked < {d.quiet_ms}) THEN 'ignored' ELSE 'taken' END
      WHEN action = 'decline' THEN CASE WHEN open THEN 'declined' ELSE 'not-found' END
      WHEN action = 'approve' THEN CASE WHEN NOT open THEN 'not-found' WHEN status = 'active' THEN 'is-active' ELSE 'approved' END
      WHEN action = 'invite' THEN CASE WHEN status = 'active' THEN 'is-active' ELSE 'invited' END
      WHEN action = 'redeem' THEN CASE WHEN locked > at_ms THEN 'locked' WHEN status IS NOT NULL AND code = detail AND expires > at_ms THEN 'ok' ELSE 'invalid' END
      WHEN action = 'touch' THEN CASE WHEN at_ms - touched < {d.touch_ms} THEN 'recent' WHEN status IS NULL THEN 'unknown' ELSE 'seen' END
      WHEN action = 'remove' THEN CASE WHEN status IS NULL THEN 'not-found' ELSE 'removed' END
      WHEN action NOT IN ('accept', 'extract', 'sign_out') THEN 'no-action'
      WHEN status IS NULL THEN 'unknown' WHEN action = 'accept' THEN 'accepted' WHEN action = 'extract' THEN 'counted' ELSE 'signed-out' END AS result
    FROM (SELECT a.*, s.status, s.epoch, s.extractions, s.pending, s.seen_ms, s.terms, s.code, s.expires, s.asked, s.failures, s.failed, s.locked, s.touched,
        s.pending AND a.at_ms - s.asked < {d.pending_ms} AS open, CASE WHEN a.at_ms - s.failed >= {d.forget_ms} THEN 0 ELSE s.failures END AS bad
      FROM s JOIN a ON a.email = s.email AND a.rn = s.rn + 1))
)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "events_daily": lambda s, d: usage.daily(log(s, d), SPAN),
    "events_totals": lambda s, d: usage.totals(log(s, d), SPAN),
    "events_breakdowns": lambda s, d: usage.breakdowns(log(s, d), SPAN),
    "events_top_users": lambda s, d: usage.tally(log(s, d), "v", 10),
    "events_durations": lambda s, d: usage.durations(log(s, d), SPAN),
    "events_funnel": lambda s, d: usage.funnel(log(s, d), SPAN),
    "events_retained": lambda s, d: usage.retained(log(s, d), date(2024, 1, 30), 10).groupBy("day").agg(F.count(F.lit(1)).alias("n")),
    "events_rate_limited": _limited,
    "events_tier_limits": _tier_limited,
    "events_daily_cap": _capped,
    "events_admission": events_admission,
    "events_busy": _busy,
    "events_request_dedup": _kept_requests,
    "events_member_removed": _removed,
    "events_purged": _purged,
    "events_request_facts": _facts,
    "events_fetch_options": _options,
    "events_tracked": _tracked,
    "events_access_requests": _asked,
    "events_access": _access,
    "events_members": _members,
    "events_user_agents": _agents,
    "events_visitor_hash": lambda s, d: log(s, d).select("v", usage.visitor_hash(F.date_format("day", "yyyyMMdd"), F.col("v"), F.col("dev")).alias("hash")).distinct(),
}

SQL: dict[str, str] = {
    "events_daily": LOG + f", g AS (SELECT day, {_V} AS visitors, count(*) FILTER (type = 'pageview') AS pageviews, count(*) FILTER (type = 'extract') AS extractions FROM spanned GROUP BY day) "
    "SELECT CAST(c.day AS DATE) AS day, coalesce(visitors, 0) AS visitors, coalesce(pageviews, 0) AS pageviews, coalesce(extractions, 0) AS extractions "
    "FROM (SELECT CAST(unnest(range(DATE '2024-01-17', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) c LEFT JOIN g USING (day)",
    "events_totals": LOG + f"SELECT count(*) AS \"eventCount\", count(*) FILTER (type = 'pageview') AS pageviews, count(*) FILTER (type = 'extract') AS extractions, count(*) FILTER (type = 'export') AS exports, "
    "count(*) FILTER (type = 'ratelimit') AS \"rateLimited\", 0::BIGINT AS \"capReached\", 0::BIGINT AS busy, 0::BIGINT AS boots, 0::BIGINT AS \"accessRequests\", 0::BIGINT AS invites, 0::BIGINT AS redemptions, "
    "count(*) FILTER (type = 'login') AS logins, count(*) FILTER (type = 'extract' AND outcome = 'ok') AS \"extractionsOk\", "
    f"CAST((SELECT sum(n) FROM (SELECT {_V} AS n FROM spanned GROUP BY day)) AS BIGINT) AS visitors FROM spanned",
    "events_breakdowns": _breakdown_sql(),
    "events_top_users": LOG + "SELECT v AS key, count(*) AS n FROM log WHERE v <> '' GROUP BY v ORDER BY n DESC, key LIMIT 10",
    "events_durations": LOG + "SELECT quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, CAST(floor(avg(ms) + 0.5) AS BIGINT) AS avg, count(ms) AS samples FROM spanned WHERE type = 'extract'",
    "events_funnel": LOG + f"SELECT CAST(sum(a) AS BIGINT) AS visited, CAST(sum(b) AS BIGINT) AS extracted, CAST(sum(c) AS BIGINT) AS exported FROM (SELECT {_V} AS a, count(DISTINCT CASE WHEN type = 'extract' THEN v END) AS b, count(DISTINCT CASE WHEN type = 'export' THEN v END) AS c FROM spanned GROUP BY day)",
    "events_retained": LOG + "SELECT day, count(*) AS n FROM log WHERE day >= DATE '2024-01-30' - 10 GROUP BY day",
    "events_rate_limited": _REQ + ", h AS (SELECT a.event_id, count(*) AS hits FROM r a JOIN r b ON a.user_id = b.user_id AND b.at_ms > a.at_ms - 21600000 AND (b.at_ms < a.at_ms OR (b.at_ms = a.at_ms AND b.event_id <= a.event_id)) GROUP BY a.event_id) SELECT event_id, hits, hits <= 2 AS allowed FROM h",
    "events_tier_limits": _REQ + " SELECT tier, CASE tier WHEN 'anon' THEN 10 ELSE 30 END AS max_hits, CASE tier WHEN 'anon' THEN 300 ELSE 1000 END AS daily_cap, count(*) AS n FROM r GROUP BY tier",
    "events_daily_cap": _REQ + ", n AS (SELECT event_id, row_number() OVER (PARTITION BY tier, at_ms // 86400000 ORDER BY at_ms, event_id) AS used FROM r) SELECT event_id, used, used <= 40 AS within_cap FROM n",
    "events_admission": _REQ + ", h AS (SELECT a.event_id, count(*) AS hits FROM r a JOIN r b ON a.user_id = b.user_id AND b.at_ms > a.at_ms - 21600000 AND (b.at_ms < a.at_ms OR (b.at_ms = a.at_ms AND b.event_id <= a.event_id)) GROUP BY a.event_id), "
    "x AS (SELECT *, at_ms + 60000 * (1 + user_id % 9) AS end_ms FROM r), "
    "b AS (SELECT a.event_id, count(*) > 3 AS busy FROM x a JOIN x b ON b.at_ms <= a.at_ms AND b.end_ms > a.at_ms GROUP BY a.event_id), "
    "j AS (SELECT r.*, hits <= 2 AS ok, event_id % 4 <> 0 AS valid, busy FROM r JOIN h USING (event_id) JOIN b USING (event_id)), "
    "k AS (SELECT event_id, row_number() OVER (PARTITION BY tier, at_ms // 86400000 ORDER BY at_ms, event_id) AS used FROM j WHERE ok AND valid AND NOT busy) "
    "SELECT event_id, CASE WHEN NOT ok THEN 'limited' WHEN NOT valid THEN 'invalid' WHEN busy THEN 'busy' WHEN used > 25 THEN 'capped' ELSE 'run' END AS decision FROM j LEFT JOIN k USING (event_id)",
    "events_busy": _REQ + ", x AS (SELECT *, at_ms + 60000 * (1 + user_id % 9) AS end_ms FROM r) SELECT event_id, (SELECT count(*) FROM x y WHERE y.at_ms <= x.at_ms AND y.end_ms > x.at_ms) AS running, (SELECT count(*) FROM x y WHERE y.at_ms <= x.at_ms AND y.end_ms > x.at_ms) > 2 AS busy FROM x",
    "events_member_removed": _REQ + " SELECT CAST(user_id AS VARCHAR) AS email, event_id FROM r WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND user_id % 3 = 0)",
    "events_purged": _REQ + " SELECT tier, count(*) AS n FROM r WHERE at_ms >= 1706659200000 - CASE WHEN tier = 'member' THEN 20 ELSE 5 END * 86400000::BIGINT GROUP BY tier",
    "events_request_dedup": "WITH RECURSIVE r AS (SELECT CAST(user_id AS VARCHAR) AS email, epoch_us(ts) // 1000 AS at_ms FROM events), "
    "f AS (SELECT email, min(at_ms) AS at_ms FROM r GROUP BY email UNION ALL SELECT f.email, (SELECT min(r.at_ms) FROM r WHERE r.email = f.email AND r.at_ms - f.at_ms >= 604800000) FROM f WHERE f.at_ms IS NOT NULL) "
    "SELECT email, count(at_ms) AS n, min(at_ms) AS first_ms FROM f WHERE at_ms IS NOT NULL GROUP BY email",
    "events_fetch_options": "SELECT event_id, user_id % 7 = 0 AND user_id % 5 <> 0 AS images, user_id % 4 > 0 AS \"useMetaLanguage\", CASE WHEN user_id % 2 = 0 THEN substr(event_type, 1, 2) ELSE 'en' END AS language, "
    "CASE WHEN user_id % 9 > 0 THEN least(greatest(value * 60, 1000.0), 12000.0) ELSE 12000.0 END::DOUBLE AS \"timeoutMs\", CASE WHEN user_id % 7 IN (0, 1) THEN 5000000 ELSE 3000000 END::BIGINT AS \"pageBytes\" FROM events",
    "events_request_facts": "SELECT event_id, CASE WHEN w <= 0 OR w > 20000 OR isnan(w) THEN NULL WHEN w < 480 THEN '<480' WHEN w < 768 THEN '480-767' WHEN w < 1024 THEN '768-1023' WHEN w < 1440 THEN '1024-1439' ELSE '1440+' END AS vw, "
    "CASE event_id % 4 WHEN 0 THEN '/about' WHEN 1 THEN 'other' WHEN 2 THEN '/' ELSE '/login' END AS path, "
    "CASE event_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 3 THEN 'eng' END AS lang, "
    "CASE WHEN user_id % 5 = 0 THEN 'robots' WHEN user_id % 3 = 0 THEN 'blocking' WHEN user_id % 3 = 1 THEN 'http-error' WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'ok' END AS outcome "
    "FROM (SELECT *, value * 20 - 100 AS w FROM events)",
    "events_user_agents": _agents_sql(),
    "events_tracked": "WITH r AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, epoch_us(ts) // 1000 AS at_ms, CASE WHEN event_type = 'view' THEN 'pageview' ELSE event_type END AS type, value * 10 AS w, '10.0.0.' || user_id % 40 AS ip, "
    f"[{', '.join(repr(a) for a in BROWSERS)}][user_id % {len(BROWSERS)} + 1] AS ua, event_id % 13 = 0 OR event_id % 17 = 0 AS opted FROM events WHERE user_id % 29 <> 0), p AS (SELECT * FROM r WHERE type = 'pageview' AND NOT opted), "
    "h AS (SELECT a.event_id, count(*) AS hits FROM p a JOIN p b ON a.ip = b.ip AND b.at_ms > a.at_ms - 21600000 AND (b.at_ms < a.at_ms OR (b.at_ms = a.at_ms AND b.event_id <= a.event_id)) GROUP BY 1), "
    "k AS (SELECT r.*, hits IS NOT NULL AS seen FROM r LEFT JOIN h USING (event_id) WHERE (type IS DISTINCT FROM 'pageview' OR hits <= 4) AND user_id % 5 <> 2), m AS (SELECT *, strftime(day, '%Y%m%d') AS d FROM k), "
    "n AS (SELECT *, array_to_string(list_transform(range(1, 9), lambda i: printf('%02x', xor(ascii(substr(d, CAST(i AS INT), 1)), 54))), '') || repeat('36', 56) AS a, "
    "array_to_string(list_transform(range(1, 9), lambda i: printf('%02x', xor(ascii(substr(d, CAST(i AS INT), 1)), 92))), '') || repeat('5c', 56) AS b FROM m) "
    "SELECT event_id, type, CASE WHEN user_id % 7 = 0 THEN 'member' ELSE 'anon' END AS tier, CASE WHEN seen THEN CASE user_id % 5 WHEN 1 THEN 'mobile' WHEN 4 THEN 'tablet' ELSE 'desktop' END END AS dev, "
    "CASE WHEN seen THEN CASE user_id % 5 WHEN 0 THEN 'Chrome' WHEN 3 THEN 'Firefox' ELSE 'Safari' END END AS br, CASE WHEN seen THEN CASE WHEN event_id % 2 = 0 THEN '/about' ELSE 'other' END END AS path, "
    "CASE WHEN seen AND event_id % 5 <> 3 THEN 'h' || event_id % 5 || '.org' END AS ref, CASE WHEN seen THEN 'vi' END AS lang, "
    "CASE WHEN NOT seen OR w <= 0 OR w > 20000 OR isnan(w) THEN NULL WHEN w < 480 THEN '<480' WHEN w < 768 THEN '480-767' WHEN w < 1024 THEN '768-1023' WHEN w < 1440 THEN '1024-1439' WHEN w >= 1440 THEN '1440+' END AS vw, "
    "CASE WHEN seen THEN CASE WHEN user_id % 3 = 0 THEN 'dark' ELSE 'light' END END AS cs, CASE WHEN seen THEN user_id % 2 = 0 END AS touch, "
    "CASE WHEN NOT opted AND day(day) % 2 = 0 THEN substr(sha256(unhex(b) || unhex(sha256(unhex(a) || encode(ip || '|' || ua)))), 1, 16) END AS v FROM n",
    "events_access_requests": _REQ + ", q AS (SELECT *, user_id % 40 AS ip FROM r), h AS (SELECT a.event_id, count(*) AS hits FROM q a JOIN q b ON a.ip = b.ip AND b.at_ms > a.at_ms - 21600000 AND (b.at_ms < a.at_ms OR (b.at_ms = a.at_ms AND b.event_id <= a.event_id)) GROUP BY 1), "
    "s AS (SELECT q.*, CASE WHEN hits > 2 THEN 'limited' WHEN event_id % 11 = 0 THEN 'pretended' WHEN event_id % 5 = 0 THEN 'terms' WHEN event_id % 19 = 0 THEN 'email' END AS said FROM q JOIN h USING (event_id)) "
    "SELECT event_id, coalesce(said, CASE WHEN row_number() OVER (PARTITION BY said IS NULL, at_ms // 86400000 ORDER BY at_ms, event_id) <= 20 THEN 'taken' ELSE 'capped' END) AS decision FROM s",
    # HMAC by its definition: hash(outer key + hash(inner key + message)), the salt's bytes padded to 64 and combined with 0x36 and 0x5c.
    "events_visitor_hash": LOG + ", k AS (SELECT v, dev, strftime(day, '%Y%m%d') AS d FROM log), p AS (SELECT v, concat_ws('|', v, dev) AS m, "
    "array_to_string(list_transform(range(1, 9), lambda i: printf('%02x', xor(ascii(substr(d, CAST(i AS INT), 1)), 54))), '') || repeat('36', 56) AS a, "
    "array_to_string(list_transform(range(1, 9), lambda i: printf('%02x', xor(ascii(substr(d, CAST(i AS INT), 1)), 92))), '') || repeat('5c', 56) AS b FROM k) "
    "SELECT DISTINCT v, substr(sha256(unhex(b) || unhex(sha256(unhex(a) || encode(m)))), 1, 16) AS hash FROM p",
    "events_access": _access_sql() + " SELECT email, event_id, action, result, status, epoch, extractions, pending, seen_ms, terms FROM s WHERE rn > 0",
    "events_members": _access_sql() + " SELECT email, status, epoch, extractions, pending, seen_ms, terms FROM s WHERE status IS NOT NULL AND rn = (SELECT max(a.rn) FROM a WHERE a.email = s.email)",
}
