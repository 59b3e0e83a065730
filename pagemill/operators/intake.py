"""What of a request log becomes usage events, and which requests for access are taken in.

requests has t (timestamp), type (pageview for a visit's beacon), ip, ua, owner, member, dnt and gpc, and for beacons path,
referrer, host, language, width, dark and touch.  A null flag counts as not set and a null user agent as a program's.
"""

from __future__ import annotations

import secrets
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import links
from . import admission, usage

BEACON = "pageview"


def opted_out(dnt: Column, gpc: Column) -> Column:
    """Whether a browser asks not to be followed."""
    return F.coalesce(dnt == "1", F.lit(False)) | F.coalesce(gpc == "1", F.lit(False))


def daily_salt(salts: DataFrame, today: date) -> DataFrame:
    """The table of salts (day, salt) with today's row alone, drawn where it is missing: hashes of days gone by can't be made again."""
    kept = salts.filter(F.col("day") == F.lit(today)).select("day", "salt")
    return salts.sparkSession.createDataFrame([(today, secrets.token_hex(32))], kept.schema) if kept.isEmpty() else kept


def tracked(requests: DataFrame, salts: DataFrame, order: str, beacons: int = 60, window_ms: int = 60_000) -> DataFrame:
    """requests that are recorded, as usage events with their own columns beside.

    The owner and programs are never recorded.  Who opted out has no beacon, and no hash in other events.  Beacons of one address
    are limited; the limit counts those of programs too.  salts has one salt a day (a day without one has no hashes); the
    table is as small as the span of days and is broadcast.
    """
    out = opted_out(F.col("dnt"), F.col("gpc"))
    rows = requests.filter(~F.coalesce(F.col("owner"), F.lit(False))).withColumns({"opted": out, "at_ms": F.unix_millis("t")})
    beacon = F.coalesce(F.col("type") == BEACON, F.lit(False))
    visits = admission.rate_limited(rows.filter(beacon & ~F.col("opted")), "ip", "at_ms", order, beacons, window_ms).filter("allowed").drop("hits", "allowed")
    client = usage.user_agent(F.col("ua"))
    visits = visits.withColumns(
        {
            "dev": client["dev"], "br": client["br"], "os": client["os"], "path": usage.normal_path(F.col("path")), "ref": links.referrer_host(F.col("referrer"), F.col("host")),
            "lang": usage.primary_language(F.col("language")), "vw": usage.viewport(F.col("width")), "cs": F.when(F.col("dark"), "dark").otherwise("light"), "touch": F.coalesce("touch", F.lit(False)),
        }
    )
    none = F.lit(None).cast("string")
    others = rows.filter(~beacon).withColumns(dict.fromkeys(("dev", "br", "os", "path", "ref", "lang", "vw", "cs"), none) | {"touch": F.lit(None).cast("boolean")})
    both = visits.unionByName(others.select(visits.columns)).filter(client["dev"] != "bot").withColumn("day", F.to_date("t"))
    salted = both.join(F.broadcast(salts.select(F.col("day").alias("salt_day"), "salt")), F.col("day") == F.col("salt_day"), "left")
    made = salted.withColumns({"tier": F.when(F.col("member"), "member").otherwise("anon"), "v": F.when(~F.col("opted"), usage.visitor_hash(F.col("salt"), F.col("ip"), F.col("ua")))})
    return made.drop("opted", "at_ms", "salt", "salt_day", "referrer", "language", "width", "dark")


def access_requests(requests: DataFrame, order: str, each: int = 3, window_ms: int = 3_600_000, cap: int = 20) -> DataFrame:
    """requests (ip, at_ms, email, website, agree) with decision: limited, pretended, terms, email, capped or taken.

    An address may ask so many times an hour.  A filled field that no person sees is thanked for and dropped.  What is well formed
    counts towards the day's cap, over which requests are dropped as well.
    """
    limited = admission.rate_limited(requests, "ip", "at_ms", order, each, window_ms)
    stage = (
        F.when(~F.col("allowed"), "limited").when(F.coalesce(F.trim("website"), F.lit("")) != "", "pretended").when(~F.coalesce(F.col("agree") == "1", F.lit(False)), "terms")
        .when(admission.normal_email(F.col("email")).isNull(), "email")
    )
    staged = limited.withColumn("decision", stage).drop("hits", "allowed")
    passed = admission.daily_capped(staged.filter("decision IS NULL").withColumn("form", F.lit("access")), "at_ms", order, cap, "form")
    passed = passed.withColumn("decision", F.when(F.col("within_cap"), "taken").otherwise("capped"))
    return staged.filter("decision IS NOT NULL").unionByName(passed.select(staged.columns))
