"""Who may do what how often: limits, caps, members and invitations, as batch operators over request logs.

No request is lost: one whose time is null is in no window and on no day, so it is neither limited nor capped; a null key, tier or
order is a value like any other, null first in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import free_names

# Fixed values: (tier, hits, window in ms, hits a day or null) of extractions, and (action, hits, window in ms) of other actions.
TIERS = (("anon", 10, 600_000, 300), ("member", 30, 600_000, 1000), ("owner", 120, 600_000, None))
ACTIONS = (("export", 60, 600_000), ("beacon", 60, 60_000), ("login", 5, 600_000), ("verify", 20, 600_000), ("redeem", 10, 600_000), ("request", 3, 3_600_000))
#: Letters and digits of an invitation code; those that look alike are left out.
CODE_LETTERS = "ABCDEFGHJKMNPQRSTUVWXYZ23456789"
DAY_MS = 86_400_000


def rate_limited(requests: DataFrame, key: str, at_ms: str, order: str, most: int | Column, window_ms: int) -> DataFrame:
    """requests with hits (of the key in the window up to this request, refused ones included; null without a time) and allowed.

    A key's time is cut into slots of one window, and each slot also gets the rows of the slot before, so a busy key is
    spread over its slots.  The frame is by time; hits at the same millisecond that come later in `order` are taken off.
    Rows without a time stay out of the windows.  Columns hits and allowed of the caller's are replaced.
    """
    own, at_slot = free_names(requests, "own", "slot")
    slot = F.floor(F.col(at_ms) / window_ms)
    timed = requests.filter(F.col(at_ms).isNotNull())
    both = timed.withColumn(own, F.explode(F.array(F.lit(True), F.lit(False)))).withColumn(at_slot, F.when(F.col(own), slot).otherwise(slot + 1))
    span = Window.partitionBy(key, at_slot).orderBy(at_ms).rangeBetween(1 - window_ms, Window.currentRow)
    peers = Window.partitionBy(key, at_slot, at_ms)
    later = F.count(F.lit(1)).over(peers) - F.row_number().over(peers.orderBy(order))
    limit = F.lit(most) if isinstance(most, int) else most
    hits = both.withColumn("hits", F.count(F.lit(1)).over(span) - later).filter(own).drop(own, at_slot)
    hits = hits.unionByName(requests.filter(F.col(at_ms).isNull()).withColumn("hits", F.lit(None).cast("long")))
    return hits.withColumn("allowed", F.coalesce(F.col("hits") <= limit, F.lit(True)))


def tier_limits(requests: DataFrame, tier: str = "tier") -> DataFrame:
    """requests with max_hits, window_ms and daily_cap of their tier."""
    table = requests.sparkSession.createDataFrame(TIERS, "tier string, max_hits int, window_ms long, daily_cap int")
    return requests.join(F.broadcast(table.withColumnRenamed("tier", tier)), tier, "left")  # a fixed table of three rows


def daily_capped(requests: DataFrame, at_ms: str, order: str, cap: int | Column, tier: str = "tier") -> DataFrame:
    """requests with used (place within day and tier, null without a time) and within_cap; no cap where it is null.

    Places come from counts per (day, tier, minute) and a rank inside the minute, so a busy tier is spread over tasks.
    """
    day, slot, nth, t, d, m, before = free_names(requests, "day", "slot", "nth", "tier_of", "day_of", "slot_of", "before")
    rows = requests.withColumn(day, F.floor(F.col(at_ms) / DAY_MS)).withColumn(slot, F.floor(F.col(at_ms) / 60_000))
    slots = rows.filter(F.col(at_ms).isNotNull()).groupBy(F.col(tier).alias(t), F.col(day).alias(d), F.col(slot).alias(m)).agg(F.count(F.lit(1)).alias(before))
    earlier = Window.partitionBy(t, d).orderBy(m).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    place = F.when(F.col(at_ms).isNotNull(), F.row_number().over(Window.partitionBy(tier, day, slot).orderBy(at_ms, order)))
    limit = F.lit(cap) if isinstance(cap, int) else cap
    same = F.col(tier).eqNullSafe(F.col(t)) & (F.col(day) == F.col(d)) & (F.col(slot) == F.col(m))
    out = rows.withColumn(nth, place).join(slots, same, "left").withColumn("used", F.col(before) + F.col(nth))
    return out.withColumn("within_cap", F.coalesce(F.col("used") <= limit, F.lit(True))).drop(day, slot, nth, t, d, m, before)


def admitted(requests: DataFrame, key: str, at_ms: str, order: str, most: int, window_ms: int, valid: Column, cap: int, tier: str = "tier", busy: Column | None = None) -> DataFrame:
    """requests with decision: limited, invalid, busy, capped or run; every stage counts only what the one before let pass.

    busy tells whether all places were taken when the request came; such a request uses nothing of the cap.
    """
    limited = rate_limited(requests, key, at_ms, order, most, window_ms)
    stage = F.when(~F.col("allowed"), "limited").when(~F.coalesce(valid, F.lit(False)), "invalid").when(F.lit(False) if busy is None else busy, "busy")
    limited = limited.withColumn("decision", stage)
    passed = daily_capped(limited.filter("decision IS NULL"), at_ms, order, cap, tier).withColumn("decision", F.when(F.col("within_cap"), "run").otherwise("capped"))
    keep = [*requests.columns, "decision"]
    return passed.select(keep).unionByName(limited.filter("decision IS NOT NULL").select(keep))


def too_many_at_once(runs: DataFrame, start_ms: str, end_ms: str, most: int = 2) -> DataFrame:
    """runs with running (runs under way when this one starts, itself included) and busy, by hour of start.

    Starts and ends are events of one series; a run may cross hours, and one without an end goes on.  A run without a start
    is never under way: its running is null and it is not busy.  Columns running and busy of the caller's are replaced.
    """
    begun = runs.filter(F.col(start_ms).isNotNull())
    starts = begun.select(F.col(start_ms).alias("t"), F.lit(1).alias("d"))
    ends = begun.filter(F.col(end_ms).isNotNull()).select(F.col(end_ms).alias("t"), F.lit(-1).alias("d"))
    step = starts.unionByName(ends).groupBy("t").agg(F.sum("d").alias("d"))
    hours = step.groupBy(F.floor(F.col("t") / 3_600_000).alias("h")).agg(F.sum("d").alias("sum"))
    carried = hours.select("h", F.coalesce(F.sum("sum").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carry"))
    inside = F.sum("d").over(Window.partitionBy("h").orderBy("t"))
    level = step.withColumn("h", F.floor(F.col("t") / 3_600_000)).withColumn("in", inside).join(carried, "h")
    at, now = free_names(runs, "at", "now")
    level = level.select(F.col("t").alias(at), (F.col("in") + F.col("carry")).alias(now))
    joined = runs.join(level, F.col(start_ms) == F.col(at), "left")
    return joined.withColumn("running", F.col(now)).drop(at, now).withColumn("busy", F.coalesce(F.col("running") > most, F.lit(False)))


# -- members, invitations, requests


def normal_email(email: Column) -> Column:
    """Trimmed lower-case address of 5 to 254 characters, null if it does not look like one."""
    e = F.lower(F.regexp_replace(email, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    part = r"""[^\s\p{Z}@<>()\[\]\\,;:"]"""
    return F.when(F.rlike(e, F.lit(rf"^{part}+@{part}+\.{part}{{2,}}\z")) & F.length(e).between(5, 254), e)


def normal_code(code: Column) -> Column:
    """An invitation code in upper case without what people type between its letters; null if what is left can't be one."""
    c = F.regexp_replace(F.upper(code), "[^A-Z0-9]", "")
    return F.when(F.rlike(c, F.lit(rf"^[{CODE_LETTERS}]{{10}}\z")), c)


def shown_code(code: Column) -> Column:
    """A code in two halves, as people read it."""
    return F.concat(F.substring(code, 1, 5), F.lit("-"), F.substring(code, 6, 5))


def code_well_formed(code: Column) -> Column:
    return F.coalesce(normal_code(code).isNotNull(), F.lit(False))


def without_member(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of the addresses in gone (column email)."""
    keys = gone.select("email").distinct()
    return {name: t.join(keys, "email", "left_anti") for name, t in tables.items()}


def current_invites(invites: DataFrame) -> DataFrame:
    """The latest invitation of each address."""
    best = F.max(F.struct("sent_ms", *[c for c in invites.columns if c not in ("email", "sent_ms")])).alias("b")
    return invites.groupBy("email").agg(best).select("email", "b.*")


def _told(rows: DataFrame, by: str, order: list[str], name: str, kind: str, step: Callable[[Any, dict], tuple[Any, Any]]) -> DataFrame:
    """rows with column name: step(state, row) gives the next state and the value, over each key's rows in order, from None.

    A key's rows pass by one after the other and are never held together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), None
        for b in batches:
            values = []
            for row in b.to_pylist():
                if row[by] != at:
                    at, state = row[by], None
                state, value = step(state, row)
                values.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, {"string": pa.string(), "boolean": pa.bool_()}[kind])], names=[*b.schema.names, name])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + [f"`{name}` {kind}"])
    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def redeemed(attempts: DataFrame, invites: DataFrame, now: str = "at_ms", most_failures: int = 5, lock_ms: int = 900_000) -> DataFrame:
    """attempts (email, code_hash, at_ms) with result: ok, wrong, expired, unknown or locked.

    After most_failures attempts in a row that were not ok an address is locked for lock_ms.
    """
    joined = attempts.join(current_invites(invites), "email", "left")
    said = (
        F.when(F.col("invite_hash").isNull(), "unknown").when(F.col("used"), "expired").when(F.col(now) > F.col("expires_ms"), "expired")
        .when(F.col("code_hash") == F.col("invite_hash"), "ok").otherwise("wrong")
    )

    def step(state: Any, row: dict) -> tuple[Any, str]:
        bad, until = state or (0, -1)
        if row[now] < until:
            return (bad, until), "locked"
        bad = 0 if row["said"] == "ok" else bad + 1
        return ((0, row[now] + lock_ms) if bad >= most_failures else (bad, until)), row["said"]

    return _told(joined.select("email", F.col(now).cast("long").alias(now), said.alias("said")), "email", [now, "said"], "result", "string", step).drop("said")


def stored_requests(requests: DataFrame, at_ms: str = "at_ms", quiet_ms: int = 7 * DAY_MS) -> DataFrame:
    """requests (email, at_ms) with kept: one is dropped while the last kept one of its address is under quiet_ms old."""

    def step(last: Any, row: dict) -> tuple[Any, bool]:
        kept = last is None or row[at_ms] - last >= quiet_ms
        return (row[at_ms] if kept else last), kept

    return _told(requests.select("email", F.col(at_ms).cast("long").alias(at_ms)), "email", [at_ms], "kept", "boolean", step)


def purged(rows: DataFrame, now_ms: int, at_ms: Column, keep_days: Column) -> DataFrame:
    """Rows that are no older than their number of days; a null number keeps them."""
    return rows.filter(F.coalesce(at_ms >= F.lit(now_ms) - keep_days * DAY_MS, F.lit(True)))


def newest_members(members: DataFrame) -> DataFrame:
    return members.orderBy(F.desc("added_ms"), "email")
