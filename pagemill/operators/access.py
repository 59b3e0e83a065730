"""How people get in: requests for access, invitations, codes, members, as keyed state over a log of actions.

A log has email, at_ms, an order among actions of one millisecond, action and detail:

=========  ====================================  =====================================================
action     detail                                result
=========  ====================================  =====================================================
ask        -                                     taken, ignored
decline    -                                     declined, not-found
approve    hash of a new code                    approved, is-active, not-found
invite     hash of a new code                    invited, is-active
redeem     hash of the code typed, terms         ok, invalid, locked
accept     version of the terms                  accepted, unknown
touch      -                                     seen, recent, unknown
extract    -                                     counted, unknown
sign_out   -                                     signed-out, unknown
remove     -                                     removed, not-found
=========  ====================================  =====================================================

Any other action is refused as no-action, one without a time as no-time and one without an address as no-email; none of them
changes anything.  `streaming.access` runs the same rules over a stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .admission import DAY_MS


@dataclass(frozen=True)
class Terms:
    """How long things hold, in ms."""

    invite_ms: int = 14 * DAY_MS
    quiet_ms: int = 7 * DAY_MS  # between two requests of one address
    pending_ms: int = 180 * DAY_MS  # after that an unanswered request is gone
    touch_ms: int = 3_600_000
    most_failures: int = 5
    lock_ms: int = 900_000
    forget_ms: int = 30 * DAY_MS  # without another attempt, failures are forgotten


@dataclass
class Standing:
    """What is known of one address; seen_ms, terms and the like are those of a member."""

    status: str | None = None
    added_by: str | None = None
    added_ms: int | None = None
    redeemed_ms: int | None = None
    terms: str | None = None
    terms_ms: int | None = None
    seen_ms: int | None = None
    extractions: int = 0
    epoch: int = 0
    code_hash: str | None = None  # of the one invitation that is open
    expires_ms: int = 0
    pending: bool = False
    asked_ms: int | None = None
    failures: int = 0
    failed_ms: int = 0
    locked_ms: int = 0
    touched_ms: int | None = None


_SQL_TYPES = {"str | None": "string", "int | None": "long", "int": "long", "bool": "boolean"}
STANDING_SCHEMA = ", ".join(f"{f.name} {_SQL_TYPES[f.type]}" for f in fields(Standing))
#: What is told of an address beside each result.
TOLD = ("status", "epoch", "extractions", "pending", "seen_ms", "terms")
TOLD_SCHEMA = "result string, status string, epoch long, extractions long, pending boolean, seen_ms long, terms string"


def lapsed(s: Standing, at: int, terms: Terms) -> None:
    """What time alone undoes: unanswered requests and old failures."""
    if s.pending and at - s.asked_ms >= terms.pending_ms:
        s.pending, s.asked_ms = False, None
    if s.failures and at - s.failed_ms >= terms.forget_ms:
        s.failures = 0


def lapses_at(s: Standing, terms: Terms) -> int | None:
    """When the next part of a standing that no member has may be forgotten; None where it is kept."""
    if s.status is not None:
        return None
    ends = [s.asked_ms + (terms.pending_ms if s.pending else terms.quiet_ms)] if s.asked_ms is not None else []
    ends += [s.failed_ms + terms.forget_ms] if s.failures else []
    ends += [s.locked_ms] if s.locked_ms else []
    ends += [s.touched_ms + terms.touch_ms] if s.touched_ms is not None else []
    return max(ends, default=0)


def _invited(s: Standing, at: int, code_hash: str | None, by: str, terms: Terms) -> bool:
    if s.status == "active":
        return False
    if s.status is None:
        s.status, s.added_by, s.added_ms = "invited", by, at
    s.code_hash, s.expires_ms = code_hash, at + terms.invite_ms  # an earlier code is void
    return True


def _redeemed(s: Standing, at: int, code_hash: str | None, version: str | None, terms: Terms) -> str:
    if s.locked_ms > at:
        return "locked"
    if s.status is not None and s.code_hash is not None and s.code_hash == code_hash and s.expires_ms > at:
        s.status, s.redeemed_ms, s.terms, s.terms_ms = "active", at, version, at
        s.code_hash, s.failures, s.locked_ms = None, 0, 0  # a code serves once
        return "ok"
    s.failures, s.failed_ms, s.locked_ms = s.failures + 1, at, 0
    if s.failures >= terms.most_failures:
        s.failures, s.locked_ms = 0, at + terms.lock_ms
    return "invalid"


def step(s: Standing, action: str | None, at: int, detail: str | None, version: str | None, terms: Terms) -> str:
    """The result of one action; s becomes the standing after it."""
    lapsed(s, at, terms)
    if action == "ask":
        if s.pending or (s.asked_ms is not None and at - s.asked_ms < terms.quiet_ms):
            return "ignored"
        s.pending, s.asked_ms = True, at
        return "taken"
    if action in ("decline", "approve"):
        if not s.pending:
            return "not-found"
        s.pending = False
        return "declined" if action == "decline" else "approved" if _invited(s, at, detail, "request", terms) else "is-active"
    if action == "invite":
        return "invited" if _invited(s, at, detail, "owner", terms) else "is-active"
    if action == "redeem":
        return _redeemed(s, at, detail, version, terms)
    if action == "touch":
        if s.touched_ms is not None and at - s.touched_ms < terms.touch_ms:
            return "recent"
        s.touched_ms = at
        if s.status is not None:
            s.seen_ms = at
        return "unknown" if s.status is None else "seen"
    if action == "remove":
        found = s.status is not None
        kept = Standing(failures=s.failures, failed_ms=s.failed_ms, locked_ms=s.locked_ms, touched_ms=s.touched_ms)  # guesses are counted on
        vars(s).update(vars(kept))
        return "removed" if found else "not-found"
    if action not in ("accept", "extract", "sign_out"):
        return "no-action"
    if s.status is None:
        return "unknown"
    if action == "accept":
        s.terms, s.terms_ms = detail, at
        return "accepted"
    if action == "extract":
        s.extractions, s.seen_ms = s.extractions + 1, at
        return "counted"
    s.epoch += 1
    return "signed-out"


def acted(actions: DataFrame, order: str, terms: Terms = Terms()) -> DataFrame:
    """(email, at_ms, order, action, result, and the address's standing after it) of a log with email, at_ms, action, detail and version.

    An address's actions pass through one task one after the other, sorted by Spark, and only its standing is held; an address is
    a person, and its share of the log bounds nothing but the time of that task.  A column of order ties ends in action and detail.
    """
    names = ["email", "at_ms", order, "action"]
    rows = actions.select("email", F.col("at_ms").cast("long").alias("at_ms"), order, "action", "detail", "version")
    fit = F.col("email").isNotNull() & F.col("at_ms").isNotNull()
    schema = rows.select(names).schema
    told = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", " + TOLD_SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, Standing()
        for b in batches:
            out: list[list[Any]] = [[] for _ in range(len(TOLD) + 1)]
            for row in b.select(["email", "at_ms", "action", "detail", "version"]).to_pylist():
                if row["email"] != at:
                    at, state = row["email"], Standing()
                out[0].append(step(state, row["action"], row["at_ms"], row["detail"], row["version"], terms))
                for values, name in zip(out[1:], TOLD, strict=True):
                    values.append(getattr(state, name))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string())
            made = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *made], names=[*names, "result", *TOLD])

    done = rows.filter(fit).repartition("email").sortWithinPartitions("email", "at_ms", order, "action", "detail", "version").mapInArrow(run, told)
    refused = rows.filter(~fit).withColumn("result", F.when(F.col("email").isNull(), "no-email").otherwise("no-time")).select(*names, "result")
    return done.unionByName(refused, allowMissingColumns=True)


def standings(done: DataFrame, order: str) -> DataFrame:
    """The last standing of each address that is a member or invited, out of what `acted` gives; addresses aggregate before they move."""
    last = done.filter(F.col("status").isNotNull() | (F.col("result") == "removed")).groupBy("email").agg(F.max_by(F.struct(*TOLD), F.struct("at_ms", order)).alias("s"))
    return last.select("email", "s.*").filter("status IS NOT NULL")


def can_sign_in(email: Column, status: Column, owner: str) -> Column:
    """The owner always, others once they have redeemed a code."""
    return F.coalesce((F.lower(F.trim(email)) == owner) | (status == "active"), F.lit(False))
