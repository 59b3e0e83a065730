"""The rules of `operators.access` over a stream: actions wait for the watermark, so that late ones take their place."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.access import STANDING_SCHEMA, TOLD, TOLD_SCHEMA, Standing, Terms, lapses_at, step

#: The state store that lists and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Doors(StatefulProcessor):
    def __init__(self, terms: Terms):
        self.terms = terms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.standing = handle.getValueState("standing", STANDING_SCHEMA)
        self.waiting = handle.getListState("waiting", "at_ms long, seq long, action string, detail string, version string")

    def _wake(self, at: int) -> None:
        """One timer an address, the earliest that it needs."""
        set_for = list(self.handle.listTimers())
        if not set_for or at < min(set_for):
            for t in set_for:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        came = [(r.at_ms, r.seq, r.action, r.detail, r.version) for r in rows if r.at_ms >= mark]
        if came:
            self.waiting.appendList(came)
            self._wake(min(r[0] for r in came) + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in held if r[0] < mark), key=lambda r: [(v is not None, v) for v in r])  # nulls first, as in batches
        rest = [r for r in held if r[0] >= mark]
        state = Standing(*self.standing.get()) if self.standing.exists() else Standing()
        for at, seq, action, detail, version in due:
            result = step(state, action, at, detail, version, self.terms)
            yield Row(email=key[0], at_ms=at, seq=seq, action=action, result=result, **{n: getattr(state, n) for n in TOLD})
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(r[0] for r in rest) + 1)
        ends = lapses_at(state, self.terms)
        if ends is not None and ends < mark:
            self.standing.clear()
            return
        self.standing.update(astuple(state))
        if ends is not None and not rest:
            self.handle.registerTimer(ends + 1)

    def close(self) -> None:
        pass


def acted(actions: DataFrame, terms: Terms = Terms(), late_ms: int = 60_000) -> DataFrame:
    """What `operators.access.acted` gives, for a stream of (email, at_ms, seq, action, detail, version), in append mode.

    An action takes effect once the watermark, late_ms behind the latest action, has passed it, in the order of time; one that comes
    after that is left out, as are those without an address or a time.  An address that nobody invited is forgotten when its
    request, failures and lock have run out.  The session needs the state store named STORE.
    """
    if actions.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass has to be {STORE}")
    timed = actions.filter("email IS NOT NULL AND at_ms IS NOT NULL").withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", f"{late_ms} milliseconds")
    schema = "email string, at_ms long, seq long, action string, " + TOLD_SCHEMA
    return timed.groupBy("email").transformWithState(_Doors(terms), schema, "append", "EventTime")
