"""Streaming forms: daily counts with late events, and the sliding-window limiter with state."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, type, n, visitors) per UTC day; visitors is approximate, as a stream keeps no exact distinct sets."""
    windowed = events.filter(~F.col("dev").eqNullSafe("bot")).withWatermark("t", late).groupBy(F.window("t", "1 day"), "type")
    return windowed.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("v").alias("visitors")).select(F.to_date("window.start").alias("day"), "type", "n", "visitors")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(v, started, ended, n): runs of a visitor's events with no gap longer than that."""
    made = events.withWatermark("t", late).groupBy(F.session_window("t", gap), "v").agg(F.count(F.lit(1)).alias("n"))
    return made.select("v", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def rate_limited(requests: DataFrame, most: int, window_ms: int, late_ms: int = 60_000) -> DataFrame:
    """(key, request_id, at_ms, hits, allowed) of a stream of (key, request_id, at_ms), by event time.

    hits are the requests of the key in the window up to this one, refused ones included.  State holds a key's hits that
    a request may still need, and goes when the watermark, late_ms behind the latest request, has passed its last window.
    Requests older than the watermark are left out.
    """

    def decide(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mark = state.getCurrentWatermarkMs()
        held = [t for t in state.get[0] if t > mark - window_ms] if state.exists else []
        rows = sorted(r for b in batches for r in zip(b["at_ms"].tolist(), b["request_id"].tolist(), strict=True) if r[0] >= mark)
        out = []
        for at, request in rows:
            insort(held, at)
            hits = bisect_right(held, at) - bisect_right(held, at - window_ms)
            out.append((key[0], request, at, hits, hits <= most))
        if held:
            state.update((held,))
            state.setTimeoutTimestamp(max(held[-1], mark) + window_ms)
        yield pd.DataFrame(out, columns=["key", "request_id", "at_ms", "hits", "allowed"])

    timed = requests.select("key", "request_id", "at_ms", F.timestamp_millis("at_ms").alias("at")).withWatermark("at", f"{late_ms} milliseconds")
    return timed.groupBy("key").applyInPandasWithState(
        decide, "key string, request_id long, at_ms long, hits int, allowed boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
