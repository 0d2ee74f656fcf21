"""Reading progress as a stream of save events."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tomewright import fixed as K
from tomewright.functions import text as T


def progress_stream(events: DataFrame, tie: str | None = None) -> DataFrame:
    """Last write per key from (key, unit_id, pct, t); for update or complete mode.

    A clearing event has a null pct: it replaces the stored value and reads as
    no progress.  State is one row per key.
    """
    by = F.struct("t", tie) if tie else F.struct("t")
    return (events.groupBy("key").agg(F.max_by(F.struct("unit_id", "pct", "t"), by).alias("_l"))
            .select("key", "_l.unit_id", "_l.pct", F.col("_l.t").alias("t"),
                    T.progress_label(F.col("_l.pct")).alias("label")))


def throttled_saves(events: DataFrame, watermark: str = "1 hour",
                    every: str = K.PROGRESS_THROTTLE) -> DataFrame:
    """At most one save per key and interval, the last one; rows behind the watermark are dropped.

    Interval state is closed by the watermark, so it stays bounded by the
    lateness that is admitted.
    """
    return (events.withWatermark("t", watermark).groupBy(F.window("t", every), "key")
            .agg(F.max_by(F.struct("unit_id", "pct", "t"), "t").alias("_l"))
            .select("key", "_l.unit_id", "_l.pct", F.col("_l.t").alias("t")))


_UNITS = {"microsecond": 1, "millisecond": 1000, "second": 10 ** 6, "minute": 60 * 10 ** 6, "hour": 3600 * 10 ** 6, "day": 86400 * 10 ** 6}
_SAVED = "key string, unit_id string, pct int, us long, kind string"
_OPEN = "saved long, last array<string>, stale boolean, wait array<array<string>>"


def _micros(interval: str) -> int:
    n, unit = re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", interval.lower()).groups()
    return int(n) * _UNITS[unit]


def _save_rule(every: int, idle: int):
    """State of a key: time of the visit's last throttled save, its last event, whether that one is unsaved, events ahead of the watermark."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        saved, last, stale, wait = None, None, False, []
        if state.exists:
            saved, last, stale, held = state.get
            last = None if last is None else _event(last)
            wait = [_event(e) for e in held]
        if not state.hasTimedOut:
            for pdf in batches:
                wait += [(int(us), int(tie), unit, None if pd.isna(pct) else int(pct))
                         for us, tie, unit, pct in zip(pdf["us"], pdf["tie"], pdf["unit_id"], pdf["pct"])]
            wait.sort(key=lambda e: e[:2])
        mark = state.getCurrentWatermarkMs() * 1000
        out = []

        def leave():
            nonlocal saved, last, stale
            if stale:
                out.append((key[0], last[2], last[3], last[0], "leave"))
            saved, last, stale = None, None, False
        ready = bisect_right(wait, mark, key=lambda e: e[0])        # no event at or before the watermark can still arrive
        for e in wait[:ready]:
            if last is not None and e[0] - last[0] > idle:
                leave()
            stale = saved is not None and e[0] - saved < every
            if not stale:
                out.append((key[0], e[2], e[3], e[0], "move"))
                saved = e[0]
            last = e
        wait = wait[ready:]
        if last is not None and mark > last[0] + idle and not (wait and wait[0][0] <= last[0] + idle):
            leave()
        if last is None and not wait:
            state.remove() if state.exists else None
        else:
            text = lambda e: [None if x is None else str(x) for x in e]
            state.update((saved, None if last is None else text(last), stale, [text(e) for e in wait]))
            due = min([e[0] for e in wait[:1]] + ([last[0] + idle] if last is not None else []))
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "unit_id", "pct", "us", "kind"]).astype({"pct": "Int32", "us": "int64"})
    return step


def _event(e) -> tuple:
    return int(e[0]), int(e[1]), e[2], None if e[3] is None else int(e[3])


def save_stream(events: DataFrame, every: str = K.PROGRESS_THROTTLE, idle: str = "30 minutes", late: str = "1 hour",
                tie: str | None = None) -> DataFrame:
    """The saves of a reader by the throttle rule, as a stream: key, unit_id, pct, t, kind.

    The first event of a visit is saved, then none until ``every`` has passed
    since that save, then the next one, and so on ('move').  A visit ends when
    no event follows within ``idle``; its last event is saved if the throttle
    held it back ('leave'), and the next visit starts afresh.  Events of one
    time are taken by ``tie`` (an integer), else in any order.

    ``events`` is a stream of (key string, unit_id, pct, t).  Events wait until the
    watermark, ``late`` behind the newest one, has passed them, so they may
    arrive in any order; later ones
    and those without a time are dropped.  State is one open visit per
    key with the events of the last ``late``.  Null keys only move the
    watermark: a last row with a null key and a late time closes all visits.
    """
    rows = events.select("key", F.col("unit_id").cast("string").alias("unit_id"), F.col("pct").cast("int").alias("pct"),
                         F.col("t").cast("timestamp").alias("t"), F.coalesce(F.col(tie) if tie else F.lit(0), F.lit(0)).cast("long").alias("tie"))
    rows = rows.where("t IS NOT NULL").withWatermark("t", late).withColumn("us", F.unix_micros("t"))
    saves = rows.groupBy("key").applyInPandasWithState(_save_rule(_micros(every), _micros(idle)), _SAVED, _OPEN, "append",
                                                       GroupStateTimeout.EventTimeTimeout)
    return saves.select("key", "unit_id", "pct", F.timestamp_micros("us").alias("t"), "kind")
