"""Settlement of daily bars by event-time timers.

A bar that was fetched before its session's close and the settlement delay is
provisional, one that was fetched after is complete, and another settled fetch
with other values corrects it.  State and timers are kept for each date: when event
time, the watermark of fetches, has passed the settlement, the date is final: it
is given out once, settled or withheld, and again for each correction after that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.market import SETTLEMENT_MINUTES, classify_bar, volume_review

#: The state store that timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VALUES = ("open", "high", "low", "close", "volume")
_STATE = "open double, high double, low double, close double, volume double, bar_status string, fetched_ms long, final boolean"
OUTPUT = "date string, open double, high double, low double, close double, volume double, bar_status string, fetched_ms long, event string"


def classified(fetches: DataFrame, calendar: DataFrame, positive: bool = True) -> DataFrame:
    """Fetches (date, open, high, low, close, volume, fetched_at) with their session, settles_at, bar_status and review, by the calendar (date, is_trading, close_sec; broadcast).

    A bar of a day without a session is provider_invalid, and so is one with
    impossible prices (``positive``: zero is one); a fetch whose time is not known is provisional.
    """
    days = calendar.select("date", "is_trading", "close_sec")
    rows = fetches.join(F.broadcast(days), "date", "left")
    open_ = F.coalesce("is_trading", F.lit(False))
    status, _ = classify_bar(F.col("date"), F.col("fetched_at"), F.coalesce("close_sec", F.lit(0)), [F.col(c) for c in VALUES[:4]], F.col("volume"), positive)
    settles = F.timestamp_seconds(F.unix_timestamp(F.col("date").cast("timestamp")) + F.col("close_sec") + SETTLEMENT_MINUTES * 60)
    known = F.when(F.col("fetched_at").isNull() & (status == "complete"), "provisional").otherwise(F.coalesce(status, F.lit("provisional")))
    return rows.withColumns(
        {
            "bar_status": F.when(open_, known).otherwise("provider_invalid"),
            "settles_at": F.when(open_, settles),
            "review": volume_review(open_, F.col("close_sec"), F.col("volume")),
        }
    )


class Settlement(StatefulProcessor):
    """The standing bar of a date, and a timer at its settlement."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bar = handle.getValueState("bar", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.bar.get() if self.bar.exists() else None
        out = []
        batch = pd.concat(list(rows)).sort_values(["fetched_ms", "close"], kind="stable")
        for r in batch.itertuples(index=False):
            values = tuple(None if pd.isna(x) else float(x) for x in (getattr(r, c) for c in VALUES))
            before = state
            state = stand(state, values, r.bar_status, int(r.fetched_ms))
            if state[7] and state != before and _RANK[state[5]] >= 2:  # final before: a settlement that came late, or a correction
                out.append(told(key, state, "corrected" if state[5] == "corrected" else "settled_late"))
        settles = int(batch["settles_ms"].max())
        if not state[7]:
            if settles < 0 or settles <= timerValues.getCurrentWatermarkInMs():
                state = (*state[:7], True)
                out.append(told(key, state, final_event(state)))
            elif settles not in list(self.handle.listTimers()):
                self.handle.registerTimer(settles)
        self.bar.update(state)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.bar.get()
        if not state[7]:
            state = (*state[:7], True)
            self.bar.update(state)
            yield pd.DataFrame([told(key, state, final_event(state))], columns=COLUMNS)

    def close(self) -> None:
        pass


COLUMNS = ["date", *VALUES, "bar_status", "fetched_ms", "event"]
_RANK = {"provider_invalid": 0, "provisional": 1, "complete": 2, "corrected": 3}


def stand(state: tuple | None, values: tuple, status: str, fetched: int) -> tuple:
    """The bar that stands after a fetch: settled ones are never demoted, one settled with other values is corrected and stays so."""
    if state is None:
        return (*values, status, fetched, False)
    old = state[5]
    if status == "complete" and _RANK[old] >= 2:
        return (*values, "corrected", fetched, state[7]) if values != tuple(state[:5]) else tuple(state)
    if _RANK[status] >= _RANK[old]:
        return (*values, status, fetched, state[7])
    return tuple(state)


def final_event(state: tuple) -> str:
    return "settled" if _RANK[state[5]] >= 2 else "withheld"


def told(key, state: tuple, event: str) -> tuple:
    return (key[0], *state[:7], event)


def settled_bars(fetches: DataFrame, calendar: DataFrame, delay: str = "1 hour", positive: bool = True) -> DataFrame:
    """A stream of fetches (date, prices, volume, fetched_at) as events of dates.

    ``settled`` or ``withheld`` when event time passes a date's settlement (at once
    for a day without one); ``settled_late`` and ``corrected`` when a fetch after
    that changes the standing bar.  Times are UTC wall clock; fetches without a
    time count as fetched at the epoch.  The session needs STATE_STORE.
    """
    timed = fetches.withColumn("_at", F.coalesce(F.col("fetched_at").cast("timestamp"), F.timestamp_seconds(F.lit(0)))).withWatermark("_at", delay)
    rows = classified(timed, calendar, positive)
    ms = lambda c: F.coalesce(F.unix_millis(F.col(c).cast("timestamp")), F.lit(-1))
    doubles = [F.col(c).cast("double").alias(c) for c in VALUES]
    narrow = rows.select(F.col("date").cast("string").alias("date"), *doubles, "bar_status", ms("_at").alias("fetched_ms"), ms("settles_at").alias("settles_ms"), "_at")
    return narrow.groupBy("date").transformWithStateInPandas(Settlement(), OUTPUT, "Append", "EventTime")


def latest(events: DataFrame) -> DataFrame:
    """The last word on each date of the events so far."""
    order = F.when(F.col("event").isin("settled", "withheld"), 0).when(F.col("event") == "settled_late", 1).otherwise(2)
    return events.groupBy("date").agg(F.max_by(F.struct(*[c for c in events.columns if c != "date"]), F.struct(order, "fetched_ms")).alias("b")).select("date", "b.*")
