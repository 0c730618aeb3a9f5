"""Structured Streaming: replay-safe ingest, session aggregates, and item and bar state."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.core import observation_key
from tidemark.operators.calendar import assign_sessions
from tidemark.operators.history import MAX_ATTEMPTS
from tidemark.sources import sinks


def read_landed(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """Landed JSON files as a stream; the checkpoint keeps the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)


def keyed(stream: DataFrame) -> DataFrame:
    """Adds observation_key; the time of fetching is no part of it."""
    return stream.withColumn("observation_key", observation_key(F.col("source"), F.col("guid"), F.col("url"), F.col("title"), F.col("published_ts")))


def deduplicated(stream: DataFrame, delay: str = "3 days", at: str = "published_ts") -> DataFrame:
    """The first of each observation within the watermark."""
    return keyed(stream).withWatermark(at, delay).dropDuplicatesWithinWatermark(["observation_key"])


def append_observations(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Appends what the table lacks, batch by batch; a replayed batch adds nothing."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    add = lambda df, n: sinks.insert_ignore(df, path, ["observation_key"], "published_ts", (name, n))
    write = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (write.trigger(availableNow=True) if once else write).start()


def session_aggregates(stream: DataFrame, calendar: DataFrame, at: str = "published_ts", delay: str = "3 days") -> DataFrame:
    """Running count and mean score by session; the calendar is a static broadcast side."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay)
    rows = assign_sessions(timed.withColumn("published_date", F.to_date(at)), calendar, at)
    return rows.groupBy("signal_date", "timing_bucket").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


def daily_windows(stream: DataFrame, at: str = "published_ts", delay: str = "3 days") -> DataFrame:
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay)
    return timed.groupBy(F.window("_at", "1 day"), "category").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


def attempt_states(stream: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """State of each item (id, ok, seq) after its attempts so far: pending, scored, retry_pending or failed.

    A scored or failed item stays so; attempts of one batch are taken in seq order.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, status = state.get if state.exists else (0, "pending")
        for ok in pd.concat(list(batches)).sort_values("seq")["ok"]:
            if status in ("scored", "failed"):
                break
            failures += not ok
            status = "scored" if ok else "failed" if failures >= most else "retry_pending"
        state.update((int(failures), status))
        yield pd.DataFrame({"id": [key[0]], "failures": [failures], "status": [status]})

    return stream.groupBy("id").applyInPandasWithState(step, "id long, failures long, status string", "failures long, status string", "update", GroupStateTimeout.NoTimeout)


_RANK = {"provider_invalid": 0, "provisional": 1, "complete": 2, "corrected": 3}


def bar_states(stream: DataFrame) -> DataFrame:
    """The standing bar of each date (date, close, bar_status, fetched_at): settled bars are never demoted, corrections stay."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        close, status = state.get if state.exists else (None, None)
        for r in pd.concat(list(batches)).sort_values("fetched_at").itertuples(index=False):
            if status is None or _RANK[r.bar_status] >= _RANK[status]:
                close, status = r.close, r.bar_status
        state.update((None if close is None else float(close), status))
        yield pd.DataFrame({"date": [key[0]], "close": [close], "bar_status": [status]})

    return stream.groupBy("date").applyInPandasWithState(step, "date string, close double, bar_status string", "close double, bar_status string", "update", GroupStateTimeout.NoTimeout)
