"""Derived tables that late rows reach: only the sessions that a batch touches are rebuilt."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.calendar import assign_sessions
from tidemark.sources.snapshots import SnapshotTable
from tidemark.streaming.ingest import keyed

KEY = ["observation_key"]


def session_rows(items: DataFrame) -> DataFrame:
    """One row for each session: items, scored ones, sources, mean score and the latest time."""
    return items.groupBy("signal_date").agg(
        F.count("*").alias("n_items"),
        F.count("score").alias("n_scored"),
        F.count_distinct("source").alias("n_sources"),
        F.avg("score").alias("mean_score"),
        F.max("published_ts").alias("last_seen"),
    )


def maintain_sessions(stream: DataFrame, calendar: DataFrame, items_path: str, sessions_path: str, checkpoint: str):
    """Keeps a table of items and one of sessions up to date with ``stream`` (source, guid, url, title, published_ts, score); returns the query.

    A batch's new items are appended (an observation once, however late it comes
    and how often), then the sessions of the batch are computed again from all
    their items and replaced; other sessions are not read.  Both tables are
    versioned: a batch that is replayed after a failure appends nothing and
    rebuilds its sessions from what is there.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def step(df: DataFrame, n: int) -> None:
        items, sessions = (SnapshotTable(df.sparkSession, p) for p in (items_path, sessions_path))
        rows = assign_sessions(keyed(df).withColumn("published_date", F.to_date("published_ts")), calendar).persist()
        try:
            items.insert_ignore(rows, KEY, "published_ts", batch=(name, n))
            touched = rows.select("signal_date").distinct()
            # a batch may have few sessions or many; Spark chooses how to join them
            again = session_rows(items.read(like=rows).join(touched, "signal_date", "left_semi"))
            version = items.manifest().version if items.versions() else 0
            sessions.insert_or_replace(again.withColumn("items_version", F.lit(version).cast("long")), ["signal_date"], "items_version")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
