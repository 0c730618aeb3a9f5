"""Upserts and append-only writes on versioned tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.snapshots import SnapshotTable


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A table as of its newest or an earlier version."""
    return SnapshotTable(spark, path).read(version)


def insert_ignore(rows: DataFrame, path: str, keys: list[str], order: str, batch: tuple[str, int] | None = None) -> int:
    """Appends the first row of each key that the table lacks; running it again adds nothing.  Returns how many."""
    return SnapshotTable(rows.sparkSession, path).insert_ignore(rows, keys, order, batch)


def insert_or_replace(rows: DataFrame, path: str, keys: list[str], version: str) -> int:
    """The table with ``rows`` in it; of each key the row of the highest version stays."""
    return SnapshotTable(rows.sparkSession, path).insert_or_replace(rows, keys, version)


def replace_version(rows: DataFrame, path: str, column: str) -> int:
    """Replaces just the rows of the versions in ``rows``."""
    return SnapshotTable(rows.sparkSession, path).replace_version(rows, column)


def rebuild(rows: DataFrame, path: str) -> int:
    return SnapshotTable(rows.sparkSession, path).rebuild(rows)


def prune(spark: SparkSession, path: str, column: str, current: str) -> int:
    return SnapshotTable(spark, path).prune(column, current)


class AppendOnly:
    """A table that has no update or delete; rows are identified by a hash of their content."""

    def __init__(self, path: str, keys: list[str]):
        self.path, self.keys = path, keys

    def append(self, rows: DataFrame) -> int:
        key = F.sha2(F.to_json(F.struct(*self.keys), {"ignoreNullFields": "false"}), 256)
        return insert_ignore(rows.withColumn("content_key", key), self.path, ["content_key"], "content_key")


def freeze_artifact(spark: SparkSession, document: dict, path: str, name: str, version: str) -> str:
    """Stores a document under its hash; another document under the same name and version is refused."""
    text = json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    row = spark.createDataFrame([(name, version, text)], "name string, version string, document string").withColumn("artifact_hash", F.sha2("document", 256))
    digest = row.first()["artifact_hash"]
    table = SnapshotTable(spark, path)
    had = table.read(like=row).where((F.col("name") == name) & (F.col("version") == version)).select("artifact_hash").limit(1).collect()
    if had and had[0][0] != digest:
        raise ValueError(f"{name} {version} is frozen with other content")
    if not had:
        table.insert_ignore(row, ["name", "version"], "artifact_hash")
    return digest


def verify_artifacts(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path).select("name", "version", (F.sha2("document", 256) == F.col("artifact_hash")).alias("intact"))


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A report of bounded size as one file."""
    out = df.coalesce(1).write.mode("overwrite")
    out.option("header", "true").csv(path) if kind == "csv" else out.json(path)


def html_table(df: DataFrame, title: str, most: int = 500) -> str:
    """A plain HTML page of the first rows, in the frame's own order."""
    import html

    rows = df.limit(most).collect()
    cell = lambda x: html.escape("" if x is None else str(x))
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    head = "".join(f"<th>{cell(c)}</th>" for c in df.columns)
    return f"<!doctype html><meta charset='utf-8'><title>{cell(title)}</title><h1>{cell(title)}</h1><table><tr>{head}</tr>{body}</table>"
