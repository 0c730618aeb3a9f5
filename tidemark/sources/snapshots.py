"""Versioned tables: folders of Parquet under a manifest.

``<path>/data/<id>`` holds what one commit wrote, ``<path>/manifests/<version>.json``
names the folders of a version.  A commit writes its data first and then creates
the next manifest, which either comes about whole or not at all; a reader takes
the folders of one manifest when it plans, so it sees the table before or after a
commit, and earlier versions stay until they are expired.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(Exception):
    """Another commit came first, and this one depends on what it read."""


@dataclass(frozen=True)
class Manifest:
    version: int
    folders: tuple[str, ...]
    schema: str
    rows: int
    operation: str
    batches: dict[str, int]

    def text(self) -> str:
        return json.dumps(self.__dict__ | {"folders": list(self.folders)}, sort_keys=True)

    @classmethod
    def of(cls, text: str) -> Manifest:
        found = json.loads(text)
        return cls(**found | {"folders": tuple(found["folders"])})


class SnapshotTable:
    """A table at ``path``, in any store that Spark writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._folder = self._at(f"{self.path}/manifests")
        self._store = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _name(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def versions(self) -> list[int]:
        """Those that can be read, oldest first."""
        if not self._store.exists(self._folder):
            return []
        names = [f.getPath().getName() for f in self._store.listStatus(self._folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest | None:
        """That of a version, or of the newest; None for a table without commits."""
        known = self.versions()
        if version is None:
            if not known:
                return None
            version = known[-1]
        if version not in known:
            raise ValueError(f"{self.path} has no version {version}")
        stream = self._store.open(self._at(self._name(version)))
        try:
            return Manifest.of(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None, like: DataFrame | None = None) -> DataFrame:
        """The rows of a version, or of the newest; without commits those of ``like``, none of them."""
        found = self.manifest(version)
        return self._rows(found, like)

    def _rows(self, found: Manifest | None, like: DataFrame | None) -> DataFrame:
        if found is None:
            if like is None:
                raise ValueError(f"{self.path} has no version yet")
            return like.limit(0)
        schema = T.StructType.fromJson(json.loads(found.schema))
        if not found.folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*found.folders)

    def _publish(self, found: Manifest) -> bool:
        """Creates the manifest; False if its version is taken.

        It is written beside its place and renamed, and a rename never replaces:
        so of two commits of the same version one comes about.
        """
        draft, place = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}"), self._at(self._name(found.version))
        out = self._store.create(draft, False)
        out.write(bytearray(found.text().encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._store.makeQualified(draft), self._store.makeQualified(place), none)
        except Exception as e:
            self._store.delete(draft, False)
            if self._store.exists(place):
                return False
            raise e
        return True

    def commit(self, make: Callable[[DataFrame | None], DataFrame | None], operation: str, keep: bool, batch: tuple[str, int] | None = None, attempts: int = 5, like: DataFrame | None = None) -> int:
        """How many rows were written by ``make``, which takes the newest version's rows.

        ``make`` runs once for each attempt, its rows are evaluated once, by the
        write that counts them; None or no rows leave the table as it is, unless
        ``keep`` is off: then what is written is the whole new version.  If another
        commit comes first, all is done again on what that one left.  ``batch``, a
        stream's name and number, is committed once and not again.
        """
        for _ in range(attempts):
            before = self.manifest()
            done = dict(before.batches) if before else {}
            if batch and done.get(batch[0], -1) >= batch[1]:
                return 0
            fresh = make(self._rows(before, like) if before or like is not None else None)
            folder, n = f"{self.path}/data/{uuid.uuid4().hex}", 0
            if fresh is not None:
                seen = Observation()
                fresh.observe(seen, F.count("*").alias("n")).write.parquet(folder)
                n = seen.get["n"]
            if not n:
                self._store.delete(self._at(folder), True)
                if keep and not batch:
                    return 0
            old = before.folders if before and keep else ()
            kept = before.rows if before and keep else 0
            schema = json.dumps((fresh if fresh is not None else self._rows(before, like)).schema.jsonValue())
            if keep and before:
                schema = _wider(before.schema, schema)
            if batch:
                done[batch[0]] = batch[1]
            version = before.version + 1 if before else 1
            if self._publish(Manifest(version, (*old, folder) if n else old, schema, kept + n, operation, done)):
                return n
            self._store.delete(self._at(folder), True)
        raise Conflict(f"{self.path}: {attempts} other commits came first")

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        return self.commit(lambda _: rows, "append", True, batch, like=rows)

    def insert_ignore(self, rows: DataFrame, keys: list[str], order: str, batch: tuple[str, int] | None = None) -> int:
        """Appends the first row of each key that the table lacks; null keys are alike.  Running it again adds nothing."""
        first = rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")

        def fresh(now: DataFrame) -> DataFrame:
            known = now.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys))).distinct()
            same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
            return first.join(known, same, "left_anti").select(*rows.columns)

        return self.commit(fresh, "insert_ignore", True, batch, like=rows)

    def insert_or_replace(self, rows: DataFrame, keys: list[str], version: str, batch: tuple[str, int] | None = None) -> int:
        """The table with ``rows`` in it; of each key the row of the highest ``version`` stays, of equal ones the new row."""

        def merged(now: DataFrame) -> DataFrame:
            both = now.withColumn("_new", F.lit(False)).unionByName(rows.withColumn("_new", F.lit(True)), allowMissingColumns=True)
            order = W.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
            return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_new")

        return self.commit(merged, "insert_or_replace", False, batch, like=rows)

    def replace_version(self, rows: DataFrame, column: str) -> int:
        """Rows of the values of ``column`` that are in ``rows`` go, and ``rows`` come."""

        def merged(now: DataFrame) -> DataFrame:
            gone = rows.select(F.col(column).alias("_v")).distinct()
            return now.join(gone, F.col(column).eqNullSafe(F.col("_v")), "left_anti").unionByName(rows)

        return self.commit(merged, "replace_version", False, like=rows)

    def rebuild(self, rows: DataFrame) -> int:
        return self.commit(lambda _: rows, "rebuild", False, like=rows)

    def prune(self, column: str, current: str) -> int:
        return self.commit(lambda now: now.where(F.col(column) == current), "prune", False)

    def restore(self, version: int) -> int:
        """A new version with the folders of an earlier one; nothing is copied."""
        old = self.manifest(version)
        for _ in range(5):
            now = self.manifest()
            if self._publish(Manifest(now.version + 1, old.folders, old.schema, old.rows, f"restore {version}", now.batches)):
                return now.version + 1
        raise Conflict(f"{self.path}: other commits came first")

    def history(self) -> DataFrame:
        rows = [(m.version, m.operation, m.rows, len(m.folders)) for m in map(self.manifest, self.versions())]
        return self.spark.createDataFrame(rows, "version long, operation string, n_rows long, n_folders long")

    def expire(self, keep: int = 10) -> int:
        """Lets go of all versions but the newest ``keep``, and of folders that no version left names; how many folders went.

        Not for while others commit: a folder without a manifest may be that of a
        commit under way.
        """
        known = self.versions()
        for version in known[:-keep]:
            self._store.delete(self._at(self._name(version)), False)
        used = {f.rsplit("/", 1)[-1] for v in known[-keep:] for f in self.manifest(v).folders}
        data = self._at(f"{self.path}/data")
        folders = [f.getPath() for f in self._store.listStatus(data)] if self._store.exists(data) else []
        gone = [p for p in folders if p.getName() not in used]
        for p in gone:
            self._store.delete(p, True)
        return len(gone)


def _wider(old: str, new: str) -> str:
    """The old columns, then those that are new: tables only ever gain columns, which are null in older folders."""
    a, b = (T.StructType.fromJson(json.loads(x)) for x in (old, new))
    kinds = {f.name: f.dataType for f in a.fields}
    for f in b.fields:
        if f.name in kinds and kinds[f.name] != f.dataType:
            raise ValueError(f"column {f.name} is {kinds[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return json.dumps(T.StructType([*a.fields, *(f for f in b.fields if f.name not in kinds)]).jsonValue())
