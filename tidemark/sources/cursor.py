"""Landed detail pages behind a cursor, as a stream: ``spark.readStream.format("cursor_pages")``.

A fetcher lands details as lines of JSON in folders ``page=<k>`` of ``path``, of
which each holds the indices from k * page_size on.  The source reads what is
past its cursor: on its first run it is seeded at the last index landed (or at
``startingIndex``), a batch takes ``maxDetails`` details at most, and the cursor is
committed when the batch has been.  It keeps the cursor in ``cursorPath`` itself,
so a query that has lost its checkpoint reads nothing twice either.

Options: path, cursorPath, maxDetails (30), page_size (1000), indexField
(disclosureIndex), startingIndex.  Paths are those of any store that Arrow opens
(a plain path or file://, hdfs://, s3://), since Python reads them, on the driver
only to list indices and on executors to read details.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.functions.core import disclosure_title

SCHEMA = "detail_index long, payload string"
#: Details that a task reads.
TASK_DETAILS = 5_000


class IndexRange(InputPartition):
    """Details of one page folder with first < index <= last."""

    def __init__(self, path: str, page: int, field: str, first: int, last: int):
        self.path, self.page, self.field, self.first, self.last = path, page, field, first, last


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _pages(path: str) -> list[int]:
    from pyarrow import fs

    store, at = _store(path)
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(int(f.base_name[5:]) for f in found if f.base_name.startswith("page="))


def _details(path: str, page: int, field: str) -> Iterator[tuple[int, str]]:
    """(index, line) of a page folder; a line that is no detail is passed over."""
    from pyarrow import fs

    store, at = _store(path)
    for f in store.get_file_info(fs.FileSelector(f"{at}/page={page}")):
        if f.is_file and not f.base_name.startswith((".", "_")):
            with store.open_input_stream(f.path) as stream:
                for line in stream.read().decode("utf-8").splitlines():
                    try:
                        yield int(json.loads(line)[field]), line
                    except (ValueError, KeyError, TypeError):
                        continue


class CursorReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.cursor_path = options["path"].rstrip("/"), options["cursorpath"].rstrip("/")
        self.most, self.page_size = int(options.get("maxdetails", 30)), int(options.get("page_size", 1000))
        self.field, self.start = options.get("indexfield", "disclosureIndex"), options.get("startingindex")

    def _cursor(self) -> dict[str, int]:
        """planned: the end of the last batch that was planned; committed: that of the last one done."""
        from pyarrow import fs

        store, at = _store(self.cursor_path)
        found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
        logs = sorted(f.path for f in found if f.base_name.endswith(".json"))
        if not logs:
            return {}
        with store.open_input_stream(logs[-1]) as stream:
            return {**json.loads(stream.read()), "log": int(logs[-1].rsplit("/", 1)[-1][:-5])}

    def _log(self, planned: int, committed: int) -> None:
        """The next entry of the log: written beside its place and moved, so none is ever seen in part."""
        from pyarrow import fs

        store, at = _store(self.cursor_path)
        number = self._cursor().get("log", -1) + 1
        store.create_dir(at, recursive=True)
        draft = f"{at}/.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps({"planned": planned, "committed": committed}).encode())
        store.move(draft, f"{at}/{number:012d}.json")
        for f in store.get_file_info(fs.FileSelector(at)):
            if f.base_name.endswith(".json") and int(f.base_name[:-5]) < number - 20:
                store.delete_file(f.path)

    def _last_landed(self) -> int:
        pages = _pages(self.path)
        return max((i for i, _ in _details(self.path, pages[-1], self.field)), default=-1) if pages else -1

    def initialOffset(self) -> dict:
        """Where the cursor stands; without one it is seeded: nothing that had landed before is read, unless asked for."""
        return {"index": self._seeded()["committed"]}

    def _seeded(self) -> dict[str, int]:
        if not self._cursor():
            seed = int(self.start) - 1 if self.start is not None else self._last_landed()
            self._log(seed, seed)
        return self._cursor()

    def latestOffset(self) -> dict:
        """At most ``maxDetails`` details beyond what has been planned."""
        now = self._seeded()
        cursor = now["planned"]
        ahead: list[int] = []
        for page in _pages(self.path):
            if (page + 1) * self.page_size <= cursor:
                continue
            ahead += [i for i, _ in _details(self.path, page, self.field) if i > cursor]
            if len(ahead) >= self.most:
                break
        if not ahead:
            return {"index": cursor}
        end = sorted(ahead)[: self.most][-1]
        self._log(end, now["committed"])
        return {"index": end}

    def partitions(self, start: dict, end: dict) -> list[IndexRange]:
        first, last = start["index"], end["index"]
        out = []
        for page in _pages(self.path):
            low, high = max(first, page * self.page_size - 1), min(last, (page + 1) * self.page_size - 1)
            for a in range(low, high, TASK_DETAILS):
                out.append(IndexRange(self.path, page, self.field, a, min(high, a + TASK_DETAILS)))
        return out

    def read(self, partition: IndexRange) -> Iterator[tuple[int, str]]:
        for i, line in _details(partition.path, partition.page, partition.field):
            if partition.first < i <= partition.last:
                yield i, line

    def commit(self, end: dict) -> None:
        now = self._cursor()
        if end["index"] > now.get("committed", -1):
            self._log(max(end["index"], now.get("planned", -1)), end["index"])


class CursorPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cursor_pages"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> CursorReader:
        return CursorReader({k.lower(): v for k, v in self.options.items()})


def read_pages(spark: SparkSession, path: str, cursor_path: str, **options: object) -> DataFrame:
    """The landed details past the cursor as a stream: detail_index, payload."""
    spark.dataSource.register(CursorPages)
    return spark.readStream.format("cursor_pages").option("cursorPath", cursor_path).options(**options).load(path)


def land_details(details: DataFrame, path: str, index: str = "disclosureIndex", page_size: int = 1000) -> None:
    """Writes details (a row each, ``index`` among the columns) as a fetcher lands them."""
    page = F.floor(F.col(index) / page_size).cast("long").alias("page")
    details.select(page, F.to_json(F.struct(*details.columns)).alias("value")).repartition("page").write.mode("append").partitionBy("page").text(path)


#: What a detail's JSON holds, as far as it is read.
DETAIL = "disclosureType string, disclosureClass string, time string, senderTitle string, behalfSenderTitle string, subject struct<tr:string>, summary struct<tr:string>, relatedStocks array<struct<code:string>>"


def disclosure_events(details: DataFrame) -> DataFrame:
    """Events of details (detail_index, payload): one for each whose time can be read, day first; the others are passed over.

    A title is the company and the summary, else the subject, else the type.
    """
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    d = details.select("detail_index", F.from_json("payload", DETAIL).alias("d")).select("detail_index", "d.*")
    when = F.try_to_timestamp(F.trim("time"), F.lit("dd.MM.yyyy HH:mm:ss")).cast("timestamp_ntz")
    company = F.coalesce(blank(F.col("senderTitle")), blank(F.col("behalfSenderTitle")), F.lit("?"))
    title = disclosure_title(company, F.coalesce(blank(F.col("summary.tr")), blank(F.col("subject.tr"))), F.coalesce("disclosureType", F.lit("")))
    codes = F.filter(F.transform(F.coalesce("relatedStocks", F.array().cast("array<struct<code:string>>")), lambda s: s["code"]), lambda c: c != "")
    out = d.select(
        F.concat(F.lit("disclosure:"), "detail_index").alias("external_id"),
        F.lit("disclosures").alias("source"),
        F.lit("A").alias("source_tier"),
        F.lit(1.0).alias("credibility"),
        when.alias("published_ts"),
        F.to_date(when).alias("published_date"),
        title.alias("title"),
        F.concat_ws("/", F.coalesce("disclosureType", F.lit("")), F.coalesce("disclosureClass", F.lit(""))).alias("event_type"),
        F.array_compact(codes).alias("tickers"),
    )
    return out.where("published_ts IS NOT NULL")
