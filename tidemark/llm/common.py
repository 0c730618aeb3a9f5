"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WRITTEN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only a local session, where everything runs in one process, may fall back
    to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "local" not in _WRITTEN:
        _WRITTEN["local"] = tempfile.mkdtemp(prefix="tidemark-")
    return "file://" + _WRITTEN["local"]


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and everything that follows sees the same rows however often it runs.  The
    table goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not any(k != "local" for k in _WRITTEN):
        atexit.register(_remove_written, spark)
    _WRITTEN[path] = path
    return spark.read.schema(df.schema).parquet(path)


def _remove_written(spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:  # the session ended first
        return
    for key, path in _WRITTEN.items():
        hadoop_path = jvm.org.apache.hadoop.fs.Path("file://" + path if key == "local" else path)
        hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def durable_with(df: DataFrame, files: int | None = None, **measures: Column) -> tuple[DataFrame, dict]:
    """``durable``, and aggregates of the rows that come with the write, without another job.

    ``files`` merges the tasks of a narrow result into so many at most.
    """
    df = df.coalesce(files) if files else df
    if not measures:
        return durable(df), {}
    seen = Observation()
    out = durable(df.observe(seen, *[c.alias(k) for k, c in measures.items()]))
    return out, seen.get


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores put before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def reserved(df: DataFrame, *names: str) -> None:
    """Refuses a table that has a column of one of these names already."""
    if taken := {c.lower() for c in df.columns} & {n.lower() for n in names}:
        raise ValueError(f"the table has a column {', '.join(sorted(taken))} already")


#: Rows and bytes that go to a Python worker at once, at most; a text beyond that goes alone.
BATCH_ROWS, BATCH_BYTES = 2_000, 8_000_000


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session sends Python workers no larger batches, so that their memory is bounded in bytes."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = df.sparkSession.conf.get(name).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            df.sparkSession.conf.set(name, str(most))
    return df


_TABLES: dict[str, object] = {}


def worker_table(key: str, make: Callable[[], object]):
    """A Python worker's table for the operator at work.

    Workers live on from stage to stage, so the tables of the operator before are
    let go when another begins; a worker never holds those of two.
    """
    if key not in _TABLES:
        _TABLES.clear()
        tidy()
        _TABLES[key] = make()
    return _TABLES[key]


class Recent(dict):
    """A cache of ``make(key)`` for ``most`` keys, in two generations: when the younger is full it becomes the older, and what is met again comes back from there."""

    most = 0

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        if len(self) >= self.most // 2:
            self.older = dict(self)
            self.clear()
        if (value := self.older.get(key)) is None:
            value = self.make(key)
        self[key] = value
        return value


def tidy() -> None:
    """Gives memory that a worker has freed back to the system; allocators would keep it for the tasks after, and several workers share a machine."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable) -> Callable:
    """``run``, a function on batches, that tidies up when a task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


#: Types of the columns that Python adds, as Spark and as Arrow name them.
ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
    "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
    "array<binary>": pa.list_(pa.binary()), "array<double>": pa.list_(pa.float64()),
}


def read_columns(df: DataFrame, column: str, fields: dict[str, str], read: Callable[[list], tuple], keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all of them by default) and ``fields`` (name: type), which ``read`` works out, one list each, from a list of the values of ``column``.

    A map.  What is kept goes through Python as Arrow arrays and is never
    converted: in pandas one null makes floats of a batch's whole numbers, and
    those are rounded beyond 2 ** 53.
    """
    kept = df.columns if keep is None else keep
    kinds = [ARROW[kind] for kind in fields.values()]
    names = [*kept, *fields]

    def run(batches):
        for batch in batches:
            found = read(batch.column(column).to_pylist())
            arrays = [pa.array(x, kind) for x, kind in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *arrays], names)

    needed = df if keep is None else df.select(*dict.fromkeys([*kept, column]))
    schema = T.StructType([*df.select(*kept).schema.fields, *(T.StructField(n, T.DataType.fromDDL(kind)) for n, kind in fields.items())])
    return bounded_batches(needed).mapInArrow(tidied(run), schema)


def utf8_length(column: str):
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")
