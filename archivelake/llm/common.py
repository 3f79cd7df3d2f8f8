"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that goes to Python, where the session keeps Spark's default of 10,000: whole
#: texts are kilobytes each, and batches take memory beside the heap.
BATCH_ROWS = 2_000
#: Documents of which a task that writes a table on the way tells, at least, as long as each core has CORE_TASKS
#: of them: Hadoop starts three processes for each file of a local folder, which take longer than a few rows.
TASK_DOCS = 2_000
CORE_TASKS = 6


def bounded_batches(spark: SparkSession) -> None:
    """Sets BATCH_ROWS for the session unless it has a number of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (any path that Spark reads)."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(names: list[str], name: str) -> int:
    """Which column ``name`` is: the first of exactly that name, else the first that differs in case."""
    found = [i for i, h in enumerate(names) if h == name] or [i for i, h in enumerate(names) if h.lower() == name.lower()]
    if not found:
        raise ValueError(f"no column {name!r} among {names}")
    return found[0]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the columns ``names``, whatever else ``df`` has.

    Columns are taken by position, so further columns whose names differ only in
    case, or repeat one of ``names``, cannot make a reference ambiguous: the
    first column of exactly that name wins, then the first that differs in case.
    """
    have = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(have))])
    return flat.select(*[F.col(f"c{place(have, n)}").alias(n) for n in names])


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster.  Where it is unset, as in
    tests, the warehouse folder of the session is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _LEFT.append(("path", path))
    return path


def written(df: DataFrame, what: str, docs: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors.

    With ``docs``, the number of documents that its rows are about, partitions of few of them share a
    task and a file; not for rows that Python makes with their task's number.
    """
    path = shared_dir(df.sparkSession, what)
    if docs is None:
        df.write.parquet(path)
    else:
        df.coalesce(max(CORE_TASKS * df.sparkSession.sparkContext.defaultParallelism, -(-docs // TASK_DOCS))).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes what ``written`` gave, once all that reads it is written itself."""
    for df in frames:
        name = _PATHS.pop(df)
        _LEFT.remove(("path", name))
        _delete(spark, name)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release() -> None:
    """Gives memory that a Python worker has freed back to the system: workers are reused, and
    what they keep is missed beside the heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def releasing(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives memory back when its task ends."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        release()

    return run


#: What operators of this process have written beside their results: (kind, name).
_LEFT: list[tuple[str, str]] = []
#: Where the DataFrames lie that ``written`` gave.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def fresh_table(what: str) -> str:
    """A name for a new table of the warehouse."""
    name = f"{what}_{uuid.uuid4().hex}"
    _LEFT.append(("table", name))
    return name


def clean(spark: SparkSession) -> None:
    """Deletes what operators have written beside their results, which read it: call it
    when these have been written or collected."""
    while _LEFT:
        kind, name = _LEFT.pop()
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            _delete(spark, name)
