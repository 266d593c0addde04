"""Where operators keep intermediate tables: the folder that a cluster's machines share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: The lists of the scopes that are open here, in this thread or task alone.
_NAMED: ContextVar[tuple[list[str], ...]] = ContextVar("named", default=())


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Where the setting is absent (tests on one machine), a temporary folder stands in; a session on
    a cluster has to name a shared folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    for names in _NAMED.get():
        names.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables that operators write inside, once nothing that reads them is left to run.

    Tables that another thread writes meanwhile aren't this scope's.
    """
    names: list[str] = []
    opened = _NAMED.set((*_NAMED.get(), names))
    try:
        yield
    finally:
        _NAMED.reset(opened)
        for path in names:
            delete(spark, path)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches in slices of few rows, so that a task never holds Python objects for a whole batch of long texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Rows of an Arrow batch of texts: Spark's own bound of 10,000 is a gigabyte of long texts, held by the JVM and by Python at once.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches to BATCH_ROWS rows, unless it sets fewer. Spark reads the setting when a query runs, so it stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives back the memory it freed: Python workers are used again and would carry it into every later stage."""

    @functools.wraps(run)
    def ended(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not the GNU library
                pass

    return ended
