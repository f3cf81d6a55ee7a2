"""Tables in the folder that all executors share, and code for their Python workers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import shutil
import tempfile
import threading
import uuid
import zipfile

import pyarrow
from pyspark.sql import DataFrame, SparkSession

#: Rows of a batch for Python: texts can be long, and a batch is held whole on both sides.
BATCH_ROWS = 1000



class _Tables(threading.local):
    """The staged tables of a thread: queries that run at once in one driver don't delete each other's."""

    every: list[list[tuple[SparkSession, str]]] = []

    def __init__(self):
        self.open: list[tuple[SparkSession, str]] = []
        self.every.append(self.open)


_TABLES = _Tables()
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only where driver and executors are one process, a fresh one if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="tagloom-")
        found = f"file://{_OWN[app]}"
    return found.rstrip("/")


#: Rows of a file of a narrow table, and its least number of files.
FILE_ROWS, FILES = 250_000, 8


def staged(df: DataFrame, tag: str, rows: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: later jobs survive lost executors without running
    the plan again, and the reread table has a known size for the planner.
    rows: about how many narrow rows there are at most; they are written to as
    many files as that takes, not one for each shuffle partition.  Only where an
    aggregation makes them: a task that takes several partitions of a hash join
    holds the maps of all of them.
    by: columns of folders, so that a job that wants some of their values reads no other files.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(FILES, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/tagloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    _TABLES.open.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def staged_tables() -> int:
    """How many staged tables this thread has."""
    return len(_TABLES.open)


def drop_staged(since: int = 0, but_last: bool = False) -> None:
    """Delete this thread's staged tables (those from number `since`, and not the last one if it is to stay); call it once the results that read them are written."""
    _drop(_TABLES.open, since, but_last)


def _drop(tables: list[tuple[SparkSession, str]], since: int = 0, but_last: bool = False) -> None:
    stay = [tables.pop()] if but_last and len(tables) > since else []
    while len(tables) > since:
        spark, path = tables.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            break
    tables.extend(stay)


def _leave() -> None:
    for tables in _Tables.every:
        _drop(tables)
    for path in _OWN.values():
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_leave)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, and bound the rows of a batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if (app := spark.sparkContext.applicationId) in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tagloom-"), "tagloom.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    out.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def release() -> None:
    """Give memory that a Python worker has freed back to the system: workers live on between tasks."""
    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow, with this package on the executors and memory given back after each task."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            release()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
