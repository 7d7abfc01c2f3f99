"""The folder that the driver and all executors see, and the tables that jobs keep there for a while.

All tables of an application are in one folder of its own, which goes when the driver's Python ends or `release` is
called; a table that a later one replaces can go at once (`removed`).
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where that is unset and all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file:///tmp/barloom-checkpoints"
    return base.rstrip("/")


_scratch: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    name = spark.sparkContext.applicationId
    if name not in _scratch:
        _scratch[name] = f"{shared_dir(spark)}/barloom-{name}-{uuid.uuid4().hex[:8]}"
        atexit.register(release, spark)
    return _scratch[name]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Remove all tables of this application. What still reads them can't be run after that."""
    with contextlib.suppress(Exception):  # the session may be gone
        path = _scratch.pop(spark.sparkContext.applicationId, None)
        if path:
            _delete(spark, path)


#: Paths written since each open `only`.
_open: list[list[str]] = []


#: Whether shuffle files go when a query has ended, not when the JVM next collects what refers to them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """A block of writes whose shuffle files go with each: nothing reads a written table's plan again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it is read several times, and lineage ends at what outlives any executor."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_go(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    for paths in _open:
        paths.append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def removed(table: DataFrame) -> None:
    """Remove the table that `written` gave, once a later one has replaced it."""
    path = getattr(table, "_scratch_path", None)
    if path:
        _delete(table.sparkSession, path)


@contextlib.contextmanager
def only(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose tables go at its end, but for those that are passed to the function it gives."""
    paths: list[str] = []
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table._scratch_path)
        return table

    _open.append(paths)
    try:
        yield keep
    finally:
        _open.remove(paths)
        for path in paths:
            if path not in kept:
                _delete(spark, path)
