"""Tables that one job reads several times, written once to the shared folder; and a scope that removes them after use."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class Scratch:
    """The folder of one scope, and what its jobs share by key."""

    folder: str
    shared: dict[tuple, DataFrame] = field(default_factory=dict)


_SCOPE: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, one of our own in local mode (tests); an error on a
    cluster, whose executors see no folder of the driver's."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "gondola-work")
    return at.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """Where temporary tables go: the scope's folder, or the shared folder outside any scope."""
    scope = _SCOPE.get()
    return shared_dir(spark) if scope is None else scope.folder


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Temporary tables of the jobs inside are removed at its end, so results must be written or collected before."""
    scope = Scratch(f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}")
    token = _SCOPE.set(scope)
    try:
        yield scope
    finally:
        _SCOPE.reset(token)
        where = spark._jvm.org.apache.hadoop.fs.Path(scope.folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table as Parquet and read it back: its plan runs once, and lost executors cost nothing but a new read."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared(key: tuple, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """A written table that all jobs of a scope share; outside a scope each job writes its own."""
    scope = _SCOPE.get()
    if scope is None:
        return written(make(), name)
    if key not in scope.shared:
        scope.shared[key] = written(make(), name)
    return scope.shared[key]


def small(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """A table of the caller's with a broadcast hint if Catalyst's estimate, which filters and aggregates don't exceed, shows
    at most so many bytes; else as it is, for Spark to join by whatever way fits."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= most else df


def numbered(df: DataFrame, column: str) -> DataFrame:
    """The values of a column that has few, with a short number `c` for each: arrays of numbers take less room than of names."""
    return small(written(df.select(column).distinct().withColumn("c", F.row_number().over(Window.orderBy(column)).cast("short")), "numbers"))
