"""Date partitions that are replaced all at once.

A load writes its partitions into folders of its own, `<date_col>=D/load=L`; a small numbered manifest then names, for each
date, the load that counts. Readers take the newest manifest, so they see a date before or after a load and never in between,
on stores without rename too: a manifest's number can be created only once, and whoever comes second merges and tries again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFESTS = "_manifests"
#: Seconds that a writer waits for another's manifest of a few bytes to become whole.
PATIENCE = 20.0


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    where, fs = _folder(spark, f"{path}/{MANIFESTS}")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(where)) if fs.exists(where) else []


def _manifest(spark: SparkSession, path: str, number: int) -> dict | None:
    """A manifest: the number that it builds on, and each date's load; None if it isn't whole (its writer is at work, or died)."""
    where, fs = _folder(spark, f"{path}/{MANIFESTS}/{number:012d}")
    stream = fs.open(where)
    try:
        lines = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        text = lines.readLine()
    finally:
        stream.close()
    try:
        return json.loads(text or "")
    except ValueError:
        return None


def _newest(spark: SparkSession, path: str, numbers: list[int]) -> tuple[int, dict[str, str]]:
    """Number and loads of the newest whole manifest; 0 and none before the first."""
    return next(((n, m["loads"]) for n in reversed(numbers) if (m := _manifest(spark, path, n)) is not None), (0, {}))


def _current(spark: SparkSession, path: str) -> dict[str, str]:
    return _newest(spark, path, _numbers(spark, path))[1]


def _skipped(spark: SparkSession, path: str, number: int) -> bool:
    """Whether a later manifest took this one's writer for dead and builds on an earlier one."""
    later = [m for n in _numbers(spark, path) if n > number and (m := _manifest(spark, path, n)) is not None]
    return bool(later) and later[0]["base"] < number


def _publish(spark: SparkSession, path: str, change: Callable[[dict[str, str]], dict[str, str]]) -> None:
    """Write the next manifest: change(the newest). If another writer takes its number, or passes this one over, start anew
    from what is there then. A manifest that isn't whole is waited for; after PATIENCE its writer counts as dead."""
    end = time.monotonic() + PATIENCE
    while True:
        numbers = _numbers(spark, path)
        base, loads = _newest(spark, path, numbers)
        if numbers and base != numbers[-1] and time.monotonic() < end:
            time.sleep(0.1)
            continue
        number = max(numbers, default=0) + 1
        where, fs = _folder(spark, f"{path}/{MANIFESTS}/{number:012d}")
        try:
            stream = fs.create(where, False)
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                continue
            raise
        stream.write(bytearray(json.dumps({"base": base, "loads": change(loads)}).encode()))
        stream.close()
        if not _skipped(spark, path, number):
            return


def stage(df: DataFrame, path: str, date_col: str = "data_date") -> str:
    """Write the partitions of df beside the table's own; nobody reads them before they are committed. Returns the load."""
    load = f"v{uuid.uuid4().hex}"
    df.withColumn("load", F.lit(load)).write.mode("append").partitionBy(date_col, "load").parquet(path)
    return load


def staged_dates(spark: SparkSession, path: str, load: str, date_col: str = "data_date") -> list[str]:
    pattern, fs = _folder(spark, f"{path}/{date_col}=*/load={load}")
    return sorted(s.getPath().getParent().getName().partition("=")[2] for s in fs.globStatus(pattern) or [])


def commit(spark: SparkSession, path: str, load: str, date_col: str = "data_date") -> list[str]:
    """Let a staged load count for all its dates at once; a load without partitions is an error."""
    dates = staged_dates(spark, path, load, date_col)
    if not dates:
        raise ValueError("nothing to write: the load is empty")
    _publish(spark, path, lambda now: now | dict.fromkeys(dates, load))
    return dates


def discard(spark: SparkSession, path: str, load: str, date_col: str = "data_date") -> None:
    """Remove a staged load that won't be committed."""
    pattern, fs = _folder(spark, f"{path}/{date_col}=*/load={load}")
    for s in fs.globStatus(pattern) or []:
        fs.delete(s.getPath(), True)


def replace_partitions(df: DataFrame, path: str, date_col: str = "data_date") -> list[str]:
    """The partitions that df holds replace their like, all at once; others stay. Safe to repeat. Returns the dates."""
    return commit(df.sparkSession, path, stage(df, path, date_col), date_col)


def read_partitions(spark: SparkSession, path: str, date_col: str = "data_date") -> DataFrame:
    """The committed rows; filters on the date prune folders. Columns that older partitions lack are null there."""
    now = _current(spark, path)
    if not now:
        raise ValueError(f"{path} holds no committed partition")
    folders = [f"{path}/{date_col}={d}/load={load}" for d, load in sorted(now.items())]
    rows = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(*folders).drop("load")
    return rows.withColumn(date_col, F.col(date_col).cast("date"))


def drop_partitions(spark: SparkSession, path: str, before: str) -> list[str]:
    """Dates before a day stop counting; vacuum removes their files."""
    gone: list[str] = []

    def without(now: dict[str, str]) -> dict[str, str]:
        gone[:] = sorted(d for d in now if d < before)
        return {d: load for d, load in now.items() if d >= before}

    _publish(spark, path, without)
    return gone


def vacuum(spark: SparkSession, path: str, keep: int = 2, date_col: str = "data_date") -> int:
    """Remove folders that none of the newest `keep` manifests names, and older manifests; run it when no load is staged and
    no reader holds an older manifest. Returns how many folders went."""
    numbers = _numbers(spark, path)
    used = {(d, load) for n in numbers[-keep:] for d, load in (_manifest(spark, path, n) or {"loads": {}})["loads"].items()}
    pattern, fs = _folder(spark, f"{path}/{date_col}=*/load=*")
    gone = 0
    for s in fs.globStatus(pattern) or []:
        if (s.getPath().getParent().getName().partition("=")[2], s.getPath().getName().partition("=")[2]) not in used:
            fs.delete(s.getPath(), True)
            gone += 1
    for n in numbers[:-keep]:
        fs.delete(_folder(spark, f"{path}/{MANIFESTS}/{n:012d}")[0], False)
    return gone
