"""The last stored price of each product and chain as a bucketed table, one version per day.

The price history grows without end; what K20 asks of it, the last price before a day, is one row per product and chain. Each
day's version is written from the version before it and the day's prices: the state is bucketed by its key, so only the day's
prices are shuffled, and the rows of the new version that carry the day's date are the day's changes. Replaying a day starts
from the version before it, so it gives the same rows.
"""

from __future__ import annotations

import uuid
from datetime import date as Date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.params import DEFAULTS, Params

KEY = ["product_id", "chain"]
SCHEMA = "product_id string, chain string, price double, data_date date, price_date date"


def _day(date: Date | str) -> Date:
    return Date.fromisoformat(date) if isinstance(date, str) else date


def _versions(spark: SparkSession, root: str) -> list[tuple[Date, int, int, str]]:
    """Day, time, buckets and folder of each complete version."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        day, buckets, _ = status.getPath().getName().split(".")
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append((Date.fromisoformat(day), status.getModificationTime(), int(buckets), status.getPath().toString()))
    return sorted(found)


def _write(state: DataFrame, root: str, day: Date, buckets: int) -> DataFrame:
    """A new version in a folder of its own; it counts once its _SUCCESS is there."""
    name, path = f"price_state_{uuid.uuid4().hex}", f"{root}/{day}.{buckets}.{uuid.uuid4().hex}"
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    state.select(*columns).write.format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
    return state.sparkSession.table(name)


def state_before(spark: SparkSession, root: str, date: Date | str) -> tuple[DataFrame, int] | None:
    """The newest version older than a day, as a bucketed table, and its buckets; None without one."""
    older = [v for v in _versions(spark, root) if v[0] < _day(date)]
    if not older:
        return None
    _, _, buckets, path = older[-1]
    name = f"price_state_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({SCHEMA}) USING parquet CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(KEY)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name), buckets


def rebuild_price_state(history: DataFrame, root: str, date: Date | str, buckets: int | None = None) -> DataFrame:
    """The state as of a day from the whole history; needed once, or to replay days whose versions are gone."""
    day = _day(date)
    last = F.max_by(F.struct("price", "data_date", "price_date"), "data_date")
    rows = history.filter(F.col("data_date") <= F.lit(day)).groupBy(*KEY).agg(last.alias("v")).select(*KEY, "v.*")
    return _write(rows, root, day, buckets or int(history.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def advance_price_state(today: DataFrame, root: str, date: Date | str, buckets: int | None = None, p: Params = DEFAULTS) -> DataFrame:
    """K20 from the state: merges a day's prices (data_date, price_date, product_id, chain, price) and returns those that
    changed by more than price_epsilon or are new. Of repeated keys the smallest price counts; rows of other days are left out."""
    spark, day = today.sparkSession, _day(date)
    found = state_before(spark, root, day)
    if found is None:
        found = spark.createDataFrame([], SCHEMA), buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    state, buckets = found
    rows = today.filter(F.col("data_date") == F.lit(day)).groupBy(*KEY).agg(F.min("price").alias("new_price"), F.min("price_date").alias("new_date"))
    merged = state.join(rows, KEY, "full")
    moved = F.col("new_price").isNotNull() & (F.col("price").isNull() | (F.abs(F.col("new_price") - F.col("price")) > p.price_epsilon))
    either = lambda new, old: F.when(moved, new).otherwise(F.col(old)).alias(old)
    out = _write(merged.select(*KEY, either(F.col("new_price"), "price"), either(F.lit(day), "data_date"), either(F.col("new_date"), "price_date")), root, day, buckets)
    return out.filter(F.col("data_date") == F.lit(day)).select("data_date", "price_date", *KEY, "price")


def drop_old_states(spark: SparkSession, root: str, keep_days: int) -> int:
    """Delete versions beyond the newest keep_days days, and all but the newest version of a day; returns how many went."""
    versions = _versions(spark, root)
    newest = {v[0]: v for v in versions}
    kept = {newest[d][3] for d in sorted(newest)[-keep_days:]}
    gone = [v[3] for v in versions if v[3] not in kept]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(gone)
