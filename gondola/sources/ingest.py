"""The daily feed and its tables: reading, partitions, dates to compute, snapshots, logs."""

from __future__ import annotations

from datetime import date as Date
from datetime import timedelta

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gondola.params import DEFAULTS, Params
from gondola.sources.snapshots import commit, discard, stage

OTHER = "Otros"
#: Rows longer than their header that a load may drop.
MAX_BAD_RECORDS = 1000


class TooManyBadRecords(ValueError):
    pass


def _files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files that paths name, those in folders included."""
    out = []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        found = fs.listStatus(where)
        names = [s.getPath() for s in found if s.isFile()]
        out += [n.toString() for n in names if not n.getName().startswith(("_", "."))]
    return out


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names in a file's first line that isn't blank. Only that line is read, and no job runs."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    where = hadoop.fs.Path(path)
    stream = where.getFileSystem(conf).open(where)
    try:
        codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
        lines = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream if codec is None else codec.createInputStream(stream), "UTF-8"))
        line = lines.readLine()
        while line is not None and not line.strip():
            line = lines.readLine()
    finally:
        stream.close()
    return [] if line is None else [c.strip().strip('"').lower() for c in line.lstrip("\ufeff").split("|")]


def _feed_rows(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Rows of all files, with `_long` true where a row has more fields than its header: one read for each distinct header."""
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in _files(spark, paths):
        by_header.setdefault(tuple(_header(spark, path)), []).append(path)
    rows = None
    for names, own in by_header.items():
        if not names:
            continue
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_bad"]])
        # Without pruning, or a row's length isn't seen.
        one = spark.read.option("columnPruning", "false").csv(own, schema=schema, sep="|", header=True, multiLine=True, columnNameOfCorruptRecord="_bad", mode="PERMISSIVE", enforceSchema=True)
        fields = F.size(F.split(F.regexp_replace("_bad", '"[^"]*"', ""), r"\|", -1))
        # Spark refuses to read the flag alone; the second test is never true, but it reads a column beside the flag.
        one = one.withColumn("_long", F.coalesce(fields > len(names), F.lit(False)) | (F.length(F.coalesce(F.col(names[0]), F.lit(""))) < 0))
        one = one.select("_long", *(F.coalesce(F.col(c) if c in names else F.lit(None).cast("string"), F.lit("")).alias(c) for c in columns))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        return spark.createDataFrame([], T.StructType([T.StructField("_long", T.BooleanType()), *(T.StructField(c, T.StringType()) for c in columns)]))
    return rows


def _too_many(bad: int, most: int) -> TooManyBadRecords:
    return TooManyBadRecords(f"{bad} rows are longer than their header; at most {most} may be")


def read_price_feed(spark: SparkSession, paths: list[str], data_date: Date | str, columns: list[str], max_bad_records: int | None = MAX_BAD_RECORDS) -> DataFrame:
    """Pipe-delimited files with a header each, by column name, all text, stamped with the date.

    Short rows are filled with empty text, rows longer than the header are dropped (an error beyond max_bad_records, which
    a pass of its own counts; None accepts any number; load_price_feed counts while it writes), quoted newlines, a byte-order
    mark and blank lines are read over; columns that a file lacks are empty. Files of one header are read together.
    """
    rows = _feed_rows(spark, paths, columns)
    if max_bad_records is not None and (bad := rows.filter("_long").count()) > max_bad_records:
        raise _too_many(bad, max_bad_records)
    return rows.filter("NOT _long").drop("_long").withColumn("data_date", F.lit(data_date).cast("date"))


def load_price_feed(spark: SparkSession, paths: list[str], data_date: Date | str, columns: list[str], table: str, max_bad_records: int = MAX_BAD_RECORDS) -> dict[str, int]:
    """S1 to S3 in one pass: the feed's rows into the table's partition of the date. Rows are counted while they are staged;
    with too many bad ones, or none good, nothing is committed and readers keep the date as it was. Returns the counts."""
    seen = Observation()
    rows = _feed_rows(spark, paths, columns).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("_long").alias("bad"))
    load = stage(rows.filter("NOT _long").drop("_long").withColumn("data_date", F.lit(data_date).cast("date")), table)
    counts = {k: v or 0 for k, v in seen.get.items()}
    if counts["bad"] > max_bad_records:
        discard(spark, table, load)
        raise _too_many(counts["bad"], max_bad_records)
    commit(spark, table, load)
    return counts


def write_partition(df: DataFrame, path: str, date_col: str = "data_date") -> None:
    """S3: replace the partitions that df holds, no others; an empty df is an error. Safe to repeat. Readers of the folder may
    meet the moment between removal and rename; snapshots.replace_partitions has none."""
    if df.isEmpty():
        raise ValueError("nothing to write: the load is empty")
    append_history(df, path, date_col)


def append_history(df: DataFrame, path: str, date_col: str = "data_date") -> None:
    """Partitions of the result replace their like; all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_col).parquet(path)


def refresh_dimension(current: DataFrame, landing: DataFrame, expected_companies: list[str]) -> tuple[DataFrame, DataFrame]:
    """The landed rows, with the current rows of expected companies that didn't land; and the snapshot before."""
    spark = current.sparkSession
    landed = landing.filter(F.trim(F.col("company_id")) != "")
    expected = spark.createDataFrame([(c,) for c in expected_companies], "company_id string")
    absent = expected.join(landed.select("company_id").distinct(), "company_id", "left_anti")
    return landed.unionByName(current.join(F.broadcast(absent), "company_id", "left_semi"), allowMissingColumns=True), current


def append_classification(df: DataFrame, path: str) -> None:
    """New versions are added; older files may lack newer columns."""
    df.write.mode("append").parquet(path)


def read_classification(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def products_to_classify(raw: DataFrame, classified: DataFrame, date: Date | str) -> DataFrame:
    """Products of the date that have no classification yet."""
    day = raw.filter(F.col("data_date") == F.lit(date).cast("date")).filter("product_id IS NOT NULL")
    new = day.join(classified.select("product_id").distinct(), "product_id", "left_anti")
    return new.groupBy("product_id").agg(F.min("description").alias("description"), F.min("brand").alias("brand"))


def products_to_reclassify(classified: DataFrame, categories: list[str], before: str) -> DataFrame:
    """Products whose current category is listed and was given before a time, or at none."""
    w = Window.partitionBy("product_id").orderBy(F.col("classified_at").desc_nulls_last(), "category", "description")
    now = classified.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    return now.filter(F.col("category").isin(*categories) & (F.col("classified_at").isNull() | (F.col("classified_at") < F.lit(before).cast("timestamp")))).select("product_id", "description", "brand", "category")


def apply_taxonomy(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Labels outside the taxonomy (category, section) become "Otros"; the section follows."""
    known = taxonomy.select("category", F.col("section").alias("known_section"), F.lit(True).alias("known"))
    rows = labels.join(F.broadcast(known), "category", "left").drop("section")
    rows = rows.withColumn("category", F.when(F.col("known"), F.col("category")).otherwise(OTHER))
    return rows.withColumn("section", F.coalesce("known_section", F.lit(OTHER))).drop("known", "known_section")


def category_transitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """How many products went from one category to another."""
    pairs = old.select("product_id", F.col("category").alias("old")).join(new.select("product_id", F.col("category").alias("new")), "product_id")
    return pairs.filter("NOT old <=> new").groupBy("old", "new").agg(F.count("*").alias("products"))


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S9."""
    return spark.read.csv(path, schema=schema, header=True)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(neighbourhood, district, wkt)."""
    return spark.read.csv(path, schema="neighbourhood string, district int, wkt string", header=True, quote='"', escape='"')


def dates_of(df: DataFrame, column: str = "data_date") -> list[Date]:
    """Distinct dates of a table, oldest first: a few hundred values whatever the number of rows."""
    return [r[0] for r in df.select(column).distinct().orderBy(column).collect() if r[0] is not None]


def latest_date(df: DataFrame, column: str = "data_date") -> Date:
    """The last date, as a literal that prunes partitions; an empty table is an error."""
    last = df.agg(F.max(column)).first()[0]
    if last is None:
        raise ValueError("the table is empty: it has no latest date")
    return last


def dates_to_compute(source: list[Date], history: list[Date], p: Params = DEFAULTS, forced: list[Date] = ()) -> list[Date]:
    """Dates of the source that the history lacks, oldest first and at most max_dates_per_run; the last date always,
    unless the cap cuts; then the forced dates that the source has. An empty source is an error."""
    known = sorted(set(source))
    if not known:
        raise ValueError("the source has no dates")
    missing = [d for d in known if d not in set(history)]
    chosen = set(missing[: p.max_dates_per_run])
    if len(missing) <= p.max_dates_per_run:
        chosen.add(known[-1])
    return sorted(chosen | (set(forced) & set(known)))


def date_pairs(source: list[Date], batch: list[Date]) -> list[tuple[Date, Date | None]]:
    """Each date of the batch with the source's date before it; None for the source's first."""
    known = sorted(set(source))
    before = dict(zip(known, [None, *known], strict=False))
    return [(d, before[d]) for d in sorted(batch) if d in before]


def with_bases(pairs: list[tuple[Date, Date | None]]) -> list[Date]:
    """The batch with the bases added."""
    return sorted({d for pair in pairs for d in pair if d is not None})


def pairs_frame(spark: SparkSession, pairs: list[tuple[Date, Date | None]]) -> DataFrame:
    return spark.createDataFrame(pairs, "data_date date, base_date date")


def missing_dates(spark: SparkSession, first: str, last: str, *tables: DataFrame) -> DataFrame:
    """Days of the window that no table has, oldest first."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("data_date"))
    for t in tables:
        days = days.join(t.select("data_date").distinct(), "data_date", "left_anti")
    return days.orderBy("data_date")


def dates_at_risk(raw: DataFrame, incoming: DataFrame, history: DataFrame) -> DataFrame:
    """Dates of the raw or incoming table that the history lacks."""
    dates = raw.select("data_date").unionByName(incoming.select("data_date")).distinct()
    return dates.join(history.select("data_date").distinct(), "data_date", "left_anti")


def retention_days(at_risk: list[Date], today: Date, base: int = 3) -> int:
    """Days to keep; longer while the oldest date at risk would expire."""
    age = (today - min(at_risk)).days if at_risk else 0
    return age + base if age >= base else base


def expire_partitions(df: DataFrame, today: Date | str, days: int) -> DataFrame:
    """S15."""
    return df.filter(F.col("data_date") >= F.date_sub(F.lit(today).cast("date"), days))


def drop_expired(spark: SparkSession, path: str, today: Date, days: int, date_col: str = "data_date") -> list[Date]:
    """Delete the partition folders of a table that are older than so many days; returns their dates."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    old = []
    for status in fs.listStatus(folder):
        name, _, value = status.getPath().getName().partition("=")
        if name == date_col and Date.fromisoformat(value) < today - timedelta(days=days):
            fs.delete(status.getPath(), True)
            old.append(Date.fromisoformat(value))
    return sorted(old)


def verify_loaded(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Loaded dates that the table no longer has."""
    return dates.select("data_date").distinct().join(df.select("data_date").distinct(), "data_date", "left_anti")


def pending_dates(raw: DataFrame, *histories: DataFrame) -> DataFrame:
    """Dates of the raw table that one of the histories lacks."""
    days = raw.select("data_date").distinct()
    out = None
    for h in histories:
        lacks = days.join(h.select("data_date").distinct(), "data_date", "left_anti")
        out = lacks if out is None else out.unionByName(lacks)
    return out.distinct()


def days_behind(raw: DataFrame, today: Date | str) -> DataFrame:
    return raw.agg(F.datediff(F.lit(today).cast("date"), F.max("data_date")).alias("days_behind"))


def append_change_log(log: DataFrame, detections: DataFrame, date: Date | str) -> DataFrame:
    """The log without this date's rows, and the detections stamped with it: the same however often it runs."""
    stamp = F.lit(date).cast("date")
    return log.filter(F.col("data_date") != stamp).unionByName(detections.withColumn("data_date", stamp), allowMissingColumns=True)


def change_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("data_date", "dimension", "change").agg(F.count("*").alias("n"))
