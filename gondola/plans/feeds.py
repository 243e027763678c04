"""Registered queries over feeds, histories, places, households and checks, beside those of registry; and all of them."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.functions.text import declared_size, effective_qty, pieces_in_text
from gondola.operators import baskets, catalog, checks, dims, index, prices, promos
from gondola.params import Params
from gondola.plans.demo import LAST_DAY
from gondola.plans.registry import ORACLES, QUERIES, Tables, baskets_of, job
from gondola.sources import ingest, snapshots
from gondola.sources.work import work_dir, written

__all__ = ["ORACLES", "QUERIES"]


def path_of(t: Tables, name: str) -> str:
    return f"{work_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


# The daily feed and its tables

_FEED = ["product_id", "description", "brand", "list_price"]


def _feed_rows(t: Tables) -> DataFrame:
    return t.table("part").select(F.col("p_partkey").cast("string").alias("product_id"), F.concat("p_name", F.lit("\n"), "p_brand").alias("description"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_brand")).alias("brand"), F.col("p_size").cast("string").alias("list_price"))


def _feed(t: Tables) -> DataFrame:
    """Parts as a pipe-delimited feed with quoted line feeds, read back; one column isn't in the files."""
    path = path_of(t, "feed")
    _feed_rows(t).write.csv(path, sep="|", header=True, quoteAll=True, emptyValue="")
    return ingest.read_price_feed(t.spark, [path], LAST_DAY, [*_FEED, "promo"])


def _feed_with_bad_rows(t: Tables) -> DataFrame:
    """Every tenth row has one field too many."""
    path = path_of(t, "feed")
    rows = t.table("part").select(F.col("p_partkey").cast("string").alias("product_id"), F.when(F.col("p_partkey") % 10 == 0, F.concat("p_name", F.lit("|x"))).otherwise(F.col("p_name")).alias("description"))
    rows.write.csv(path, sep="|", header=True, quote="\u0000")
    return ingest.read_price_feed(t.spark, [path], LAST_DAY, ["product_id", "description"], None)


job("s1_price_feed", f"SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name || chr(10) || p_brand AS description, CASE WHEN p_partkey % 4 > 0 THEN p_brand ELSE '' END AS brand, CAST(p_size AS VARCHAR) AS list_price, '' AS promo, DATE '{LAST_DAY}' AS data_date FROM part")(_feed)
job("s2_feed_with_bad_rows", f"SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS description, DATE '{LAST_DAY}' AS data_date FROM part WHERE p_partkey % 10 <> 0")(_feed_with_bad_rows)


def _loaded_feed(t: Tables) -> DataFrame:
    """The feed with bad rows, loaded in one pass over an earlier load; then a load with too many bad rows, which changes nothing."""
    path, table = path_of(t, "feed"), path_of(t, "loaded")
    rows = t.table("part").select(F.col("p_partkey").cast("string").alias("product_id"), F.when(F.col("p_partkey") % 10 == 0, F.concat("p_name", F.lit("|x"))).otherwise(F.col("p_name")).alias("description"))
    rows.write.csv(f"{path}/a", sep="|", header=True, quote="\u0000")
    rows.filter("product_id < '2'").select(F.upper("description").alias("description"), "product_id").filter("description NOT LIKE '%|%'").write.csv(f"{path}/b", sep="|", header=True)
    ingest.load_price_feed(t.spark, [f"{path}/b"], LAST_DAY, ["product_id", "description"], table)
    ingest.load_price_feed(t.spark, [f"{path}/a", f"{path}/b"], LAST_DAY, ["product_id", "description"], table, 10**9)
    try:
        ingest.load_price_feed(t.spark, [f"{path}/a"], LAST_DAY, ["product_id", "description"], table, 0)
    except ingest.TooManyBadRecords:
        return snapshots.read_partitions(t.spark, table)
    raise AssertionError("a load with too many bad rows was committed")


job(
    "s2_loaded_feed",
    f"SELECT *, DATE '{LAST_DAY}' AS data_date FROM (SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS description FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), upper(p_name) FROM part WHERE p_partkey % 10 <> 0 AND CAST(p_partkey AS VARCHAR) < '2')",
)(_loaded_feed)


def _by_day(t: Tables) -> DataFrame:
    return t.prices.groupBy("data_date", "company_id").agg(F.count("*").alias("n"))


_BY_DAY = "(SELECT data_date, company_id, count(*) AS n FROM demo_prices GROUP BY ALL)"


def _kept_history(t: Tables, *batches: DataFrame, write=ingest.append_history) -> tuple[DataFrame, str]:
    path = path_of(t, "history")
    for b in batches:
        write(b, path)
    return t.spark.read.parquet(path), path


def _replaced(t: Tables) -> DataFrame:
    rows = _by_day(t)
    return _kept_history(t, rows, rows.filter(f"data_date = '{LAST_DAY}'").withColumn("n", F.col("n") * 10), write=ingest.write_partition)[0]


def _appended(t: Tables) -> DataFrame:
    """A history of the first four days; then a batch from the fourth on, with other numbers."""
    rows = _by_day(t)
    return _kept_history(t, rows.filter("data_date <= '2024-01-04'"), rows.filter("data_date >= '2024-01-04'").withColumn("n", -F.col("n")))[0]


def _without_expired(t: Tables) -> DataFrame:
    _, path = _kept_history(t, _by_day(t))
    ingest.drop_expired(t.spark, path, date(2024, 1, 8), 3)
    return t.spark.read.parquet(path)


def _committed(t: Tables) -> DataFrame:
    """A table of all days; the last is replaced, another load of it is staged and never committed, early days expire."""
    rows, path = _by_day(t), path_of(t, "table")
    last = rows.filter(f"data_date = '{LAST_DAY}'")
    for df in (rows, last.withColumn("n", F.col("n") * 10), last.withColumn("n", F.col("n") * 10)):
        snapshots.replace_partitions(df, path)
    snapshots.stage(last.withColumn("n", -F.col("n")), path)
    snapshots.drop_partitions(t.spark, path, "2024-01-03")
    return snapshots.read_partitions(t.spark, path)


job("s3_committed_partitions", f"SELECT data_date, company_id, CASE WHEN data_date = DATE '{LAST_DAY}' THEN n * 10 ELSE n END AS n FROM {_BY_DAY} WHERE data_date >= DATE '2024-01-03'")(_committed)
job("s3_replaced_partition", f"SELECT data_date, company_id, CASE WHEN data_date = DATE '{LAST_DAY}' THEN n * 10 ELSE n END AS n FROM {_BY_DAY}")(_replaced)
job("s18_appended_history", f"SELECT data_date, company_id, CASE WHEN data_date >= DATE '2024-01-04' THEN -n ELSE n END AS n FROM {_BY_DAY}")(_appended)
job("s15_expired_rows", f"SELECT * FROM {_BY_DAY} WHERE data_date >= DATE '2024-01-05'")(lambda t: ingest.expire_partitions(_by_day(t), "2024-01-08", 3))
job("s15_dropped_partitions", f"SELECT * FROM {_BY_DAY} WHERE data_date >= DATE '2024-01-05'")(_without_expired)
job(
    "s4_refreshed_dimension",
    """
SELECT company_id, store_id, CASE WHEN CAST(company_id AS INTEGER) < 4 THEN upper(name) ELSE name END AS name FROM demo_stores WHERE CAST(company_id AS INTEGER) < 6""",
)(lambda t: ingest.refresh_dimension(t.stores.select("company_id", "store_id", "name"), t.stores.filter("company_id < '4'").select("company_id", "store_id", F.upper("name").alias("name")), list("012345"))[0])


def _classified(t: Tables) -> DataFrame:
    """Two loads of classifications; the second has one more column."""
    path = path_of(t, "classified")
    rows = t.categories.select("product_id", "category")
    ingest.append_classification(rows, path)
    ingest.append_classification(rows.filter("category = 'PROMO'").withColumns({"category": F.lit("again"), "model": F.lit("m")}), path)
    return ingest.read_classification(t.spark, path)


job("s5_appended_classification", "SELECT product_id, category, CAST(NULL AS VARCHAR) AS model FROM demo_categories UNION ALL SELECT product_id, 'again', 'm' FROM demo_categories WHERE category = 'PROMO'", "product_id, category, model")(_classified)


def _versions(t: Tables) -> DataFrame:
    """Classifications with a time for two of three products."""
    day = F.when(F.col("product_id").cast("int") % 3 > 0, F.timestamp_seconds(F.lit(1704067200) + F.col("product_id").cast("int") % 5 * 86400))
    return t.categories.withColumn("classified_at", day)


job("s7_products_to_reclassify", "SELECT product_id, description, brand, category FROM demo_categories WHERE category IN ('PROMO', 'SMALL') AND (CAST(product_id AS INTEGER) % 3 = 0 OR CAST(product_id AS INTEGER) % 5 < 2)")(lambda t: ingest.products_to_reclassify(_versions(t), ["PROMO", "SMALL"], "2024-01-03 00:00:00"))
job("s8_applied_taxonomy", "SELECT product_id, CASE WHEN category IN ('PROMO', 'SMALL') THEN category ELSE 'Otros' END AS category, CASE category WHEN 'PROMO' THEN 'Ofertas' WHEN 'SMALL' THEN 'Chico' ELSE 'Otros' END AS section FROM demo_categories", "product_id, category, section")(
    lambda t: ingest.apply_taxonomy(t.categories.select("product_id", "category", "section"), t.spark.createDataFrame([("PROMO", "Ofertas"), ("SMALL", "Chico")], "category string, section string"))
)


def _seed(t: Tables) -> DataFrame:
    path = path_of(t, "seed")
    t.table("nation").select("n_nationkey", "n_name").write.csv(path, header=True)
    return ingest.read_seed(t.spark, path, "n_nationkey int, n_name string")


job("s9_seed", "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name FROM nation")(_seed)
_SOME_DAYS = "data_date IN (DATE '2024-01-02', DATE '2024-01-04', DATE '2024-01-06')"
job("s14_dates_at_risk", f"SELECT DISTINCT data_date FROM demo_prices WHERE NOT {_SOME_DAYS} UNION SELECT DATE '2024-01-08'")(lambda t: ingest.dates_at_risk(t.prices, t.prices.limit(1).select(F.lit("2024-01-08").cast("date").alias("data_date")), t.prices.filter(_SOME_DAYS)))
job("s16_lost_dates", f"SELECT DISTINCT data_date FROM demo_prices WHERE {_SOME_DAYS}")(lambda t: ingest.verify_loaded(t.prices.filter(f"NOT {_SOME_DAYS}"), t.prices))
job("s17_days_behind", "SELECT CAST(DATE '2024-01-12' - max(data_date) AS INTEGER) AS days_behind FROM demo_prices")(lambda t: ingest.days_behind(t.prices, "2024-01-12"))


def _change_log(t: Tables) -> DataFrame:
    """Store changes of two days; the second day is logged twice."""
    def changed(k: int) -> DataFrame:
        return t.stores.filter(f"CAST(store_id AS INT) % 5 = {k}").select(F.lit("stores").alias("dimension"), "store_id", F.lit("alta" if k else "baja").alias("change"))

    log = ingest.append_change_log(changed(0).filter("false").withColumn("data_date", F.lit(LAST_DAY).cast("date")), changed(0), "2024-01-06")
    for _ in range(2):
        log = ingest.append_change_log(log, changed(1), LAST_DAY)
    return ingest.change_counts(log)


job("s19_change_log", f"SELECT CASE WHEN s_suppkey % 5 = 0 THEN DATE '2024-01-06' ELSE DATE '{LAST_DAY}' END AS data_date, 'stores' AS dimension, CASE WHEN s_suppkey % 5 = 0 THEN 'baja' ELSE 'alta' END AS change, count(*) AS n FROM supplier WHERE s_suppkey % 5 < 2 GROUP BY ALL")(_change_log)


def _wins_twice(t: Tables) -> DataFrame:
    path = path_of(t, "wins")
    prices.who_wins_history(t.wins, [date(2024, 1, 2), date(2024, 1, 3)], path)
    return prices.who_wins_history(t.wins, [date(2024, 1, 3), date(2024, 1, 4)], path)


job("k17_who_wins_history", "SELECT * FROM wins WHERE data_date BETWEEN DATE '2024-01-02' AND DATE '2024-01-04'")(_wins_twice)

# Sizes and pieces

_UNITS = ("KG", "kgm", "GR", "Lt.", "L", "ML", "CM3", "CL", "UNI", "EA", "XX", "")
_SCALES = {"KG": ("g", 1000), "kgm": ("g", 1000), "GR": ("g", 1), "Lt.": ("cc", 1000), "L": ("cc", 1000), "ML": ("cc", 1), "CM3": ("cc", 1), "CL": ("cc", 10), "UNI": ("unidad", 1), "EA": ("unidad", 1)}


def _declared(t: Tables) -> DataFrame:
    unit = F.get(F.array(*map(F.lit, _UNITS)), (F.col("p_partkey") % len(_UNITS)).cast("int"))
    rows = t.table("part").select(F.col("p_partkey").alias("product_id"), F.concat(F.col("p_size").cast("string"), F.lit(",5")).alias("raw_qty"), unit.alias("raw_unit"))
    qty, unit = declared_size(F.col("raw_qty"), F.col("raw_unit"))
    return rows.select("product_id", qty.alias("qty"), unit.alias("unit"))


_BY_UNIT = lambda k: "CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN {_SCALES[u][k]!r}" for i, u in enumerate(_UNITS) if u in _SCALES) + " END"
job("f2_declared_sizes", f"SELECT p_partkey AS product_id, (p_size + CAST(0.5 AS DOUBLE)) * {_BY_UNIT(1)} AS qty, {_BY_UNIT(0)} AS unit FROM part")(_declared)
PIECES = (" X 12 UNIDADES", " MAPLE", " MEDIA DOCENA", " DOCENA", " X 6", " 24 U", "")


def _pieces(t: Tables) -> DataFrame:
    text = F.concat(F.regexp_replace(F.upper("p_name"), "[0-9]", ""), F.get(F.array(*map(F.lit, PIECES)), (F.col("p_partkey") % 7).cast("int")))
    rows = t.table("part").select(F.col("p_partkey").alias("product_id"), pieces_in_text(text).alias("pieces"), (F.col("p_partkey") % 2 == 0).alias("per_piece"))
    return rows.select("product_id", "pieces", effective_qty(F.lit(1.0), F.lit("unidad"), F.col("per_piece"), F.col("pieces")).alias("qty"))


COUNT_OF_PIECES = "CASE p_partkey % 7 WHEN 0 THEN 12 WHEN 1 THEN 30 WHEN 2 THEN 6 WHEN 3 THEN 12 WHEN 4 THEN 6 WHEN 5 THEN 24 END"
job("f4_pieces", f"SELECT p_partkey AS product_id, {COUNT_OF_PIECES} AS pieces, CASE WHEN p_partkey % 2 = 0 THEN CAST({COUNT_OF_PIECES} AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS qty FROM part")(_pieces)

# Places, zones and households


def polygons(t: Tables) -> DataFrame:
    """Seven stripes of two hundredths of a degree of longitude; they leave out the northern half."""
    stripe = lambda i: f"POLYGON (({x} -34.655, {x + 0.02} -34.655, {x + 0.02} -34.505, {x} -34.505, {x} -34.655))" if (x := -58.405 + 0.02 * i) else ""
    return t.spark.createDataFrame([(f"barrio {i}", stripe(i)) for i in range(7)], "neighbourhood string, wkt string")


job(
    "k4_store_neighbourhood",
    """
SELECT CAST(s_suppkey % 7 AS VARCHAR) AS company_id, CAST(s_suppkey AS VARCHAR) AS store_id, CASE WHEN s_suppkey % 20 < 10 THEN concat('barrio ', CAST((s_suppkey % 13) // 2 AS VARCHAR)) END AS neighbourhood
FROM supplier WHERE s_nationkey % 5 = 2""",
)(lambda t: dims.store_neighbourhood(t.stores, polygons(t)))
job(
    "k88_search_zones",
    """
SELECT n_nationkey AS query_id, rank, name AS zone FROM nation JOIN (
  SELECT *, row_number() OVER (PARTITION BY digit ORDER BY stores DESC, name, province) AS rank FROM (
    SELECT locality AS name, province, count(*) AS stores, CAST(right(locality, 1) AS INTEGER) AS digit FROM on_map GROUP BY ALL)) z ON z.digit = n_nationkey % 7 WHERE rank <= 5""",
)(
    lambda t: baskets.search_zones(
        t.table("nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("Loca "), (F.col("n_nationkey") % 7).cast("string")).alias("text")),
        t.on_map.groupBy(F.col("locality").alias("name"), "province").agg(F.count("*").alias("stores")).withColumn("aliases", F.array().cast("array<string>")),
    )
)


def _households(t: Tables) -> DataFrame:
    """A home for each customer: some ask for double of one category, some name an amount, some only that."""
    k = F.col("c_custkey")
    said = F.struct(F.lit("arroz").alias("category"), F.when(k % 3 == 0, F.lit(2.0)).alias("factor"), F.when(k % 3 == 1, F.lit(700.0)).alias("quantity"), F.lit("g").alias("unit"), F.lit("premium").alias("tier"), F.lit("said").alias("reason"))
    items = F.when(k % 3 < 2, F.array(said)).otherwise(F.array().cast("array<struct<category:string,factor:double,quantity:double,unit:string,tier:string,reason:string>>"))
    return t.table("customer").select(k.alias("household_id"), (k % 20 / 4).alias("adult_eq"), F.when(k % 2 == 0, "medio").otherwise("none").alias("tier"), F.when(k % 5 == 0, F.array(F.lit("leche"))).alias("remove"), (k % 7 == 0).alias("only_mentioned"), items.alias("items"))


_BASE = (("arroz", 500.0, "g"), ("leche", 1000.0, "cc"), ("huevos", 3.0, "unidad"))
_TAKEN = "(VALUES " + ", ".join(f"('{c}', CAST({q} AS DOUBLE), '{u}')" for c, q, u in _BASE) + ") b(category, q, unit)"
job(
    "k85_household_baskets",
    f"""
WITH h AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 20 / 4 BETWEEN 0.35 AND 15 THEN CAST(c_custkey % 20 / 4 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS a FROM customer)
SELECT k AS household_id, 'arroz' AS category, CASE WHEN k % 3 = 0 THEN round_even(500 * a * 2 / 10, 0) * 10 ELSE CAST(700 AS DOUBLE) END AS quantity, 'g' AS unit, 'premium' AS tier FROM h WHERE k % 3 < 2
UNION ALL SELECT k, category, CASE WHEN unit = 'unidad' THEN round_even(q * a, 0) ELSE round_even(q * a / 10, 0) * 10 END, unit, CASE WHEN k % 2 = 0 THEN 'medio' ELSE 'economico' END
FROM h, {_TAKEN} WHERE k % 7 <> 0 AND NOT (k % 5 = 0 AND category = 'leche') AND NOT (k % 3 < 2 AND category = 'arroz')""",
    "household_id, category, quantity, unit, tier",
)(lambda t: baskets.expand_household_baskets(_households(t), t.spark.createDataFrame([b[:2] for b in _BASE], "category string, quantity double"), t.spark.createDataFrame(list(_BASE), "category string, quantity double, unit string")))

# Checks that find something

job("q1_not_null", "SELECT store_id FROM (SELECT store_id, CASE WHEN CAST(store_id AS INTEGER) % 3 > 0 THEN name END AS n FROM demo_stores) WHERE n IS NULL", "store_id")(lambda t: checks.not_null(t.stores.withColumn("name", F.when(F.col("store_id").cast("int") % 3 > 0, F.col("name"))), "name", "lat"))
job("q1_accepted_values", "SELECT product_id, unit FROM tiers WHERE tier = 'premium'", "product_id, unit")(lambda t: checks.accepted_values(t.tiers, "tier", ["economico", "medio"]))
job("q1_expression_is_true", "SELECT product_id, chain, data_date FROM product_chain WHERE stores > 1 AND NOT min_price = max_price", "product_id, chain, data_date")(lambda t: checks.expression_is_true(t.product_chain, "min_price = max_price", "stores > 1"))
job("q3_capital_without_name", "SELECT CAST(s_suppkey AS VARCHAR) AS store_id FROM supplier WHERE s_nationkey % 5 = 2 AND (s_suppkey % 3 = 0 OR s_suppkey % 2 = 1)", "store_id")(
    lambda t: checks.capital_without_name(t.stores.withColumns({"locality": F.when(F.col("store_id").cast("int") % 3 == 0, "Capital Federal").otherwise(F.col("locality")), "neighbourhood": F.when(F.col("store_id").cast("int") % 2 == 0, F.lit("x"))}))
)
job("q6_foreign_markers", "SELECT category, count(*) FILTER ((category = 'PROMO' AND description LIKE '%red%') OR (category = 'SMALL' AND description LIKE '%blue%')) AS \"foreign\", count(*) AS products FROM demo_categories WHERE category IN ('PROMO', 'SMALL') GROUP BY category HAVING \"foreign\" > products * 0.02")(lambda t: checks.foreign_markers(t.categories, {"PROMO": "red", "SMALL": "blue"}))
job("q8_raw_behind", "SELECT max(data_date) AS latest, CAST(DATE '2024-01-12' - max(data_date) AS INTEGER) AS behind FROM demo_prices")(lambda t: checks.raw_behind(t.prices, "2024-01-12"))
job("q10_tiers_reversed", "SELECT category, unit, count(*) AS n FROM tiers GROUP BY ALL HAVING count(*) >= 3 AND avg(unit_price) FILTER (tier = 'economico') < avg(unit_price) FILTER (tier = 'premium')", "category, unit, n")(lambda t: checks.tiers_out_of_order(t.tiers.withColumn("unit_price", -F.col("unit_price")), 3))
job("q12_index_covers_too_little", "SELECT count(*) AS covered FROM (VALUES ('ECONOMY'), ('LARGE'), ('MEDIUM'), ('PROMO'), ('SMALL'), ('STANDARD')) b(category) WHERE category IN (SELECT category FROM wins) HAVING count(*) < 30")(lambda t: checks.index_covers_too_little(t.wins, t.basket))
job("q13_other_province", "SELECT CAST(s_suppkey AS VARCHAR) AS store_id FROM supplier WHERE s_suppkey % 4 = 0", "store_id")(lambda t: checks.locality_names_other_province(t.stores.withColumn("locality", F.when(F.col("store_id").cast("int") % 4 == 0, "Córdoba").otherwise(F.col("locality"))).withColumn("province", F.lit("AR-B"))))
job("q14_extremes_without_agreement", "SELECT product_id, chain FROM same_product a WHERE credible AND median_price IN (lowest, highest) AND NOT EXISTS (SELECT 1 FROM same_product o WHERE o.product_id = a.product_id AND o.chain <> a.chain AND abs(o.median_price - a.median_price) <= a.median_price * CAST(0.001 AS DOUBLE))", "product_id, chain")(
    lambda t: checks.extremes_not_credible(t.same.withColumn("in_range", F.lit(False)), Params(agreement_tolerance=0.001))
)
job("q16_market_promos_above", "SELECT product_id, store_id, discount_pct FROM valid WHERE evidence = 'mercado' AND discount_pct > 15", "product_id, store_id, discount_pct")(lambda t: checks.market_promos_above_verified(t.valid, promos.promo_calibration(t.evidence).withColumn("max_discount", F.lit(15.0))))
job("q16_unverified_above", "SELECT product_id, store_id, discount_pct FROM evidence WHERE product_id LIKE '%1' AND discount_pct > 20", "product_id, store_id, discount_pct")(lambda t: checks.unverified_promos_above(t.evidence.filter("product_id LIKE '%1'").withColumn("evidence", F.lit("sin_verificar")), Params(promo_max_unverified_pct=20)))
job("q16_verified_hidden", "SELECT product_id, store_id, promo_kind FROM evidence WHERE evidence = 'leyenda' AND discount_pct >= 10 AND (product_id, company_id, banner_id, store_id, promo_kind, data_date) NOT IN (SELECT (product_id, company_id, banner_id, store_id, promo_kind, data_date) FROM valid WHERE discount_pct < 20)", "product_id, store_id, promo_kind")(
    lambda t: checks.verified_promos_hidden(t.evidence, t.valid.filter("discount_pct < 20"))
)
job("q17_latest_date_invalid", f"SELECT f AS failed FROM (SELECT count(*) FILTER (data_date = DATE '{LAST_DAY}' AND CAST(product_id AS INTEGER) % 9 = 0) AS n FROM demo_prices), (VALUES ('null prices'), ('unknown units')) v(f) WHERE n > 0")(
    lambda t: checks.latest_date_invalid(t.prices.withColumns({"price": F.when(F.col("product_id").cast("int") % 9 > 0, F.col("price")), "unit": F.when(F.col("product_id").cast("int") % 9 > 0, F.col("unit")).otherwise("kg")}))
)
job("q18_units_unrecognised", "SELECT count(*) FILTER (p_partkey % 12 = 10) AS unrecognised, count(*) AS rows FROM part WHERE p_partkey % 12 <> 11")(lambda t: checks.units_unrecognised(t.table("part").select(F.lit("1").alias("declared_qty"), F.get(F.array(*map(F.lit, _UNITS)), (F.col("p_partkey") % len(_UNITS)).cast("int")).alias("declared_unit")), declared_size(F.col("declared_qty"), F.col("declared_unit"))[1]))

# Index over a history that also holds levels of few samples

_FEW = Params(min_samples_chain=1, min_market_companies=2)


def _history_of_few(t: Tables) -> DataFrame:
    return written(prices.chain_category_mart(prices.chain_category_levels(t.unit_prices, _FEW), t.factors), "history")


_FEW_PERIOD = "(SELECT min(base_date) AS s, max(data_date) AS e, count(*) AS n FROM (SELECT DISTINCT data_date, base_date FROM factors))"
_FEW_MARKET = f"""
(SELECT category, exp(sum(ln(f))) AS total, min(chains) AS chains FROM (
  SELECT m.category, m.data_date, exp(avg(ln(factor))) AS f, count(DISTINCT m.chain) AS chains FROM factors m LEFT JOIN demo_chains h ON h.chain = m.chain
  GROUP BY ALL HAVING count(DISTINCT coalesce(company_id, m.chain)) >= 2) GROUP BY category HAVING count(*) = (SELECT n FROM {_FEW_PERIOD}))"""
_FEW_SPENT = f"""
(SELECT b.category, 10 * level AS spending, total AS factor, chains FROM (VALUES ('ECONOMY'), ('LARGE'), ('MEDIUM'), ('PROMO'), ('SMALL'), ('STANDARD')) b(category)
 JOIN (SELECT category, quantile_disc(median_unit_price, 0.5) AS level FROM levels_of_few, {_FEW_PERIOD} WHERE data_date = s AND unit = 'g' GROUP BY category) USING (category) JOIN {_FEW_MARKET} k USING (category))"""
job(
    "k53_contributions_of_few",
    f"SELECT category, round(spending / w * 100, 6) AS weight_pct, round((factor - 1) * 100, 6) AS change_pct, round(spending / w * (factor - 1) * 100, 6) AS contribution_pp, chains FROM {_FEW_SPENT}, (SELECT sum(spending) AS w FROM {_FEW_SPENT})",
    rounded=("weight_pct", "change_pct", "contribution_pp"),
)(lambda t: index.contributions(index.basket_spending(_history_of_few(t), t.chains, t.basket, "2024-01", _FEW))[0])
job("k86_localities_with_prices", "SELECT locality, province, count(DISTINCT category) AS categories FROM locality_prices GROUP BY ALL")(lambda t: baskets.quotable_localities(t.locality_prices, 1))

# Jobs whose twins compare whole groups

_PAIRS = """
(SELECT a.chain, b.chain AS sibling, a.median_price / b.median_price AS ratio FROM same_product a JOIN demo_chains x ON x.chain = a.chain JOIN demo_chains y ON y.company_id = x.company_id AND y.chain <> x.chain
 JOIN same_product b ON b.product_id = a.product_id AND b.chain = y.chain WHERE a.credible AND b.credible AND a.median_price > 0 AND b.median_price > 0)"""
job(
    "k66_sibling_price_rules",
    f"""
SELECT r.chain, r.sibling, products, pct_cheaper, pct_equal, pct_dearer, coalesce(steps, '') AS steps FROM (
  SELECT *, row_number() OVER (PARTITION BY chain ORDER BY products DESC, sibling) AS n FROM (
    SELECT chain, sibling, count(*) AS products, round(count(*) FILTER (ratio < CAST(0.997 AS DOUBLE)) / count(*) * 100, 1) AS pct_cheaper, round(count(*) FILTER (abs(ratio - 1) <= CAST(0.003 AS DOUBLE)) / count(*) * 100, 1) AS pct_equal,
           round(count(*) FILTER (ratio > CAST(1.003 AS DOUBLE)) / count(*) * 100, 1) AS pct_dearer FROM {_PAIRS} GROUP BY ALL HAVING count(*) >= 5)) r
LEFT JOIN (SELECT chain, sibling, string_agg(concat(discount, ':', round(k / every * 100, 1)), ',' ORDER BY i) AS steps FROM (
  SELECT *, row_number() OVER (PARTITION BY chain, sibling ORDER BY k DESC, discount) AS i FROM (SELECT chain, sibling, CAST(round((1 - ratio) * 100) AS INTEGER) AS discount, count(*) AS k FROM {_PAIRS} WHERE ratio < CAST(0.997 AS DOUBLE) GROUP BY ALL)
  JOIN (SELECT chain, sibling, count(*) AS every FROM {_PAIRS} GROUP BY ALL) USING (chain, sibling)) WHERE i <= 3 GROUP BY chain, sibling) s ON s.chain = r.chain AND s.sibling = r.sibling WHERE n = 1""",
)(lambda t: catalog.sibling_price_rules(t.same, t.chains, t.chains.select("chain"), Params(min_rule_products=5), 0, 100).withColumn("steps", F.expr("coalesce(array_join(transform(steps, x -> concat(x.discount, ':', x.pct)), ','), '')")))
_LIST_PRICES = "(SELECT list_id, product_id, quantity, chain, median_price FROM lists JOIN same_product USING (product_id) WHERE credible AND format = 'supermercado')"
job(
    "k38_list_total_with_promos",
    f"""
SELECT list_id, chain, store_key, round(km, 2) AS distance_km, total_with_promos, total_list, items_on_promo, valid_until FROM (
  SELECT *, row_number() OVER (PARTITION BY list_id, chain ORDER BY total_with_promos, km, store_key) AS n FROM (
    SELECT w.list_id, w.chain, s.store_key, s.km, total_list, CAST(round(sum(CAST(CASE WHEN o.price < p.median_price THEN o.price ELSE p.median_price END * p.quantity AS DECIMAL(24,6))), 2) AS DOUBLE) AS total_with_promos,
           count(*) FILTER (o.price < p.median_price) AS items_on_promo, min(CASE WHEN o.price < p.median_price THEN o.until END) AS valid_until
    FROM (SELECT list_id, chain, CAST(round(sum(CAST(median_price * quantity AS DECIMAL(24,6))), 2) AS DOUBLE) AS total_list FROM {_LIST_PRICES} JOIN (SELECT list_id, count(*) AS items FROM lists GROUP BY list_id) USING (list_id) GROUP BY list_id, chain, items HAVING count(*) = items) w
    JOIN (SELECT *, sqrt(pow((lon - CAST(-58.35 AS DOUBLE)) * CAST(111 AS DOUBLE) * cos(radians((lat - CAST(34.55 AS DOUBLE)) / 2)), 2) + pow((lat + CAST(34.55 AS DOUBLE)) * CAST(111 AS DOUBLE), 2)) AS km FROM on_map) s ON s.chain = w.chain AND s.km <= 3
    JOIN {_LIST_PRICES} p ON p.list_id = w.list_id AND p.chain = w.chain
    LEFT JOIN (SELECT product_id, store_key, first(promo_price ORDER BY promo_price, until NULLS FIRST) AS price, first(until ORDER BY promo_price, until NULLS FIRST) AS until FROM (
      SELECT product_id, unnest(string_split(stores, ',')) AS store_key, promo_price, CASE WHEN legend LIKE '%al 18/01/2024%' THEN '2024-01-18' WHEN legend LIKE '%hasta 2024-01-20%' THEN '2024-01-20' END AS until FROM promos_mapped WHERE NOT multi_buy)
      GROUP BY product_id, store_key) o ON o.product_id = p.product_id AND o.store_key = s.store_key GROUP BY ALL)) WHERE n = 1""",
)(lambda t: promos.list_total_with_promos(t.lists, t.same, t.promos_mapped, t.on_map, t.lists.select("list_id").distinct().select("list_id", F.lit(-34.55).alias("lat"), F.lit(-58.35).alias("lon")), "2024-01-10"))
_TIER_PRICE = "(SELECT chain, category, tier AS use_tier, unit, quantile_cont(median_unit_price, 0.5) AS price FROM store_prices GROUP BY ALL)"
_ASKED = "(SELECT DISTINCT basket_id, category, b.tier, unit, CAST(100 AS DOUBLE) AS quantity FROM tiers CROSS JOIN (VALUES ('0', 'economico'), ('1', 'medio'), ('2', 'premium')) b(basket_id, tier))"
_CHOICES = "(VALUES ('economico', 'economico', 0), ('economico', 'medio', 1), ('medio', 'medio', 0), ('medio', 'premium', 1), ('medio', 'economico', 2), ('premium', 'premium', 0), ('premium', 'medio', 2)) c(tier, use_tier, choice)"
_FOUND = f"(SELECT * FROM (SELECT a.*, p.chain, p.price, p.use_tier <> a.tier AS other, row_number() OVER (PARTITION BY basket_id, a.category, a.unit, a.tier, p.chain ORDER BY choice) AS n FROM {_ASKED} a JOIN {_CHOICES} ON c.tier = a.tier JOIN {_TIER_PRICE} p ON p.category = a.category AND p.unit = a.unit AND p.use_tier = c.use_tier) WHERE n = 1)"
_KEPT = f"(SELECT * FROM (SELECT *, quantile_cont(price, 0.5) OVER w AS m, count(*) OVER w AS k FROM {_FOUND} WINDOW w AS (PARTITION BY basket_id, category, unit, tier)) WHERE k < 3 OR price BETWEEN m / 2 AND m * 2)"
_ENTER = f"(SELECT basket_id, chain FROM {_KEPT} JOIN (SELECT basket_id, count(*) AS items FROM {_ASKED} GROUP BY basket_id) USING (basket_id) GROUP BY basket_id, chain, items HAVING count(*) >= items * CAST(0.1 AS DOUBLE))"
_ROWS = f"(SELECT *, quantile_cont(price, 0.5) OVER w AS reference, count(*) OVER w AS have FROM {_KEPT} JOIN {_ENTER} USING (basket_id, chain) WINDOW w AS (PARTITION BY basket_id, category, unit, tier))"
_COMMON = f"(SELECT * FROM {_ROWS} JOIN (SELECT basket_id, count(*) AS chains FROM {_ENTER} GROUP BY basket_id) USING (basket_id) WHERE have = chains)"
_LEVELS = "(SELECT chain, category, exp(avg(ln(median_price / reference))) AS level FROM same_product WHERE reference > 0 AND companies >= 2 AND credible AND median_price > 0 GROUP BY GROUPING SETS ((chain, category), (chain)) HAVING count(*) >= 5)"
job(
    "k83_basket_by_chain",
    f"""
SELECT basket_id, r.chain, CAST(round(sum(CAST(coalesce(reference * coalesce(l.level, g.level), price) * quantity AS DECIMAL(24,6))), 2) AS DOUBLE) AS total, count(*) FILTER (other) AS other_tier, count(*) FILTER (l.level IS NULL AND g.level IS NOT NULL) AS general_level,
       count(*) FILTER (l.level IS NULL AND g.level IS NULL) AS own_price, min(stores) AS stores, string_agg(DISTINCT r.category, ',' ORDER BY r.category) AS compared
FROM {_COMMON} r LEFT JOIN {_LEVELS} l ON l.chain = r.chain AND l.category = r.category LEFT JOIN (SELECT * FROM {_LEVELS} WHERE category IS NULL) g ON g.chain = r.chain
JOIN (SELECT chain, count(DISTINCT (company_id, store_id)) AS stores FROM store_prices GROUP BY chain) s ON s.chain = r.chain GROUP BY basket_id, r.chain""",
)(lambda t: baskets.basket_by_chain(baskets_of(t), t.store_prices, catalog.chain_price_levels(t.same), 0.1, 1))
