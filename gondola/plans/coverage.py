"""Registered queries for branches that the other queries don't reach; and all queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.operators import dims, prices, promos
from gondola.params import Params
from gondola.plans.demo import LAST_DAY
from gondola.plans.feeds import COUNT_OF_PIECES, ORACLES, PIECES, QUERIES, path_of, polygons
from gondola.plans.registry import Tables, job
from gondola.sources import ingest

__all__ = ["ORACLES", "QUERIES"]


def _raw_stores(t: Tables) -> DataFrame:
    """Every third store has no id, every fourth no readable latitude."""
    k = F.col("s_suppkey")
    return t.table("supplier").select(F.when(k % 3 > 0, k.cast("string")).alias("store_id"), F.when(k % 4 > 0, F.concat(F.lit("-"), (k % 20).cast("string"), F.lit(".5"))).otherwise("x").alias("lat"), F.lit("-58.25").alias("lon"), F.col("s_name").alias("name"))


job("p2_clean_stores", "SELECT CAST(s_suppkey AS VARCHAR) AS store_id, CASE WHEN s_suppkey % 4 > 0 THEN -(s_suppkey % 20 + CAST(0.5 AS DOUBLE)) END AS lat, CAST(-58.25 AS DOUBLE) AS lon, s_name AS name FROM supplier WHERE s_suppkey % 3 > 0")(lambda t: dims.clean_stores(_raw_stores(t)))
_NAMED = ("Capital Federal", "CÓRDOBA", "Buenos Aires", "Tucumán", "Localidad", "caba")
job("x3_named_provinces", "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'AR-C' WHEN 1 THEN 'AR-X' WHEN 2 THEN 'AR-B' WHEN 3 THEN 'AR-T' WHEN 5 THEN 'AR-C' END AS province FROM supplier")(
    lambda t: t.table("supplier").select("s_suppkey", dims.named_province(F.get(F.array(*map(F.lit, _NAMED)), (F.col("s_suppkey") % 6).cast("int"))).alias("province"))
)
job("f21_store_address", "SELECT store_id, nullif(trim(concat_ws(' ', CASE WHEN CAST(store_id AS INTEGER) % 3 > 0 THEN street END, CASE WHEN CAST(store_id AS INTEGER) % 4 > 0 THEN number END)), '') AS address FROM demo_stores")(
    lambda t: t.stores.select("store_id", dims.store_address(F.when(F.col("store_id").cast("int") % 3 > 0, F.col("street")), F.when(F.col("store_id").cast("int") % 4 > 0, F.col("number")).otherwise("")).alias("address"))
)


def _polygons_file(t: Tables) -> DataFrame:
    path = path_of(t, "polygons")
    t.table("nation").select(F.col("n_name").alias("neighbourhood"), F.col("n_regionkey").alias("district"), F.concat(F.lit('POLYGON ((0 0, 1 0, 1 "'), F.col("n_nationkey").cast("string"), F.lit('", 0 0))')).alias("wkt")).write.csv(path, header=True, quote='"', escape='"')
    return ingest.read_polygons(t.spark, path)


job("s9_polygons", "SELECT n_name AS neighbourhood, CAST(n_regionkey AS INTEGER) AS district, concat('POLYGON ((0 0, 1 0, 1 \"', n_nationkey, '\", 0 0))') AS wkt FROM nation")(_polygons_file)


def _raw_prices(t: Tables) -> DataFrame:
    """Prices as text, some unreadable, some of 1 and less."""
    k = F.col("p_partkey")
    price = F.when(k % 5 == 0, "x").when(k % 5 == 1, "1").when(k % 5 == 2, "0.99").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5")))
    ids = {"company_id": k % 7, "banner_id": k % 14, "store_id": k % 30, "product_id": k}
    return t.table("part").select(*(c.cast("string").alias(name) for name, c in ids.items()), price.alias("list_price"), F.lit(LAST_DAY).cast("date").alias("data_date"), F.lit("2,5").alias("declared_qty"), F.lit("kg.").alias("declared_unit"), F.col("p_name").alias("description"))


job(
    "k1_stage_prices",
    f"""
SELECT CAST(p_partkey % 7 AS VARCHAR) AS company_id, CAST(p_partkey % 14 AS VARCHAR) AS banner_id, CAST(p_partkey % 30 AS VARCHAR) AS store_id, CAST(p_partkey AS VARCHAR) AS product_id, p_size + CAST(0.5 AS DOUBLE) AS price,
       DATE '{LAST_DAY}' AS data_date, CAST(2500 AS DOUBLE) AS qty, 'g' AS unit FROM part WHERE p_partkey % 5 > 2""",
)(lambda t: prices.stage_prices(_raw_prices(t)))

_BY_PIECE = Params(per_piece_categories=("PROMO", "SMALL"))


def _pieces_in_names(t: Tables) -> DataFrame:
    text = F.concat(F.regexp_replace(F.upper("description"), "[0-9]", ""), F.get(F.array(*map(F.lit, PIECES)), (F.col("product_id").cast("int") % 7)))
    return t.categories.withColumn("description", text)


job(
    "k11_tiers_by_piece",
    f"""
SELECT *, CASE ntile(3) OVER (PARTITION BY category, unit ORDER BY unit_price, product_id) WHEN 1 THEN 'economico' WHEN 2 THEN 'medio' ELSE 'premium' END AS tier FROM (
  SELECT product_id, category, section, quantile_disc(price, 0.5) AS median_price, quantile_disc(price / q, 0.5) AS unit_price, unit, per_piece, pieces FROM (
    SELECT p.product_id, c.category, c.section, price, unit, per_piece, pieces, CASE WHEN unit <> 'unidad' THEN qty WHEN per_piece THEN CAST(pieces AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS q
    FROM demo_prices p JOIN demo_categories c ON c.product_id = p.product_id
    JOIN (SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey % 40 > 0 AND p_type IN ('PROMO', 'SMALL') AS per_piece, CASE WHEN p_partkey % 40 > 0 AND p_type IN ('PROMO', 'SMALL') THEN {COUNT_OF_PIECES} END AS pieces FROM part) ON id = p.product_id)
  WHERE category <> 'Otros' AND ((unit IN ('g', 'cc') AND q BETWEEN 5 AND 10000) OR (unit = 'unidad' AND q BETWEEN CASE WHEN per_piece THEN 3 ELSE 1 END AND 200)) GROUP BY ALL)""",
)(lambda t: prices.product_tiers(t.prices.withColumn("qty", F.when(F.col("unit") == "unidad", F.lit(1.0)).otherwise(F.col("qty"))), _pieces_in_names(t), _BY_PIECE))
job(
    "k35_filtered_listing",
    """
SELECT product_id, description, brand, category, section, chain, list_price, promo_price, discount_pct, legend, evidence, 'AR-B' AS province, CAST(1 AS BIGINT) AS provinces, CAST(sum(stores) AS BIGINT) AS stores
FROM promos_now WHERE category = 'PROMO' AND chain = 'chain_3' AND province = 'AR-B' GROUP BY ALL ORDER BY discount_pct DESC, product_id, chain, list_price, promo_price, legend NULLS FIRST LIMIT 30""",
)(lambda t: promos.promo_listing(t.promos_now, 30, "PROMO", "chain_3", "AR-B"))
_HOOD = "(SELECT CAST(s_suppkey AS VARCHAR) AS store_id, concat('barrio ', CAST((s_suppkey % 13) // 2 AS VARCHAR)) AS barrio FROM supplier WHERE s_nationkey % 5 = 2 AND s_suppkey % 20 < 10)"
_KM = "2 * CAST(6371.0088 AS DOUBLE) * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))"
_FIXED = f"""
(SELECT a.store_id, barrio, coalesce(barrio, a.locality) AS locality, CASE WHEN barrio IS NOT NULL OR near IS NULL THEN a.province ELSE near END AS province
 FROM demo_stores a LEFT JOIN {_HOOD} h ON h.store_id = a.store_id LEFT JOIN (
   SELECT a.store_id, first(b.province ORDER BY round({_KM}, 9), b.province, b.locality) AS near FROM demo_stores a JOIN demo_stores b ON a.province = 'AR-C' AND b.province <> 'AR-C' AND {_KM} <= 50 GROUP BY a.store_id) n ON n.store_id = a.store_id)"""
job(
    "k5_stores_in_polygons",
    f"""
SELECT s.company_id, s.banner_id, s.store_id, s.name, s.type, s.street, s.number, x.barrio AS neighbourhood, f.spelling AS locality, x.province, s.postcode, s.lat, s.lon FROM demo_stores s JOIN {_FIXED} x ON x.store_id = s.store_id
JOIN (SELECT province, lower(locality) AS k, first(locality ORDER BY n DESC, locality) AS spelling FROM (SELECT province, locality, count(*) AS n FROM {_FIXED} GROUP BY ALL) GROUP BY ALL) f ON f.k = lower(x.locality) AND f.province = x.province""",
)(lambda t: dims.store_dimension(t.stores, dims.store_neighbourhood(t.stores, polygons(t))))
