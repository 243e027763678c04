"""All price queries over the projected tables, and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gondola.functions import text
from gondola.functions.geo import haversine_km
from gondola.operators import baskets, catalog, checks, dims, index, price_state, prices, promos
from gondola.params import Params
from gondola.plans.demo import LAST_DAY, view
from gondola.plans.sqltwins import twin
from gondola.sources import ingest
from gondola.sources.work import shared, work_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The projected views of one folder and the jobs built on them, each made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = JOBS[name](self) if name in JOBS else view(self.spark, self.sf_dir, f"demo_{name}")
        return self._made[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def _day_pairs(t: Tables) -> DataFrame:
    days = ingest.dates_of(t.prices)
    return ingest.pairs_frame(t.spark, ingest.date_pairs(days, days))


JOBS: dict[str, Callable[[Tables], DataFrame]] = {
    "product_chain": lambda t: prices.product_chain_prices(t.prices, t.chains),
    "tiers": lambda t: shared(("tiers", t.sf_dir), lambda: prices.product_tiers(t.prices, t.categories), "tiers"),
    "unit_prices": lambda t: prices.unit_prices(t.prices, t.categories, t.tiers, t.chains),
    "levels": lambda t: prices.chain_category_levels(t.unit_prices),
    "pairs": _day_pairs,
    "factors": lambda t: prices.paired_price_index(t.unit_prices, t.pairs),
    "mart": lambda t: prices.chain_category_mart(t.levels, t.factors),
    "history": lambda t: shared(("history", t.sf_dir), lambda: t.mart, "history"),
    "wins": lambda t: prices.who_wins(t.product_chain, t.categories),
    "same_rows": lambda t: prices.same_product(t.product_chain, t.categories, None, LAST_DAY),
    # Most jobs read the same-product table several times, in branches that differ too much for Spark to share.
    "same": lambda t: shared(("same", t.sf_dir), lambda: t.same_rows, "same"),
    "locality_prices": lambda t: prices.category_locality_prices(t.prices, t.categories, t.tiers, t.stores, t.chains, LAST_DAY),
    "store_rows": lambda t: prices.category_store_prices(t.prices, t.categories, t.tiers, t.stores, t.chains, LAST_DAY),
    "store_prices": lambda t: shared(("store_prices", t.sf_dir), lambda: t.store_rows, "store_prices"),
    "evidence": lambda t: promos.promo_evidence(t.promos, LAST_DAY),
    "valid": lambda t: promos.valid_promos(t.evidence),
    "promos_now": lambda t: promos.current_promos(t.valid, t.categories, t.stores, t.chains),
    "on_map": lambda t: dims.map_stores(t.stores, t.chains),
    "promos_mapped": lambda t: promos.map_promos(t.valid, t.on_map, t.categories),
    "summary": lambda t: catalog.product_summary(t.same),
    "zone_chains": lambda t: shared(("zone_chains", t.sf_dir), lambda: t.on_map.select(F.col("locality").alias("zone_id"), "chain").distinct(), "zones"),
    # An order may name a product twice; the jobs on lists take the largest quantity.
    "lists": lambda t: t.table("lineitem").select(F.col("l_orderkey").alias("list_id"), F.col("l_partkey").cast("string").alias("product_id"), F.col("l_quantity").cast("int").alias("quantity")),
    "basket": lambda t: t.spark.createDataFrame([(c, 10.0, u) for c in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD") for u in ("g",)], "category string, quantity double, unit string"),
    "points": lambda t: t.table("supplier").select(F.col("s_suppkey").cast("string").alias("basket_id"), (F.lit(-34.6) + (F.col("s_suppkey") % 9) * 0.01).alias("lat"), (F.lit(-58.4) + (F.col("s_suppkey") % 7) * 0.01).alias("lon"), F.lit(3).alias("max_stores")),
}


def _flat(df: DataFrame) -> DataFrame:
    """Arrays of text as text, so that both engines show them alike."""
    return df.withColumns({f.name: F.array_join(f.name, ",") for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType)})


def job(name: str, sql: str | None, columns: str = "*", rounded: tuple[str, ...] = ()):
    """Register a job on Tables under a name, with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = _flat(f(Tables(spark, sf_dir)))
            out = out.withColumns({c: F.round(c, 6) for c in rounded})
            return out if columns == "*" else out.selectExpr(*columns.split(", "))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = twin(sql)
        return f

    return add


# Prices

job("k10_product_chain_prices", "SELECT * FROM product_chain")(lambda t: t.product_chain)
job("k11_product_tiers", "SELECT product_id, category, section, median_price, unit_price, unit, tier FROM tiers", "product_id, category, section, median_price, unit_price, unit, tier")(lambda t: t.tiers)
job("k12_chain_category_levels", "SELECT * FROM levels")(lambda t: t.levels)
job("k13_paired_price_index", "SELECT category, chain, unit, data_date, base_date, round(factor, 6) AS factor, paired_products FROM factors", rounded=("factor",))(lambda t: t.factors)
job("k14_chain_category_mart", "SELECT category, chain, unit, data_date, median_unit_price, samples, base_date, round(factor, 6) AS factor, paired_products FROM mart", rounded=("factor",))(lambda t: t.mart)
job(
    "k15_index_history_update",
    "SELECT category, chain, unit, data_date, median_unit_price, samples, base_date, round(factor, 6) AS factor, paired_products FROM mart WHERE data_date IN (SELECT data_date FROM mart WHERE factor IS NOT NULL) OR data_date > DATE '2024-01-03'",
    rounded=("factor",),
)(lambda t: prices.index_history_update(t.history, t.history.filter("data_date <= '2024-01-03'")))
job("k16_who_wins", "SELECT * FROM wins")(lambda t: t.wins)
job(
    "k18_same_product",
    "SELECT * REPLACE (round(reference, 6) AS reference) FROM same_product",
    rounded=("reference",),
)(lambda t: t.same_rows)
job(
    "k19_product_names",
    f"""
SELECT product_id, description, brand, search_text FROM (
  SELECT n.product_id, first(n.description ORDER BY NOT contains(upper(n.description), coalesce(b.brand, '')), NOT regexp_matches(n.description, '[0-9]'), length(n.description) > 45, length(n.description), n.description) AS description,
         min(b.brand) AS brand, substr(string_agg(DISTINCT lower(concat(n.description, ' ', coalesce(n.brand, ''))), ' ' ORDER BY lower(concat(n.description, ' ', coalesce(n.brand, '')))), 1, 1500) AS search_text
  FROM (SELECT DISTINCT product_id, company_id, trim(description) AS description, upper(trim(brand)) AS brand FROM demo_promos WHERE data_date = DATE '{LAST_DAY}') n
  LEFT JOIN (SELECT product_id, min(upper(trim(brand))) AS brand FROM demo_promos WHERE data_date = DATE '{LAST_DAY}' GROUP BY product_id) b USING (product_id) GROUP BY n.product_id)""",
)(lambda t: prices.product_names(t.promos, t.prices.select("product_id"), LAST_DAY))
job("k22_category_locality_prices", "SELECT * FROM locality_prices")(lambda t: t.locality_prices)
job("k23_category_store_prices", "SELECT * FROM store_prices")(lambda t: t.store_rows)


def _stored(t: Tables) -> DataFrame:
    """A price history: each product's and chain's price of every second day."""
    return t.product_chain.filter("data_date IN (DATE '2024-01-02', DATE '2024-01-04', DATE '2024-01-06')").select("data_date", F.col("data_date").alias("price_date"), "product_id", "chain", (F.col("median_price") * F.lit(0.9)).alias("price"))


_STORED = "(SELECT data_date, data_date AS price_date, product_id, chain, median_price * CAST(0.9 AS DOUBLE) AS price FROM product_chain WHERE data_date IN (DATE '2024-01-02', DATE '2024-01-04', DATE '2024-01-06'))"
_K20 = f"""
SELECT s.data_date, s.price_date, s.product_id, s.chain, s.median_price AS price FROM same_product s
LEFT JOIN (SELECT product_id, chain, max_by(price, data_date) AS last FROM {_STORED} WHERE data_date < DATE '{LAST_DAY}' GROUP BY ALL) h USING (product_id, chain)
WHERE credible AND (last IS NULL OR abs(s.median_price - last) > CAST(0.005 AS DOUBLE))"""
job("k20_price_history_update", _K20)(lambda t: prices.price_history_update(t.same_rows, _stored(t), LAST_DAY))


def _from_state(t: Tables) -> DataFrame:
    """The state as of the day before, made from the history once; then the last day in one step, twice: a replay is the same."""
    root = f"{work_dir(t.spark)}/price-state-{uuid.uuid4().hex}"
    price_state.rebuild_price_state(_stored(t), root, date(2024, 1, 6))
    for _ in range(2):
        changes = price_state.advance_price_state(prices.credible_today(t.same), root, LAST_DAY)
    return changes


job("k20_from_state", _K20)(_from_state)


def _stored_with_today(t: Tables) -> DataFrame:
    today = t.same.filter("credible").select("data_date", "price_date", "product_id", "chain", F.col("median_price").alias("price"))
    return _stored(t).unionByName(today)


job(
    "k21_recent_price_changes",
    f"""
SELECT h.product_id, h.chain, h.price, h.prev AS previous_price, h.price_date AS change_date, round((h.price / h.prev - 1) * 100, 1) AS change_pct
FROM (SELECT *, row_number() OVER w AS n, lead(price) OVER w AS prev FROM (SELECT * FROM {_STORED} UNION ALL BY NAME SELECT data_date, price_date, product_id, chain, median_price AS price FROM same_product WHERE credible)
      WINDOW w AS (PARTITION BY product_id, chain ORDER BY data_date DESC)) h
JOIN same_product a USING (product_id, chain)
WHERE a.credible AND h.n = 1 AND h.prev > 0 AND abs(a.median_price - h.price) <= CAST(0.005 AS DOUBLE) AND h.price_date >= a.data_date - 30 AND abs(h.price / h.prev - 1) * 100 >= 3""",
)(lambda t: prices.recent_price_changes(_stored_with_today(t), t.same))

# Dimensions

job("k2_current_categories", "SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS description, p_brand AS brand, CASE WHEN p_partkey % 3 = 0 THEN 'old' ELSE p_type END AS category, 's' AS section FROM part")(
    lambda t: prices.current_categories(
        t.table("part").select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("description"), F.col("p_brand").alias("brand"), F.explode(F.array(F.struct(F.lit("old").alias("category"), F.lit(None).cast("timestamp").alias("classified_at")), F.struct(F.col("p_type").alias("category"), F.when(F.col("p_partkey") % 3 != 0, F.lit("2024-01-01").cast("timestamp")).alias("classified_at")))).alias("v")).select("product_id", "description", "brand", F.when(F.col("v.classified_at").isNull() & (F.col("v.category") != "old"), "zz").otherwise(F.col("v.category")).alias("category"), F.lit("s").alias("section"), "v.classified_at")
    )
)
job(
    "k3_company_dimension",
    """
SELECT company_id, banner_id, company_id AS tax_id, 'x' AS legal_name, concat(' banner ', banner_id) AS banner_name,
       CASE WHEN format = 'farmacia' THEN concat('banner ', banner_id) ELSE chain END AS chain, 'supermercado' AS format, CASE WHEN format = 'farmacia' THEN true ELSE reports_daily END AS reports_daily FROM demo_chains""",
)(lambda t: dims.company_dimension(t.chains.select("company_id", "banner_id", F.col("company_id").alias("tax_id"), F.lit("x").alias("legal_name"), F.concat(F.lit(" banner "), F.col("banner_id")).alias("banner_name")), t.chains.filter("format <> 'farmacia'")))
job(
    "k5_store_dimension",
    """
SELECT s.company_id, s.banner_id, s.store_id, s.name, s.type, s.street, s.number, s.neighbourhood, f.spelling AS locality, f.province, s.postcode, s.lat, s.lon FROM demo_stores s
JOIN (SELECT province, lower(locality) AS k, first(locality ORDER BY n DESC, locality) AS spelling FROM (SELECT province, locality, count(*) AS n FROM fixed GROUP BY ALL) GROUP BY ALL) f
  ON f.k = lower(s.locality) AND f.province = (SELECT province FROM fixed x WHERE x.store_id = s.store_id)""".replace(
        "FROM fixed",
        """FROM (SELECT a.store_id, a.locality, CASE WHEN a.province <> 'AR-C' THEN a.province ELSE coalesce((SELECT first(b.province ORDER BY round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))), 9), b.province, b.locality) FROM demo_stores b WHERE b.province <> 'AR-C'), a.province) END AS province FROM demo_stores a)""",
    ),
)(lambda t: dims.store_dimension(t.stores, t.stores.select("company_id", "store_id", "neighbourhood")))
job(
    "k6_snapshot_diff",
    """
SELECT 'stores' AS dimension, store_id, name, CASE WHEN s_suppkey % 5 = 0 THEN 'alta' WHEN s_suppkey % 5 = 1 THEN 'baja' ELSE 'modificacion' END AS change
FROM (SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS store_id, s_name AS name FROM supplier) WHERE s_suppkey % 5 IN (0, 1, 2)""",
)(
    lambda t: dims.snapshot_diff(
        t.stores.filter("CAST(store_id AS INT) % 5 <> 1").withColumn("type", F.when(F.col("store_id").cast("int") % 5 == 2, F.lit(None).cast("string")).otherwise(F.col("type"))),
        t.stores.filter("CAST(store_id AS INT) % 5 <> 0"), ["store_id"], ["name", "type"], "stores",
    )
)
job("k7_map_stores", "SELECT * FROM on_map")(lambda t: t.on_map)

# Promotions

_EVIDENCE = "company_id, banner_id, store_id, product_id, data_date, description, brand, list_price, promo_price, legend, promo_kind, discount_pct, declared_pct, multi_buy, market_reference, evidence, market_ratio"
job("k30_promo_evidence", f"SELECT {_EVIDENCE} FROM evidence", _EVIDENCE)(lambda t: t.evidence)
job("k31_valid_promos", f"SELECT {_EVIDENCE} FROM valid", _EVIDENCE)(lambda t: t.valid)
job(
    "k32_promo_calibration",
    """
SELECT data_date, count(*) FILTER (evidence = 'leyenda') AS verified, count(market_ratio) FILTER (evidence = 'leyenda') AS verified_with_market,
       quantile_disc(CASE WHEN evidence = 'leyenda' THEN market_ratio END, CAST(0.001 AS DOUBLE)) AS ratio_p001, quantile_disc(CASE WHEN evidence = 'leyenda' THEN discount_pct END, CAST(0.999 AS DOUBLE)) AS discount_p999,
       max(discount_pct) FILTER (evidence = 'leyenda') AS max_discount FROM evidence GROUP BY data_date""",
)(lambda t: promos.promo_calibration(t.evidence))
job("k33_current_promos", "SELECT * FROM promos_now")(lambda t: t.promos_now)
job("k34_map_promos", "SELECT * FROM promos_mapped")(lambda t: t.promos_mapped)
job(
    "k35_promo_listing",
    """
SELECT product_id, description, brand, category, section, chain, list_price, promo_price, discount_pct, legend, evidence, province, provinces, stores FROM (
  SELECT product_id, description, brand, category, section, chain, list_price, promo_price, discount_pct, legend, evidence, first(province ORDER BY stores DESC, province DESC) AS province,
         count(DISTINCT province) AS provinces, CAST(sum(stores) AS BIGINT) AS stores FROM promos_now GROUP BY ALL)
ORDER BY discount_pct DESC, product_id, chain, list_price, promo_price, legend NULLS FIRST LIMIT 50""",
)(lambda t: promos.promo_listing(t.promos_now, 50))
job(
    "k39_promos_per_store",
    """
SELECT chain, sum(coalesce(n, 0)) / count(*) AS promos_per_store, sum(coalesce(n, 0)) / count(*) < 50 AS rarely_reports
FROM on_map LEFT JOIN (SELECT store_key, count(*) AS n FROM (SELECT unnest(string_split(stores, ',')) AS store_key FROM promos_mapped) GROUP BY store_key) USING (store_key) GROUP BY chain""",
)(lambda t: promos.promos_per_store(t.promos_mapped, t.on_map))


def _boxes(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(1, -34.6, -34.5, None, None, None, None), (2, None, None, -58.4, -58.36, "AR-A", None), (3, -34.6, -34.4, -58.4, -58.3, None, "red")], "box_id int, south double, north double, west double, east double, province string, text string")


job(
    "k36_promos_in_box",
    """
SELECT * EXCLUDE (r) FROM (SELECT *, count(*) OVER (PARTITION BY box_id) > 100 AS has_more, row_number() OVER (PARTITION BY box_id ORDER BY discount_pct DESC, promo_price, description, product_id, list_price, legend NULLS FIRST, promo_kind) AS r FROM (
  SELECT box_id, product_id, promo_price, list_price, discount_pct, description, legend, promo_kind, count(DISTINCT s.store_key) AS total_stores, string_agg(DISTINCT s.store_key, ',' ORDER BY s.store_key) AS stores
  FROM (SELECT *, unnest(string_split(stores, ',')) AS store_key FROM promos_mapped) p JOIN on_map s USING (store_key)
  JOIN (VALUES (1, -34.6, -34.5, NULL, NULL, NULL, NULL), (2, NULL, NULL, -58.4, -58.36, 'AR-A', NULL), (3, -34.6, -34.4, -58.4, -58.3, NULL, 'red')) b(box_id, south, north, west, east, bp, txt)
    ON coalesce(s.lat BETWEEN CAST(south AS DOUBLE) AND CAST(north AS DOUBLE), true) AND coalesce(s.lon BETWEEN CAST(west AS DOUBLE) AND CAST(east AS DOUBLE), true) AND coalesce(s.province = bp, true) AND coalesce(contains(lower(description), txt), true)
  GROUP BY box_id, product_id, promo_price, list_price, discount_pct, description, legend, promo_kind, p.data_date, p.brand, p.evidence, p.multi_buy, p.category, p.section)) WHERE r <= 100""",
    "box_id, product_id, promo_price, list_price, discount_pct, description, legend, promo_kind, total_stores, stores, has_more",
)(lambda t: promos.promos_in_box(t.promos_mapped, t.on_map, _boxes(t)))


def _requests(t: Tables) -> DataFrame:
    return t.table("part").select((F.col("p_partkey") % 5).alias("point_id"), (F.lit(-34.6) + (F.col("p_partkey") % 5) * 0.02).alias("lat"), (F.lit(-58.4) + (F.col("p_partkey") % 5) * 0.02).alias("lon"), F.col("p_partkey").cast("string").alias("product_id"))


_NEAR = """
(SELECT point_id, product_id, chain, store_key, km, promo_price, list_price, discount_pct, legend, evidence, multi_buy, until, row_number() OVER (PARTITION BY point_id, product_id, promo ORDER BY km, store_key) AS n, count(*) OVER (PARTITION BY point_id, product_id, promo) - 1 AS others, promo
 FROM (SELECT r.point_id, p.product_id, s.chain, s.store_key, p.promo_price, p.list_price, p.discount_pct, p.legend, p.evidence, p.multi_buy, p.until, p.promo,
         sqrt(pow((s.lon - r.lon) * CAST(111 AS DOUBLE) * cos(radians((r.lat + s.lat) / 2)), 2) + pow((s.lat - r.lat) * CAST(111 AS DOUBLE), 2)) AS km
  FROM (SELECT *, concat_ws('|', product_id, list_price, promo_price, coalesce(legend, '-'), stores) AS promo, CASE WHEN legend LIKE '%al 18/01/2024%' THEN '2024-01-18' WHEN legend LIKE '%hasta 2024-01-20%' THEN '2024-01-20' END AS until, unnest(string_split(stores, ',')) AS store_key FROM promos_mapped) p
  JOIN (SELECT p_partkey % 5 AS point_id, CAST(-34.6 AS DOUBLE) + (p_partkey % 5) * CAST(0.02 AS DOUBLE) AS lat, CAST(-58.4 AS DOUBLE) + (p_partkey % 5) * CAST(0.02 AS DOUBLE) AS lon, CAST(p_partkey AS VARCHAR) AS product_id FROM part) r USING (product_id)
  JOIN on_map s USING (store_key)) WHERE km <= 3 AND (until IS NULL OR until >= '2024-01-19'))"""
job(
    "k37_promos_near",
    f"""
SELECT point_id, product_id, chain, store_key, others AS other_stores, promo_price, list_price, discount_pct, legend, evidence, until AS valid_until, multi_buy, rank, round(km, 1) AS distance_km FROM (
  SELECT *, row_number() OVER (PARTITION BY point_id, product_id ORDER BY promo_price, round(km, 1), chain) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY point_id, product_id, chain ORDER BY promo_price, round(km, 1), store_key, promo) AS best FROM {_NEAR} WHERE n = 1) WHERE best = 1) WHERE rank <= 3""",
    "point_id, product_id, chain, store_key, other_stores, promo_price, list_price, discount_pct, legend, evidence, valid_until, multi_buy, rank, distance_km",
)(lambda t: promos.promos_near(t.promos_mapped, t.on_map, _requests(t), "2024-01-19"))
job(
    "k40_worthwhile_promos",
    f"""
SELECT point_id, product_id, chain, store_key, others AS other_stores, promo_price, list_price, discount_pct, legend, evidence, until AS valid_until, multi_buy, rank, round(km, 1) AS distance_km FROM (
  SELECT *, row_number() OVER (PARTITION BY point_id, product_id ORDER BY promo_price, round(km, 1), chain) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY point_id, product_id, chain ORDER BY promo_price, round(km, 1), store_key, promo) AS best FROM {_NEAR} WHERE n = 1) WHERE best = 1)
LEFT JOIN (SELECT product_id, min(median_price) AS z FROM same_product WHERE credible GROUP BY product_id) USING (product_id) WHERE rank <= 3 AND (z IS NULL OR promo_price < z)""",
    "point_id, product_id, chain, store_key, other_stores, promo_price, list_price, discount_pct, legend, evidence, valid_until, multi_buy, rank, distance_km",
)(lambda t: promos.worthwhile_promos(promos.promos_near(t.promos_mapped, t.on_map, _requests(t), "2024-01-19"), t.same.filter("credible").groupBy("product_id").agg(F.min("median_price").alias("zone_price")).withColumn("point_id", F.explode(F.sequence(F.lit(0), F.lit(4))))))

# Index

_PERIOD = "(SELECT min(base_date) AS s, max(data_date) AS e, count(*) AS n FROM (SELECT DISTINCT data_date, base_date FROM mart WHERE factor IS NOT NULL))"
_LOOSE = Params(min_market_companies=2)
# The history is read several times by each of these jobs; written, its shuffles run once.

job("k50_month_chain", f"SELECT DISTINCT data_date, base_date, s AS period_start, e AS period_end, n AS expected_links, DATE '2024-01-01' AS month, s < DATE '2024-01-01' AS from_month_start FROM mart, {_PERIOD} WHERE factor IS NOT NULL")(lambda t: index.month_chain(t.history, "2024-01"))
job(
    "k51_chain_inflation",
    f"""
SELECT f.category, f.chain, f.unit, m.median_unit_price AS current_price, round((total - 1) * 100, 2) AS change_pct, s AS period_start, e AS period_end
FROM (SELECT category, chain, unit, exp(sum(ln(factor))) AS total, count(*) AS links FROM mart WHERE factor IS NOT NULL GROUP BY ALL) f CROSS JOIN {_PERIOD} p
LEFT JOIN mart m ON m.category = f.category AND m.chain = f.chain AND m.unit = f.unit AND m.data_date = p.e WHERE links = n""",
)(lambda t: index.chain_inflation(t.history, "2024-01"))
_MARKET = f"""
(SELECT category, exp(sum(ln(f))) AS total, CAST(round(avg(series)) AS BIGINT) AS series, min(chains) AS chains, min(companies) AS companies, count(*) AS links FROM (
  SELECT m.category, m.data_date, exp(avg(ln(factor))) AS f, count(*) AS series, count(DISTINCT m.chain) AS chains, count(DISTINCT coalesce(company_id, m.chain)) AS companies
  FROM mart m LEFT JOIN demo_chains h ON h.chain = m.chain WHERE factor IS NOT NULL GROUP BY ALL HAVING count(DISTINCT coalesce(company_id, m.chain)) >= 2) GROUP BY category
  HAVING count(*) = (SELECT n FROM {_PERIOD}))"""
job("k52_market_inflation", f"SELECT category, round((total - 1) * 100, 2) AS change_pct, series, chains, companies, s AS period_start, e AS period_end, DATE '2024-01-01' AS month, s < DATE '2024-01-01' AS from_month_start FROM {_MARKET}, {_PERIOD}")(lambda t: index.market_inflation(t.history, t.chains, "2024-01", _LOOSE))
_SPENT = f"""
(SELECT b.category, 10 * level AS spending, total AS factor, chains FROM (VALUES ('ECONOMY'), ('LARGE'), ('MEDIUM'), ('PROMO'), ('SMALL'), ('STANDARD')) b(category)
 LEFT JOIN (SELECT category, quantile_disc(median_unit_price, 0.5) AS level FROM mart, {_PERIOD} WHERE data_date = s AND unit = 'g' GROUP BY category) USING (category) LEFT JOIN {_MARKET} k USING (category))"""
job(
    "k53_basket_contributions",
    f"""
SELECT category, round(spending / w * 100, 6) AS weight_pct, round((factor - 1) * 100, 6) AS change_pct, round(spending / w * (factor - 1) * 100, 6) AS contribution_pp, chains
FROM {_SPENT}, (SELECT sum(spending) AS w FROM {_SPENT} WHERE spending IS NOT NULL AND factor IS NOT NULL) WHERE spending IS NOT NULL AND factor IS NOT NULL""",
    rounded=("weight_pct", "change_pct", "contribution_pp"),
)(lambda t: index.contributions(index.basket_spending(t.history, t.chains, t.basket, "2024-01", _LOOSE))[0])
job(
    "k53_basket_summary",
    f"""
SELECT round(sum(spending * (factor - 1)) FILTER (factor IS NOT NULL) / sum(spending) FILTER (factor IS NOT NULL) * 100, 6) AS basket_change_pct, round(sum(spending) FILTER (factor IS NOT NULL) / sum(spending) * 100, 6) AS coverage_pct,
       coalesce(string_agg(category, ',' ORDER BY category) FILTER (spending IS NOT NULL AND factor IS NULL), '') AS no_index, coalesce(string_agg(category, ',' ORDER BY category) FILTER (spending IS NULL), '') AS no_price FROM {_SPENT}""",
    rounded=("basket_change_pct", "coverage_pct"),
)(lambda t: index.contributions(index.basket_spending(t.history, t.chains, t.basket, "2024-01", _LOOSE))[1])
job(
    "k54_overall_movement",
    f"""
SELECT round((exp(sum(series * ln(1 + c / 100)) / sum(series)) - 1) * 100, 6) AS overall_pct, count(*) FILTER (c >= CAST(0.005 AS DOUBLE)) AS up, count(*) FILTER (c <= CAST(-0.005 AS DOUBLE)) AS down, count(*) FILTER (abs(c) < CAST(0.005 AS DOUBLE)) AS unchanged, CAST(max(e - s) AS INTEGER) AS days
FROM (SELECT series, round((total - 1) * 100, 2) AS c, s, e FROM {_MARKET}, {_PERIOD})""",
    rounded=("overall_pct",),
)(lambda t: index.overall_movement(index.market_inflation(t.history, t.chains, "2024-01", _LOOSE)))

# Catalogue

job("k60_product_summary", "SELECT * REPLACE (round(reference, 6) AS reference) FROM summary", rounded=("reference",))(lambda t: t.summary)
_ANY_STORES = Params(min_extreme_stores=1)
_BACKED = "(SELECT * REPLACE (coalesce(bool_or(credible AND median_price = lowest) OVER (PARTITION BY product_id) AND bool_or(credible AND median_price = highest) OVER (PARTITION BY product_id), false) AS credible) FROM same_product)"
job("k61_top_differences", "SELECT product_id, gap_pct, rank FROM (SELECT product_id, gap_pct, row_number() OVER (ORDER BY gap_pct DESC, description, product_id) AS rank FROM (SELECT DISTINCT product_id, gap_pct, description FROM same_product WHERE companies >= 3)) WHERE rank <= 40", "product_id, gap_pct, rank")(
    lambda t: catalog.top_differences(catalog.product_summary(t.same, _ANY_STORES), 40)
)
job("k62_carried_chains", "SELECT DISTINCT chain, price_date, data_date FROM same_product WHERE price_date <> data_date")(lambda t: catalog.carried_chains(t.same))
_ZONE_WINS = """
(SELECT zone_id, category, section, chain, won, offered, total, round(won / total * 100, 1) AS pct_wins, round(won / offered * 100, 1) AS pct_wins_when_offered FROM (
   SELECT zone_id, category, section, chain, count(DISTINCT product_id) FILTER (median_price = low) AS won, count(DISTINCT product_id) AS offered FROM zoned WHERE category <> 'Otros' GROUP BY ALL)
 JOIN (SELECT zone_id, category, count(DISTINCT product_id) AS total FROM zoned WHERE category <> 'Otros' GROUP BY ALL) USING (zone_id, category) WHERE won > 0 AND offered >= 3)""".replace(
    "FROM zoned",
    "FROM (SELECT *, min(median_price) OVER (PARTITION BY zone_id, product_id) AS low, count(*) OVER (PARTITION BY zone_id, product_id) AS k FROM same_product JOIN zone_chains USING (chain) QUALIFY k >= 2)",
)
job("k63_who_wins_in_zone", f"SELECT * FROM {_ZONE_WINS}")(lambda t: catalog.who_wins_in_zone(t.same, t.zone_chains, Params(min_offered=3)))
_LEADERS = "(SELECT category, string_agg(chain, ',' ORDER BY chain) AS chains, max(pct_wins_when_offered) AS pct FROM (SELECT *, rank() OVER (PARTITION BY category ORDER BY pct_wins_when_offered DESC) AS r FROM wins WHERE data_date = DATE '2024-01-03') WHERE r = 1 GROUP BY category)"
job("k64_category_leaders", f"SELECT * FROM {_LEADERS}")(lambda t: catalog.category_leaders(t.wins.filter("data_date = '2024-01-03'")))
job("k64_categories_led", f"SELECT chain, count(*) AS categories_led FROM (SELECT unnest(string_split(chains, ',')) AS chain FROM {_LEADERS}) GROUP BY chain")(lambda t: catalog.categories_led(catalog.category_leaders(t.wins.filter("data_date = '2024-01-03'"))))
_COMP = "(SELECT * FROM same_product WHERE companies >= 3 AND reference IS NOT NULL)"
job(
    "k65_savings_by_category",
    f"""
SELECT category, products, round(m * 100, 1) AS median_saving_pct, cheapest_chains, round(n / products * 100, 1) AS cheapest_pct
FROM (SELECT category, count(*) AS products, quantile_cont(s, 0.5) AS m FROM (SELECT DISTINCT category, product_id, 1 - lowest / reference AS s FROM {_COMP}) GROUP BY category HAVING count(*) >= 20)
JOIN (SELECT category, string_agg(chain, ',' ORDER BY chain) AS cheapest_chains, max(n) AS n FROM (SELECT category, chain, n, rank() OVER (PARTITION BY category ORDER BY n DESC) AS r FROM (SELECT category, chain, count(DISTINCT product_id) AS n FROM {_COMP} WHERE is_cheapest GROUP BY ALL)) WHERE r = 1 GROUP BY category) USING (category)""",
)(lambda t: catalog.savings_by_category(t.same, catalog.product_summary(t.same, _ANY_STORES)))
job(
    "k65_cheapest_chains",
    f"SELECT chain, count(DISTINCT product_id) AS products, round(count(DISTINCT product_id) / (SELECT count(DISTINCT product_id) FROM {_COMP}) * 100, 1) AS pct FROM {_COMP} WHERE is_cheapest GROUP BY chain ORDER BY products DESC, chain LIMIT 5",
)(lambda t: catalog.cheapest_chains(t.same, catalog.product_summary(t.same, _ANY_STORES)))
job(
    "k67_chain_price_levels",
    """
SELECT chain, category, round(exp(avg(ln(median_price / reference))), 6) AS level, count(*) AS products FROM same_product WHERE reference > 0 AND companies >= 2 AND credible AND median_price > 0
GROUP BY GROUPING SETS ((chain, category), (chain)) HAVING count(*) >= 5""",
    rounded=("level",),
)(lambda t: catalog.chain_price_levels(t.same))
job(
    "k68_popular_by_category",
    """
SELECT * FROM (SELECT category, row_number() OVER (PARTITION BY category ORDER BY f DESC, stores DESC, description, product_id) AS rank, product_id, description, brand, stores FROM (
  SELECT *, row_number() OVER (PARTITION BY category, lower(brand) ORDER BY stores DESC, description, product_id) = 1 AS f FROM (
    SELECT product_id, description, brand, category, CAST(sum(CASE WHEN credible THEN stores ELSE 0 END) AS BIGINT) AS stores FROM same_product GROUP BY ALL))) WHERE rank <= 4""",
)(lambda t: catalog.popular_by_category(t.same))
job(
    "k69_merge_equal_formats",
    """
SELECT product_id, string_agg(DISTINCT s.chain, ',' ORDER BY s.chain) AS chains, min(median_price) AS price, CAST(sum(stores) AS BIGINT) AS stores, min(min_price) AS min_price, max(max_price) AS max_price, credible, price_date
FROM same_product s LEFT JOIN demo_chains h ON h.chain = s.chain GROUP BY product_id, company_id, CAST(round(median_price * 100) AS BIGINT), credible, price_date""",
)(lambda t: catalog.merge_equal_formats(t.same, t.chains.select("chain", F.col("company_id").alias("group_name"))))
_ZONE_PRICES = """
(SELECT zone_id, product_id, string_agg(chain, ',' ORDER BY chain) FILTER (median_price = lo) AS cheapest, min(lo) AS price, string_agg(chain, ',' ORDER BY chain) FILTER (median_price = hi) AS dearest, max(hi) AS max_price, count(*) AS chains_in_zone, CAST(round((max(hi) - min(lo)) / max(hi) * 100) AS INTEGER) AS saving_pct
 FROM (SELECT *, min(median_price) OVER (PARTITION BY zone_id, product_id) AS lo, max(median_price) OVER (PARTITION BY zone_id, product_id) AS hi FROM same_product JOIN zone_chains USING (chain) WHERE credible) GROUP BY zone_id, product_id)"""
job("k70_zone_price_summary", f"SELECT * FROM {_ZONE_PRICES}")(lambda t: catalog.zone_price_summary(t.same, t.zone_chains))
job(
    "k73_product_headline",
    f"""
WITH x AS (SELECT 1) SELECT zone_id, product_id, 'zona' AS scope, CASE WHEN sold IS NULL THEN 'no_en_zona' WHEN price IS NULL THEN 'sin_creible_en_zona' WHEN chains_in_zone = 1 THEN 'una_cadena' WHEN price = max_price THEN 'igual' WHEN g < 1 THEN 'casi_igual' ELSE 'diferencia' END AS kind, coalesce(price, lowest) AS price, coalesce(max_price, highest) AS max_price, coalesce(g, gap_pct) AS gap_pct
FROM (SELECT * FROM summary CROSS JOIN (SELECT DISTINCT zone_id FROM zone_chains)) LEFT JOIN (SELECT DISTINCT zone_id, product_id, true AS sold FROM same_product JOIN zone_chains USING (chain)) USING (zone_id, product_id)
LEFT JOIN (SELECT *, round((max_price - price) / price * 100, 1) AS g FROM {_ZONE_PRICES}) USING (zone_id, product_id)
UNION ALL SELECT NULL, product_id, 'pais', CASE WHEN highest > lowest AND NOT extremes_backed THEN 'sin_respaldo' WHEN lowest = highest THEN 'igual' WHEN gap_pct < 1 THEN 'casi_igual' ELSE 'diferencia' END, lowest, highest, gap_pct FROM summary""".replace("WITH x AS (SELECT 1) ", ""),
)(lambda t: catalog.product_headline(t.summary, t.same, t.zone_chains))


def _products(t: Tables) -> DataFrame:
    return t.summary.hint("merge").join(t.same.groupBy("product_id").agg(F.min("search_text").alias("search_text")), "product_id")


def _words(t: Tables) -> DataFrame:
    return t.table("part").select(F.substring_index("p_name", " ", 1).alias("a"), F.substring(F.substring_index("p_name", " ", -1), 1, 3).alias("b")).distinct().select(F.concat_ws(" ", "b", "a").alias("query_id"), F.concat_ws(" ", "b", "a").alias("text"))


def _words_of(text: str) -> str:
    """Words of a text without accents or written units, as the search hears them."""
    heard = f"lower({text})"
    for letters, sound in (("ll", "y"), ("v", "b"), ("z", "s"), ("ce", "se"), ("ci", "si")):
        heard = f"replace({heard}, '{letters}', '{sound}')"
    return f"regexp_extract_all(regexp_replace({heard}, '(^|[^c])h', '\\1', 'g'), '[a-z0-9]+(?:[.,][0-9]+)?[a-z]*')"


def _forms_of(word: str) -> str:
    return f"CASE WHEN length({word}) > 3 THEN list_distinct([{word}, regexp_replace({word}, 'es$', ''), regexp_replace({word}, 's$', '')]) ELSE [{word}] END"


def _hits(queries: str) -> str:
    """Ranked hits of queries (query_id, text) that hold no sizes."""
    begins = lambda words: f"len(list_filter(forms, lambda v: len(list_filter({words}, lambda w: len(list_filter(v, lambda x: starts_with(w, x))) > 0)) > 0)) = len(forms)"
    touched = f"len(list_filter(cats, lambda w: len(list_filter(forms, lambda v: list_has_any({_forms_of('w')}, v))) > 0))"
    return f"""
(SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY category_match, visible DESC, whole_words DESC, chains DESC, length(description), description, product_id) AS INTEGER) AS rank, product_id, category_match, visible, whole_words, chains FROM (
  SELECT query_id, product_id, description, chains, CASE {touched} WHEN 0 THEN 2 WHEN len(cats) THEN 0 ELSE 1 END AS category_match, {begins("vis")} AS visible,
         len(list_filter(forms, lambda v: len(list_filter(vis, lambda w: list_has_any({_forms_of("w")}, v))) > 0)) = len(forms) AS whole_words
  FROM (SELECT query_id, list_transform({_words_of("text")}, lambda w: {_forms_of("w")}) AS forms FROM {queries}) q,
       (SELECT product_id, description, chains, {_words_of("concat_ws(' ', description, brand)")} AS vis, {_words_of("concat_ws(' ', description, brand, search_text, category)")} AS names, list_filter(list_distinct({_words_of("category")}), lambda w: length(w) > 2) AS cats
        FROM summary JOIN (SELECT product_id, min(search_text) AS search_text FROM same_product GROUP BY product_id) USING (product_id)) p
  WHERE len(forms) > 0 AND {begins("names")}))"""


job("k71_bulk_search", f"SELECT * FROM {_hits("(SELECT DISTINCT concat(left(split_part(p_name, ' ', -1), 3), ' ', split_part(p_name, ' ', 1)) AS query_id, query_id AS text FROM part)")} WHERE rank <= 5")(lambda t: catalog.bulk_search(_words(t), _products(t), 5))
#: Each size's parts as a pasted list, a line for each name; a line's place is that of its name among the list's.
_LINES = "(SELECT p_size AS list_id, p_name AS search, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_name) - 1 AS INTEGER) AS line_no FROM (SELECT DISTINCT p_size, p_name FROM part))"
_NAMED = f"(SELECT product_id, 0 AS rank FROM {_hits("(SELECT 'red widget' AS query_id, 'red widget' AS text)")} WHERE rank = 1)"
job(
    "k72_pasted_lists",
    f"""
SELECT list_id, line_no, concat(list_id, ' ', l.search) AS text, l.search, CAST(least(99, greatest(1, list_id)) AS INTEGER) AS quantity, coalesce(candidates, '') AS candidates
FROM {_LINES} l LEFT JOIN (
  SELECT search, string_agg(product_id, ',' ORDER BY rank) AS candidates FROM (
    SELECT *, row_number() OVER (PARTITION BY search ORDER BY rank) AS n FROM (
      SELECT search, product_id, min(rank) AS rank FROM (
        SELECT query_id AS search, product_id, rank FROM {_hits("(SELECT DISTINCT p_name AS query_id, p_name AS text FROM part)")} WHERE rank <= 4 UNION ALL SELECT 'red widget', * FROM {_NAMED}) GROUP BY ALL))
  WHERE n <= 3 GROUP BY search) USING (search)""",
)(
    lambda t: catalog.resolve_pasted_lists(
        t.table("part").groupBy(F.col("p_size").alias("list_id")).agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(" ", F.col("p_size").cast("string"), F.col("p_name")))), "\n").alias("text")),
        _products(t), t.spark.createDataFrame([("red widget", "red widget")], "name string, text string"), catalog.resolve_staples(t.spark.createDataFrame([("red widget", "red widget")], "name string, text string"), _products(t)),
    )
)

# Baskets and lists

job(
    "k80_quote_lists",
    """
SELECT list_id, chain, total, priced, priced = n AS complete, missing FROM (
  SELECT p.list_id, p.chain, CAST(round(sum(CAST(median_price * quantity AS DECIMAL(24,6))), 2) AS DOUBLE) AS total, count(*) AS priced, min(n) AS n, array_to_string(list_sort(list_filter(min(e), lambda x: NOT list_contains(list(product_id), x))), ',') AS missing
  FROM priced_lists p JOIN (SELECT list_id, list(DISTINCT product_id) AS e, count(DISTINCT product_id) AS n FROM priced_lists GROUP BY list_id) s USING (list_id) GROUP BY p.list_id, p.chain)""",
)(lambda t: baskets.quote_lists(t.lists, t.same))
job(
    "k80_list_summary",
    """
SELECT list_id, coalesce(CAST(round(sum(CAST(low * least(99, greatest(1, quantity)) AS DECIMAL(24,6))), 2) AS DOUBLE), 0) AS combined_total, coalesce(string_agg(product_id, ',' ORDER BY product_id) FILTER (low IS NULL), '') AS not_found
FROM lists LEFT JOIN (SELECT product_id, min(median_price) AS low FROM same_product WHERE credible AND format = 'supermercado' GROUP BY product_id) USING (product_id) GROUP BY list_id""",
)(lambda t: baskets.list_summary(t.lists, t.same))
job(
    "k81_quote_lists_in_zone",
    """
SELECT list_id, zone_id, chain, total, priced, priced = n AS complete, missing FROM (
  SELECT list_id, zone_id, chain, CAST(round(sum(CAST(median_price * quantity AS DECIMAL(24,6))), 2) AS DOUBLE) AS total, count(*) AS priced, min(n) AS n, array_to_string(list_sort(list_filter(min(e), lambda x: NOT list_contains(list(product_id), x))), ',') AS missing
  FROM (SELECT * FROM priced_lists JOIN zone_chains USING (chain)) JOIN (SELECT list_id, zone_id, list(DISTINCT product_id) AS e, count(DISTINCT product_id) AS n FROM priced_lists JOIN zone_chains USING (chain) GROUP BY ALL) USING (list_id, zone_id) GROUP BY list_id, zone_id, chain)""",
)(lambda t: baskets.quote_lists_in_zone(t.lists, t.same, t.zone_chains))


def baskets_of(t: Tables) -> DataFrame:
    """One basket for each tier: every category and unit in the tier."""
    tiers = F.array(*(F.struct(F.lit(str(k)).alias("basket_id"), F.lit(tier).alias("tier")) for k, tier in enumerate(("economico", "medio", "premium"))))
    return t.tiers.select("category", "unit").distinct().withColumn("b", F.explode(tiers)).select("b.basket_id", "category", "b.tier", "unit", F.lit(100.0).alias("quantity"))


def _baskets_at_points(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The three baskets at every supplier's point, with a basket_id of point and tier."""
    name = F.concat_ws("-", F.col("basket_id"), "tier")
    specs = baskets_of(t).drop("basket_id")
    points = t.points.crossJoin(F.broadcast(specs.select("tier").distinct()))
    return t.points.select("basket_id").crossJoin(F.broadcast(specs)).withColumn("basket_id", name), points.withColumn("basket_id", name).drop("tier")


def _zones(t: Tables) -> DataFrame:
    return t.stores.filter("locality LIKE '% 1' OR locality LIKE '% 2'").select("locality", "province").distinct().withColumn("basket_id", F.explode(F.array(*map(F.lit, "012"))))


_LEVEL = "(SELECT {on}, category, tier, unit, sum(median_unit_price * samples) / sum(samples) AS p, CAST(sum(samples) AS BIGINT) AS n FROM locality_prices JOIN (SELECT DISTINCT {where} FROM demo_stores WHERE locality LIKE '% 1' OR locality LIKE '% 2') USING ({where}) GROUP BY ALL)"
_COSTS = f"""
(SELECT b.basket_id, b.category, b.tier, b.unit, CAST(100 AS DOUBLE) AS quantity, round(coalesce(z.p, w.p), 4) AS unit_price, round(coalesce(z.p, w.p) * 100, 2) AS cost, coalesce(z.n, w.n) AS samples, CASE WHEN z.p IS NOT NULL THEN 'zona' ELSE 'provincia' END AS price_origin
 FROM (SELECT DISTINCT basket_id, category, b.tier, unit FROM tiers CROSS JOIN (VALUES ('0', 'economico'), ('1', 'medio'), ('2', 'premium')) b(basket_id, tier)) b
 LEFT JOIN {_LEVEL.format(on="1 AS one", where="locality, province")} z USING (category, tier, unit) LEFT JOIN {_LEVEL.format(on="1 AS one", where="province")} w USING (category, tier, unit) WHERE z.p IS NOT NULL OR w.p IS NOT NULL)"""
job("k82_basket_cost", f"SELECT * FROM {_COSTS}")(lambda t: baskets.basket_cost(baskets_of(t), _zones(t), t.locality_prices))
job(
    "k82_basket_totals",
    f"""
SELECT basket_id, asked, coalesce(total, 0) AS total, coalesce(priced, 0) AS priced, coalesce(from_province, 0) AS from_province
FROM (SELECT basket_id, count(*) AS asked FROM (SELECT DISTINCT basket_id, category, b.tier, unit FROM tiers CROSS JOIN (VALUES ('0', 'economico'), ('1', 'medio'), ('2', 'premium')) b(basket_id, tier)) GROUP BY basket_id)
LEFT JOIN (SELECT basket_id, CAST(round(sum(CAST(cost AS DECIMAL(24,6))), 2) AS DOUBLE) AS total, count(*) AS priced, count(*) FILTER (price_origin = 'provincia') AS from_province FROM {_COSTS} GROUP BY basket_id) USING (basket_id)""",
)(lambda t: baskets.basket_totals(baskets_of(t), baskets.basket_cost(baskets_of(t), _zones(t), t.locality_prices)))
job("k84_best_store_combinations", None)(lambda t: baskets.best_store_combinations(*_baskets_at_points(t), t.store_prices))
_NEAR_COSTS = """
(SELECT p.lat, p.lon, tier, concat(s.company_id, '-', s.store_id) AS store, concat(category, '/', unit) AS item, median_unit_price * CAST(100 AS DOUBLE) AS cost
 FROM (SELECT DISTINCT CAST(-34.6 AS DOUBLE) + (s_suppkey % 9) * CAST(0.01 AS DOUBLE) AS lat, CAST(-58.4 AS DOUBLE) + (s_suppkey % 7) * CAST(0.01 AS DOUBLE) AS lon FROM supplier) p
 JOIN store_prices s ON 2 * CAST(6371.0088 AS DOUBLE) * asin(sqrt(pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2))) <= 10)"""
_SETS_OF_STORES = f"""
(SELECT lat, lon, tier, 1 AS k, count(*) AS covered, round(sum(cost), 6) AS total FROM {_NEAR_COSTS} GROUP BY lat, lon, tier, store
 UNION ALL SELECT lat, lon, tier, 2, count(*), round(sum(low), 6) FROM (
   SELECT r.lat, r.lon, r.tier, a, b, item, min(cost) AS low FROM {_NEAR_COSTS} r
   JOIN (SELECT x.lat, x.lon, x.tier, x.store AS a, y.store AS b FROM (SELECT DISTINCT lat, lon, tier, store FROM {_NEAR_COSTS}) x JOIN (SELECT DISTINCT lat, lon, tier, store FROM {_NEAR_COSTS}) y ON x.lat = y.lat AND x.lon = y.lon AND x.tier = y.tier AND x.store < y.store) p
   ON r.lat = p.lat AND r.lon = p.lon AND r.tier = p.tier AND r.store IN (p.a, p.b) GROUP BY ALL) GROUP BY lat, lon, tier, a, b)"""
_BEST_SETS = f"""
(SELECT concat(s_suppkey, '-', tier) AS basket_id, m.k, first(covered ORDER BY covered DESC, total) AS covered, first(total ORDER BY covered DESC, total) AS total
 FROM supplier JOIN {_SETS_OF_STORES} c ON c.lat = CAST(-34.6 AS DOUBLE) + (s_suppkey % 9) * CAST(0.01 AS DOUBLE) AND c.lon = CAST(-58.4 AS DOUBLE) + (s_suppkey % 7) * CAST(0.01 AS DOUBLE)
 JOIN (VALUES (1), (2)) m(k) ON c.k <= m.k GROUP BY s_suppkey, tier, m.k)"""


def _two_stores(t: Tables) -> DataFrame:
    wanted, points = _baskets_at_points(t)
    return baskets.best_store_combinations(wanted, points.withColumn("max_stores", F.lit(2)), t.store_prices)


job("k84_one_or_two_stores", f"SELECT basket_id, k, CAST(covered AS INTEGER) AS covered, total FROM {_BEST_SETS}", "basket_id, k, covered, total", ("total",))(_two_stores)
job(
    "k89_option_of_two_stores",
    f"""
SELECT basket_id, CAST(k AS INTEGER) AS k, CAST(covered AS INTEGER) AS covered, total, round(CASE WHEN covered = one_covered THEN one_total - total END, 6) AS saving_vs_one FROM (
  SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY covered DESC, total, k) AS n, first_value(total) OVER (PARTITION BY basket_id ORDER BY k) AS one_total, first_value(covered) OVER (PARTITION BY basket_id ORDER BY k) AS one_covered FROM {_BEST_SETS}) WHERE n = 1""",
    "basket_id, k, covered, total, saving_vs_one", ("total", "saving_vs_one"),
)(lambda t: baskets.best_option(_two_stores(t)))
job("k86_quotable_localities", "SELECT locality, province, count(DISTINCT category) AS categories FROM locality_prices GROUP BY ALL HAVING count(DISTINCT category) >= 2")(lambda t: baskets.quotable_localities(t.locality_prices, 2))
job("k87_zone_gazetteer", None)(lambda t: baskets.zone_gazetteer(t.on_map, spread_km=30))
job(
    "k88_nearest_zone",
    """
SELECT point_id, first(name ORDER BY round(km, 9), name) AS zone, round(min(km), 1) AS distance_km FROM (
  SELECT p.store_id AS point_id, z.name, sqrt(pow((z.lon - p.lon) * CAST(111 AS DOUBLE) * cos(radians((p.lat + z.lat) / 2)), 2) + pow((z.lat - p.lat) * CAST(111 AS DOUBLE), 2)) AS km
  FROM demo_stores p CROSS JOIN (SELECT locality AS name, min(lat) AS lat, min(lon) AS lon FROM on_map GROUP BY locality) z) WHERE km <= 50 GROUP BY point_id""",
)(lambda t: baskets.nearest_zone(t.stores.select(F.col("store_id").alias("point_id"), "lat", "lon"), t.on_map.groupBy(F.col("locality").alias("name")).agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))))
job("k89_best_option", None)(lambda t: baskets.best_option(baskets.best_store_combinations(*_baskets_at_points(t), t.store_prices)))

# Text and joins

_DESCRIPTION = "upper(p_name) || ' X ' || CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN ' GRS' ELSE ' KG' END"
job(
    "k1_stage_sizes",
    """
SELECT CAST(p_partkey AS VARCHAR) AS product_id, CASE WHEN q BETWEEN 5 AND 10000 THEN q ELSE CAST(1 AS DOUBLE) END AS qty, CASE WHEN q BETWEEN 5 AND 10000 THEN 'g' ELSE 'unidad' END AS unit
FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) * CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 1000 END AS q FROM part)""",
    "product_id, qty, unit",
)(lambda t: prices.stage_prices(t.table("part").select(*(F.col("p_partkey").cast("string").alias(c) for c in ("company_id", "banner_id", "store_id", "product_id")), F.lit("2.5").alias("list_price"), F.lit(LAST_DAY).cast("date").alias("data_date"), F.lit("1").alias("declared_qty"), F.lit("UNI").alias("declared_unit"), F.concat(F.upper("p_name"), F.lit(" X "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, " GRS").otherwise(" KG")).alias("description"))))
job("f5_fold_accents", "SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents")(lambda t: t.table("documents").select("doc_id", text.fold(F.col("text")).alias("folded")))
job(
    "f17_haversine",
    "SELECT a.store_id AS a, b.store_id AS b, round(2 * CAST(6371.0088 AS DOUBLE) * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))), 6) AS km FROM demo_stores a JOIN demo_stores b ON CAST(a.store_id AS INTEGER) + 7 = CAST(b.store_id AS INTEGER)",
    rounded=("km",),
)(lambda t: t.stores.select((F.col("store_id").cast("int") + 7).alias("next"), F.col("store_id").alias("a"), "lat", "lon").join(t.stores.select(F.col("store_id").cast("int").alias("next"), F.col("store_id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "next").select("a", "b", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("km")))

# Dates and tables

job("s10_latest_date", "SELECT max(data_date) AS data_date FROM demo_prices")(lambda t: t.spark.createDataFrame([(ingest.latest_date(t.prices),)], "data_date date"))
job("s11_s12_date_pairs", "SELECT * FROM pairs WHERE data_date >= DATE '2024-01-03' AND data_date < DATE '2024-01-07'")(lambda t: ingest.pairs_frame(t.spark, ingest.date_pairs(ingest.dates_of(t.prices), ingest.dates_to_compute(ingest.dates_of(t.prices), [date(2024, 1, 1), date(2024, 1, 2)]))))
job("s13_missing_dates", "SELECT CAST(d AS DATE) AS data_date FROM generate_series(DATE '2023-12-28', DATE '2024-01-12', INTERVAL 1 DAY) s(d) WHERE CAST(d AS DATE) NOT IN (SELECT data_date FROM demo_prices)")(lambda t: ingest.missing_dates(t.spark, "2023-12-28", "2024-01-12", t.prices))
job("s17_pending_dates", "SELECT DISTINCT data_date FROM demo_prices WHERE data_date NOT IN (DATE '2024-01-02', DATE '2024-01-04', DATE '2024-01-06')")(lambda t: ingest.pending_dates(t.prices, _stored(t)))
job("s6_products_to_classify", f"SELECT p.product_id, min(p.p_name) AS description, min(p.p_brand) AS brand FROM demo_prices p WHERE data_date = DATE '{LAST_DAY}' AND product_id NOT IN (SELECT product_id FROM demo_categories WHERE category = 'PROMO') GROUP BY p.product_id")(lambda t: ingest.products_to_classify(t.prices.withColumnsRenamed({"p_name": "description", "p_brand": "brand"}), t.categories.filter("category = 'PROMO'"), LAST_DAY))
job("s8_category_transitions", "SELECT a.section AS old, a.category AS new, count(*) AS products FROM demo_categories a WHERE a.section <> a.category GROUP BY ALL")(lambda t: ingest.category_transitions(t.categories.select("product_id", F.col("section").alias("category")), t.categories))

# Checks

job("q1_unique", "SELECT product_id, unit, count(*) AS n FROM (SELECT DISTINCT product_id, unit, qty FROM demo_prices) GROUP BY ALL HAVING count(*) > 1")(lambda t: checks.unique(t.prices.select("product_id", "unit", "qty").distinct(), "product_id", "unit"))
job("q2_carried_too_long", "SELECT product_id, chain FROM same_product WHERE data_date - price_date > 0", "product_id, chain")(lambda t: checks.carried_too_long(t.same, Params(carry_days=0)))
job("q4_incomplete_chains", "SELECT chain, count(DISTINCT product_id) FILTER (data_date = DATE '2024-01-07') AS today, count(DISTINCT product_id) FILTER (data_date = DATE '2024-01-06') AS before FROM demo_prices JOIN demo_chains USING (company_id, banner_id) WHERE reports_daily GROUP BY chain HAVING count(DISTINCT product_id) FILTER (data_date = DATE '2024-01-06') > 10 AND count(DISTINCT product_id) FILTER (data_date = DATE '2024-01-07') < 0.5 * count(DISTINCT product_id) FILTER (data_date = DATE '2024-01-06')")(lambda t: checks.incomplete_chains(t.prices, t.chains, LAST_DAY, 10))
job("q5_calibration_too_small", "SELECT data_date, count(market_ratio) FILTER (evidence = 'leyenda') AS verified_with_market FROM evidence GROUP BY data_date HAVING count(market_ratio) FILTER (evidence = 'leyenda') < 10000", "data_date, verified_with_market")(lambda t: checks.calibration_too_small(promos.promo_calibration(t.evidence)))
job("q7_classification_degraded", "SELECT round(avg(CASE WHEN category = 'Otros' THEN 1 ELSE 0 END), 6) AS other, round(avg(CASE WHEN category IS NULL THEN 1 ELSE 0 END), 6) AS missing FROM (SELECT DISTINCT product_id FROM demo_prices) LEFT JOIN demo_categories USING (product_id)", rounded=("other", "missing"))(lambda t: checks.classification_degraded(t.prices, t.categories, 0.001))
job("q9_pharmacy_outside", "SELECT product_id, h.chain FROM product_chain p JOIN demo_chains h ON h.chain = p.chain JOIN demo_categories c USING (product_id) WHERE h.format = 'farmacia' AND section NOT IN ('Higiene', 'Bebes')", "product_id, chain")(lambda t: checks.pharmacy_outside(t.product_chain.join(t.categories, "product_id"), t.chains))
job("q10_tiers_out_of_order", "SELECT category, unit, count(*) AS n FROM tiers GROUP BY ALL HAVING count(*) >= 10 AND NOT avg(unit_price) FILTER (tier = 'economico') < avg(unit_price) FILTER (tier = 'premium')", "category, unit, n")(lambda t: checks.tiers_out_of_order(t.tiers))
job("q11_history_misses_latest", "SELECT DATE '2024-01-07' AS data_date")(lambda t: checks.history_misses_latest(t.prices, _stored(t)))
job("q14_extremes_not_credible", "SELECT product_id, chain FROM same_product a WHERE credible AND NOT in_range AND median_price IN (lowest, highest) AND NOT EXISTS (SELECT 1 FROM same_product o WHERE o.product_id = a.product_id AND o.chain <> a.chain AND abs(o.median_price - a.median_price) <= a.median_price * CAST(0.1 AS DOUBLE))", "product_id, chain")(lambda t: checks.extremes_not_credible(t.same))
job("q15_prices_without_company", "SELECT DISTINCT company_id, banner_id FROM demo_prices WHERE banner_id IN ('1', '2')")(lambda t: checks.prices_without_company(t.prices, t.chains.filter("banner_id NOT IN ('1', '2')")))
job("q16_market_promos_above_verified", "SELECT product_id, store_id, discount_pct FROM valid WHERE evidence = 'mercado' AND discount_pct > (SELECT max(discount_pct) FROM evidence WHERE evidence = 'leyenda')", "product_id, store_id, discount_pct")(lambda t: checks.market_promos_above_verified(t.valid, promos.promo_calibration(t.evidence)))

FLAGSHIP = QUERIES["k16_who_wins"]
