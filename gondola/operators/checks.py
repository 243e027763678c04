"""Data-quality checks: each returns the rows that violate it; an empty result passes (Q1-Q18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.functions.text import competes_in, declared_unit, fold
from gondola.operators.dims import named_province
from gondola.params import DEFAULTS, Params


def not_null(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.filter(" OR ".join(f"{c} IS NULL" for c in columns))


def unique(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def accepted_values(rows: DataFrame, column: str, values: list) -> DataFrame:
    return rows.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def expression_is_true(rows: DataFrame, expression: str, where: str = "true") -> DataFrame:
    return rows.filter(where).filter(f"NOT coalesce({expression}, false)")


def carried_too_long(same: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Q2."""
    return same.filter((F.datediff("data_date", "price_date") > p.carry_days) | (F.col("price_date") > F.col("data_date")))


def capital_without_name(stores: DataFrame) -> DataFrame:
    """Q3: stores of the capital whose locality is still the capital as a whole, or in no polygon."""
    generic = F.coalesce(named_province(F.col("locality")) == "AR-C", F.lit(False)) | (fold(F.col("locality")) == "buenos aires")
    return stores.filter((F.col("province") == "AR-C") & (generic | F.col("neighbourhood").isNull()))


def incomplete_chains(prices: DataFrame, companies: DataFrame, date, least_products: int = 1000, share: float = 0.5) -> DataFrame:
    """Q4: chains that report daily and had many products the day before, with none or under half of them on the date."""
    daily = companies.filter("reports_daily").select("company_id", "banner_id", "chain").distinct()
    days = prices.select("data_date").distinct().filter(F.col("data_date") < F.lit(date).cast("date")).agg(F.max("data_date").alias("previous"))
    rows = prices.join(F.broadcast(daily), ["company_id", "banner_id"]).crossJoin(F.broadcast(days))
    count = lambda cond: F.countDistinct(F.when(cond, F.col("product_id")))
    per = rows.groupBy("chain").agg(count(F.col("data_date") == F.lit(date).cast("date")).alias("today"), count(F.col("data_date") == F.col("previous")).alias("before"))
    return per.filter((F.col("before") > least_products) & (F.col("today") < F.col("before") * share))


def calibration_too_small(calibration: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Q5."""
    return calibration.filter(F.col("verified_with_market") < p.promo_min_verified)


def foreign_markers(categories: DataFrame, markers: dict[str, str], most: float = 0.02) -> DataFrame:
    """Q6: categories of which too many descriptions match another kind's words (category -> pattern)."""
    rows = categories.filter(F.col("category").isin(*markers))
    hit = F.lit(False)
    for name, pattern in markers.items():
        hit = hit | ((F.col("category") == name) & fold(F.col("description")).rlike(pattern))
    return rows.groupBy("category").agg(F.count_if(hit).alias("foreign"), F.count("*").alias("products")).filter(F.col("foreign") > F.col("products") * most)


def classification_degraded(products: DataFrame, categories: DataFrame, most_other: float = 0.08, most_missing: float = 0.05) -> DataFrame:
    """Q7: one row if too many products are "Otros" or have no category."""
    rows = products.select("product_id").distinct().join(categories.select("product_id", "category"), "product_id", "left")
    out = rows.agg(F.avg((F.coalesce("category", F.lit("")) == "Otros").cast("int")).alias("other"), F.avg(F.col("category").isNull().cast("int")).alias("missing"))
    return out.filter((F.col("other") > most_other) | (F.col("missing") > most_missing))


def raw_behind(prices: DataFrame, today, most_days: int = 2) -> DataFrame:
    """Q8."""
    return prices.agg(F.max("data_date").alias("latest")).withColumn("behind", F.datediff(F.lit(today).cast("date"), "latest")).filter(F.col("behind").isNull() | (F.col("behind") > most_days))


def pharmacy_outside(rows: DataFrame, companies: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Q9: rows (chain, section) of a pharmacy outside its sections."""
    formats = companies.groupBy("chain").agg(F.min("format").alias("chain_format"))
    return rows.join(F.broadcast(formats), "chain").filter(~competes_in(F.col("chain_format"), F.col("section"), p)).drop("chain_format")


def tiers_out_of_order(tiers: DataFrame, least: int = 10) -> DataFrame:
    """Q10: category and unit groups whose economy products cost no less per unit than the premium ones."""
    per = tiers.groupBy("category", "unit").agg(F.count("*").alias("n"), F.avg(F.when(F.col("tier") == "economico", F.col("unit_price"))).alias("low"), F.avg(F.when(F.col("tier") == "premium", F.col("unit_price"))).alias("high"))
    return per.filter((F.col("n") >= least) & ~(F.col("low") < F.col("high")))


def history_misses_latest(source: DataFrame, history: DataFrame) -> DataFrame:
    """Q11."""
    return source.agg(F.max("data_date").alias("data_date")).join(history.select("data_date").distinct(), "data_date", "left_anti")


def index_covers_too_little(market: DataFrame, basket: DataFrame, least: int = 30) -> DataFrame:
    """Q12: one row if fewer basket categories than that have a market index."""
    return basket.join(market.select("category"), "category", "left_semi").agg(F.count("*").alias("covered")).filter(F.col("covered") < least)


def locality_names_other_province(stores: DataFrame) -> DataFrame:
    """Q13."""
    return stores.filter(named_province(F.col("locality")) != F.col("province"))


def extremes_not_credible(same: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Q14: published extremes that are out of range and that no other chain confirms."""
    ends = same.filter(F.col("credible") & ~F.col("in_range") & ((F.col("median_price") == F.col("lowest")) | (F.col("median_price") == F.col("highest"))))
    other = same.select(F.col("product_id").alias("o_product"), F.col("chain").alias("o_chain"), F.col("median_price").alias("o_price"))
    near = (F.col("product_id") == F.col("o_product")) & (F.col("chain") != F.col("o_chain")) & (F.abs(F.col("o_price") - F.col("median_price")) <= F.col("median_price") * p.agreement_tolerance)
    return ends.join(other, near, "left_anti")


def prices_without_company(prices: DataFrame, companies: DataFrame) -> DataFrame:
    """Q15."""
    return prices.select("company_id", "banner_id").distinct().join(companies, ["company_id", "banner_id"], "left_anti")


def market_promos_above_verified(valid: DataFrame, calibration: DataFrame) -> DataFrame:
    """Q16: market promos above the largest verified discount."""
    return valid.filter("evidence = 'mercado'").join(F.broadcast(calibration.select("data_date", "max_discount")), "data_date").filter("discount_pct > max_discount")


def unverified_promos_above(valid: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Q16: unverified promos above the ceiling."""
    return valid.filter((F.col("evidence") == "sin_verificar") & (F.col("discount_pct") > p.promo_max_unverified_pct))


def verified_promos_hidden(evidence: DataFrame, valid: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Q16: legend-verified promos that aren't among the valid ones."""
    keys = ["product_id", "company_id", "banner_id", "store_id", "promo_kind", "data_date"]
    return evidence.filter((F.col("evidence") == "leyenda") & (F.col("discount_pct") >= p.promo_min_pct)).join(valid.select(*keys), keys, "left_anti")


def latest_date_invalid(prices: DataFrame) -> DataFrame:
    """Q17: one row for each failed test of the latest date."""
    latest = prices.agg(F.max("data_date").alias("data_date"))
    day = prices.join(F.broadcast(latest), "data_date")
    tests = {
        "empty": F.count("*") == 0,
        "null ids": F.count_if(F.col("product_id").isNull() | F.col("store_id").isNull() | F.col("company_id").isNull()) > 0,
        "null prices": F.count_if(F.col("price").isNull()) > 0,
        "unknown units": F.count_if(F.col("unit").isNotNull() & ~F.col("unit").isin("g", "cc", "unidad")) > 0,
    }
    failed = day.agg(F.array_compact(F.array(*(F.when(cond, name) for name, cond in tests.items()))).alias("f"))
    return failed.select(F.explode("f").alias("failed"))


def units_unrecognised(raw: DataFrame, staged_unit, most: float = 0.02) -> DataFrame:
    """Q18: one row if too many written units have no normal form. staged_unit: the normalised unit of a raw row."""
    written = raw.filter(declared_unit(F.col("declared_unit")) != "")
    return written.agg(F.count_if(staged_unit.isNull()).alias("unrecognised"), F.count("*").alias("rows")).filter(F.col("unrecognised") > F.col("rows") * most)
