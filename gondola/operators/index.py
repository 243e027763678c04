"""The price index of a month: links of days, chains, market, basket contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.functions.stats import geometric_mean, lower_median, product
from gondola.params import DEFAULTS, Params


def month_chain(history: DataFrame, month: str | None = None) -> DataFrame:
    """The links (data_date, base_date) from the month's last date back, while the base is in the month; the last link
    may end in the month before. A gap cuts the chain. month: yyyy-mm, or None for the latest. The distinct links are one or
    two a day, whatever the number of prices, so one row holds them and folds them into the chain; no job runs before the
    result's own."""
    links = history.filter("factor IS NOT NULL").select("data_date", "base_date")
    if month is not None:
        links = links.filter(F.date_format("data_date", "yyyy-MM") == month)
    link = "struct<data_date:date,base_date:date>"
    one = links.agg(F.sort_array(F.collect_set(F.struct("data_date", "base_date")), asc=False).alias("links")).withColumn("last", F.get("links", F.lit(0))["data_date"]).withColumn("month", F.trunc("last", "month"))

    def step(acc, x):
        reached = F.when(x["base_date"] >= F.col("month"), F.array_append(acc["reached"], x["base_date"])).otherwise(acc["reached"])
        return F.when(F.array_contains(acc["reached"], x["data_date"]), F.struct(reached.alias("reached"), F.array_append(acc["chain"], x).alias("chain"))).otherwise(acc)

    none = F.struct(F.array("last").alias("reached"), F.array().cast(f"array<{link}>").alias("chain"))
    # Bases lie before their dates, so from the last date back each link comes after the one that leads to it.
    walked = one.withColumn("chain", F.aggregate("links", none, step, lambda acc: acc["chain"]))
    start = F.array_min(F.transform("chain", lambda x: x["base_date"]))
    whole = walked.select(F.explode("chain").alias("x"), start.alias("period_start"), F.col("last").alias("period_end"), F.size("chain").cast("long").alias("expected_links"), "month")
    return whole.select("x.data_date", "x.base_date", "period_start", "period_end", "expected_links", "month", (F.col("period_start") < F.col("month")).alias("from_month_start"))


def _linked(history: DataFrame, month: str | None) -> DataFrame:
    return history.filter("factor IS NOT NULL").join(F.broadcast(month_chain(history, month)), ["data_date", "base_date"])


def chain_inflation(history: DataFrame, month: str | None = None) -> DataFrame:
    """Change of each category, chain and unit over the month's links; series that miss a link are left out."""
    series = _linked(history, month).groupBy("category", "chain", "unit", "period_start", "period_end", "expected_links").agg(product("factor").alias("total"), F.count("*").alias("links")).filter("links = expected_links")
    now = history.select("category", "chain", "unit", F.col("data_date").alias("period_end"), F.col("median_unit_price").alias("current_price"))
    return series.join(now, ["category", "chain", "unit", "period_end"], "left").select("category", "chain", "unit", "current_price", F.round((F.col("total") - 1) * 100, 2).alias("change_pct"), "period_start", "period_end")


def market_factors(history: DataFrame, chain_map: DataFrame, month: str | None = None, p: Params = DEFAULTS) -> DataFrame:
    """Per category the market's factor over the month: each day the geometric mean of its series, with enough companies."""
    owners = chain_map.groupBy("chain").agg(F.min("company_id").alias("company_id"))
    rows = _linked(history, month).join(F.broadcast(owners), "chain", "left").withColumn("company", F.coalesce("company_id", "chain"))
    period = ["period_start", "period_end", "month", "from_month_start", "expected_links"]
    daily = rows.groupBy("category", "data_date", *period).agg(geometric_mean("factor").alias("factor"), F.count("*").alias("series"), F.countDistinct("chain").alias("chains"), F.countDistinct("company").alias("companies"))
    daily = daily.filter(F.col("companies") >= p.min_market_companies)
    out = daily.groupBy("category", *period).agg(product("factor").alias("total"), F.count("*").alias("links"), F.round(F.avg("series")).cast("long").alias("series"), F.min("chains").alias("chains"), F.min("companies").alias("companies"))
    return out.filter("links = expected_links")


def market_inflation(history: DataFrame, chain_map: DataFrame, month: str | None = None, p: Params = DEFAULTS) -> DataFrame:
    """Change of each category in the market over the month."""
    rows = market_factors(history, chain_map, month, p)
    return rows.select("category", F.round((F.col("total") - 1) * 100, 2).alias("change_pct"), "series", "chains", "companies", "period_start", "period_end", "month", "from_month_start")


def basket_spending(history: DataFrame, chain_map: DataFrame, basket: DataFrame, month: str | None = None, p: Params = DEFAULTS) -> DataFrame:
    """category, spending (basket quantity times the price level at the period's start), factor and chains; either may be
    null."""
    chain = month_chain(history, month).select("period_start").distinct()
    levels = history.filter("median_unit_price IS NOT NULL").join(F.broadcast(chain), F.col("data_date") == F.col("period_start")).groupBy("category", "unit").agg(lower_median("median_unit_price").alias("level"))
    market = market_factors(history, chain_map, month, p).select("category", F.col("total").alias("factor"), "chains")
    return basket.join(levels, ["category", "unit"], "left").join(market, "category", "left").select("category", (F.col("quantity") * F.col("level")).alias("spending"), "factor", "chains")


def contributions(spending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Laspeyres contributions of categories with price and index, which add up to the basket's change; and one summary
    row with the share of spending that they cover and the categories without index or price."""
    both = spending.filter("spending IS NOT NULL AND factor IS NOT NULL")
    total = both.agg(F.sum("spending").alias("total"))
    change = F.col("factor") - 1
    weight = F.col("spending") / F.col("total")
    rows = both.crossJoin(F.broadcast(total)).select("category", (weight * 100).alias("weight_pct"), (change * 100).alias("change_pct"), (weight * change * 100).alias("contribution_pp"), "chains")
    measured = F.col("spending").isNotNull() & F.col("factor").isNotNull()
    lists = lambda cond: F.sort_array(F.collect_set(F.when(cond, F.col("category"))))
    summary = spending.agg(
        (F.sum(F.when(measured, F.col("spending") * change)) / F.sum(F.when(measured, F.col("spending"))) * 100).alias("basket_change_pct"),
        (F.sum(F.when(measured, F.col("spending"))) / F.sum("spending") * 100).alias("coverage_pct"),
        lists(F.col("spending").isNotNull() & F.col("factor").isNull()).alias("no_index"),
        lists(F.col("spending").isNull()).alias("no_price"),
    )
    return rows, summary


def overall_movement(market: DataFrame) -> DataFrame:
    """Series-weighted geometric mean change of all categories; how many rose, fell or stayed."""
    w = F.sum(F.col("series") * F.log(1 + F.col("change_pct") / 100)) / F.sum("series")
    return market.agg(((F.exp(w) - 1) * 100).alias("overall_pct"), F.count_if(F.col("change_pct") >= 0.005).alias("up"), F.count_if(F.col("change_pct") <= -0.005).alias("down"), F.count_if(F.abs("change_pct") < 0.005).alias("unchanged"), F.max(F.datediff("period_end", "period_start")).alias("days"))
