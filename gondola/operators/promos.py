"""Promotions: evidence, validity, regional and map outputs, offers near a point."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions.geo import planar_km, within_km
from gondola.functions.stats import money, quantile
from gondola.functions.text import declared_discount, multi_buy, percent_off, valid_until
from gondola.params import DEFAULTS, Params
from gondola.sources.work import numbered, written


def unpivot_promos(raw: DataFrame) -> DataFrame:
    """One row for each of the two promo prices that is below the list price."""
    rows = raw.select("*", F.explode(F.array(*(F.struct(F.lit(f"promo{k}").alias("kind"), F.col(f"promo{k}_price").alias("price"), F.col(f"promo{k}_legend").alias("legend")) for k in (1, 2)))).alias("x"))
    rows = rows.withColumns({"promo_price": F.col("x.price"), "legend": F.col("x.legend"), "promo_kind": F.col("x.kind")})
    return rows.drop("x", *(f"promo{k}_{c}" for k in (1, 2) for c in ("price", "legend"))).filter("promo_price > 0 AND promo_price < list_price")


def promo_evidence(raw: DataFrame, date) -> DataFrame:
    """Each promo of a date with its discount, what its legend declares, the cheapest list price in another company,
    and the level of evidence. Two cheapest companies per product serve all companies."""
    base = raw.filter(F.col("data_date") == F.lit(date).cast("date"))
    for c in ("list_price", "promo1_price", "promo2_price"):
        base = base.withColumn(c, F.col(c).try_cast("double"))
    base = base.filter("list_price > 1")
    cheapest = base.groupBy("product_id", "company_id").agg(F.min("list_price").alias("low"))
    w = Window.partitionBy("product_id").orderBy("low", "company_id")
    two = cheapest.withColumn("n", F.row_number().over(w)).filter("n <= 2").groupBy("product_id").agg(F.max(F.when(F.col("n") == 1, F.col("company_id"))).alias("first"), F.max(F.when(F.col("n") == 1, F.col("low"))).alias("low1"), F.max(F.when(F.col("n") == 2, F.col("low"))).alias("low2"))
    rows = unpivot_promos(base).join(two, "product_id", "left")
    rows = rows.withColumns(
        {
            "discount_pct": percent_off(F.col("list_price"), F.col("promo_price")),
            "declared_pct": declared_discount(F.col("legend")),
            "multi_buy": multi_buy(F.col("legend")),
            "market_reference": F.when(F.col("first") != F.col("company_id"), F.col("low1")).otherwise(F.col("low2")),
        }
    ).drop("first", "low1", "low2")
    level = F.when(F.abs(F.col("declared_pct") - F.col("discount_pct")) <= 3, "leyenda").when(F.col("market_reference").isNotNull(), "mercado").otherwise("sin_verificar")
    return rows.withColumns({"evidence": level, "market_ratio": F.try_divide("promo_price", "market_reference")})


def valid_promos(evidence: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Discounts that their evidence allows."""
    market = (F.col("market_ratio") >= p.promo_min_market_ratio) & (F.col("discount_pct") <= p.promo_max_market_pct)
    allowed = F.when(F.col("evidence") == "leyenda", True).when(F.col("evidence") == "mercado", market).otherwise(F.col("discount_pct") <= p.promo_max_unverified_pct)
    return evidence.filter((F.col("discount_pct") >= p.promo_min_pct) & allowed)


def promo_calibration(evidence: DataFrame) -> DataFrame:
    """What legend-verified promos say about plausible ratios and discounts, per date."""
    rows = evidence.withColumns({"v_ratio": F.when(F.col("evidence") == "leyenda", F.col("market_ratio")), "v_pct": F.when(F.col("evidence") == "leyenda", F.col("discount_pct"))})
    return rows.groupBy("data_date").agg(F.count_if(F.col("evidence") == "leyenda").alias("verified"), F.count("v_ratio").alias("verified_with_market"), quantile("v_ratio", 0.001).alias("ratio_p001"), quantile("v_pct", 0.999).alias("discount_p999"), F.max("v_pct").alias("max_discount"))


_PROMO = ["product_id", "description", "brand", "list_price", "promo_price", "discount_pct", "legend", "promo_kind", "data_date", "evidence", "multi_buy"]


def current_promos(valid: DataFrame, categories: DataFrame, stores: DataFrame, companies: DataFrame) -> DataFrame:
    """Valid promos by chain and province, with the number of stores."""
    rows = valid.join(categories.select("product_id", "category", "section"), "product_id", "left").join(stores.select("company_id", "store_id", "province"), ["company_id", "store_id"], "left").join(companies.select("company_id", "banner_id", "chain"), ["company_id", "banner_id"], "left")
    return rows.groupBy(*_PROMO, "category", "section", "chain", "province").agg(F.countDistinct("store_id").alias("stores"))


def map_promos(valid: DataFrame, map_stores: DataFrame, categories: DataFrame) -> DataFrame:
    """One row for each promo of a company with its stores that are on the map."""
    key = F.concat_ws("-", "company_id", "store_id")
    rows = valid.withColumn("store_key", key).join(map_stores.select("store_key"), "store_key").join(categories.select("product_id", "category", "section"), "product_id", "left")
    return rows.groupBy("company_id", *_PROMO, "category", "section").agg(F.sort_array(F.collect_set("store_key")).alias("stores")).drop("company_id")


def promo_listing(promos: DataFrame, n: int = 20, category: str | None = None, chain: str | None = None, province: str | None = None) -> DataFrame:
    """The n largest discounts; equal offers of several provinces are one row with the province of most stores."""
    for column, value in (("category", category), ("chain", chain), ("province", province)):
        promos = promos if value is None else promos.filter(F.col(column) == value)
    keys = ["product_id", "description", "brand", "category", "section", "chain", "list_price", "promo_price", "discount_pct", "legend", "evidence"]
    rows = promos.groupBy(*keys).agg(F.max_by("province", F.struct("stores", "province")).alias("province"), F.countDistinct("province").alias("provinces"), F.sum("stores").alias("stores"))
    return rows.orderBy(F.col("discount_pct").desc(), "product_id", "chain", "list_price", "promo_price", "legend").limit(n)


def promos_in_box(promos: DataFrame, map_stores: DataFrame, boxes: DataFrame, limit: int = 100) -> DataFrame:
    """Promos with stores in each box (box_id, south, north, west, east, province, text; null limits don't count): the
    first `limit` by discount, then price, with whether there are more."""
    inside = F.coalesce(F.col("lat").between(F.col("south"), F.col("north")), F.lit(True)) & F.coalesce(F.col("lon").between(F.col("west"), F.col("east")), F.lit(True)) & F.coalesce(F.col("province") == F.col("box_province"), F.lit(True))
    stores = map_stores.select("store_key", "lat", "lon", "province").join(F.broadcast(boxes.withColumnRenamed("province", "box_province")), inside).select("box_id", "store_key", "text")
    rows = promos.withColumn("store_key", F.explode("stores")).drop("stores").join(stores, "store_key").filter(F.coalesce(F.contains(F.lower("description"), F.lower("text")), F.lit(True)))
    keys = ["box_id", *[c for c in promos.columns if c != "stores"]]
    found = rows.groupBy(*keys).agg(F.sort_array(F.collect_set("store_key")).alias("stores"), F.countDistinct("store_key").alias("total_stores"))
    w = Window.partitionBy("box_id")
    order = w.orderBy(F.col("discount_pct").desc(), "promo_price", "description", "product_id", "list_price", "legend", "promo_kind")
    return found.withColumns({"rank": F.row_number().over(order), "has_more": F.count("*").over(w) > limit}).filter(F.col("rank") <= limit)


def _near_stores(map_stores: DataFrame, points: DataFrame, km: float) -> DataFrame:
    places = map_stores.select("store_key", "chain", F.col("lat").alias("place_lat"), F.col("lon").alias("place_lon")).filter("place_lat IS NOT NULL AND place_lon IS NOT NULL")
    return within_km(points, places, km, distance=planar_km)


def promos_near(promos: DataFrame, map_stores: DataFrame, requests: DataFrame, day: str, p: Params = DEFAULTS, per_product: int = 3) -> DataFrame:
    """For requests (point_id, lat, lon, product_id), unexpired promos within near_km: the cheapest of each chain with
    its nearest store, and the best per_product of them."""
    until = valid_until(F.col("legend"))
    offers = promos.withColumn("valid_until", until).filter(F.coalesce(F.col("valid_until") >= day, F.lit(True))).withColumn("promo_row", F.xxhash64("product_id", "list_price", "promo_price", "legend", "promo_kind", F.array_join("stores", ",")))
    near = _near_stores(map_stores, requests.select("point_id", "lat", "lon").distinct(), p.near_km).select("point_id", "store_key", "chain", "distance_km")
    asked = requests.select("point_id", "product_id").distinct()
    rows = offers.join(asked, "product_id").withColumn("store_key", F.explode("stores")).join(near, ["point_id", "store_key"])
    nearest = Window.partitionBy("point_id", "product_id", "promo_row").orderBy("distance_km", "store_key")
    rows = rows.withColumns({"n": F.row_number().over(nearest), "other_stores": F.count("*").over(Window.partitionBy("point_id", "product_id", "promo_row")) - 1}).filter("n = 1").withColumn("distance_km", F.round("distance_km", 1))
    best = Window.partitionBy("point_id", "product_id", "chain").orderBy("promo_price", "distance_km", "store_key", "promo_row")
    rows = rows.withColumn("n", F.row_number().over(best)).filter("n = 1")
    order = Window.partitionBy("point_id", "product_id").orderBy("promo_price", "distance_km", "chain")
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_product)
    return rows.select("point_id", "product_id", "rank", "chain", "store_key", "distance_km", "other_stores", "list_price", "promo_price", "discount_pct", "legend", "evidence", "valid_until", "multi_buy")


def _whole_lists(wanted: DataFrame, prices: DataFrame) -> DataFrame:
    """(list_id, chain, product_id, quantity, median_price) of the lists (list_id, product_id, quantity) and chains that price
    all of a list. Lists are gathered with the numbers of their products' chains alone; prices join what is left."""
    numbers = numbered(prices, "chain")
    sold = prices.join(numbers, "chain").groupBy("product_id").agg(F.array_sort(F.collect_set("c")).alias("cs"))
    items = wanted.join(sold, "product_id", "left").select("list_id", F.struct("product_id", "quantity", F.coalesce("cs", F.array().cast("array<smallint>")).alias("cs")).alias("item"))
    gathered = items.groupBy("list_id").agg(F.collect_list("item").alias("items"))
    common = F.aggregate("items", F.get("items", F.lit(0))["cs"], lambda found, i: F.array_intersect(found, i["cs"]))
    whole = gathered.select("list_id", F.explode(common).alias("c"), "items").select("list_id", "c", F.explode("items").alias("i"))
    return whole.select("list_id", "c", "i.product_id", "i.quantity").join(numbers, "c").drop("c").join(prices, ["product_id", "chain"])


def list_total_with_promos(lists: DataFrame, same: DataFrame, promos: DataFrame, map_stores: DataFrame, points: DataFrame, day: str, p: Params = DEFAULTS) -> DataFrame:
    """For each list (list_id, product_id, quantity) and chain that prices all of it, the near store with the lowest
    total of min(list price, promo without multi-buy); points: list_id, lat, lon.

    A store where no promo beats a list's prices asks for the chain's total, as do all its like: the nearest store stands for
    them, and lists meet only such stores beside it as offer one of their products for less.
    """
    wanted = lists.repartition("product_id").groupBy("list_id", "product_id").agg(F.max("quantity").alias("quantity"))
    prices = same.filter("credible AND format = 'supermercado'").select("product_id", "chain", "median_price")
    # Read for totals and for what promos save.
    whole = written(_whole_lists(wanted, prices), "whole")
    exact = lambda price: (price * F.col("quantity")).cast("decimal(24,6)")
    totals = whole.groupBy("list_id", "chain").agg(F.sum(exact(F.col("median_price"))).alias("listed"))
    homes = points.select("list_id", "lat", "lon").distinct()
    near = written(_near_stores(map_stores, homes.select("lat", "lon").distinct(), p.near_km), "near")
    nearest = near.groupBy("lat", "lon", "chain").agg(F.min(F.struct("distance_km", "store_key")).alias("s")).select("lat", "lon", "chain", "s.distance_km", "s.store_key")

    until = valid_until(F.col("legend"))
    offers = promos.filter("NOT multi_buy").withColumn("valid_until", until).filter(F.coalesce(F.col("valid_until") >= day, F.lit(True))).select("product_id", F.explode("stores").alias("store_key"), "promo_price", "valid_until")
    offers = offers.groupBy("product_id", "store_key").agg(F.min(F.struct("promo_price", "valid_until")).alias("offer")).select("product_id", "store_key", "offer.*")
    stores = near.select("store_key", "chain", "place_lat", "place_lon").distinct()
    below = offers.join(stores, "store_key").join(prices, ["product_id", "chain"]).filter("promo_price < median_price").drop("median_price")
    saved = within_km(whole.join(homes, "list_id"), below, p.near_km, distance=planar_km, on=("product_id", "chain"))
    saved = saved.groupBy("list_id", "chain", "lat", "lon", "store_key", "distance_km").agg(F.sum(exact(F.col("promo_price")) - exact(F.col("median_price"))).alias("saving"), F.count("*").alias("items_on_promo"), F.min("valid_until").alias("valid_until"))
    plain = totals.select("list_id", "chain").join(homes, "list_id").join(nearest, ["lat", "lon", "chain"])
    plain = plain.withColumns({"saving": F.lit(0).cast("decimal(35,6)"), "items_on_promo": F.lit(0).cast("long"), "valid_until": F.lit(None).cast("string")})
    rows = saved.unionByName(plain).drop("lat", "lon").join(totals, ["list_id", "chain"])
    cents = lambda amount: F.round(amount, 2).cast("double")
    rows = rows.withColumns({"total_with_promos": cents(F.col("listed") + F.coalesce("saving", F.lit(0))), "total_list": cents(F.col("listed"))})
    # The nearest store is there twice if it has offers, and last without them.
    w = Window.partitionBy("list_id", "chain").orderBy("total_with_promos", "distance_km", "store_key", F.col("items_on_promo").desc())
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").select("list_id", "chain", "store_key", F.round("distance_km", 2).alias("distance_km"), "total_with_promos", "total_list", "items_on_promo", "valid_until")


def promos_per_store(promos: DataFrame, map_stores: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Mean number of promos of a chain's stores; chains below the limit rarely report."""
    counts = promos.select(F.explode("stores").alias("store_key")).groupBy("store_key").agg(F.count("*").alias("n"))
    rows = map_stores.select("store_key", "chain").join(counts, "store_key", "left")
    out = rows.groupBy("chain").agg((F.sum(F.coalesce("n", F.lit(0))) / F.count("*")).alias("promos_per_store"))
    return out.withColumn("rarely_reports", F.col("promos_per_store") < p.few_promos_per_store)


def worthwhile_promos(near: DataFrame, zone_prices: DataFrame) -> DataFrame:
    """Promos below the zone's cheapest price (point_id, product_id, zone_price); without such a price all stay."""
    return near.join(zone_prices, ["point_id", "product_id"], "left").filter(F.col("zone_price").isNull() | (F.col("promo_price") < F.col("zone_price"))).drop("zone_price")
