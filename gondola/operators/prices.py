"""Prices by product, chain, category, place and day (K1, K2, K10-K23). Facts shuffle on product keys; dimensions stay small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions.stats import geometric_mean, group_limits, lower_median, median, ranked_slices, select_ranks
from gondola.functions.text import competes_in, effective_qty, package_size, pieces_in_text, reasonable_qty
from gondola.params import DEFAULTS, Params
from gondola.sources.ingest import append_history

OTHER = "Otros"


def stage_prices(raw: DataFrame) -> DataFrame:
    """K1: typed prices above 1 with a normalised package size; a narrow projection."""
    qty, unit = package_size(F.col("declared_qty"), F.col("declared_unit"), F.col("description"))
    price = F.col("list_price").try_cast("double")
    return raw.select("company_id", "banner_id", "store_id", "product_id", price.alias("price"), "data_date", qty.alias("qty"), unit.alias("unit")).filter("price > 1")


def current_categories(classified: DataFrame) -> DataFrame:
    """K2: the newest classification of each product; rows without a time are oldest."""
    w = Window.partitionBy("product_id").orderBy(F.col("classified_at").desc_nulls_last(), "category", "description")
    return classified.withColumn("n", F.row_number().over(w)).filter("n = 1").select("product_id", "description", "brand", "category", "section")


def product_chain_prices(prices: DataFrame, companies: DataFrame) -> DataFrame:
    """Prices of a product in a chain on a day. Companies join on company and banner. A group has a row for each of the
    chain's stores, so its prices are gathered once and sorted; that takes one shuffle, where a distinct count beside exact
    medians would take two and keep a tree for each group."""
    rows = prices.join(companies.select("company_id", "banner_id", "chain", "format"), ["company_id", "banner_id"])
    gathered = rows.groupBy("data_date", "product_id", "chain").agg(
        F.min("company_id").alias("company_id"), F.min("format").alias("format"), F.sort_array(F.collect_list("price")).alias("paid"), F.collect_set("store_id").alias("stores"), F.sort_array(F.collect_list("qty")).alias("sizes"), F.min("unit").alias("unit")
    )
    middle = lambda c: F.get(c, F.floor((F.size(c) - 1) / 2).cast("int"))
    return gathered.select(
        "data_date", "product_id", "chain", "company_id", "format", middle("paid").alias("median_price"), F.get("paid", F.lit(0)).alias("min_price"), F.get("paid", F.size("paid") - 1).alias("max_price"),
        F.size("stores").cast("long").alias("stores"), middle("sizes").alias("qty"), "unit",
    )


def with_package(categories: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Categories with per_piece and the pieces of their description."""
    per_piece = F.coalesce(F.col("category").isin(*p.per_piece_categories), F.lit(False))
    return categories.withColumn("per_piece", per_piece).withColumn("pieces", F.when(per_piece, pieces_in_text(F.col("description"))))


def product_tiers(prices: DataFrame, categories: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Tercile of the unit price within category and unit, over all dates; equal prices by product_id. The two rows that
    end a tercile are selected by rank, so no task holds a category."""
    qty = effective_qty(F.col("qty"), F.col("unit"), F.col("per_piece"), F.col("pieces"))
    usable = F.col("qty").isNotNull() & reasonable_qty(F.col("qty"), F.col("unit"), F.col("per_piece"), F.col("pieces"))
    rows = prices.join(with_package(categories, p), "product_id").filter(usable).filter(F.col("category") != OTHER).withColumn("per_unit", F.col("price") / qty)
    one = rows.groupBy("product_id", "unit").agg(*(F.min(c).alias(c) for c in ("category", "section", "per_piece", "pieces")), lower_median("price").alias("median_price"), lower_median("per_unit").alias("unit_price"))
    keys, order = ["category", "unit"], ["unit_price", "product_id"]
    one = ranked_slices(one, keys, order)
    third = lambda k: lambda n: F.floor(n / 3) * k + F.least(n % 3, F.lit(k))
    bounds = select_ranks(one, keys, order, {"first": third(1), "second": third(2)})
    at = F.struct(*order)
    tier = F.when(at <= F.col("first"), "economico").when(at <= F.coalesce("second", "first"), "medio").otherwise("premium")
    return one.join(bounds, keys).select("product_id", "category", "section", "median_price", "unit_price", "unit", "per_piece", "pieces", tier.alias("tier"))


def unit_prices(prices: DataFrame, categories: DataFrame, tiers: DataFrame, companies: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Prices per unit with category, tier and chain; what both index branches start from."""
    keyed = tiers.select("product_id", "unit", "per_piece", "pieces", "tier")
    rows = prices.join(categories.filter(F.col("category") != OTHER).select("product_id", "category", "section"), "product_id").join(keyed, ["product_id", "unit"]).join(companies.select("company_id", "banner_id", "chain", "format"), ["company_id", "banner_id"])
    size = (F.col("qty"), F.col("unit"), F.col("per_piece"), F.col("pieces"))
    rows = rows.filter(F.col("qty").isNotNull() & reasonable_qty(*size) & competes_in(F.col("format"), F.col("section"), p))
    return rows.withColumn("unit_price", F.col("price") / effective_qty(*size))


def chain_category_levels(rows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """From unit_prices, the economy level of a chain in a category, inside the category's 10 % and 90 % limits."""
    rows = rows.filter("tier = 'economico'")
    inside = rows.join(group_limits(rows, ["category", "data_date"], "unit_price"), ["category", "data_date"]).filter("unit_price BETWEEN low AND high")
    level = inside.groupBy("category", "chain", "unit", "data_date").agg(lower_median("unit_price").alias("median_unit_price"), F.count("*").alias("samples"))
    return level.filter(F.col("samples") >= p.min_samples_chain)


def paired_price_index(rows: DataFrame, date_pairs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """From unit_prices and pairs (data_date, base_date), the geometric mean of each product's price against its own
    price on the base date."""
    keys = ["category", "chain", "unit", "product_id"]
    day = rows.groupBy(*keys, "data_date").agg(lower_median("unit_price").alias("unit_price"))
    base = day.select(*keys, F.col("data_date").alias("base_date"), F.col("unit_price").alias("base_price")).filter("base_price > 0")
    relative = day.join(F.broadcast(date_pairs.filter("base_date IS NOT NULL")), "data_date").join(base, [*keys, "base_date"]).withColumn("relative", F.col("unit_price") / F.col("base_price"))
    kept = relative.filter(F.col("relative").between(p.relative_low, p.relative_high))
    out = kept.groupBy("category", "chain", "unit", "data_date", "base_date").agg(geometric_mean("relative").alias("factor"), F.count("*").alias("paired_products"))
    return out.filter(F.col("paired_products") >= p.min_paired_products)


def chain_category_mart(levels: DataFrame, index: DataFrame) -> DataFrame:
    """Levels and index side by side; rows of either alone stay."""
    keys = ["category", "chain", "unit", "data_date"]
    return levels.join(index, keys, "full").select(*keys, "median_unit_price", "samples", "base_date", "factor", "paired_products")


def index_history_update(batch: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of the batch to write: dates with at least one factor, and dates that the history lacks."""
    measured = batch.filter("factor IS NOT NULL").select("data_date").distinct()
    new = batch.select("data_date").distinct().join(history.select("data_date").distinct(), "data_date", "left_anti")
    return batch.join(F.broadcast(measured.unionByName(new).distinct()), "data_date", "left_semi")


def who_wins(product_chain: DataFrame, categories: DataFrame, p: Params = DEFAULTS, keys: tuple[str, ...] = ("data_date",)) -> DataFrame:
    """How often each chain is cheapest among products that at least two chains offer; ties count for all. keys: what
    a comparison stays within."""
    cats = categories.select("product_id", "category", "section")
    rows = product_chain.join(cats, "product_id", "left").filter(competes_in(F.col("format"), F.col("section"), p))
    return _wins(rows, p, keys)


def _wins(rows: DataFrame, p: Params, keys: tuple[str, ...]) -> DataFrame:
    product = Window.partitionBy(*keys, "product_id")
    # Smallest and largest chain differ exactly where at least two chains offer the product.
    rows = rows.withColumns({"lowest": F.min("median_price").over(product), "one": F.min("chain").over(product), "other": F.max("chain").over(product)}).filter("one <> other")
    rows = rows.filter(F.col("category").isNotNull() & (F.col("category") != OTHER))
    won = F.countDistinct(F.when(F.col("median_price") == F.col("lowest"), F.col("product_id")))
    chains = rows.groupBy(*keys, "category", "section", "chain").agg(won.alias("won"), F.countDistinct("product_id").alias("offered"))
    totals = rows.groupBy(*keys, "category").agg(F.countDistinct("product_id").alias("total"))
    out = chains.filter((F.col("won") > 0) & (F.col("offered") >= p.min_offered)).join(totals, [*keys, "category"])
    return out.select("category", "section", "chain", "won", "offered", "total", F.round(F.col("won") / F.col("total") * 100, 1).alias("pct_wins"), F.round(F.col("won") / F.col("offered") * 100, 1).alias("pct_wins_when_offered"), *keys)


def carried_prices(product_chain: DataFrame, date, p: Params = DEFAULTS) -> DataFrame:
    """Each chain's prices of its latest day within the carry window; data_date is the asked date, price_date the day."""
    day = F.lit(date).cast("date")
    recent = product_chain.filter(F.col("data_date").between(F.date_sub(day, p.carry_days), day)).withColumnRenamed("data_date", "price_date")
    latest = recent.groupBy("chain").agg(F.max("price_date").alias("price_date"))
    return recent.join(F.broadcast(latest), ["chain", "price_date"]).withColumn("data_date", day)


def _middle(values: Column) -> Column:
    """The mean of the two middle values of an array; null without values."""
    ordered = F.array_sort(values)
    at = lambda i: F.get(ordered, F.floor(i).cast("int"))
    return at((F.size(ordered) - 1) / 2) * 0.5 + at(F.size(ordered) / 2) * 0.5


def _assessed(product_chain: DataFrame, date, p: Params = DEFAULTS) -> DataFrame:
    """One row a product: data_date, the market reference, and `offers`, its chains' carried prices with in_range and credible
    (J9, A18). A product has at most as many offers as there are chains, so one aggregation by product holds all that its
    comparison needs."""
    fields = ["chain", "company_id", "format", "price_date", "median_price", "min_price", "max_price", "stores", "qty", "unit"]
    rows = carried_prices(product_chain, date, p)
    by_product = rows.groupBy("product_id").agg(F.min("data_date").alias("data_date"), F.collect_list(F.struct(*fields)).alias("offers"))
    prices_of = lambda c: F.transform(F.filter("offers", lambda o: o["company_id"].eqNullSafe(c)), lambda o: o["median_price"])
    companies = F.transform(F.array_distinct(F.transform("offers", lambda o: o["company_id"])), lambda c: _middle(prices_of(c)))
    market = by_product.withColumn("by_company", companies).withColumn("reference", F.when(F.size("by_company") >= p.min_reference_companies, _middle(F.col("by_company"))))

    def with_range(o: Column) -> Column:
        inside = o["median_price"].between(F.col("reference") * p.credible_low, F.col("reference") * p.credible_high)
        return F.struct(*(o[c].alias(c) for c in fields), F.coalesce(inside, F.lit(True)).alias("in_range"))

    ranged = market.withColumn("offers", F.transform("offers", with_range))

    def confirmed(a: Column) -> Column:
        agrees = lambda o: (o["chain"] != a["chain"]) & (F.abs(o["median_price"] - a["median_price"]) <= a["median_price"] * p.agreement_tolerance) & ((o["company_id"] != a["company_id"]) | o["in_range"])
        return F.coalesce(F.exists("offers", agrees), F.lit(False))

    credible = F.transform("offers", lambda a: a.withField("credible", a["in_range"] | confirmed(a)))
    # Exploded as the one element of an array, the offers are computed once; a plain column's expression would be put into
    # each of its uses, filters included.
    return ranged.select("data_date", "product_id", "reference", F.explode(F.array(credible)).alias("offers"))


def assessed_prices(product_chain: DataFrame, date, p: Params = DEFAULTS) -> DataFrame:
    """Carried prices with the market reference, in_range and credible."""
    return _assessed(product_chain, date, p).select("data_date", "product_id", F.explode("offers").alias("o"), "reference").select("data_date", "product_id", "o.*", "reference")


def _size_vote(offers: Column) -> Column:
    """The package size (qty, unit) that most companies, then most stores, report; measures before counts."""
    said = F.filter(offers, lambda o: o["qty"].isNotNull() & o["unit"].isNotNull())

    def ranked(size: Column) -> Column:
        mine = F.filter(said, lambda o: (o["qty"] == size["qty"]) & (o["unit"] == size["unit"]))
        by = F.size(F.array_distinct(F.transform(mine, lambda o: o["company_id"])))
        in_stores = F.aggregate(mine, F.lit(0).cast("long"), lambda n, o: n + o["stores"])
        return F.struct((size["unit"] == "unidad").alias("counted"), (-by).alias("by"), (-in_stores).alias("in_stores"), size["qty"].alias("qty"), size["unit"].alias("unit"))

    sizes = F.array_distinct(F.transform(said, lambda o: F.struct(o["qty"].alias("qty"), o["unit"].alias("unit"))))
    return F.array_min(F.transform(sizes, ranked))


def product_names(raw: DataFrame, product_ids: DataFrame, date) -> DataFrame:
    """Brand, shortest good description and search text of products on a date."""
    day = raw.filter((F.col("data_date") == F.lit(date).cast("date")) & F.col("description").isNotNull())
    names = day.join(product_ids.select("product_id").distinct(), "product_id", "left_semi").select("product_id", "company_id", F.trim("description").alias("description"), F.upper(F.trim("brand")).alias("brand")).distinct()
    brands = names.filter("brand <> ''").groupBy("product_id", "brand").agg(F.countDistinct("company_id").alias("by"))
    best = brands.groupBy("product_id").agg(F.min_by("brand", F.struct(-F.col("by"), -F.length("brand"), "brand")).alias("top_brand"))
    rows = names.join(best, "product_id", "left")
    has_brand = F.contains(F.upper("description"), F.coalesce("top_brand", F.lit("")))
    order = F.struct((~has_brand).cast("int"), (~F.col("description").rlike("[0-9]")).cast("int"), (F.length("description") > 45).cast("int"), F.length("description"), "description")
    text = F.lower(F.concat("description", F.lit(" "), F.coalesce("brand", F.lit(""))))
    return rows.groupBy("product_id").agg(F.min_by("description", order).alias("description"), F.min("top_brand").alias("brand"), F.substring(F.array_join(F.sort_array(F.collect_set(text)), " "), 1, 1500).alias("search_text"))


def same_product(product_chain: DataFrame, categories: DataFrame, raw: DataFrame | None, date, p: Params = DEFAULTS) -> DataFrame:
    """A product in every chain on a date: credible prices, the lowest and highest of them, size, name. raw: rows with
    product_id, company_id, description, brand and data_date; without it names come from the categories."""
    trusted = F.filter("offers", lambda o: o["credible"])
    paid = F.transform(trusted, lambda o: o["median_price"])
    per_product = _assessed(product_chain, date, p).select(
        "*", _size_vote(F.col("offers")).alias("size"), F.size("offers").cast("long").alias("chains"), F.array_min(paid).alias("lowest"), F.array_max(paid).alias("highest"),
        F.size(F.array_distinct(F.transform(trusted, lambda o: o["company_id"]))).cast("long").alias("companies"), (F.size("offers") - F.size(trusted)).cast("long").alias("chains_discarded"),
    )
    per_product = per_product.filter(F.col("chains") - F.col("chains_discarded") >= 2)
    cats = categories.select("product_id", "category", "section", F.col("description").alias("cat_description"), F.col("brand").alias("cat_brand"))
    out = per_product.join(cats, "product_id")
    if raw is None:
        out = out.select("*", *(F.lit(None).cast("string").alias(c) for c in ("description", "brand", "search_text")))
    else:
        out = out.join(product_names(raw, per_product, date), "product_id", "left")
    offer = ("chain", "company_id", "format", "price_date", "median_price", "min_price", "max_price", "stores", "in_range", "credible")
    out = out.withColumn("o", F.explode("offers")).drop("offers").select("*", F.col("size.qty").alias("qty"), F.col("size.unit").alias("unit"), *(F.col(f"o.{c}").alias(c) for c in offer))
    text = F.lower(F.concat("cat_description", F.lit(" "), F.coalesce("cat_brand", F.lit(""))))
    return out.select(
        "data_date", "price_date", "product_id", F.coalesce("description", "cat_description").alias("description"), F.coalesce("brand", "cat_brand").alias("brand"), F.coalesce("search_text", text).alias("search_text"),
        "category", "section", "chain", F.coalesce("format", F.lit("supermercado")).alias("format"), "median_price", "min_price", "max_price", "stores", "qty", "unit", "credible", "in_range", "reference",
        "chains", "companies", "chains_discarded", "lowest", "highest", F.round((F.col("highest") - F.col("lowest")) / F.col("lowest") * 100, 1).alias("gap_pct"), (F.col("credible") & (F.col("median_price") == F.col("lowest"))).alias("is_cheapest"),
    )


def credible_today(same: DataFrame) -> DataFrame:
    """What K20 compares: a day's credible prices by product and chain."""
    return same.filter("credible AND median_price IS NOT NULL").select("data_date", "price_date", "product_id", "chain", F.col("median_price").alias("price"))


def price_history_update(same: DataFrame, history: DataFrame, date=None, p: Params = DEFAULTS) -> DataFrame:
    """The credible prices of a date (the last of same, if none is given) that differ from the last stored before it, or
    were never stored (J12). It reads the whole history; price_state.advance_price_state does the same from a state table."""
    day = F.lit(credible_today(same).agg(F.max("data_date")).first()[0] if date is None else date).cast("date")
    last = history.filter(F.col("data_date") < day).groupBy("product_id", "chain").agg(F.max_by("price", "data_date").alias("last_price"))
    moved = F.col("last_price").isNull() | (F.abs(F.col("price") - F.col("last_price")) > p.price_epsilon)
    return credible_today(same).filter(F.col("data_date") == day).join(last, ["product_id", "chain"], "left").filter(moved).select("data_date", "price_date", "product_id", "chain", "price")


def recent_price_changes(history: DataFrame, same: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Last stored changes of at least min_change_pct in the last change_days that still hold today."""
    w = Window.partitionBy("product_id", "chain").orderBy(F.col("data_date").desc())
    last = history.withColumns({"n": F.row_number().over(w), "previous_price": F.lead("price").over(w)}).filter("n = 1 AND previous_price > 0").drop("data_date")
    today = same.filter("credible").select("data_date", "product_id", "chain", "median_price")
    move = F.col("price") / F.col("previous_price") - 1
    kept = last.join(today, ["product_id", "chain"]).filter((F.abs(F.col("median_price") - F.col("price")) <= p.price_epsilon) & (F.col("price_date") >= F.date_sub("data_date", p.change_days)) & (F.abs(move) * 100 >= p.min_change_pct))
    return kept.select("product_id", "chain", "price", "previous_price", F.col("price_date").alias("change_date"), F.round(move * 100, 1).alias("change_pct"))


def _placed(prices: DataFrame, categories: DataFrame, tiers: DataFrame, stores: DataFrame, date) -> DataFrame:
    keyed = tiers.select("product_id", "unit", "per_piece", "pieces", "tier")
    size = (F.col("qty"), F.col("unit"), F.col("per_piece"), F.col("pieces"))
    rows = prices.filter(F.col("data_date") == F.lit(date).cast("date")).join(categories.select("product_id", "category"), "product_id").join(keyed, ["product_id", "unit"])
    rows = rows.filter(F.col("qty").isNotNull() & reasonable_qty(*size)).withColumn("unit_price", F.col("price") / effective_qty(*size))
    return rows.join(stores.withColumnRenamed("banner_id", "store_banner"), ["company_id", "store_id"]).filter("locality IS NOT NULL")


def category_locality_prices(prices: DataFrame, categories: DataFrame, tiers: DataFrame, stores: DataFrame, companies: DataFrame, date, p: Params = DEFAULTS) -> DataFrame:
    """Median unit price by category, tier, unit and locality; limits per locality name, whatever its province."""
    markets = companies.filter("format = 'supermercado'").select("company_id", "banner_id")
    rows = _placed(prices, categories, tiers, stores.select("company_id", "store_id", "banner_id", "locality", "province"), date).join(markets, ["company_id", "banner_id"], "left_semi")
    keys = ["category", "tier", "unit", "locality"]
    kept = rows.join(group_limits(rows, keys, "unit_price"), keys).filter("unit_price BETWEEN low AND high")
    out = kept.groupBy(*keys, "province", "data_date").agg(lower_median("unit_price").alias("median_unit_price"), F.count("*").alias("samples"))
    return out.filter(F.col("samples") >= p.min_samples_locality)


def category_store_prices(prices: DataFrame, categories: DataFrame, tiers: DataFrame, stores: DataFrame, companies: DataFrame, date, p: Params = DEFAULTS) -> DataFrame:
    """The same by store with coordinates; limits per locality and province, chain from the store's banner."""
    markets = companies.filter("format = 'supermercado'").select("company_id", F.col("banner_id").alias("store_banner"), "chain")
    rows = _placed(prices, categories, tiers, stores, date).filter("lat IS NOT NULL AND lon IS NOT NULL").join(markets, ["company_id", "store_banner"])
    keys = ["category", "tier", "unit", "locality", "province"]
    kept = rows.join(group_limits(rows, keys, "unit_price"), keys).filter("unit_price BETWEEN low AND high")
    out = kept.groupBy(*keys, "company_id", "store_id", "chain", "name", "street", "number", "lat", "lon", "data_date").agg(lower_median("unit_price").alias("median_unit_price"), F.count("*").alias("samples"))
    return out.filter(F.col("samples") >= p.min_samples_store)


def who_wins_history(wins: DataFrame, dates: list, path: str) -> DataFrame:
    """who_wins of the dates to compute into the history at path; their partitions replace their like, others stay."""
    append_history(wins.filter(F.col("data_date").isin(*dates)), path)
    return wins.sparkSession.read.parquet(path)
