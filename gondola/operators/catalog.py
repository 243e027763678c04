"""Questions over the same-product table: extremes, leaders, savings, rules between banners, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions.stats import geometric_mean, median
from gondola.functions.text import FILLERS, list_line, list_lines, search_form, search_words, searchable_sizes, variants
from gondola.operators.prices import _wins
from gondola.params import DEFAULTS, Params
from gondola.sources.work import small, written

PRODUCT = ["product_id", "description", "brand", "category", "chains", "companies", "lowest", "highest", "gap_pct", "chains_discarded", "qty", "unit"]


def product_summary(same: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One row per product; extremes are backed if a credible chain with enough stores has each of them."""
    solid = F.col("credible") & (F.col("stores") >= p.min_extreme_stores)
    backed = F.bool_or(solid & (F.col("median_price") == F.col("lowest"))) & F.bool_or(solid & (F.col("median_price") == F.col("highest")))
    return same.groupBy(*PRODUCT, "reference", "data_date").agg(F.coalesce(backed, F.lit(False)).alias("extremes_backed"))


def top_differences(summary: DataFrame, n: int = 12, p: Params = DEFAULTS) -> DataFrame:
    """The n products with the largest gap among those with enough companies and backed extremes."""
    rows = summary.filter(F.col("extremes_backed") & (F.col("companies") >= p.min_highlight_companies)).orderBy(F.col("gap_pct").desc(), "description", "product_id").limit(n)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col("gap_pct").desc(), "description", "product_id")))


def carried_chains(same: DataFrame) -> DataFrame:
    """Chains whose prices come from an earlier day."""
    return same.filter("price_date <> data_date").select("chain", "price_date", "data_date").distinct()


def who_wins_in_zone(same: DataFrame, zone_chains: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """who_wins among the chains of each zone (zone_id, chain)."""
    return _wins(same.join(small(zone_chains), "chain"), p, ("zone_id",))


def category_leaders(wins: DataFrame) -> DataFrame:
    """Per category the chains that win most often when they compete, with ties."""
    w = Window.partitionBy("category").orderBy(F.col("pct_wins_when_offered").desc())
    top = wins.withColumn("n", F.rank().over(w)).filter("n = 1")
    return top.groupBy("category").agg(F.sort_array(F.collect_set("chain")).alias("chains"), F.max("pct_wins_when_offered").alias("pct"))


def categories_led(leaders: DataFrame) -> DataFrame:
    return leaders.select(F.explode("chains").alias("chain")).groupBy("chain").agg(F.count("*").alias("categories_led"))


def _comparable(same: DataFrame, summary: DataFrame, p: Params) -> DataFrame:
    keep = summary.filter(F.col("extremes_backed") & (F.col("companies") >= p.min_highlight_companies) & F.col("reference").isNotNull()).select("product_id")
    return same.join(keep, "product_id", "left_semi")


def savings_by_category(same: DataFrame, summary: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Median saving of the cheapest price against the reference, and the chains that are cheapest most often."""
    rows = _comparable(same, summary, p)
    saving = rows.select("category", "product_id", (1 - F.col("lowest") / F.col("reference")).alias("saving")).distinct()
    per = saving.groupBy("category").agg(F.count("*").alias("products"), median("saving").alias("m")).filter(F.col("products") >= p.min_category_products)
    wins = rows.filter("is_cheapest").groupBy("category", "chain").agg(F.countDistinct("product_id").alias("n"))
    top = wins.withColumn("r", F.rank().over(Window.partitionBy("category").orderBy(F.col("n").desc()))).filter("r = 1").groupBy("category").agg(F.sort_array(F.collect_set("chain")).alias("cheapest_chains"), F.max("n").alias("n"))
    return per.join(top, "category").select("category", "products", F.round(F.col("m") * 100, 1).alias("median_saving_pct"), "cheapest_chains", F.round(F.col("n") / F.col("products") * 100, 1).alias("cheapest_pct"))


def cheapest_chains(same: DataFrame, summary: DataFrame, n: int = 5, p: Params = DEFAULTS) -> DataFrame:
    """K65, second table: the n chains that are cheapest for most comparable products."""
    rows = _comparable(same, summary, p)
    total = rows.agg(F.countDistinct("product_id").alias("total"))
    wins = rows.filter("is_cheapest").groupBy("chain").agg(F.countDistinct("product_id").alias("products"))
    return wins.crossJoin(F.broadcast(total)).select("chain", "products", F.round(F.col("products") / F.col("total") * 100, 1).alias("pct")).orderBy(F.col("products").desc(), "chain").limit(n)


def sibling_price_rules(same: DataFrame, chain_map: DataFrame, chains: DataFrame, p: Params = DEFAULTS, least_cheaper: float = 50, most_dearer: float = 5) -> DataFrame:
    """How a chain's prices relate to a sibling banner of its company on the products that both price; the sibling with
    most shared products, where the chain is mostly cheaper and hardly ever dearer."""
    owner = chain_map.select("chain", "company_id").distinct()
    pairs = chains.select("chain").join(owner, "chain").join(owner.withColumnRenamed("chain", "sibling"), "company_id").filter("chain <> sibling").select("chain", "sibling")
    prices = same.filter("credible AND median_price > 0").select("product_id", "chain", "median_price")
    ratios = prices.join(small(pairs), "chain").join(prices.select("product_id", F.col("chain").alias("sibling"), F.col("median_price").alias("sibling_price")), ["product_id", "sibling"]).withColumn("ratio", F.col("median_price") / F.col("sibling_price"))
    tol = p.equal_tolerance
    pct = lambda cond: F.round(F.count_if(cond) / F.count("*") * 100, 1)
    per = ratios.groupBy("chain", "sibling").agg(F.count("*").alias("products"), pct(F.col("ratio") < 1 - tol).alias("pct_cheaper"), pct(F.abs(F.col("ratio") - 1) <= tol).alias("pct_equal"), pct(F.col("ratio") > 1 + tol).alias("pct_dearer")).filter(F.col("products") >= p.min_rule_products)
    w = Window.partitionBy("chain").orderBy(F.col("products").desc(), "sibling")
    rule = per.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n").filter((F.col("pct_cheaper") >= least_cheaper) & (F.col("pct_dearer") <= most_dearer))
    steps = ratios.filter(F.col("ratio") < 1 - tol).groupBy("chain", "sibling", F.round((1 - F.col("ratio")) * 100).cast("int").alias("discount")).agg(F.count("*").alias("k"))
    ranked = steps.withColumn("n", F.row_number().over(Window.partitionBy("chain", "sibling").orderBy(F.col("k").desc(), "discount"))).filter("n <= 3")
    steps = ranked.join(rule.select("chain", "sibling", "products"), ["chain", "sibling"]).groupBy("chain", "sibling").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "discount", F.round(F.col("k") / F.col("products") * 100, 1).alias("pct")))), lambda x: F.struct(x["discount"].alias("discount"), x["pct"].alias("pct"))).alias("steps"))
    return rule.join(steps, ["chain", "sibling"], "left")


def chain_price_levels(same: DataFrame, p: Params = DEFAULTS, least_companies: int = 2) -> DataFrame:
    """Geometric mean of price over reference per chain and category, and per chain (category null)."""
    rows = same.filter((F.col("reference") > 0) & (F.col("companies") >= least_companies) & F.col("credible") & (F.col("median_price") > 0)).withColumn("ratio", F.col("median_price") / F.col("reference"))
    agg = [geometric_mean("ratio").alias("level"), F.count("*").alias("products")]
    out = rows.groupBy("chain", "category").agg(*agg).unionByName(rows.groupBy("chain").agg(*agg).withColumn("category", F.lit(None).cast("string")))
    return out.filter(F.col("products") >= p.min_level_products).select("chain", "category", "level", "products")


def popular_by_category(same: DataFrame, k: int = 4) -> DataFrame:
    """The k products of each category in most stores, one of each brand first."""
    rows = same.groupBy("product_id", "description", "brand", "category").agg(F.sum(F.when(F.col("credible"), F.col("stores")).otherwise(0)).alias("stores")).withColumn("brand_key", search_form(F.coalesce(F.nullif("brand", F.lit("")), F.col("description"))))
    order = [F.col("stores").desc(), "description", "product_id"]
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("category", "brand_key").orderBy(*order)) == 1)
    w = Window.partitionBy("category").orderBy(F.col("first").desc(), *order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("category", "rank", "product_id", "description", "brand", "stores")


def merge_equal_formats(same: DataFrame, format_map: DataFrame) -> DataFrame:
    """Banners of one group (chain, group_name) with the same price in cents, credibility and date as one row."""
    rows = same.join(small(format_map), "chain", "left").withColumn("group_name", F.coalesce("group_name", "chain"))
    keys = ["product_id", "group_name", F.round(F.col("median_price") * 100).cast("long").alias("cents"), "credible", "price_date"]
    out = rows.groupBy(*keys).agg(F.sort_array(F.collect_set("chain")).alias("chains"), F.min("median_price").alias("price"), F.sum("stores").alias("stores"), F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price"))
    return out.select("product_id", "chains", "price", "stores", "min_price", "max_price", "credible", "price_date")


def zone_price_summary(same: DataFrame, zone_chains: DataFrame) -> DataFrame:
    """Cheapest and dearest credible chains of each product in each zone."""
    rows = same.filter("credible").join(small(zone_chains), "chain")
    w = Window.partitionBy("zone_id", "product_id")
    rows = rows.withColumns({"low": F.min("median_price").over(w), "high": F.max("median_price").over(w)})
    names = lambda c: F.sort_array(F.collect_set(F.when(F.col("median_price") == F.col(c), F.col("chain"))))
    return rows.groupBy("zone_id", "product_id").agg(names("low").alias("cheapest"), F.min("low").alias("price"), names("high").alias("dearest"), F.max("high").alias("max_price"), F.count("*").alias("chains_in_zone"), F.round((F.max("high") - F.min("low")) / F.max("high") * 100).cast("int").alias("saving_pct"))


def product_headline(summary: DataFrame, same: DataFrame, zone_chains: DataFrame, near_pct: float = 1.0) -> DataFrame:
    """What to say of each product in each zone and, with a null zone, in the country."""
    zones = zone_chains.select("zone_id").distinct()
    sold = same.join(small(zone_chains), "chain").select("zone_id", "product_id").distinct().withColumn("sold", F.lit(True))
    z = zone_price_summary(same, zone_chains).withColumn("zone_gap", F.round((F.col("max_price") - F.col("price")) / F.col("price") * 100, 1))
    by_gap = lambda low, high, gap: F.when(low == high, "igual").when(gap < near_pct, "casi_igual").otherwise("diferencia")
    every = summary.select("product_id", "lowest", "highest", "gap_pct", "extremes_backed").crossJoin(F.broadcast(zones))
    rows = every.join(sold, ["zone_id", "product_id"], "left").join(z, ["zone_id", "product_id"], "left")
    kind = F.when(F.col("sold").isNull(), "no_en_zona").when(F.col("price").isNull(), "sin_creible_en_zona").when(F.col("chains_in_zone") == 1, "una_cadena").otherwise(by_gap(F.col("price"), F.col("max_price"), F.col("zone_gap")))
    local = rows.select("zone_id", "product_id", F.lit("zona").alias("scope"), kind.alias("kind"), F.coalesce("price", "lowest").alias("price"), F.coalesce("max_price", "highest").alias("max_price"), F.coalesce("zone_gap", "gap_pct").alias("gap_pct"))
    country = F.when((F.col("highest") > F.col("lowest")) & ~F.col("extremes_backed"), "sin_respaldo").otherwise(by_gap(F.col("lowest"), F.col("highest"), F.col("gap_pct")))
    return local.unionByName(summary.select(F.lit(None).cast(zone_chains.schema["zone_id"].dataType).alias("zone_id"), "product_id", F.lit("pais").alias("scope"), country.alias("kind"), F.col("lowest").alias("price"), F.col("highest").alias("max_price"), "gap_pct"))


def _search_index(products: DataFrame) -> DataFrame:
    visible = F.array_distinct(search_words(F.concat_ws(" ", "description", "brand")))
    every = F.array_distinct(F.concat(visible, search_words(F.concat_ws(" ", "search_text", "category", searchable_sizes(F.col("qty"), F.col("unit"))))))
    in_category = F.array_distinct(search_words(F.coalesce("category", F.lit(""))))
    return products.select("product_id", "description", "chains", visible.alias("visible_words"), every.alias("all_words"), F.filter(in_category, lambda w: F.length(w) > 2).alias("category_words"))


def _prefixes(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda n: F.substring(word, F.lit(1), n))


def _candidates(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(question, product_id) where the rarest word of the question begins a word of the product. How many products a prefix
    reaches is counted over the vocabulary, so a prefix that is in every product costs a count and no row, unless a question
    has nothing rarer. What is made of the index is never broadcast: as a file it is far smaller than its rows."""
    places = asked.select("question", F.posexplode("forms").alias("place", "form"))
    posted = index.select("product_id", F.explode("all_words").alias("word"))
    vocabulary = posted.groupBy("word").agg(F.count("*").alias("products")).select("word", "products", F.explode(_prefixes(F.col("word"))).alias("prefix"))
    tried = places.select(F.explode("form").alias("prefix")).distinct()
    begun = written(vocabulary.hint("merge").join(tried, "prefix"), "begun")
    cost = begun.groupBy("prefix").agg(F.sum("products").alias("cost"))
    by_place = places.select("question", "place", F.explode("form").alias("prefix")).join(cost, "prefix", "left").groupBy("question", "place").agg(F.sum(F.coalesce("cost", F.lit(0))).alias("cost"))
    rarest = by_place.groupBy("question").agg(F.min(F.struct("cost", "place")).alias("least")).filter("least.cost > 0").select("question", F.col("least.place").alias("place"))
    words = places.join(rarest, ["question", "place"]).select("question", F.explode("form").alias("prefix")).join(begun, "prefix").select("question", "word").distinct()
    return small(written(words, "words"), 1 << 20).join(posted.hint("merge"), "word").select("question", "product_id").distinct()


def bulk_search(queries: DataFrame, products: DataFrame, k: int = 20) -> DataFrame:
    """For queries (query_id, text) over products (product_id, description, brand, search_text, category, qty, unit,
    chains), the k best products in which each word of the query begins a word.

    Equal queries are answered once. Each starts from its rarest word, and what that reaches is tested for the other words;
    the rank's window keeps k rows of a query in each task before they meet.
    """
    index = written(_search_index(products), "search")
    texts = queries.withColumn("words", search_words(F.col("text"))).filter(F.size("words") > 0).withColumn("question", F.array_join("words", " "))
    asked = small(written(texts.select("question", "words").distinct().withColumn("forms", F.transform("words", variants)), "asked"), 1 << 20)
    begins = lambda names, v: F.exists(names, lambda w: F.exists(v, lambda x: F.startswith(w, x)))
    found = _candidates(asked, index).join(asked, "question").join(index.hint("merge"), "product_id").filter(F.forall("forms", lambda v: begins(F.col("all_words"), v)))

    def same_word(w: Column, v: Column) -> Column:
        return F.arrays_overlap(variants(w), v)

    touched = F.size(F.filter("category_words", lambda w: F.exists(F.col("forms"), lambda v: same_word(w, v))))
    match = F.when(touched == 0, 2).when(touched == F.size("category_words"), 0).otherwise(1)
    visible = F.forall("forms", lambda v: begins(F.col("visible_words"), v))
    whole = F.forall("forms", lambda v: F.exists("visible_words", lambda w: same_word(w, v)))
    found = found.withColumns({"category_match": match, "visible": visible, "whole_words": whole})
    w = Window.partitionBy("question").orderBy("category_match", F.col("visible").desc(), F.col("whole_words").desc(), F.col("chains").desc(), F.length("description"), "description", "product_id")
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("question", "rank", "product_id", "category_match", "visible", "whole_words", "chains")
    return texts.select("query_id", "question").join(best, "question").drop("question")


def resolve_staples(staples: DataFrame, products: DataFrame) -> DataFrame:
    """The first hit of each staple (name, text)."""
    return bulk_search(staples.select(F.col("name").alias("query_id"), "text"), products, 1).select(F.col("query_id").alias("name"), "product_id")


def _staple_key(text: Column) -> Column:
    singular = lambda w: F.when((F.length(w) > 4) & w.endswith("es"), F.substring(w, F.lit(1), F.length(w) - 2)).when((F.length(w) > 3) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(search_words(text), lambda w: ~w.isin(*FILLERS)), singular))), " ")


def resolve_pasted_lists(lists: DataFrame, products: DataFrame, staples: DataFrame, resolved: DataFrame, k: int = 3) -> DataFrame:
    """Lines of pasted texts (list_id, text): quantity, search text and up to k candidates, a named staple first."""
    lines = lists.select("list_id", F.posexplode(list_lines(F.col("text"))).alias("line_no", "text"))
    search, qty = list_line(F.col("text"))
    lines = lines.withColumns({"search": search, "quantity": qty}).withColumn("query_id", F.concat_ws("/", F.col("list_id").cast("string"), F.col("line_no").cast("string")))
    hits = bulk_search(lines.select("query_id", F.col("search").alias("text")), products, k + 1).select("query_id", "product_id", "rank")
    named = staples.join(resolved, "name").select(_staple_key(F.col("name")).alias("key"), "product_id")
    first = lines.withColumn("key", _staple_key(F.col("search"))).join(small(named), "key").select("query_id", "product_id", F.lit(0).alias("rank"))
    best = hits.unionByName(first).groupBy("query_id", "product_id").agg(F.min("rank").alias("rank"))
    chosen = best.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("n") <= k).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "product_id"))), lambda x: x["product_id"]).alias("candidates"))
    return lines.join(chosen, "query_id", "left").select("list_id", "line_no", "text", "search", "quantity", F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))

