"""Companies, stores and their places; differences between snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions.geo import haversine_km, in_polygon, within_km
from gondola.functions.text import fold
from gondola.params import DEFAULTS, Params
from gondola.sources.work import small, written

PROVINCE_CODE = r"^AR-[A-Z]$"
#: Names under which a province stands in the locality column, folded.
PROVINCE_NAMES = {
    "AR-C": ("capital federal", "ciudad autonoma de buenos aires", "ciudad autonoma buenos aires", "ciudad autonoma de bs as", "caba"),
    "AR-B": ("buenos aires",),
    "AR-K": ("catamarca",),
    "AR-H": ("chaco",),
    "AR-U": ("chubut",),
    "AR-X": ("cordoba",),
    "AR-W": ("corrientes",),
    "AR-E": ("entre rios",),
    "AR-P": ("formosa",),
    "AR-Y": ("jujuy",),
    "AR-L": ("la pampa",),
    "AR-F": ("la rioja",),
    "AR-M": ("mendoza",),
    "AR-N": ("misiones",),
    "AR-Q": ("neuquen",),
    "AR-R": ("rio negro",),
    "AR-A": ("salta",),
    "AR-J": ("san juan",),
    "AR-D": ("san luis",),
    "AR-Z": ("santa cruz",),
    "AR-S": ("santa fe",),
    "AR-G": ("santiago del estero",),
    "AR-V": ("tierra del fuego",),
    "AR-T": ("tucuman",),
}


def named_province(locality):
    """The province that a locality names, or null."""
    key = fold(locality)
    out = F.lit(None).cast("string")
    for code, names in PROVINCE_NAMES.items():
        out = F.when(key.isin(*names), code).otherwise(out)
    return out


def store_address(street: Column, number: Column) -> Column:
    """street and number as one text; null without either."""
    return F.nullif(F.trim(F.concat_ws(" ", F.nullif(street, F.lit("")), F.nullif(number, F.lit("")))), F.lit(""))


def clean_companies(raw: DataFrame) -> DataFrame:
    """Rows with both keys."""
    return raw.filter("trim(company_id) <> '' AND trim(banner_id) <> ''").select("company_id", "banner_id", "tax_id", "legal_name", "banner_name")


def clean_stores(raw: DataFrame) -> DataFrame:
    """Rows with a store, coordinates as numbers."""
    return raw.filter("store_id IS NOT NULL").withColumns({c: F.col(c).try_cast("double") for c in ("lat", "lon")})


def company_dimension(raw: DataFrame, chain_map: DataFrame) -> DataFrame:
    """K3: companies with chain, format and whether they report daily; defaults where the map has no row."""
    names = chain_map.select(F.col("company_id").cast("string").alias("company_id"), F.col("banner_id").cast("string").alias("banner_id"), F.col("chain").alias("mapped"), F.col("format").alias("mapped_format"), F.col("reports_daily").alias("mapped_daily"))
    rows = clean_companies(raw).join(small(names), ["company_id", "banner_id"], "left")
    return rows.select("company_id", "banner_id", "tax_id", "legal_name", "banner_name", F.coalesce("mapped", F.trim("banner_name")).alias("chain"), F.coalesce("mapped_format", F.lit("supermercado")).alias("format"), F.coalesce("mapped_daily", F.lit(True)).alias("reports_daily"))


def store_neighbourhood(stores: DataFrame, polygons: DataFrame) -> DataFrame:
    """K4: stores of the capital, or whose province is no code, with the polygon that holds them, if any."""
    rows = stores.filter((F.col("province") == "AR-C") | ~F.col("province").rlike(PROVINCE_CODE)).filter("lat IS NOT NULL AND lon IS NOT NULL").select("company_id", "store_id", "lat", "lon")
    found = in_polygon(rows, polygons, ["company_id", "store_id"])
    return rows.select("company_id", "store_id").join(found, ["company_id", "store_id"], "left")


def _nearest_clean(spots: DataFrame, clean: DataFrame, p: Params) -> DataFrame:
    """spot, near_province and near_locality of the nearest clean place to each spot (spot, lat, lon, wanted) within
    near_store_km, one in the wanted province first. Rings of growing radius: a spot that has found one leaves, so few spots
    meet places far away."""
    places, left = written(clean, "clean"), written(spots, "spots")
    rings = [spots.select("spot", F.lit(None).cast("string").alias("near_province"), F.lit(None).cast("string").alias("near_locality")).limit(0)]
    # Distances that differ in the tenth decimal are the same; what is that near a ring's edge waits for the next ring.
    nearest, last = F.min(F.struct(F.round("distance_km", 9).alias("km"), "near_province", "near_locality")).alias("n"), p.near_store_km
    for of_province, km in ((of, km) for of in (True, False) for km in (last / 16, last)):
        asked = left.filter("wanted IS NOT NULL").withColumn("province", F.col("wanted")) if of_province else left
        if asked.isEmpty():
            continue
        near = within_km(asked, places.withColumn("province", F.col("near_province")), km, distance=haversine_km, on=("province",) if of_province else ())
        ring = near.groupBy("spot").agg(nearest).select("spot", "n.*").filter((F.col("km") < km - 1e-8) | (F.lit(km) == last))
        rings.append(written(ring.drop("km"), "ring"))
        if of_province or km < last:
            left = written(left.join(rings[-1], "spot", "left_anti"), "spots")
    return reduce(DataFrame.unionByName, rings)


def store_dimension(stores: DataFrame, neighbourhoods: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """K5: stores with a repaired province and locality, and one spelling of each locality.

    Suspicious stores (in no polygon, though in the capital, without a province code, or in a locality named after another
    province) take the province of the nearest clean store within 50 km, one in the named province first; their locality too
    where their own is a province's name. A polygon's name wins. Of the spellings of a locality the most frequent stays.
    """
    keys = ["company_id", "store_id"]
    rows = stores.withColumn("named", named_province(F.col("locality"))).drop("neighbourhood").join(neighbourhoods.select(*keys, "neighbourhood"), keys, "left")
    coded = F.coalesce(F.col("province").rlike(PROVINCE_CODE), F.lit(False))
    odd = (F.col("province") == "AR-C") | ~coded | F.coalesce(F.col("named") != F.col("province"), F.lit(False))
    rows = rows.withColumn("suspicious", F.coalesce(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("neighbourhood").isNull() & odd, F.lit(False)))
    clean = rows.filter(~F.col("suspicious") & coded & (F.col("province") != "AR-C") & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.col("province").alias("near_province"), F.col("locality").alias("near_locality"), F.col("lat").alias("place_lat"), F.col("lon").alias("place_lon"))
    doubted = rows.filter("suspicious").select(*keys, "lat", "lon", F.when(F.col("named") != F.col("province"), F.col("named")).alias("wanted"))
    doubted = doubted.withColumn("spot", F.concat_ws("/", "lat", "lon", "wanted"))
    # Stores at one spot have the same nearest store.
    near = _nearest_clean(doubted.select("spot", "lat", "lon", "wanted").distinct(), clean.distinct(), p)
    near = doubted.select(*keys, "spot").join(near, "spot").drop("spot")
    rows = rows.join(near, keys, "left")
    generic = F.col("near_province").isNotNull() & F.col("named").isNotNull() & (fold(F.col("locality")) != fold(F.col("near_locality")))
    locality = F.when(F.col("neighbourhood").isNotNull(), F.col("neighbourhood")).when(generic, F.col("near_locality")).otherwise(F.col("locality"))
    province = F.when(F.col("neighbourhood").isNotNull(), "AR-C").otherwise(F.coalesce("near_province", "province"))
    rows = rows.withColumns({"raw_locality": locality, "province": province}).withColumn("key", fold(F.col("raw_locality")))
    counts = rows.filter("raw_locality IS NOT NULL").groupBy("province", "key", "raw_locality").agg(F.count("*").alias("n"))
    spelling = counts.groupBy("province", "key").agg(F.min_by("raw_locality", F.struct(-F.col("n"), "raw_locality")).alias("spelling"))
    rows = rows.join(spelling, ["province", "key"], "left").withColumn("locality", F.coalesce("spelling", "raw_locality"))
    return rows.select("company_id", "banner_id", "store_id", "name", "type", "street", "number", "neighbourhood", "locality", "province", "postcode", "lat", "lon")


def snapshot_diff(today: DataFrame, yesterday: DataFrame, keys: list[str], compare: list[str], dimension: str = "", name: str | None = None) -> DataFrame:
    """K6: rows that came (alta), went (baja) or changed (modificacion) between snapshots; unchanged ones are left out."""
    label = name or compare[0]
    side = lambda df, s: df.select(*keys, F.struct(*compare).alias(s), F.col(label).alias(f"{s}_name"))
    both = side(today, "now").join(side(yesterday, "was"), keys, "full")
    change = F.when(F.col("was").isNull(), "alta").when(F.col("now").isNull(), "baja").when(~F.equal_null("now", "was"), "modificacion")
    return both.select(F.lit(dimension).alias("dimension"), *keys, F.coalesce("now_name", "was_name").alias("name"), change.alias("change")).filter("change IS NOT NULL")


def map_stores(stores: DataFrame, companies: DataFrame) -> DataFrame:
    """K7: stores with coordinates, keyed company-store, with chain and format."""
    rows = stores.filter("lat IS NOT NULL AND lon IS NOT NULL").join(companies.select("company_id", "banner_id", "chain", "format"), ["company_id", "banner_id"], "left")
    return rows.select(F.concat_ws("-", "company_id", "store_id").alias("store_key"), "chain", F.coalesce("format", F.lit("supermercado")).alias("format"), "name", "street", "number", "neighbourhood", "locality", "province", "lat", "lon")
