"""Distances, radius joins by grid cells, and points in polygons."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: Kilometres of a degree of latitude, and of a degree of longitude at 63 degrees; radius joins hold up to that latitude.
DEGREE_LAT, DEGREE_LON = 110.0, 49.9


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    y, x = (lat2 - lat1) * 111.0, (lon2 - lon1) * 111.0 * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(x * x + y * y)


def within_km(points: DataFrame, places: DataFrame, km: float, point=("lat", "lon"), place=("place_lat", "place_lon"), distance=planar_km, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of points and places at most km apart (and equal in the columns `on`), with distance_km. An equi-join on grid cells
    that are just as high and wide as the radius: each place is copied to its cell and the eight around it, so a point meets
    only places nearby."""
    cell = lambda lat, lon: (F.floor(lat * (DEGREE_LAT / km)), F.floor(lon * (DEGREE_LON / km)))
    py, px = cell(F.col(point[0]), F.col(point[1]))
    qy, qx = cell(F.col(place[0]), F.col(place[1]))
    around = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    near = places.withColumn("cell_y", F.explode(F.transform(around, lambda d: qy + d))).withColumn("cell_x", F.explode(F.transform(around, lambda d: qx + d)))
    pairs = points.withColumn("cell_y", py).withColumn("cell_x", px).join(near, [*on, "cell_y", "cell_x"]).drop("cell_y", "cell_x")
    pairs = pairs.withColumn("distance_km", distance(F.col(point[0]), F.col(point[1]), F.col(place[0]), F.col(place[1])))
    return pairs.filter(F.col("distance_km") <= km)


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of all rings of a WKT polygon or multipolygon."""
    for rows in batches:
        out = []
        for name, wkt in zip(rows["neighbourhood"], rows["wkt"], strict=True):
            for ring in (wkt or "").replace("MULTIPOLYGON", "").replace("POLYGON", "").replace(")", "(").split("("):
                points = [tuple(map(float, p.split()[:2])) for p in ring.strip(" ,").split(",") if len(p.split()) >= 2]
                out += [(name, *a, *b) for a, b in zip(points, points[1:], strict=False)]
        yield pd.DataFrame(out, columns=["neighbourhood", "x1", "y1", "x2", "y2"]).astype({"neighbourhood": object})


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """(neighbourhood, x1, y1, x2, y2) of polygons (neighbourhood, wkt)."""
    return polygons.select("neighbourhood", "wkt").mapInPandas(_edges, "neighbourhood string, x1 double, y1 double, x2 double, y2 double")


def in_polygon(points: DataFrame, polygons: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the name of the polygon that holds (lon, lat): an odd number of edges lie to the right. Points in none have
    no row. Edges meet the points by bands of latitude, and points outside a polygon's box leave first."""
    band = 0.01
    edges = polygon_edges(polygons).filter("y1 <> y2")
    low, high = F.floor(F.least("y1", "y2") / band), F.floor(F.greatest("y1", "y2") / band)
    by_band = edges.withColumn("band", F.explode(F.sequence(low, high)))
    crossing = ((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & (F.col("lon") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    hits = points.filter("lat IS NOT NULL AND lon IS NOT NULL").withColumn("band", F.floor(F.col("lat") / band)).join(by_band, "band").filter(crossing)
    return hits.groupBy(*keys, "neighbourhood").agg(F.count("*").alias("n")).filter("n % 2 = 1").groupBy(*keys).agg(F.min("neighbourhood").alias("neighbourhood"))
