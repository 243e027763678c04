"""Index, catalogue, baskets, places, ingestion and checks on small tables; seeded comparisons with plain versions."""

import math
import os
import random
from datetime import date
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from gondola.functions import geo, text
from gondola.operators import baskets, catalog, checks, dims, index
from gondola.params import Params
from gondola.plans import registry
from gondola.sources import ingest

DAY = date(2026, 11, 11)


def test_search_text(spark):
    rows = [("Leche Ñandú 2,25 LITROS", "leche nandu 2,25l"), ("Zapallo 500 GR", "zapallo 500gr"), (None, ""), ("ÁÉÍ kilo 1 kilo", "aei kilo 1kg")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "x string").select(text.search_form(F.col("x")).alias("y"))
    assert [r["y"] for r in df.collect()] == [b for _, b in rows]
    words = spark.createDataFrame([("Zapallo con chocolate y huevo 1,5 l",)], "x string").select(text.search_words(F.col("x")).alias("y")).first()["y"]
    assert words == ["sapayo", "con", "chocolate", "y", "uebo", "1,5l"]
    v = spark.createDataFrame([("panes",), ("es",)], "x string").select(text.variants(F.col("x")).alias("y")).collect()
    assert [set(r["y"]) for r in v] == [{"panes", "pan", "pane"}, {"es"}]
    sizes = spark.createDataFrame([(1500.0, "cc"), (500.0, "g"), (12.0, "unidad"), (None, None)], "q double, u string").select(text.searchable_sizes(F.col("q"), F.col("u")).alias("y")).collect()
    assert sizes[0]["y"].split() == ["1500ml", "1500cc", "1.5l", "1,5l", "1.5lt", "1,5lt"] and "0,5kg" in sizes[1]["y"] and sizes[2]["y"] == "12u" and sizes[3]["y"] == ""


@pytest.mark.parametrize(("line", "search", "n"), [("- 2 leche", "leche", 2), ("3x yerba mate", "yerba mate", 3), ("500 g arroz", "500 g arroz", 1), ("pan x2", "pan", 2), ("fideos (4)", "fideos", 4), ("1) aceite de girasol", "aceite girasol", 1), ("azucar", "azucar", 1)])
def test_list_lines(spark, line, search, n):
    q, c = text.list_line(F.col("x"))
    r = spark.createDataFrame([(line,)], "x string").select(q.alias("q"), c.alias("n")).first()
    assert (r["q"], r["n"]) == (search, n)


def test_pasted_text(spark):
    r = spark.createDataFrame([("pan, leche , ",), ("a\nb;c\n\n",), (None,)], "x string").select(text.list_lines(F.col("x")).alias("y")).collect()
    assert [x["y"] for x in r] == [["pan", "leche"], ["a", "b", "c"], []]


HISTORY = "category string, chain string, unit string, median_unit_price double, base_date date, factor double, data_date date"


def test_month_chain_stops_at_gaps(spark):
    d = lambda k: date(2026, 10, k)
    links = [(d(1), date(2026, 9, 30)), (d(2), d(1)), (d(5), d(4)), (d(6), d(5))]
    h = spark.createDataFrame([("c", "x", "g", 1.0, b, 1.1, a) for a, b in links], HISTORY)
    found = index.month_chain(h, "2026-10").collect()
    assert {r["data_date"] for r in found} == {d(5), d(6)} and found[0]["period_start"] == d(4) and not found[0]["from_month_start"] and found[0]["expected_links"] == 2
    whole = index.month_chain(h.filter("data_date <= '2026-10-02'"), None).collect()
    assert len(whole) == 2 and whole[0]["from_month_start"]
    change = index.chain_inflation(h.filter("data_date <= '2026-10-02'")).first()
    assert change["change_pct"] == 21.0


def test_market_needs_companies(spark):
    h = spark.createDataFrame([("c", ch, "g", 1.0, date(2026, 9, 30), f, date(2026, 10, 1)) for ch, f in (("A", 1.1), ("B", 1.2), ("C", 1.3))], HISTORY)
    owners = lambda *rows: spark.createDataFrame(list(rows), "chain string, company_id string")
    assert index.market_inflation(h, owners(("A", "1"), ("B", "1"))).count() == 0
    r = index.market_inflation(h, owners(("A", "1"), ("B", "2"))).first()
    assert r["companies"] == 3 and r["change_pct"] == round(((1.1 * 1.2 * 1.3) ** (1 / 3) - 1) * 100, 2)


def test_contributions_add_up(spark):
    rng = random.Random(20261027)
    for _ in range(12):
        rows = [(f"c{k}", rng.choice([None, rng.uniform(1, 1000)]), rng.choice([None, rng.uniform(0.5, 2)]), 3) for k in range(rng.randint(2, 12))]
        rows.append(("sure", 10.0, 1.5, 3))
        parts, total = index.contributions(spark.createDataFrame(rows, "category string, spending double, factor double, chains long"))
        t = total.first()
        assert sum(r["contribution_pp"] for r in parts.collect()) == pytest.approx(t["basket_change_pct"])
        assert t["no_price"] == sorted(r[0] for r in rows if r[1] is None)
        assert t["no_index"] == sorted(r[0] for r in rows if r[1] is not None and r[2] is None)


def test_leaders_with_ties(spark):
    rng = random.Random(5)
    rows = [(f"c{k % 9}", f"x{k}", float(rng.randint(0, 4))) for k in range(80)]
    found = {r["category"]: (r["chains"], r["pct"]) for r in catalog.category_leaders(spark.createDataFrame(rows, "category string, chain string, pct_wins_when_offered double")).collect()}
    for c in {r[0] for r in rows}:
        best = max(p for cc, _, p in rows if cc == c)
        assert found[c] == (sorted(x for cc, x, p in rows if cc == c and p == best), best)


SAME = "product_id string, description string, brand string, search_text string, category string, section string, chain string, format string, median_price double, min_price double, max_price double, stores long, qty double, unit string, credible boolean, in_range boolean, reference double, chains long, companies long, chains_discarded long, lowest double, highest double, gap_pct double, is_cheapest boolean, price_date date, data_date date"


def same_table(spark, products):
    """products: {id: [(chain, price, stores[, credible])]}."""
    rows = []
    for k, offers in products.items():
        good = [o[1] for o in offers if len(o) < 4 or o[3]]
        low, high = min(good), max(good)
        for o in offers:
            ok = len(o) < 4 or o[3]
            rows.append((k, f"{k} coca cola 1,5 l", "Marca", f"{k} coca cola", "Gaseosas", "Bebidas", o[0], "supermercado", float(o[1]), float(o[1]), float(o[1]), o[2], 1500.0, "cc", ok, True, float(sorted(good)[len(good) // 2]), len(offers), len(offers), 0, float(low), float(high), round((high - low) / low * 100, 1), ok and o[1] == low, DAY, DAY))
    return spark.createDataFrame(rows, SAME)


def test_catalogue(spark):
    same = same_table(spark, {"a": [("Coto", 3100, 40), ("Dia", 3400, 90), ("Jumbo", 4100, 12), ("Vea", 5400, 8)], "b": [("Coto", 100, 1), ("Dia", 200, 50), ("Vea", 300, 9)]})
    s = {r["product_id"]: r for r in catalog.product_summary(same).collect()}
    assert s["a"]["extremes_backed"] and not s["b"]["extremes_backed"]
    assert [r["product_id"] for r in catalog.top_differences(catalog.product_summary(same)).collect()] == ["a"]
    zones = spark.createDataFrame([("z", "Dia"), ("z", "Vea"), ("y", "Otra"), ("w", "Coto")], "zone_id string, chain string")
    z = {r["product_id"]: r for r in catalog.zone_price_summary(same, zones).filter("zone_id = 'z'").collect()}
    assert z["a"]["cheapest"] == ["Dia"] and z["a"]["max_price"] == 5400 and z["a"]["saving_pct"] == 37
    kinds = {(r["zone_id"], r["product_id"]): r["kind"] for r in catalog.product_headline(catalog.product_summary(same), same, zones).collect()}
    assert kinds["z", "a"] == "diferencia" and kinds["y", "a"] == "no_en_zona" and kinds["w", "a"] == "una_cadena" and kinds[None, "b"] == "sin_respaldo"
    level = {(r["chain"], r["category"]): r["level"] for r in catalog.chain_price_levels(same, Params(min_level_products=2)).collect()}
    assert level["Coto", None] == pytest.approx(math.sqrt(3100 / 4100 * 100 / 200))


def test_search(spark):
    products = spark.createDataFrame(
        [("1", "Leche entera La Serenisima 1 L", "La Serenisima", "leche entera", "Leche fluida", 1000.0, "cc", 9), ("2", "Dulce de leche 400 g", "X", "dulce de leche", "Dulces y mermeladas", 400.0, "g", 12), ("3", "Arroz largo", "Gallo", "arroz", "Arroz", 1000.0, "g", 5), ("4", "Lechuga", None, "lechuga", "Verduras", None, None, 3)],
        "product_id string, description string, brand string, search_text string, category string, qty double, unit string, chains long",
    )
    asked = spark.createDataFrame([("a", "leche"), ("b", "leches serenisima"), ("c", "arros 1kg"), ("d", ""), ("e", "nada asi"), ("f", "dulse leche")], "query_id string, text string")
    found = {}
    for r in catalog.bulk_search(asked, products).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["product_id"])
    assert found["a"][0] == "1" and set(found["a"]) == {"1", "2"} and found["b"] == ["1"] and found["c"] == ["3"] and found["f"] == ["2"] and not {"d", "e"} & set(found)
    staples = spark.createDataFrame([("Leche", "leche entera")], "name string, text string")
    pasted = catalog.resolve_pasted_lists(spark.createDataFrame([(1, "2 leches\narroz")], "list_id int, text string"), products, staples, catalog.resolve_staples(staples, products)).orderBy("line_no").collect()
    assert [(r["search"], r["quantity"], r["candidates"][0]) for r in pasted] == [("leches", 2, "1"), ("arroz", 1, "3")]


def test_lists(spark):
    same = same_table(spark, {"a": [("Coto", 10, 5), ("Dia", 12, 5)], "b": [("Dia", 5, 5), ("Vea", 4, 5)]})
    lists = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "zz", 1)], "list_id int, product_id string, quantity int")
    q = {r["chain"]: (r["total"], r["complete"], r["missing"]) for r in baskets.quote_lists(lists, same).collect()}
    assert q == {"Coto": (20.0, False, ["b"]), "Dia": (29.0, True, []), "Vea": (4.0, False, ["a"])}
    s = baskets.list_summary(lists, same).first()
    assert s["combined_total"] == 24.0 and s["not_found"] == ["zz"]
    zone = baskets.quote_lists_in_zone(lists, same, spark.createDataFrame([("z", "Coto")], "zone_id string, chain string")).first()
    assert zone["complete"] and zone["total"] == 20.0


def exhaustive(stores, wanted, most):
    keys = [k for k in wanted if any(k in p for _, _, p in stores)]
    best = None
    out = []
    for k in range(1, most + 1):
        for group in combinations(stores, k):
            costs = [min((p[x] * wanted[x] for _, _, p in group if x in p), default=None) for x in keys]
            have = [c for c in costs if c is not None]
            if have:
                key = (-len(have), sum(have))
                best = key if best is None else min(best, key)
        out.append(best)
    return out


def test_store_combinations_against_all(spark):
    rng = random.Random(20260910)
    for _ in range(40):
        items = [f"i{k}" for k in range(rng.randint(1, 5))]
        stores = [(f"s{s}", float(rng.randint(0, 9)), {x: float(rng.choice([1, 2, 3])) for x in items if rng.random() > 0.25}) for s in range(rng.randint(1, 7))]
        stores = [s for s in stores if s[2]]
        if not stores:
            continue
        wanted = {x: float(rng.randint(1, 3)) for x in items}
        got = baskets.combine_stores(stores, wanted)
        assert [(-p["covered"], p["total"]) for p in got] == exhaustive(stores, wanted, 3)


def test_store_combinations_cover_every_point(spark):
    path = "/root/testdata/sf0.001"
    t = registry.Tables(spark, path)
    wanted, points = registry._baskets_at_points(t)
    assert points.count() == 3 * t.table("supplier").count() == wanted.select("basket_id").distinct().count()
    got = registry.QUERIES["k84_best_store_combinations"](spark, path)
    assert got.select(F.substring_index("basket_id", "-", 1)).distinct().count() == t.table("supplier").count()


def test_household_baskets(spark):
    base = spark.createDataFrame([("Pan", 6750.0), ("Huevos", 11.0)], "category string, quantity double")
    taxonomy = spark.createDataFrame([("Pan", 6750.0, "g"), ("Huevos", 11.0, "unidad"), ("Snacks", 500.0, "g")], "category string, quantity double, unit string")
    item = "struct<category:string,factor:double,quantity:double,unit:string,tier:string,reason:string>"
    homes = spark.createDataFrame(
        [
            (1, 2.0, "medio", ["Pan"], False, [("Huevos", 0.5, None, None, "premium", "few"), ("Snacks", None, 10.0, "g", "economico", None), ("Pan", 9.0, None, None, "medio", "")]),
            (2, None, "?", None, None, None),
            (3, 1.0, "medio", None, True, [("Snacks", None, 3.0, "unidad", "economico", "")]),
        ],
        f"household_id int, adult_eq double, tier string, remove array<string>, only_mentioned boolean, items array<{item}>",
    )
    got = {(r["household_id"], r["category"]): (r["quantity"], r["unit"], r["tier"]) for r in baskets.expand_household_baskets(homes, base, taxonomy).collect()}
    assert got == {(1, "Huevos"): (11.0, "unidad", "premium"), (1, "Snacks"): (500.0, "g", "economico"), (2, "Pan"): (6080.0, "g", "economico"), (2, "Huevos"): (10.0, "unidad", "economico"), (3, "Snacks"): (500.0, "g", "economico")}


STORE = "company_id string, banner_id string, store_id string, name string, type string, street string, number string, neighbourhood string, locality string, province string, postcode string, lat double, lon double"


def test_places(spark):
    s = lambda i, loc, prov, lat, lon: ("1", "1", i, "n", "t", "c", "1", None, loc, prov, "0", lat, lon)
    stores = spark.createDataFrame([s("in", "CABA", "AR-C", 0.5, 0.5), s("wrong", "Buenos Aires", "AR-C", 5.0, 5.0), s("near", "Lanús", "AR-B", 5.01, 5.0), s("near2", "LANUS", "AR-B", 5.02, 5.0), s("near3", "Lanús", "AR-B", 5.03, 5.0), s("far", "Salta", "AR-A", 20.0, 20.0), s("none", None, "AR-B", None, None)], STORE)
    polygons = spark.createDataFrame([("Centro", "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0), (0.1 0.1, 0.2 0.1, 0.2 0.2, 0.1 0.2, 0.1 0.1))")], "neighbourhood string, wkt string")
    hood = dims.store_neighbourhood(stores, polygons)
    assert {r["store_id"]: r["neighbourhood"] for r in hood.collect()} == {"in": "Centro", "wrong": None}
    fixed = {r["store_id"]: (r["province"], r["locality"]) for r in dims.store_dimension(stores, hood).collect()}
    assert fixed["in"] == ("AR-C", "Centro") and fixed["wrong"] == ("AR-B", "Lanús") and fixed["near2"] == ("AR-B", "Lanús") and fixed["far"] == ("AR-A", "Salta") and fixed["none"] == ("AR-B", None)
    hole = spark.createDataFrame([("a", 0.15, 0.15), ("b", 0.3, 0.3), ("c", 2.0, 2.0)], "k string, lat double, lon double")
    assert [r["k"] for r in geo.in_polygon(hole, polygons, ["k"]).collect()] == ["b"]


def test_radius_join_against_all(spark):
    rng = random.Random(2)
    a = [(k, rng.uniform(-40, -30), rng.uniform(-65, -55)) for k in range(150)]
    b = [(k, rng.uniform(-40, -30), rng.uniform(-65, -55)) for k in range(150)]

    def km(x, y):
        la1, lo1, la2, lo2 = map(math.radians, (x[1], x[2], y[1], y[2]))
        h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
        return 2 * geo.EARTH_KM * math.asin(math.sqrt(h))

    got = geo.within_km(spark.createDataFrame(a, "i int, lat double, lon double"), spark.createDataFrame(b, "j int, place_lat double, place_lon double"), 50, distance=geo.haversine_km)
    assert {(r["i"], r["j"]) for r in got.collect()} == {(x[0], y[0]) for x in a for y in b if km(x, y) <= 50}


def test_gazetteer(spark):
    rows = [("1", "Dia", "supermercado", "n", "s", "1", "Palermo", "CABA", "AR-C", -34.58, -58.42), ("2", "Coto", "supermercado", "n", "s", "1", "PALERMO", "Capital Federal", "AR-C", -34.581, -58.421), ("3", "Vea", "supermercado", "n", "s", "1", None, "Palermo Viejo", "AR-C", -34.582, -58.42), ("4", "Farma", "farmacia", "n", "s", "1", None, "Palermo", "AR-C", -34.583, -58.42), ("5", "Dia", "supermercado", "n", "s", "1", None, "SAN JUAN", "AR-J", -31.5, -68.5), ("6", "Dia", "supermercado", "n", "s", "1", "7", "x1", "AR-J", -31.5, -68.5)]
    stores = spark.createDataFrame(rows, "store_key string, chain string, format string, name string, street string, number string, neighbourhood string, locality string, province string, lat double, lon double")
    z = {r["name"]: r for r in baskets.zone_gazetteer(stores).collect()}
    assert set(z) == {"Palermo", "San Juan"} and z["Palermo"]["aliases"] == ["Palermo Viejo"] and z["Palermo"]["stores"] == 3 and z["Palermo"]["chains"] == ["Coto", "Dia", "Vea"] and z["Palermo"]["pharmacies"] == ["Farma"]
    assert z["San Juan"]["other_chain"] and z["San Juan"]["other_km"] > 900
    near = baskets.nearest_zone(spark.createDataFrame([(1, -34.58, -58.42), (2, 0.0, 0.0)], "point_id int, lat double, lon double"), baskets.zone_gazetteer(stores)).collect()
    assert [(r["point_id"], r["zone"]) for r in near] == [(1, "Palermo")]
    hit = baskets.search_zones(spark.createDataFrame([("q", "pal vie"), ("r", "juan")], "query_id string, text string"), baskets.zone_gazetteer(stores)).collect()
    assert {(r["query_id"], r["zone"]) for r in hit} == {("q", "Palermo"), ("r", "San Juan")}


def test_gazetteer_centre_moves_with_aliases(spark):
    """The third place lies near the centre of the first two together, and near neither of their own."""
    spots = [("1", "Villa Loma Norte", 0.0), ("2", "Villa Loma Norte", 0.0), ("3", "Villa Loma", 1.8), ("4", "Villa Loma", 1.8), ("5", "Loma", 2.7)]
    rows = [(k, "Dia", "supermercado", "n", "s", "1", None, name, "AR-B", km / 111.0, 0.0) for k, name, km in spots]
    stores = spark.createDataFrame(rows, "store_key string, chain string, format string, name string, street string, number string, neighbourhood string, locality string, province string, lat double, lon double")
    z = baskets.zone_gazetteer(stores).collect()
    assert [(r["name"], sorted(r["aliases"]), r["stores"]) for r in z] == [("Villa Loma", ["Loma", "Villa Loma Norte"], 5)]


def test_snapshot_diff(spark):
    now = spark.createDataFrame([("1", "a", None), ("2", "b", "x"), ("3", "c", "z")], "k string, name string, v string")
    was = spark.createDataFrame([("1", "a", None), ("2", "b", "y"), ("4", "d", "z")], "k string, name string, v string")
    got = {r["k"]: r["change"] for r in dims.snapshot_diff(now, was, ["k"], ["name", "v"], "d").collect()}
    assert got == {"2": "modificacion", "3": "alta", "4": "baja"}


def test_feed(spark, tmp_path):
    good, other = tmp_path / "a.csv", tmp_path / "b.csv"
    good.write_text('﻿id|name|price\n1|"two\nlines"|5\n\n2|short\n3|x|6|extra\n4|y|7|\n5||\n', encoding="utf-8")
    other.write_text("price|id\n9|6\n", encoding="utf-8")
    paths = [f"file://{good}", f"file://{other}"]
    rows = {r["id"]: (r["name"], r["price"]) for r in ingest.read_price_feed(spark, paths, DAY, ["id", "name", "price"]).collect()}
    assert rows == {"1": ("two\nlines", "5"), "2": ("short", ""), "5": ("", ""), "6": ("", "9")}
    with pytest.raises(ingest.TooManyBadRecords):
        ingest.read_price_feed(spark, paths, DAY, ["id"], max_bad_records=1)
    assert ingest.read_price_feed(spark, paths, DAY, ["id"], max_bad_records=2).count() == 4


def test_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/h"
    d = lambda k, v: spark.createDataFrame([(v, date(2026, 1, k))], "v int, data_date date")
    ingest.write_partition(d(1, 1), path)
    ingest.write_partition(d(2, 2), path)
    ingest.write_partition(d(2, 3), path)
    ingest.write_partition(d(2, 3), path)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 3]
    with pytest.raises(ValueError, match="empty"):
        ingest.write_partition(d(1, 1).limit(0), path)
    assert ingest.latest_date(spark.read.parquet(path)) == date(2026, 1, 2)
    with pytest.raises(ValueError):
        ingest.latest_date(d(1, 1).limit(0))
    assert os.path.isdir(tmp_path / "h")


def test_dates(spark):
    d = lambda k: date(2026, 1, k)
    src = [d(k) for k in range(1, 9)]
    assert ingest.dates_to_compute(src, [d(1)]) == [d(2), d(3), d(4), d(5)]
    assert ingest.dates_to_compute(src, src) == [d(8)]
    assert ingest.dates_to_compute(src, src, forced=[d(3), d(20)]) == [d(3), d(8)]
    with pytest.raises(ValueError):
        ingest.dates_to_compute([], [])
    pairs = ingest.date_pairs([d(1), d(3), d(4)], [d(1), d(4)])
    assert pairs == [(d(1), None), (d(4), d(3))] and ingest.with_bases(pairs) == [d(1), d(3), d(4)]
    assert ingest.retention_days([], d(9)) == 3 and ingest.retention_days([d(8)], d(9)) == 3 and ingest.retention_days([d(5)], d(9)) == 7
    frame = lambda *ks: spark.createDataFrame([(d(k),) for k in ks], "data_date date")
    at = lambda df: sorted(r["data_date"].day for r in df.collect())
    assert at(ingest.dates_at_risk(frame(1, 2), frame(3), frame(2))) == [1, 3]
    assert at(ingest.missing_dates(spark, "2026-01-01", "2026-01-04", frame(2), frame(3))) == [1, 4]
    assert at(ingest.expire_partitions(frame(1, 5, 9), d(9), 4)) == [5, 9] and at(ingest.verify_loaded(frame(1), frame(1, 2))) == [2]
    assert at(ingest.pending_dates(frame(1, 2, 3), frame(1, 2), frame(2, 3))) == [1, 3] and ingest.days_behind(frame(1, 2), d(5)).first()[0] == 3


def test_dimensions_and_classes(spark, tmp_path):
    now = spark.createDataFrame([("1", "a"), ("2", "b")], "company_id string, v string")
    new, previous = ingest.refresh_dimension(now, spark.createDataFrame([("1", "c"), (" ", "trailer")], "company_id string, v string"), ["1", "2", "3"])
    assert {tuple(r) for r in new.collect()} == {("1", "c"), ("2", "b")} and previous.count() == 2
    path = f"file://{tmp_path}/c"
    ingest.append_classification(spark.createDataFrame([("p", "A")], "product_id string, category string"), path)
    ingest.append_classification(spark.createDataFrame([("p", "B", "2026-01-01")], "product_id string, category string, classified_at string"), path)
    assert ingest.read_classification(spark, path).count() == 2
    labels = ingest.apply_taxonomy(spark.createDataFrame([("p", "A"), ("q", "?"), ("r", None)], "product_id string, category string"), spark.createDataFrame([("A", "S")], "category string, section string"))
    assert {(r["product_id"], r["category"], r["section"]) for r in labels.collect()} == {("p", "A", "S"), ("q", "Otros", "Otros"), ("r", "Otros", "Otros")}
    log = spark.createDataFrame([("old", date(2026, 1, 1)), ("again", date(2026, 1, 2))], "dimension string, data_date date")
    found = ingest.append_change_log(log, spark.createDataFrame([("new",)], "dimension string"), "2026-01-02")
    assert {r["dimension"] for r in found.collect()} == {"old", "new"}
    seed = tmp_path / "p.csv"
    seed.write_text('barrio,comuna,wkt\nCentro,1,"POLYGON ((0 0, 1 0, 1 1, 0 0))"\n')
    assert ingest.read_polygons(spark, f"file://{seed}").first()["wkt"].startswith("POLYGON")
    assert ingest.read_seed(spark, f"file://{seed}", "a string, b int, c string").first()["b"] == 1


def test_reclassify(spark):
    rows = spark.createDataFrame([("a", "d", "b", "X", "2026-01-01 00:00:00"), ("a", "d", "b", "Y", "2026-02-01 00:00:00"), ("c", "d", "b", "X", None), ("e", "d", "b", "X", "2026-03-01 00:00:00")], "product_id string, description string, brand string, category string, at string").select("*", F.col("at").cast("timestamp").alias("classified_at"))
    assert [r["product_id"] for r in ingest.products_to_reclassify(rows, ["X"], "2026-02-15").collect()] == ["c"]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    assert checks.not_null(df, "v").count() == 1 and checks.unique(df, "k").count() == 1 and checks.accepted_values(df, "v", ["a"]).count() == 1
    assert checks.expression_is_true(df, "k < 2").count() == 1 and checks.expression_is_true(df, "k < 2", "k = 1").count() == 0
    stores = spark.createDataFrame([("Caba", "AR-C", None), ("Palermo", "AR-C", "Palermo"), ("Córdoba", "AR-B", None)], "locality string, province string, neighbourhood string")
    assert checks.capital_without_name(stores).count() == 1 and [r["locality"] for r in checks.locality_names_other_province(stores).collect()] == ["Córdoba"]
    meat = spark.createDataFrame([("Carne vacuna", "bife")] * 30 + [("Carne vacuna", "CERDO pechito")], "category string, description string")
    assert checks.foreign_markers(meat, {"Carne vacuna": r"\bcerdo"}).count() == 1
    prices = spark.createDataFrame([(DAY, "p", "s", "c", 5.0, "zz")], "data_date date, product_id string, store_id string, company_id string, price double, unit string")
    assert [r["failed"] for r in checks.latest_date_invalid(prices).collect()] == ["unknown units"]
    assert [r["failed"] for r in checks.latest_date_invalid(prices.limit(0)).collect()] == ["empty"]
    assert checks.raw_behind(prices, "2026-11-14").count() == 1 and checks.raw_behind(prices, "2026-11-12").count() == 0
    raw = spark.createDataFrame([("KG",), ("??",)], "declared_unit string")
    assert checks.units_unrecognised(raw, text.declared_size(F.lit("1"), F.col("declared_unit"))[1]).count() == 1
    assert checks.index_covers_too_little(spark.createDataFrame([("a",)], "category string"), spark.createDataFrame([("a",), ("b",)], "category string")).count() == 1


def test_registry_without_corpus_modules(spark):
    from gondola.plans import registry
    from gondola.plans.sqltwins import twin

    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) > 70
    assert twin("SELECT 1").strip() == "SELECT 1" and "demo_prices AS (" in twin("SELECT * FROM product_chain")
    wins = registry.QUERIES["k16_who_wins"](spark, "/root/testdata/sf0.001")
    assert wins.count() == 2
