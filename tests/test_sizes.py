"""Jobs whose rows must not grow with the square of their input: results against plain versions, and rows that plans make."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from gondola.operators import baskets, catalog, dims, promos


def most_rows(df, metric="numOutputRows", kind=""):
    """Run a table's plan; the most rows that one of its operators (of a kind) makes (or writes to a shuffle:
    shuffleRecordsWritten)."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        rows = node.metrics().get(metric)
        if rows.isDefined() and name.startswith(kind):
            most = max(most, rows.get().value())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return most


def _same(spark, rows):
    """product_id, chain, median_price, all credible."""
    return spark.createDataFrame(rows, "product_id string, chain string, median_price double").withColumns({"credible": F.lit(True), "format": F.lit("supermercado")})


def test_lists_meet_only_stores_with_offers(spark):
    """300 lists beside 200 stores: the best store of each list and chain as by trying every store, without meeting each."""
    rng = random.Random(38)
    prices = {(f"p{k}", c): float(rng.randint(20, 60)) for k in range(12) for c in ("a", "b", "d") if rng.random() < 0.9}
    lists = {k: {f"p{i}": rng.randint(1, 5) for i in rng.sample(range(12), rng.randint(1, 3))} for k in range(300)}
    stores = {f"s{k}": (rng.choice("abd"), -34.6 + rng.uniform(-0.005, 0.005), -58.4 + rng.uniform(-0.005, 0.005)) for k in range(200)} | {"far": ("a", -34.9, -58.4)}
    offers = {(f"p{rng.randrange(12)}", rng.choice([*stores])): (float(rng.randint(15, 60)), rng.choice([None, "2026-11-20"])) for _ in range(60)} | {("p0", "far"): (1.0, None)}
    legend = lambda until: until and f"Promo valida hasta {until}"
    table = spark.createDataFrame([(p, [s], v, legend(u), False) for (p, s), (v, u) in offers.items()], "product_id string, stores array<string>, promo_price double, legend string, multi_buy boolean")
    asked = spark.createDataFrame([(k, *i) for k, items in lists.items() for i in items.items()], "list_id int, product_id string, quantity int")
    shops = spark.createDataFrame([(k, *s) for k, s in stores.items()], "store_key string, chain string, lat double, lon double")
    homes = spark.createDataFrame([(k, -34.6, -58.4) for k in lists], "list_id int, lat double, lon double")
    found = promos.list_total_with_promos(asked, _same(spark, [(*k, v) for k, v in prices.items()]), table, shops, homes, "2026-11-18")
    km = lambda lat, lon: (((lat + 34.6) * 111) ** 2 + ((lon + 58.4) * 111 * 0.823) ** 2) ** 0.5
    want = {}
    for k, items in lists.items():
        for s, (chain, lat, lon) in stores.items():
            if s != "far" and all((p, chain) in prices for p in items):
                on = {p: offers[p, s] for p in items if (p, s) in offers and offers[p, s][0] < prices[p, chain]}
                total = sum((on[p][0] if p in on else prices[p, chain]) * q for p, q in items.items())
                row = (total, km(lat, lon), s, sum(prices[p, chain] * q for p, q in items.items()), len(on), min((u for _, u in on.values() if u), default=None))
                want[k, chain] = min(want.get((k, chain), row), row, key=lambda r: r[:3])
    got = {(r["list_id"], r["chain"]): (r["total_with_promos"], r["store_key"], r["total_list"], r["items_on_promo"], r["valid_until"]) for r in found.collect()}
    assert got == {k: (r[0], *r[2:]) for k, r in want.items()} and any(r[3] for r in got.values()) and not all(r[3] for r in got.values())
    assert most_rows(found) < 6000


def test_zones_are_met_after_the_last_shuffle(spark):
    """40 zones and 100 lists: quotes as by asking each zone's chains, and no shuffle of more rows than the lists have."""
    rng = random.Random(81)
    prices = {(f"p{k}", c): float(rng.randint(20, 60)) for k in range(30) for c in "abcdef" if rng.random() < 0.6}
    lists = {k: {f"p{i}": rng.choice([0, 1, 3, 120, None]) for i in rng.sample(range(32), rng.randint(1, 6))} for k in range(100)}
    zones = {f"z{k}": rng.sample("abcdefg", rng.randint(1, 3)) for k in range(40)} | {"none": ["g"]}
    asked = spark.createDataFrame([(k, *i) for k, items in lists.items() for i in items.items()], "list_id int, product_id string, quantity int")
    found = baskets.quote_lists_in_zone(asked, _same(spark, [(*k, v) for k, v in prices.items()]), spark.createDataFrame([(z, c) for z, cs in zones.items() for c in cs], "zone_id string, chain string"))
    want = {}
    for k, items in lists.items():
        for z, chains in zones.items():
            every = {p for p in items if any((p, c) in prices for c in chains)}
            for c in chains:
                own = [p for p in items if (p, c) in prices]
                if own:
                    want[k, z, c] = (sum(prices[p, c] * min(99, max(1, items[p] or 1)) for p in own), len(own), len(own) == len(every), sorted(every - {*own}))
    assert {(r["list_id"], r["zone_id"], r["chain"]): (r["total"], r["priced"], r["complete"], r["missing"]) for r in found.collect()} == want
    assert most_rows(found, "shuffleRecordsWritten") <= sum(map(len, lists.values())) < len(want)


def test_doubted_stores_meet_few_clean_ones(spark):
    """600 doubted stores at 40 spots among 600 clean ones: provinces and localities as from all pairs, far fewer of which meet."""
    rng = random.Random(5)
    spots = [(-34.6 + rng.uniform(-0.4, 0.4), -58.4 + rng.uniform(-0.4, 0.4)) for _ in range(40)] + [(-30.0, -60.0)]
    places = [(-34.6 + rng.uniform(-0.4, 0.4), -58.4 + rng.uniform(-0.4, 0.4), rng.choice(["AR-B", "AR-B", "AR-X"])) for _ in range(300)]
    doubted = [(f"d{k}", *spots[k % 41], rng.choice([("AR-C", "Uno"), ("x", "Uno"), ("AR-B", "Cordoba"), ("AR-B", "Salta")])) for k in range(600)]
    clean = [(f"c{k}", *places[k % 300][:2], (places[k % 300][2], f"Lugar {k % 300}")) for k in range(600)]
    columns = "company_id string, banner_id string, store_id string, name string, type string, street string, number string, neighbourhood string, locality string, province string, postcode string, lat double, lon double"
    stores = spark.createDataFrame([("1", "1", s, s, "t", "c", "1", None, loc, prov, "0", lat, lon) for s, lat, lon, (prov, loc) in doubted + clean], columns)
    found = dims.store_dimension(stores, stores.select("company_id", "store_id", "neighbourhood"))

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371.0088 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    named, want = {"Cordoba": "AR-X", "Salta": "AR-A"}, {s: p for s, _, _, p in clean}
    for s, lat, lon, (prov, loc) in doubted:
        near = min(((r[2] != named.get(loc), round(km(lat, lon, *r[:2]), 9), r[2], f"Lugar {k}") for k, r in enumerate(places) if km(lat, lon, *r[:2]) <= 50), default=None)
        want[s] = (prov, loc) if near is None else (near[2], near[3] if loc in named else loc)
    assert {r["store_id"]: (r["province"], r["locality"]) for r in found.collect()} == want


def test_spots_leave_the_rings(spark, monkeypatch):
    """What the nearest search hands to the radius joins: spots, not stores, and fewer from ring to ring."""
    met, plain = [], dims.within_km
    monkeypatch.setattr(dims, "within_km", lambda points, places, km, **more: met.append((points.count(), places.count())) or plain(points, places, km, **more))
    stores = spark.range(3000).selectExpr("'1' AS company_id", "'1' AS banner_id", "CAST(id AS STRING) AS store_id", "'n' AS name", "'t' AS type", "'c' AS street", "'1' AS number", "CAST(NULL AS STRING) AS neighbourhood", "concat('L', id % 5) AS locality", "CASE WHEN id % 2 = 0 THEN 'AR-C' ELSE 'AR-B' END AS province", "'0' AS postcode", "-34.6 + (id % 20) * 0.01D AS lat", "-58.4 + (id % 13) * 0.01D AS lon")
    assert dims.store_dimension(stores, stores.select("company_id", "store_id", "neighbourhood")).filter("province = 'AR-B'").count() == 3000
    assert met and met[0] == (130, 130) and all(points <= 130 for points, _ in met)


def test_products_are_not_broadcast(spark):
    """4000 products whose index is a small file: of the search's plan only questions and their words are broadcast."""
    products = spark.range(4000).selectExpr("CAST(id AS STRING) AS product_id", "concat('articulo ', id % 7) AS description", "'m' AS brand", "'' AS search_text", "'Cosas' AS category", "CAST(NULL AS DOUBLE) AS qty", "CAST(NULL AS STRING) AS unit", "1L AS chains")
    found = catalog.bulk_search(spark.createDataFrame([("q", "articulo 3"), ("r", "cosas 5")], "query_id string, text string"), products, 2)
    assert sorted((r["query_id"], r["rank"], r["product_id"]) for r in found.collect()) == [("q", 1, "10"), ("q", 2, "1004"), ("r", 1, "1006"), ("r", 2, "1013")]
    assert most_rows(found, kind="BroadcastExchange") <= 10


def test_sets_of_many_stores(monkeypatch):
    """3000 stores with few of 18 items each: a small share of the pairs and threes is costed, with all pairs in a matrix or not."""
    rng = np.random.default_rng(84)
    cost = np.round(rng.uniform(50, 150, (3000, 18)), 2)
    cost[rng.random(cost.shape) < 0.87] = np.inf
    km, found = np.round(rng.uniform(0, 10, 3000), 3), []
    seen: list[int] = []
    best = baskets.best_sets(cost, km, 3, seen)
    assert sum(seen) < 3000 * 2999 * 2998 / 6 / 1000
    # Of stores with most items, where plain search is possible, the same.
    few = np.argsort(-np.isfinite(cost).sum(axis=1), kind="stable")[:150]
    for most in (1024, 0):
        monkeypatch.setattr(baskets, "_ALL_PAIRS", most)
        found.append(baskets.best_sets(cost[few], km[few], 3))
    assert found[0] == found[1] and all(best[k][:2] <= found[0][k][:2] for k in best)


def test_plans_are_made_once(spark):
    """What reads the plans three times reads a table, and doesn't search three times."""
    plans = spark.range(2).selectExpr("CAST(id AS STRING) AS basket_id", "1 AS k").groupBy("basket_id").applyInPandas(lambda rows: rows.assign(stores=[[{"id": "s", "distance": 1.0, "equivalents": 0, "subtotal": 5.0, "items": ["a", "b"]}]], total=5.0, covered=2, distance_sum=1.0), baskets._PLAN)
    option = baskets.best_option(plans)
    assert "FlatMapGroups" not in option._jdf.queryExecution().executedPlan().toString()
    assert [(r["basket_id"], r["total"], r["saving_vs_one"], r["uncovered"]) for r in option.orderBy("basket_id").collect()] == [("0", 5.0, 0.0, []), ("1", 5.0, 0.0, [])]


def test_skyline_against_all_pairs():
    rng = np.random.default_rng(8)
    for n, items, missing in ((200, 6, 0.4), (200, 20, 0.8), (150, 3, 0.0)):
        cost = np.round(rng.uniform(1, 9, (n, items)))
        cost[rng.random(cost.shape) < missing] = np.inf
        cost, km = np.unique(cost, axis=0), np.round(rng.uniform(0, 5, n), 1)
        km = km[: len(cost)]
        want = [i for i in range(len(km)) if ((km <= km[i]) & (cost <= cost[i]).all(axis=1)).sum() == 1]
        assert baskets._skyline(cost, km).tolist() == want


def test_equal_stores_of_a_place_meet_points_as_one(spark, monkeypatch):
    """500 stores of two costs at two places, 20 points: the plans name the nearest and count its equals; rows stay few, also
    in the tables that are written on the way."""
    made, plain = [], baskets.written
    monkeypatch.setattr(baskets, "written", lambda df, name: made.append(most_rows(df)) or plain(df, name))
    shops = [(str(k), "medio", f"c{i}", "g", 1.0 + (k % 2), -34.6 + 0.02 * (k % 2), -58.4) for k in range(500) for i in range(2)]
    prices = spark.createDataFrame([("1", s, c, t, u, v, lat, lon) for s, t, c, u, v, lat, lon in shops], "company_id string, store_id string, category string, tier string, unit string, median_unit_price double, lat double, lon double")
    wanted = spark.createDataFrame([(str(b), f"c{i}", "medio", "g", 10.0) for b in range(20) for i in range(2)], "basket_id string, category string, tier string, unit string, quantity double")
    points = spark.createDataFrame([(str(b), -34.6 + 0.0001 * b, -58.4, 2) for b in range(20)], "basket_id string, lat double, lon double, max_stores int")
    plans = baskets.best_store_combinations(wanted, points, prices)
    rows = plans.collect()
    assert len(rows) == 40 and {(r["total"], r["covered"], r["stores"][0]["id"], r["stores"][0]["equivalents"]) for r in rows} == {(20.0, 2, "1-0", 249)}
    assert max([most_rows(plans), *made]) <= 1000
