"""Golden rows for sizes, pieces, credibility, names, histories and promos."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from gondola.functions import text
from gondola.operators import prices, promos
from gondola.params import Params

DAY = date(2026, 11, 11)


def one(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


SIZES = [
    ("arroz", "ARROZ PARBOIL GALLO ORO BOLSA X 500 GRS", "1", "UNI", 500, "g"),
    ("kilo", "ARROZ INTEGRAL LUCCHETTI X 1 KG", "1", "UNI", 1000, "g"),
    ("pack", "ALFAJOR CHOCOLATE TERRABUSI 6 X 50 GRS", "1", "UNI", 300, "g"),
    ("gaseosa", "GASEOSA COCA COLA 2,25 L", "1", "UNI", 2250, "cc"),
    ("miles", "HARINA 000 BLANCAFLOR X 1.000 GR", "1", "UNI", 1000, "g"),
    ("huevos", "HUEVO BLANCO CARREFOUR CARTON X 30 UNI", "1", "UNI", 1, "unidad"),
    ("vitamina", "VITAMINA C 500 MG X 30 COMP", "1", "UNI", 1, "unidad"),
    ("vea_leche", "LECHE UAT DESC 1% TREGAR 1L BRK-1000-ml.", "1.00", "ml.", 1000, "cc"),
    ("vea_coco", "LECHE DE COCO EN POLVO VEG GOLDEN 150G DOY-154-gr.", ".15", "gr.", 150, "g"),
    ("dia", "ARROZ LARGO FINO X 1 KG", "500.00", "GR", 500, "g"),
    ("unknown", "COSA", "1", "XX", None, None),
    ("empty", None, None, None, None, None),
]


def test_package_sizes(spark):
    raw = one(spark, [("1", "1", "1", k, "2.5", DAY, q, u, d) for k, d, q, u, _, _ in SIZES], "company_id string, banner_id string, store_id string, product_id string, list_price string, data_date date, declared_qty string, declared_unit string, description string")
    found = {r["product_id"]: (r["qty"], r["unit"]) for r in prices.stage_prices(raw).collect()}
    assert found == {k: (None if q is None else float(q), u) for k, _, _, _, q, u in SIZES}
    cheap = raw.withColumn("list_price", F.lit("1"))
    assert prices.stage_prices(cheap).count() == 0 and prices.stage_prices(raw.withColumn("list_price", F.lit("x"))).count() == 0


PIECES = [
    ("HUEVO BLANCO CARREFOUR CARTON X 30 UNI", 30),
    ("HUEVOS BL MAPLE X30", 30),
    ("HUEVOS COLOR MEDIA DOCENA", 6),
    ("UNA DOCENA", 12),
    ("KIMBIES TOA HUM 48UN", 48),
    ("SERVILLETA FESTA 25X25 CM ORO X 20 UNI", 20),
    ("NUK NUK CHUPET SIGNAT X2 T3 AZUL", 2),
    ("PAMPERS PANTS", None),
    ("BOLSA CAMISETA VERDE 45 X 55 OXO BIODEGRADABLE", None),
    ("PAPEL DE ALUMINIO PURITY X 7.5 MTS", None),
    ("HUEVOS MAPLE GRANDE", 30),
]


def test_pieces(spark):
    df = one(spark, [(d,) for d, _ in PIECES], "d string").select("d", text.pieces_in_text(F.col("d")).alias("n"))
    assert {r["d"]: r["n"] for r in df.collect()} == dict(PIECES)


def test_tiers_by_piece(spark):
    rows = [("a", 7200.0, 1.0, "HUEVO BLANCO CARREFOUR CARTON X 30 UNI", "Huevos"), ("b", 6000.0, 1.0, "HUEVOS BL MAPLE X30", "Huevos"), ("c", 2400.0, 12.0, "HUEVO BLANCO X 12", "Huevos"), ("d", 1800.0, 1.0, "HUEVOS COLOR MEDIA DOCENA", "Huevos"), ("e", 4800.0, 1.0, "KIMBIES TOA HUM 48UN", "Higiene bebe"), ("f", 3000.0, 1.0, "SERVILLETA FESTA 25X25 CM ORO X 20 UNI", "Descartables"), ("g", 5000.0, 1.0, "TAZA CERAMICA X 6", "Bazar y hogar"), ("h", 900.0, 1.0, "PAMPERS PANTS", "Panales"), ("j", 900.0, 1.0, "NUK NUK CHUPET SIGNAT X2 T3 AZUL", "Higiene bebe"), ("i", 100.0, 1.0, "X", "Otros")]
    staged = one(spark, [(k, p, q, "unidad") for k, p, q, _, _ in rows], "product_id string, price double, qty double, unit string")
    cats = one(spark, [(k, d, c, "s") for k, _, _, d, c in rows], "product_id string, description string, category string, section string")
    found = {r["product_id"]: (r["unit_price"], r["pieces"]) for r in prices.product_tiers(staged, cats).collect()}
    assert found == {"a": (240, 30), "b": (200, 30), "c": (200, 12), "d": (300, 6), "e": (100, 48), "f": (150, 20), "g": (5000, None)}


def chain_rows(spark, rows, day=DAY):
    """rows: (chain, company, price[, date])."""
    return one(spark, [(r[3] if len(r) > 3 else day, "p", r[0], r[1], "supermercado", float(r[2]), float(r[2]), float(r[2]), 5, 500.0, "g") for r in rows], "data_date date, product_id string, chain string, company_id string, format string, median_price double, min_price double, max_price double, stores long, qty double, unit string")


CATS = [("p", "YERBA", "MARCA", "Yerba mate", "Almacen")]
CAT_SCHEMA = "product_id string, description string, brand string, category string, section string"


def assessed(spark, rows):
    return {r["chain"]: r for r in prices.same_product(chain_rows(spark, rows), one(spark, CATS, CAT_SCHEMA), None, DAY).collect()}


def test_other_company_confirms(spark):
    r = assessed(spark, [("Changomas", "9", 1590), ("Carrefour", "2", 1695), ("Coto", "12", 3316), ("Jumbo", "15", 3400), ("La Anonima", "11", 3600)])
    assert not r["Changomas"]["in_range"] and r["Changomas"]["credible"]
    assert all(r[c]["in_range"] for c in ("Coto", "Jumbo", "La Anonima"))


def test_same_company_out_of_range_is_no_proof(spark):
    r = assessed(spark, [("HiperChangomas", "9", 340), ("Changomas", "9", 360), ("SuperChangomas", "9", 4939), ("Coto", "12", 5150), ("La Anonima", "11", 5100)])
    assert {c for c, x in r.items() if not x["credible"]} == {"HiperChangomas", "Changomas"}


def test_sibling_in_range_confirms(spark):
    r = assessed(spark, [("Vea", "15", 1900), ("Jumbo", "15", 1999), ("Carrefour", "2", 3849), ("Coto", "12", 3900)])
    assert not r["Vea"]["in_range"] and r["Vea"]["credible"]


def test_reference_counts_companies(spark):
    r = assessed(spark, [("Carrefour", "10", 1100), ("Maxi", "10", 1400), ("Coto", "12", 2000), ("Dia", "15", 2200), ("Vea", "9", 3000)])
    assert {x["reference"] for x in r.values()} == {2100.0}


def test_prices_are_carried(spark):
    d = lambda k: date(2026, 11, k)
    r = assessed(spark, [("Coto", "12", 1000, d(11)), ("Coto", "12", 990, d(10)), ("Carrefour", "2", 1010, d(11)), ("Jumbo", "9", 1100, d(10)), ("Jumbo", "9", 1050, d(9)), ("Dia", "15", 900, d(8))])
    assert set(r) == {"Coto", "Carrefour", "Jumbo"} and r["Jumbo"]["price_date"] == d(10) and r["Jumbo"]["highest"] == 1100
    assert r["Coto"]["is_cheapest"] and not r["Jumbo"]["is_cheapest"]


def test_names(spark):
    raw = one(spark, [("p", "15", "YERBA", "PLAYA", DAY), ("p", "12", "YERBA MATE SUAVE C PALO PLAYADITO X 500 GRS.", "PLAYADITO", DAY), ("p", "9", "PLAYADITO YERBA MATE SUAVE 500G", "PLAYADITO", DAY), ("p", "2", "Yerba Mate PLAYADITO Suave x500gr PAQ-500-gr.", "PLAYADITO", DAY), ("q", "2", None, None, DAY)], "product_id string, company_id string, description string, brand string, data_date date")
    r = prices.product_names(raw, raw.select("product_id"), DAY).collect()
    assert [(x["description"], x["brand"]) for x in r] == [("PLAYADITO YERBA MATE SUAVE 500G", "PLAYADITO")]


def test_pharmacy_wins_only_in_its_sections(spark):
    rows, cats = [], []
    for k in range(25):
        rows += [(f"S{k}", "Farmacity", "farmacia", 900.0), (f"S{k}", "Coto", "supermercado", 1000.0), (f"C{k}", "Farmacity", "farmacia", 500.0), (f"C{k}", "Coto", "supermercado", 600.0), (f"C{k}", "Dia", "supermercado", 650.0)]
        cats += [(f"S{k}", "d", "b", "Perfumeria", "Higiene"), (f"C{k}", "d", "b", "Golosinas y chocolates", "Almacen")]
    pc = one(spark, [(DAY, *r) for r in rows], "data_date date, product_id string, chain string, format string, median_price double")
    found = prices.who_wins(pc, one(spark, cats, CAT_SCHEMA)).collect()
    assert {(r["category"], r["chain"], r["won"]) for r in found} == {("Perfumeria", "Farmacity", 25), ("Golosinas y chocolates", "Coto", 25)}


def test_price_history(spark):
    today = date(2026, 11, 25)
    same = one(spark, [(today, today, "yerba", "Dia", 4200.0, True), (today, today, "aceite", "Dia", 3600.0, True), (today, date(2026, 11, 24), "cafe", "Coto", 6000.0, True), (today, today, "aceite", "Jumbo", 40000.0, False)], "data_date date, price_date date, product_id string, chain string, median_price double, credible boolean")
    old = date(2026, 11, 18)
    schema = "data_date date, price_date date, product_id string, chain string, price double"
    history = one(spark, [(old, old, "yerba", "Dia", 4200.0), (old, old, "aceite", "Dia", 4000.0), (old, old, "aceite", "Jumbo", 4100.0)], schema)
    want = {("aceite", "Dia", 3600.0), ("cafe", "Coto", 6000.0)}
    got = prices.price_history_update(same, history)
    assert {(r["product_id"], r["chain"], r["price"]) for r in got.collect()} == want
    again = prices.price_history_update(same, history.unionByName(got))
    assert {(r["product_id"], r["chain"], r["price"]) for r in again.collect()} == want
    changes = prices.recent_price_changes(history.unionByName(got), same).collect()
    assert [(r["product_id"], r["previous_price"], r["price"], r["change_pct"]) for r in changes] == [("aceite", 4000.0, 3600.0, -10.0)]


def test_index_history_keeps_good_dates(spark):
    d = lambda k: date(2026, 9, k)
    batch = one(spark, [(d(21), None), (d(22), 1.01)], "data_date date, factor double")
    kept = prices.index_history_update(batch, one(spark, [(d(21), 1.02)], "data_date date, factor double"))
    assert [r["data_date"] for r in kept.collect()] == [d(22)]
    kept = prices.index_history_update(one(spark, [(d(18), None)], "data_date date, factor double"), one(spark, [(d(14), 1.0)], "data_date date, factor double"))
    assert [r["data_date"] for r in kept.collect()] == [d(18)]


@pytest.mark.parametrize(
    ("legend", "until", "declared", "multi"),
    [
        ("15% de descuento. Vigencia desde el 01/11/2026 al 18/11/2026", "2026-11-18", 15.0, False),
        ("valida hasta el 5/1/2027", "2027-01-05", None, False),
        ("hasta 2026-11-17", "2026-11-17", None, False),
        ("hasta 31/02/2026", "2026-02-31", None, False),
        ("hasta 31/13/2026", None, None, False),
        ("LLEVANDO 2", None, None, True),
        ("2x1 en todo", None, None, True),
        ("2 x $ 500", None, None, True),
        ("2da unidad al 50%", None, 50.0, True),
        ("12,5 % off", None, 12.5, False),
        (None, None, None, False),
    ],
)
def test_legends(spark, legend, until, declared, multi):
    r = one(spark, [(legend,)], "x string").select(text.valid_until(F.col("x")).alias("u"), text.declared_discount(F.col("x")).alias("d"), text.multi_buy(F.col("x")).alias("m")).first()
    assert (r["u"], r["d"], r["m"]) == (until, declared, multi)


def test_promo_levels(spark):
    schema = "product_id string, company_id string, banner_id string, store_id string, data_date date, description string, brand string, list_price string, promo1_price string, promo1_legend string, promo2_price string, promo2_legend string"
    raw = one(
        spark,
        [
            ("a", "1", "1", "1", DAY, "d", "b", "100", "80", "20% de descuento", None, None),
            ("a", "2", "1", "1", DAY, "d", "b", "90", "150", None, "60", None),
            ("b", "1", "1", "1", DAY, "d", "b", "100", "40", None, "x", None),
            ("c", "1", "1", "1", DAY, "d", "b", "100", "95", None, None, None),
        ],
        schema,
    )
    ev = {(r["product_id"], r["company_id"]): r for r in promos.promo_evidence(raw, DAY).collect()}
    assert ev["a", "1"]["evidence"] == "leyenda" and ev["a", "1"]["market_reference"] == 90
    assert ev["a", "2"]["evidence"] == "mercado" and ev["a", "2"]["market_ratio"] == 0.6 and ev["a", "2"]["promo_kind"] == "promo2"
    assert ev["b", "1"]["evidence"] == "sin_verificar"
    valid = {r["product_id"] for r in promos.valid_promos(promos.promo_evidence(raw, DAY)).collect()}
    assert valid == {"a"}
    loose = promos.valid_promos(promos.promo_evidence(raw, DAY), Params(promo_max_unverified_pct=60)).select("product_id").distinct().collect()
    assert {r["product_id"] for r in loose} == {"a", "b"}


PROMO_SCHEMA = "product_id string, description string, brand string, list_price double, promo_price double, discount_pct double, legend string, promo_kind string, evidence string, multi_buy boolean, stores array<string>"


def test_promos_near(spark):
    stores = one(spark, [("15-1", "Dia", -34.60, -58.40), ("15-2", "Dia", -34.605, -58.40), ("10-1", "Carrefour", -34.61, -58.40), ("10-9", "Carrefour", -35.6, -58.40)], "store_key string, chain string, lat double, lon double")
    p = lambda i, price, where, legend=None, multi=False: (i, i, "b", 3800.0, price, 10.0, legend, "promo1", "leyenda", multi, where)
    table = one(spark, [p("levite", 2470.0, ["15-2", "15-1"], "al 20/11/2026"), p("levite", 2900.0, ["10-1"]), p("levite", 2000.0, ["10-9"]), p("levite", 3000.0, ["15-1"]), p("cafe", 5000.0, ["15-1"], "hasta 17/11/2026"), p("galletitas", 100.0, ["15-1"], None, True)], PROMO_SCHEMA)
    asked = one(spark, [(1, -34.60, -58.40, i) for i in ("levite", "cafe", "galletitas")], "point_id int, lat double, lon double, product_id string")
    rows = promos.promos_near(table, stores, asked, "2026-11-18").orderBy("product_id", "rank").collect()
    assert [(r["product_id"], r["chain"], r["promo_price"], r["store_key"], r["other_stores"]) for r in rows] == [("galletitas", "Dia", 100.0, "15-1", 0), ("levite", "Dia", 2470.0, "15-1", 1), ("levite", "Carrefour", 2900.0, "10-1", 0)]
    same = one(spark, [("levite", c, 3800.0, True, "supermercado") for c in ("Dia", "Carrefour")] + [("galletitas", "Dia", 500.0, True, "supermercado")], "product_id string, chain string, median_price double, credible boolean, format string")
    lists = one(spark, [(7, "levite", 2), (7, "galletitas", 1)], "list_id int, product_id string, quantity int")
    total = promos.list_total_with_promos(lists, same, table, stores, one(spark, [(7, -34.6, -58.4)], "list_id int, lat double, lon double"), "2026-11-18").collect()
    assert [(r["chain"], r["total_with_promos"], r["total_list"], r["items_on_promo"], r["valid_until"], r["store_key"]) for r in total] == [("Dia", 5440.0, 8100.0, 1, "2026-11-20", "15-1")]
