"""Jobs that must hold for few huge groups, long histories and many candidates: against plain versions, and how they get there."""

import random
import re
import unicodedata
from datetime import date
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gondola.functions import stats
from gondola.operators import baskets, catalog, price_state, prices
from gondola.plans import feeds, registry
from gondola.sources import ingest, snapshots

SF = "/root/testdata/sf0.001"


def same_rows(a, b):
    key = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    return key(a) == key(b)


# Selection by rank


def test_selected_ranks_and_limits(spark):
    rng = random.Random(3)
    rows = [("big", float(rng.choice([1, 2, 2.5, rng.random() * 9]))) for _ in range(3000)] + [("one", 4.0)] + [("two", 1.0), ("two", 7.0)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r["g"]: (r["low"], r["high"]) for r in stats.group_limits(df, ["g"], "v").collect()}
    want = {r["g"]: (r["low"], r["high"]) for r in df.filter("v IS NOT NULL").groupBy("g").agg(stats.quantile("v", 0.1).alias("low"), stats.quantile("v", 0.9).alias("high")).collect()}
    assert found == want


def test_no_task_holds_a_whole_group(spark):
    """One category holds all rows: its ranges are about even, and a wanted rank reads one of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(8000).select(F.lit("all").alias("g"), ((F.col("id") * 7919) % 8000).cast("double").alias("v"))
        sliced = stats.ranked_slices(df, ["g"], ["v"])
        sizes = [r["count"] for r in sliced.groupBy("g", "_slice").count().collect()]
        assert len(sizes) == 4 and max(sizes) < 4000
        picked = stats.select_ranks(sliced, ["g"], ["v"], {"a": lambda n: F.lit(1), "b": lambda n: n / 2, "c": lambda n: n}).first()
        assert (picked["a"]["v"], picked["b"]["v"], picked["c"]["v"]) == (0.0, 3999.0, 7999.0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_terciles_as_ntile(spark):
    rng = random.Random(5)
    for n in (1, 2, 3, 4, 50):
        rows = [("c", "g", float(rng.randint(1, 4)), f"p{k:03}") for k in range(n)]
        cats = spark.createDataFrame([(p, "d", "b", c, "s") for c, _, _, p in rows], "product_id string, description string, brand string, category string, section string")
        facts = spark.createDataFrame([(p, v, 10.0, u, date(2026, 1, 1)) for _, u, v, p in rows], "product_id string, price double, qty double, unit string, data_date date")
        found = {r["product_id"]: r["tier"] for r in prices.product_tiers(facts, cats).collect()}
        order = sorted(rows, key=lambda r: (r[2], r[3]))
        ends = [n // 3 + (n % 3 > 0), 2 * (n // 3) + min(n % 3, 2)]
        assert found == {r[3]: "economico" if k < ends[0] else "medio" if k < ends[1] else "premium" for k, r in enumerate(order)}


# State of the price history


def test_price_state_replays_days(spark, tmp_path):
    rng = random.Random(9)
    days = [date(2026, 1, k) for k in range(1, 8)]
    table = {d: {(f"p{k}", c): float(rng.choice([10, 10.004, 11, 12])) for k in range(30) for c in ("x", "y") if rng.random() < 0.8} for d in days}
    frame = lambda d: spark.createDataFrame([(d, d, *k, v) for k, v in table[d].items()], "data_date date, price_date date, product_id string, chain string, price double")
    root, last, want, history = f"file://{tmp_path}/state", {}, {}, []
    for d in days:
        want[d] = sorted((k, v) for k, v in table[d].items() if k not in last or abs(v - last[k]) > 0.005)
        last.update(dict(want[d]))
    rows = lambda df: sorted(((r["product_id"], r["chain"]), r["price"]) for r in df.collect())
    for d in days:
        out = price_state.advance_price_state(frame(d), root, d, buckets=3)
        assert rows(out) == want[d]
        history += [(d, d, *k, v) for k, v in want[d]]
    for d in (days[3], days[6]):
        assert rows(price_state.advance_price_state(frame(d), root, d)) == want[d]
    # The same from the whole history, and from a state that is rebuilt from it.
    past = spark.createDataFrame(history, "data_date date, price_date date, product_id string, chain string, price double")
    same = frame(days[6]).withColumnRenamed("price", "median_price").withColumn("credible", F.lit(True))
    assert rows(prices.price_history_update(same, past, days[6])) == want[days[6]]
    other = f"file://{tmp_path}/rebuilt"
    price_state.rebuild_price_state(past, other, days[5], 2)
    assert rows(price_state.advance_price_state(frame(days[6]), other, days[6])) == want[days[6]]
    assert price_state.drop_old_states(spark, root, 2) == 7 and rows(price_state.advance_price_state(frame(days[6]), root, days[6])) == want[days[6]]
    assert price_state.state_before(spark, f"file://{tmp_path}/empty", days[0]) is None


def test_price_state_is_not_shuffled(spark, tmp_path):
    root, day = f"file://{tmp_path}/state", date(2026, 1, 2)
    past = spark.range(5000).selectExpr("DATE '2026-01-01' AS data_date", "DATE '2026-01-01' AS price_date", "CAST(id AS STRING) AS product_id", "concat('c', id % 3) AS chain", "CAST(id AS DOUBLE) AS price")
    price_state.rebuild_price_state(past, root, date(2026, 1, 1), 4)
    state, buckets = price_state.state_before(spark, root, day)
    today = past.limit(10).groupBy("product_id", "chain").agg(F.min("price").alias("new"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = state.join(today, ["product_id", "chain"], "full")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan[: plan.index("FileScan")]
    assert buckets == 4 and "SelectedBucketsCount: 4 out of 4" in plan and "Exchange" not in above


# Search


def heard(text):
    t = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
    for pattern, short in ((r"(\d)\s*litros?\b", r"\1l"), (r"(\d)\s*(?:kilogramos?|kilos?)\b", r"\1kg"), (r"(\d)\s*gramos?\b", r"\1g"), (r"(\d)\s*mililitros?\b", r"\1ml"), (r"(\d)\s+(kg|kgs|gr|grs|g|lt|lts|l|ml|cc|un|u)\b", r"\1\2"), ("ll", "y"), ("v", "b"), ("z", "s"), ("c(?=[ei])", "s"), ("(?<!c)h", "")):
        t = re.sub(pattern, short, t)
    return re.findall(r"[a-z0-9]+(?:[.,][0-9]+)?[a-z]*", t)


def forms(w):
    return {w, re.sub("es$", "", w), re.sub("s$", "", w)} if len(w) > 3 else {w}


def plain_search(queries, products, k):
    out = []
    for q, text in queries:
        asked = [forms(w) for w in heard(text)]
        hits = []
        for p, description, brand, more, category, chains in products:
            visible, cats = set(heard(f"{description} {brand}")), {w for w in heard(category) if len(w) > 2}
            every = visible | set(heard(f"{more} {category}"))
            begins = lambda words: all(any(w.startswith(x) for w in words for x in f) for f in asked)  # noqa: E731, B023
            if not asked or not begins(every):
                continue
            touched = sum(any(forms(w) & f for f in asked) for w in cats)
            whole = all(any(forms(w) & f for w in visible) for f in asked)
            hits.append((2 if touched == 0 else 0 if touched == len(cats) else 1, not begins(visible), not whole, -chains, len(description), description, p))
        out += [(q, n, h[-1], h[0]) for n, h in enumerate(sorted(hits)[:k], 1)]
    return sorted(out)


def test_search_against_all_products(spark):
    """Words of every kind, with one that is in all products and queries of its first letter alone."""
    rng = random.Random(11)
    stock = ["aceite", "Azúcar", "arroz", "leche", "leches", "zapallo", "vino", "huevos", "chocolate", "agua", "1.5l", "500 gramos", "yerba", "llave", "pan", "panes"]
    products = [(f"p{k:03}", " ".join(rng.sample(stock, 2)), rng.choice(["Marca", "Otra"]), "aaa " + rng.choice(stock), rng.choice(["Leches", "Aceites y vinagres", "Pan"]), rng.randint(1, 4)) for k in range(150)]
    queries = [(f"q{k}", t) for k, t in enumerate(["a", "a leche", "aaa", "leche", "leches marca", "sapayo", "bino a", "500 g", "500g arroz", "pan a l", "", "nada", "uevo", "choc otra", "a", "LECHE", "aceite vinagres"])]
    table = spark.createDataFrame([(*p[:5], None, None, p[5]) for p in products], "product_id string, description string, brand string, search_text string, category string, qty double, unit string, chains long")
    found = catalog.bulk_search(spark.createDataFrame(queries, "query_id string, text string"), table, 7)
    assert sorted((r["query_id"], r["rank"], r["product_id"], r["category_match"]) for r in found.collect()) == plain_search(queries, products, 7)


def test_search_starts_from_the_rarest_word(spark):
    products = spark.range(4000).selectExpr("CAST(id AS STRING) AS product_id", "concat('articulo ', CASE WHEN id < 3 THEN 'raro' ELSE 'comun' END) AS description", "'m' AS brand", "'' AS search_text", "'Cosas' AS category", "CAST(NULL AS DOUBLE) AS qty", "CAST(NULL AS STRING) AS unit", "1L AS chains")
    index = catalog._search_index(products)
    asked = spark.createDataFrame([("a raro", [["a"], ["raro"]]), ("c articulos rar", [["c"], ["articulos", "articulo"], ["rar"]])], "question string, forms array<array<string>>")
    assert catalog._candidates(asked, index).count() == 6


# Store combinations


def all_sets(cost, km, most):
    """The best key of each size, every set compared."""
    best, n = {}, 0
    for size in range(1, most + 1):
        if size == 3:
            groups = ((i, j, k) for i, j in combinations(range(len(km)), 2) for k in range(j + 1, len(km)))
        else:
            groups = combinations(range(len(km)), size)
        for g in groups:
            n += 1
            low = cost[list(g)].min(axis=0)
            found = np.isfinite(low)
            key = (-int(found.sum()), round(float(low[found].sum()), 9), round(float(km[list(g)].sum()), 9))
            if size not in best or key < best[size]:
                best[size] = key
    return best, n


@pytest.mark.parametrize(("stores", "items", "missing"), [(30, 8, 0.3), (60, 25, 0.05), (40, 12, 0.6)])
def test_bounded_sets_equal_all_sets(stores, items, missing):
    rng = np.random.default_rng(stores)
    cost = np.round(rng.uniform(50, 150, (stores, items)) * rng.uniform(0.8, 1.2, (stores, 1)), 2)
    cost[rng.random(cost.shape) < missing] = np.inf
    km, want = np.round(rng.uniform(0, 10, stores), 3), None
    want, n = all_sets(cost, km, 3)
    seen: list[int] = []
    got = baskets.best_sets(cost, km, 3, seen)
    assert {s: k[:3] for s, k in got.items()} == want and sum(seen) < n


@pytest.mark.parametrize("missing", [0.0, 0.05, 0.3])
def test_bounds_on_the_largest_case(missing):
    """120 stores and 25 items: a fraction of the 288,100 sets is costed."""
    rng = np.random.default_rng(1)
    cost = np.round(rng.uniform(50, 150, (120, 25)) * rng.uniform(0.8, 1.2, (120, 1)), 2)
    cost[rng.random(cost.shape) < missing] = np.inf
    seen = []
    assert set(baskets.best_sets(cost, rng.uniform(0, 10, 120), 3, seen)) == {1, 2, 3} and sum(seen) < 0.2 * 288_100


def test_store_plans_of_the_registered_query(spark):
    """Plans of one to three stores at sf0.001, against all sets of the stores in reach."""
    t = registry.Tables(spark, SF)
    wanted, points = registry._baskets_at_points(t)
    want = {}
    price = {}
    for r in t.store_prices.collect():
        price.setdefault((r["company_id"], r["store_id"], r["lat"], r["lon"]), {})[r["category"], r["tier"], r["unit"]] = r["median_unit_price"]
    ask = {}
    for r in wanted.collect():
        ask.setdefault(r["basket_id"], {})[r["category"], r["tier"], r["unit"]] = float(r["quantity"])

    def km(a, b, c, d):
        a, b, c, d = map(np.radians, (a, b, c, d))
        return 2 * 6371.0088 * np.arcsin(np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2))

    for r in points.collect():
        items = ask[r["basket_id"]]
        near = [p for (_, _, lat, lon), p in price.items() if km(r["lat"], r["lon"], lat, lon) <= 10]
        best = None
        for k in (1, 2, 3):
            for g in combinations(near, k):
                have = [min(p[i] * q for p in g if i in p) for i, q in items.items() if any(i in p for p in g)]
                if have:
                    key = (-len(have), round(sum(have), 6))
                    best = key if best is None else min(best, key)
            if best:
                want[r["basket_id"], k] = best
    plans = registry.QUERIES["k84_best_store_combinations"](spark, SF)
    assert {(r["basket_id"], r["k"]): (-r["covered"], round(r["total"], 6)) for r in plans.collect()} == want
    options = registry.QUERIES["k89_best_option"](spark, SF).collect()
    assert {r["basket_id"]: (-r["covered"], round(r["total"], 6)) for r in options} == {b: min(v for (x, _), v in want.items() if x == b) for b, _ in want}


# Loads


def test_committed_partitions(spark, tmp_path, monkeypatch):
    """A load that dies between stage and commit leaves readers the old partition; so does a half-written manifest."""
    monkeypatch.setattr(snapshots, "PATIENCE", 0.3)
    path = f"file://{tmp_path}/t"
    d = lambda k, v: spark.createDataFrame([(v, date(2026, 1, k))], "v int, data_date date")
    rows = lambda: sorted((r["data_date"].day, r["v"]) for r in snapshots.read_partitions(spark, path).collect())
    with pytest.raises(ValueError):
        snapshots.read_partitions(spark, path)
    assert snapshots.replace_partitions(d(1, 1).union(d(2, 2)), path) == ["2026-01-01", "2026-01-02"]
    load = snapshots.stage(d(2, 20).union(d(3, 30)), path)
    assert rows() == [(1, 1), (2, 2)]
    (tmp_path / "t" / snapshots.MANIFESTS / f"{2:012d}").write_text('{"2026-01-01": "v')
    assert rows() == [(1, 1), (2, 2)]
    assert snapshots.commit(spark, path, load) == ["2026-01-02", "2026-01-03"] and rows() == [(1, 1), (2, 20), (3, 30)]
    snapshots.replace_partitions(d(3, 31).withColumn("w", F.lit("new")), path)
    assert rows() == [(1, 1), (2, 20), (3, 31)] and snapshots.read_partitions(spark, path).filter("w = 'new'").count() == 1
    with pytest.raises(ValueError, match="empty"):
        snapshots.replace_partitions(d(1, 1).limit(0), path)
    assert snapshots.drop_partitions(spark, path, "2026-01-02") == ["2026-01-01"] and rows() == [(2, 20), (3, 31)]
    assert snapshots.vacuum(spark, path, 1) == 3 and rows() == [(2, 20), (3, 31)]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    """Another load takes the manifest's number in between: the second writer merges with it."""
    path = f"file://{tmp_path}/t"
    d = lambda k, v: spark.createDataFrame([(v, date(2026, 1, k))], "v int, data_date date")
    snapshots.replace_partitions(d(1, 1), path)
    numbers, once = snapshots._numbers, []

    def late(spark_, path_):
        found = numbers(spark_, path_)
        if len(found) == 1 and not once and late.armed:
            once.append(1)
            monkeypatch.setattr(snapshots, "_numbers", numbers)
            snapshots.replace_partitions(d(2, 2), path)
            monkeypatch.setattr(snapshots, "_numbers", late)
        return found

    late.armed = False
    monkeypatch.setattr(snapshots, "_numbers", late)
    load = snapshots.stage(d(3, 3), path)
    late.armed = True
    snapshots.commit(spark, path, load)
    assert sorted(r["v"] for r in snapshots.read_partitions(spark, path).collect()) == [1, 2, 3]


def test_feed_is_read_once_per_header(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"f{k}.csv").write_text("id|name\n" + f"{k}|a\n" if k % 2 else "name|id|x\n" + f'"b\nb"|{k}|1|2\n"c"|{k}|1\n', encoding="utf-8")
    paths, table = [f"file://{tmp_path}/f{k}.csv" for k in range(12)], f"file://{tmp_path}/table"
    rows = ingest._feed_rows(spark, paths, ["id", "name"])
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    assert ingest.load_price_feed(spark, paths, "2026-01-01", ["id", "name"], table, 6) == {"rows": 18, "bad": 6}
    with pytest.raises(ingest.TooManyBadRecords):
        ingest.load_price_feed(spark, paths[:4], "2026-01-01", ["id", "name"], table, 1)
    got = sorted((int(r["id"]), r["name"]) for r in snapshots.read_partitions(spark, table).collect())
    assert got == [(k, "a" if k % 2 else "c") for k in range(12)]
    assert not [p for p in (tmp_path / "table").glob("data_date=*/load=*") if len(list((tmp_path / "table").glob("data_date=*/load=*"))) > 1]


def test_alias_groups_give_the_sequential_places(spark):
    """Random places: the merges by group equal those over a whole province, and no group holds a province."""
    rng = random.Random(21)
    words = ["villa", "loma", "norte", "sur", "alta", "san", "juan", "rio"]
    rows = []
    for k in range(140):
        name = " ".join(rng.sample(words, rng.randint(1, 3)))
        lat, lon = rng.uniform(-34.9, -34.3), rng.uniform(-58.9, -58.3)
        spots = [(f"s{k}-{j}", lat + rng.uniform(-0.01, 0.01), lon + rng.uniform(-0.01, 0.01)) for j in range(rng.randint(1, 4))]
        rows.append((f"{name} {k}", f"{name} {k}", rng.choice(["AR-B", "AR-C", None]), float(np.median([s[1] for s in spots])), float(np.median([s[2] for s in spots])), len(spots), spots, name.split()))
    places = spark.createDataFrame(rows, f"key string, name string, province string, lat double, lon double, stores int, spots {baskets._SPOTS}, words array<string>")
    out = "name string, province string, members array<string>, aliases array<string>"
    whole = places.groupBy("province").applyInPandas(baskets._merge_aliases(2.0), out)
    grouped = baskets.alias_groups(places, 2.0)
    assert same_rows(whole, grouped.groupBy("province", "alias_group").applyInPandas(baskets._merge_aliases(2.0), out))
    assert whole.count() < 140 and max(r["count"] for r in grouped.groupBy("province", "alias_group").count().collect()) < 30


def test_scratch_leaves_nothing(spark):
    from gondola.sources import work

    with work.scratch(spark) as scope:
        first = registry.QUERIES["k62_carried_chains"](spark, SF).count()
        assert registry.QUERIES["k60_product_summary"](spark, SF).count() > 0 and first >= 0
        assert len([k for k in scope.shared if k[0] == "same"]) == 1
        folder = spark._jvm.org.apache.hadoop.fs.Path(scope.folder)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        assert fs.exists(folder)
    assert not fs.exists(folder)


def test_month_chain_runs_no_job(spark):
    from gondola.operators import index

    d = lambda k: date(2026, 1, k)
    rows = [(d(k), d(k - 1), 1.0) for k in (3, 4, 6, 7, 8)] + [(d(1), date(2025, 12, 31), 1.0), (d(9), d(8), None)]
    history = spark.createDataFrame(rows, "data_date date, base_date date, factor double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("month", "")
    chain = index.month_chain(history, "2026-01")
    assert len(tracker.getJobIdsForGroup("month")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = sorted((r["data_date"].day, r["base_date"].day, r["expected_links"], r["period_start"].day, r["period_end"].day) for r in chain.collect())
    assert got == [(6, 5, 3, 5, 8), (7, 6, 3, 5, 8), (8, 7, 3, 5, 8)]
    assert index.month_chain(history.filter("factor > 5")).count() == 0


def test_basket_by_chain_has_a_small_plan(spark):
    df = feeds.QUERIES["k83_basket_by_chain"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 15 and plan.count("Exchange hashpartitioning") <= 20
