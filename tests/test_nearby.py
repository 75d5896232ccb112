"""What stands near and before, without a table of pairs, against every pair by brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.operators import comparables, nearby, spatial, spatial_models

START = dt.datetime(2015, 1, 1)


def _sales(n, side, seed, days=900):
    rng = random.Random(seed)
    place = lambda: rng.choice([0.0, side, rng.random() * side])  # noqa: E731  some stand at one place, some on a cell's edge
    return [(i, f"p{rng.randrange(n // 3 + 1)}", START + dt.timedelta(days=rng.randrange(days)), rng.uniform(1e5, 5e5), rng.choice("ab"), place(), place()) for i in range(n)]


def _table(spark, rows):
    return spark.createDataFrame(rows, "sale_id long, pin string, sale_date timestamp_ntz, sale_price double, residence_type string, x double, y double")


@pytest.mark.parametrize(("n", "side"), [(600, 900.0), (300, 9000.0)])
def test_comparables_are_the_best_of_all_pairs_and_no_join_makes_them(spark, n, side):
    rows = _sales(n, side, 4)
    links = spatial.comparables(_table(spark, rows), 2000.0, 300, 4, 500.0, 100.0)
    assert "Join" not in links._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in links.orderBy("target_sale_id", "rank").collect():
        got.setdefault(r.target_sale_id, []).append(r.comparable_sale_id)
    for i, pin, at, _, kind, x, y in rows:
        near = []
        for j, other, t, _, k, x2, y2 in rows:
            d, days = math.sqrt((x - x2) ** 2 + (y - y2) ** 2), (at - t).days
            if k == kind and other != pin and 1 <= days <= 300 and d <= 2000:
                near.append((-math.exp(-d / 500) * 2 ** (-days / 100), j))
        assert got.get(i, []) == [j for _, j in sorted(near)[:4]]


def test_prior_medians_take_no_join_of_pairs(spark):
    rows = _sales(300, 3000.0, 5)
    found = comparables.prior_medians(_table(spark, rows), 1200.0, 300)
    assert found._jdf.queryExecution().analyzed().toString().count("Join") == 1  # back to the sales
    got = {r.sale_id: r for r in found.collect()}
    assert len(got) == 300
    for i, pin, at, _, _, x, y in rows:
        near = sorted(p for _, other, t, p, _, x2, y2 in rows if other != pin and 1 <= (at - t).days <= 300 and math.sqrt((x - x2) ** 2 + (y - y2) ** 2) <= 1200)
        assert got[i].prior_count == len(near)
        middle = (near[(len(near) - 1) // 2] + near[len(near) // 2]) / 2 if near else None
        assert got[i].prior_median == (pytest.approx(middle) if near else None)


def test_band_moran_is_that_of_the_edges(spark):
    rng = random.Random(8)
    rows = [(i, float(rng.randrange(12)) * 10, float(rng.randrange(12)) * 10, rng.choice([None, *[rng.random()] * 9])) for i in range(200)] + [(900, 5000.0, 0.0, 3.0), (901, None, 0.0, 3.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, value double")
    want = spatial_models.moran_test(df, spatial_models.distance_band(df, "id", 15.0), "id", "value", draws=0)
    got = spatial_models.band_moran(df, "id", "value", 15.0)
    assert (got.n, got.i, got.expected, got.z_normal) == (want.n, pytest.approx(want.i), want.expected, pytest.approx(want.z_normal))


def test_no_round_sends_its_table_to_the_driver(spark):
    df = spark.createDataFrame([(i, float(i), 0.0, 1.0 * i) for i in range(40)], "id long, x double, y double, value double")
    edges = spatial.knn(df, "id", 4)
    rows = df.selectExpr("id", "value as linear", "if(id < 30, value, null) as known")
    plans = spark._jsparkSession.sharedState().statusStore()
    before = plans.executionsCount()
    spatial_models.conditional(rows, edges, "id", 0.5, tolerance=1e-3).collect()
    late = [plans.executionsList().apply(k).physicalPlanDescription() for k in range(before, plans.executionsCount())]
    assert late and not any("BroadcastHashJoin" in p for p in late)


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_runs_reach_what_their_own_rows_reach(n):
    rng = np.random.default_rng(n)
    rank, weight = rng.permutation(2 * n)[:n], rng.uniform(0.1, 1, n)
    first, end = (np.sort(rng.integers(0, n + 1, 70)) for _ in range(2))
    first, end = np.minimum(first, end), np.maximum(first, end)
    pairs = [(i, int(j)) for i in range(70) for j in sorted(set(rng.integers(first[i], end[i], 3).tolist()) if end[i] > first[i] else ())]
    own = (np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int))
    middle = nearby.reached(rank, 2 * n, first, end, own, [lambda k: (k - 1) // 2])[0]
    half = nearby.reached(rank, 2 * n, first, end, own, [lambda w: 0.5 * w], weight)[0]
    for i in range(70):
        left = sorted((int(rank[j]), weight[j]) for j in range(first[i], end[i]) if (i, j) not in set(pairs))
        if not left:
            assert middle[i] == half[i] == -1
            continue
        assert middle[i] == left[(len(left) - 1) // 2][0]
        assert half[i] == left[int(np.searchsorted(np.cumsum([w for _, w in left]), 0.5 * sum(w for _, w in left)))][0]


def test_weighted_past_of_crowded_places(spark):
    """More sales near one place than are looked at one by one."""
    rng = random.Random(12)
    rows = [(i, f"p{rng.randrange(400)}", START + dt.timedelta(days=rng.randrange(900)), float(rng.randrange(1000, 5000)), 1000.0, 300.0 * rng.randrange(3), 0.0) for i in range(2500)]
    df = spark.createDataFrame(rows, "sale_id long, pin string, sale_date timestamp_ntz, sale_price double, building_sqft double, x double, y double")
    got = {r.sale_id: r for r in comparables.prior_features(df, rules=comparables.PriorRules(miles=0.1, days=400)).collect()}
    for i, pin, at, _, _, x, _ in rows[::50]:
        near = sorted((p, j, math.exp(-abs(x - x2) / 2640) * 2 ** (-(at - t).days / 365), (at - t).days) for j, other, t, p, _, x2, _ in rows if other != pin and 1 <= (at - t).days <= 400 and abs(x - x2) <= 528)
        r, total, run = got[i], sum(n[2] for n in near), 0.0
        assert r.prior_nearby_sale_count == len(near)
        for price, _, w, _ in near:
            run += w
            if run / total >= 0.5 - 1e-12:
                break
        if near:
            assert (r.prior_nearby_sale_median, r.prior_nearby_most_recent_days) == (price, min(n[3] for n in near))
            assert r.prior_nearby_weighted_ppsf == pytest.approx(sum(n[0] * n[2] for n in near) / total / 1000, rel=1e-12)


def test_tiers_neither_write_nor_shuffle_links(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, f"p{i}", START + dt.timedelta(days=rng.randrange(900)), 100.0 + i % 90, 1000.0, 20.0, "a", rng.random() * 900, 0.0) for i in range(400)] + [(900, "far", START + dt.timedelta(days=800), 100.0, 1000.0, 20.0, "a", 12000.0, 0.0)]
    df = spark.createDataFrame(rows, "sale_id long, pin string, sale_date timestamp_ntz, sale_price double, building_sqft double, building_age double, residence_type string, x double, y double")
    written, settled = [], comparables.settled
    monkeypatch.setattr(comparables, "settled", lambda table: written.append(out := settled(table)) or out)
    links = comparables.tiered(df)
    assert "Window" not in links._jdf.queryExecution().analyzed().toString()
    sizes = [t.count() for t in written]
    assert sizes[0] == 401 and all(n <= 20 for n in sizes[1:])  # the sales, then those that a tier left without links
    told = comparables.valuations(df)
    assert not any(w in told._jdf.queryExecution().analyzed().toString() for w in ("Window", "Aggregate [target"))
    assert [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in told.orderBy("target_sale_id").collect()] == [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in comparables.valued(links).orderBy("target_sale_id").collect()]
    found = {r.target_sale_id: r for r in links.groupBy("target_sale_id").agg(F.count("*").alias("n"), F.sum("normalized_weight").alias("w"), F.min("tier").alias("tier")).collect()}
    assert (found[900].n, found[900].tier) == (10, "relaxed") and all(r.w == pytest.approx(1) for r in found.values())


def test_only_cells_with_wanted_rows_get_anything(spark):
    rows = [(i, f"p{i}", START + dt.timedelta(days=i % 900), 10.0 * i, 0.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "sale_id long, pin string, sale_date timestamp_ntz, x double, y double").withColumn("wanted", F.expr("sale_id = 2500"))
    blocks, _ = nearby.dealt(df, {"x": 400.0, "y": 400.0}, 200)
    tables = [nearby._opened(t) for t in [blocks.toArrow()]]
    x, home = tables[0]["x"].to_numpy(), tables[0]["home"].to_numpy(zero_copy_only=False)
    assert home.sum() == 1 and abs(x - 25000.0).max() <= 401 and len(x) <= 82  # once each


def test_nearby_past_reaches_a_mile_and_three_years(spark, tmp_path):
    """The reference's window: `radius_miles` 1, `lookback_days` 1095."""
    from plotline.plans import catalog

    # the query derives places from keys; 0 stands at (0, 0)
    keys = [k for k in range(1, 52800) if 1400 < math.hypot((k * 7919) % 52800, (k * 104729) % 52800) < 5200][:1]
    spark.createDataFrame([(k, 1, "a") for k in (0, *keys)], "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    orders = [(1, keys[0], START, 100.0), (2, keys[0], START + dt.timedelta(days=900), 300.0), (3, 0, START + dt.timedelta(days=1000), 500.0)]
    spark.createDataFrame([(*o, "1", "F") for o in orders], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_totalprice double, o_orderpriority string, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.sale_id: (r.prior_count, r.prior_median) for r in catalog.queries()["prior_nearby_features"](spark, str(tmp_path)).collect()}
    assert got == {1: (0, None), 2: (0, None), 3: (2, 200.0)}
