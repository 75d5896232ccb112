"""Controls, effects, ladders, samples, guards and card totals on rows with known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.operators import asof, blocks, cleaning, design, indices


def test_nuisance_controls(spark):
    rows = spark.createDataFrame([("1", 4.0, None, 1.0), ("3", None, None, 2.0), ("far", -2.0, 5.0, 9.0)], "distance string, stations double, once double, lake double")
    controls, medians = design.nuisance_controls(rows, ["distance", "stations", "once", "lake", "absent"])
    assert medians == {"distance": 2.0, "stations": 1.0, "lake": 2.0} and list(controls) == ["control_log1p_distance", "control_stations", "control_lake"]
    test = spark.createDataFrame([("-7", None, None, None), (None, 3.0, None, 8.0)], rows.schema)
    got = [tuple(r) for r in test.select(*(c.alias(n) for n, c in controls.items())).collect()]
    assert got == [(0.0, 1.0, 2.0), (pytest.approx(math.log(3)), 3.0, 8.0)]
    assert design.available(rows, ["once", "lake", "absent"]) == ["lake"] and design.available(rows, ["absent"]) == []
    assert design.distance_column(rows.withColumn("cta_distance", F.lit(1))) == "cta_distance"
    with pytest.raises(ValueError):
        design.distance_column(rows)


def test_independent_columns_effects_and_ladder(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    y = 2 + x @ [0.5, -1.0] + rng.normal(size=200) * 0.1
    rows = [(i % 3 if i > 9 else None, float(a), float(b), float(a - 2 * b + 7), 4.0, float(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "part int, a double, b double, both double, flat double, y double").repartition(3)
    block = blocks.gram(df, "y", ["a", "b", "both", "flat"])
    assert design.independent(block, ["flat", "a", "b", "both"]) == ["a", "b"] and design.independent(block, ["both", "a", "b"]) == ["both", "a"]
    model = block.fit(["a", "b"])
    assert {t: (e, m) for t, _, e, m in design.effects(model, elastic=("a",))} == {"a": (model.coefficients["a"], "elasticity"), "b": (math.expm1(model.coefficients["b"]), "proportional change")}
    assert design.matching_terms(model, "A", "none") == ["a"]
    got = {(r.subset, r.specification): r for r in design.ladder(df, "y", {"alone": ["a"], "full": ["a", "b", "both"], "without": ["b"]}, "a", "part").collect()}
    assert set(got) == {(s, k) for s in ("all", "0", "1", "2") for k in ("alone", "full")} and got["all", "full"].n == 200
    keep = [i for i in range(200) if i > 9 and i % 3 == 1]
    z = np.column_stack([np.ones(len(keep)), x[keep]])
    beta, left, *_ = np.linalg.lstsq(z, y[keep], rcond=None)
    error = math.sqrt(left[0] / (len(keep) - 3) * np.linalg.inv(z.T @ z)[1, 1])
    assert (got["1", "full"].coefficient, got["1", "full"].error) == (pytest.approx(beta[1]), pytest.approx(error))
    assert design.ladder(df, "y", {"full": ["a", "b"]}, "a", "part", least=100).count() == 1 and design.ladder(df, "y", {"full": ["a", "b"]}, "a").count() == 1


def test_samples_guards_and_places(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    first = {r.k for r in cleaning.capped_sample(df.repartition(7), "k", 50, seed=1).collect()}
    assert first == {r.k for r in cleaning.capped_sample(df.coalesce(1), "k", 50, seed=1).collect()} and len(first) == 50
    assert first != {r.k for r in cleaning.capped_sample(df, "k", 50, seed=2).collect()} and cleaning.capped_sample(df.limit(3), "k", 50).count() == 3
    assert cleaning.require_unique(df, "k") is df
    with pytest.raises(ValueError, match="not unique on k"):
        cleaning.require_unique(df.union(df.where("k = 7")), "k")
    sales = spark.createDataFrame([("a", "1", 2020), ("a", "2", 2021)], "sale_id string, pin string, sale_year int")
    with pytest.raises(ValueError, match="sale_id"):
        asof.align_snapshots(sales, spark.createDataFrame([("1", 2019)], "pin string, year int"), "pin", unique="sale_id")
    places = spark.createDataFrame([("41.9", "-87.7"), ("91", "0"), ("41", None), ("50", "-87")], "lat string, lon string")
    got = places.select(cleaning.valid_degrees("lat", "lon"), cleaning.inside_box("lat", "lon", (41.0, -88.0), (42.0, -87.0))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, None), (True, False)]


def test_cards(spark):
    made = "sale_id string, card int, property_match_year int, property_alignment_status string, property_lag_years int, char_bldg_sf double, char_land_sf double, char_beds int, char_fbath int, char_hbath int, char_yrblt int, char_type_resd string, char_gar1_size string, char_bsmt string, char_cnst_qlty string, char_heat string"
    rows = [
        ("s", 2, 2019, "historical", 1, 400.0, 5000.0, 1, 1, 0, 1980, "1.5 Story", "No", "None", None, "Steam"),
        ("s", 1, 2019, "historical", 1, 1200.0, 5000.0, 3, 1, 1, 1920, "2 Story", "2 cars", "Full", "Average", None),
        ("s", 3, None, "unmatched", None, 9e9, 9e9, 99, 9, 9, 1, "9 Story", "9 cars", "Full", "Poor", "Air"),
        ("t", 1, None, "unmatched_stale", None, 5.0, 5.0, 1, 1, 1, 1900, "1 Story", "1 car", "Full", "Poor", "Air"),
        (None, 1, 2018, "exact", 0, None, None, None, 2, None, None, "Loft", None, None, None, None),
    ]
    got = {r.sale_id: r for r in cleaning.aggregate_cards(spark.createDataFrame(rows, made).repartition(3)).collect()}
    s = got["s"]
    assert (s.card_count, s.building_sqft, s.land_sqft, s.bedrooms, s.bathrooms, s.year_built, s.stories, s.garage_spaces, s.has_basement) == (2, 1600.0, 5000.0, 4, 2.5, 1920, 2.0, 2.0, True)
    assert (s.residence_type, s.construction_quality, s.heating_type, s.property_match_year, s.property_alignment_status) == ("2 Story", "Average", "Steam", 2019, "historical")
    assert (got["t"].card_count, got["t"].building_sqft, got["t"].has_basement, got["t"].property_match_year, got["t"].property_alignment_status) == (0, None, None, None, "unmatched_stale")
    assert (got[None].card_count, got[None].bathrooms, got[None].stories, got[None].has_basement) == (1, None, None, False)


def test_appreciation_against_sorting(spark):
    rng = random.Random(3)
    start = 946_684_800
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), start + rng.randrange(6 * 365) * 86_400 + rng.choice([0, 0, 40_000]), rng.choice([None, float(rng.randrange(1, 50))])) for i in range(600)]
    df = spark.createDataFrame(rows, "sale_id long, g string, at long, sale_price double").withColumn("sale_date", F.timestamp_seconds("at").cast("timestamp_ntz")).repartition(4)
    got = {r.sale_id: (r.n_recent, r.appreciation) for r in indices.prior_appreciation(df, "g", window_days=200, least=2).collect()}
    want = {}
    for i, g, at, _ in rows:
        if g is None:
            continue
        recent = [(at - t, p) for _, h, t, p in rows if h == g and 0 < at - t <= 200 * 86_400]
        new, old = ([p for d, p in recent if (d // 86_400 <= 100) == side and p is not None] for side in (True, False))
        want[i] = (len(recent), pytest.approx(np.median(new) / np.median(old) - 1) if min(len(new), len(old)) >= 2 else None)
    assert got == want


def test_order_statistics_of_many_runs_at_once():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 64, 65, 500):
        values = rng.integers(0, max(2, n // 3), n).astype(float)  # ties
        lo = rng.integers(0, n, 300)
        hi = np.array([rng.integers(x + 1, n + 1) for x in lo])
        k = np.array([rng.integers(0, b - a) for a, b in zip(lo, hi)])
        assert indices.kth_of_runs(values, lo, hi, k).tolist() == [sorted(values[a:b])[c] for a, b, c in zip(lo, hi, k)]
        assert indices._medians(values, lo, hi).tolist() == [np.median(values[a:b]) for a, b in zip(lo, hi)]
    assert indices.kth_of_runs(np.zeros(0), *(np.zeros(0, int),) * 3).tolist() == []


def test_a_crowded_place_is_not_gone_through_sale_by_sale(spark):
    """A place's sales, many on a day, over several batches; each half of a window holds thousands."""
    rng = np.random.default_rng(2)
    day, price = np.sort(rng.integers(0, 900, 30_000)), rng.integers(1, 400, 30_000).astype(float)
    df = spark.createDataFrame([(i, "a", 946_684_800 + int(d) * 86_400, float(p)) for i, (d, p) in enumerate(zip(day, price))], "sale_id long, g string, at long, sale_price double")
    rows = indices.prior_appreciation(df.withColumn("sale_date", F.timestamp_seconds("at").cast("timestamp_ntz")), "g", window_days=400)
    got = {r.sale_id: (r.n_recent, r.appreciation) for r in rows.collect()}
    assert len(got) == 30_000
    for i in range(0, 30_000, 613):
        before = day[i] - day
        new, old = price[(before > 0) & (before <= 200)], price[(before > 200) & (before <= 400)]
        assert got[i] == (len(new) + len(old), pytest.approx(np.median(new) / np.median(old) - 1) if min(len(new), len(old)) >= 3 else None)


def test_roll_up_profiles_and_growth(spark):
    df = spark.createDataFrame([("h", "x", 5.0), ("h", "x", -9.0), ("h", "y", 4.0), ("h", "z", 1.0), ("i", "x", None)], "k string, c string, v double")
    got = {(r.k, r.c): (r.contribution, r["rank"]) for r in design.roll_up(df, "k", "c", "v").collect()}
    assert got == {("h", "x"): (-4.0, 1), ("h", "y"): (4.0, 2), ("h", "z"): (1.0, 3), ("i", "x"): (None, 1)}
    profiles = spark.createDataFrame([(0, "A", 1.0, None), (0, "A", 3.0, None), (1, "B", 7.0, 2.0)], "cluster int, archetype string, p double, q double")
    assert {tuple(r) for r in design.cluster_profiles(profiles, ["cluster", "archetype"], ["p", "q"]).collect()} == {(0, "A", 2, 2.0, None), (1, "B", 1, 7.0, 2.0)}
    index = spark.createDataFrame([("g", 2001, 100.0), ("g", 2004, 150.0), ("g", 2003, 120.0), ("e", 2001, 5.0)], "geo string, year int, level double")
    assert {(r.geo, r.year): r.annual_index_growth for r in indices.index_growth(index, "level", "geo").collect()} == {("g", 2001): None, ("g", 2003): pytest.approx(0.2), ("g", 2004): pytest.approx(0.25), ("e", 2001): None}
