"""Domain operators: every query against its SQL, and rules on small tables with known answers."""

import datetime as dt
import glob
import math
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotline.operators import asof, cleaning, hedonic, indices, spatial, validation
from plotline.plans import appraisal, auditing, catalog, comparing, designing, insight, places, regressions, valuation  # noqa: F401

SF = "/root/testdata/sf0.001"


def _normal(p: pd.DataFrame) -> list:
    def value(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 3) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    p = p.reindex(sorted(p.columns), axis=1)
    return sorted(([value(v) for v in row] for row in p.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = _normal(catalog.queries()[name](spark, SF).toPandas())
    want = _normal(duck.execute(catalog.oracle_sql()[name]).df())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=0.002, nan_ok=True) if all(isinstance(x, float) for x in a + b) else a == b


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    """Their results are compared with dense solutions in the tests of their operators."""
    assert catalog.queries()[name](spark, SF).count() > 0


def test_classification(spark):
    made = "pin string, class string, sale_price double, sale_date timestamp, sale_filter_a string, sale_filter_b string, is_multisale string"
    day = dt.datetime(2011, 7, 19)
    rows = [
        ("17-05", "234", 87_500.0, day, "no", "0", "f"),
        ("5", "234.0", 10_000.0, day, "f", "false", None),
        ("6", "278", 9_999.99, day, "f", "f", "f"),
        ("7", "212", 91_000.0, day, "f", "f", "f"),
        ("8", "900", 5.0, None, "yes", "f", "t"),
        ("9", "205", 64_000.0, day, "unclear", "f", "t"),
        ("10", "205", 64_000.0, day, "f", "f", "t"),
        ("none", "205", 64_000.0, day, "f", "f", "f"),
        ("11", "206", None, day, "f", "T", "f"),
    ]
    sales = spark.createDataFrame(rows, made)
    flags = ("sale_filter_a", "sale_filter_b")
    out = {r.pin: r for r in cleaning.classify_sales(sales, cleaning.PopulationRules(filters=flags)).collect()}
    assert len(out) == len(rows)
    assert {p: r.population_status for p, r in out.items()} == {"17-05": "market", "5": "market", "6": "excluded", "7": "excluded", "8": "excluded", "9": "ambiguous", "10": "ambiguous", "none": "excluded", "11": "excluded"}
    assert out["8"].exclusion_reasons == ["missing_or_invalid_sale_date", "price_below_minimum", "non_target_property_class", "sale_filter_a"]
    assert out["9"].ambiguity_reasons == ["missing_sale_filter_metadata", "multi_parcel_sale"] and out["10"].ambiguity_reasons == ["multi_parcel_sale"]
    assert out["none"].exclusion_reasons == ["invalid_pin"] and out["11"].exclusion_reasons == ["missing_or_invalid_sale_price", "sale_filter_b"]
    assert [p for p, r in out.items() if r.is_primary_population] == ["17-05", "5"]
    wider = cleaning.PopulationRules(multi_family=cleaning.MULTI_FAMILY, filters=flags)
    assert cleaning.classify_sales(sales, wider).where("pin = '7'").first().population_status == "market"
    with pytest.raises(ValueError, match="sale_filter_deed_type"):
        cleaning.classify_sales(sales)
    dated = spark.createDataFrame([("1", "203", 5e4, d) for d in ("2001-02-03", "soon")], "pin string, class string, sale_price double, sale_date string")
    assert [r.exclusion_reasons for r in cleaning.classify_sales(dated, cleaning.PopulationRules(filters=())).collect()] == [[], ["missing_or_invalid_sale_date"]]


def test_pins(spark):
    given = {"8": "00000000000008", "14-21-305-030-1017": "14213050301017", "77.25": "00000000000077", "abc": None, None: None, "9" * 14: "9" * 14, "9" * 16: None}
    df = spark.createDataFrame([(p,) for p in given], "pin string")
    assert {r.pin: r.n for r in df.select("pin", cleaning.normalize_pin("pin").alias("n")).collect()} == given


def test_garage_and_basement(spark):
    df = spark.createDataFrame([("2 cars", "Full"), ("No", "None"), ("attached", None), (None, "0")], "g string, b string")
    assert [tuple(r) for r in df.select(cleaning.garage_spaces("g"), cleaning.has_basement("b")).collect()] == [(2.0, True), (0.0, False), (None, False), (None, False)]


def test_alignment(spark):
    sales = spark.createDataFrame([(1, "north", 1987), (2, "north", 1991), (3, "north", 1979), (4, "south", 1987), (5, None, 1987), (6, "north", 1985)], "sale_id long, pin string, sale_year int")
    shots = spark.createDataFrame([("north", 1984), ("north", 1985), ("south", 1990), ("south", 1995), ("south", None)], "pin string, year int")
    status = {r.sale_id: (r.snapshot_match_year, r.snapshot_alignment_status) for r in asof.align_snapshots(sales, shots, "pin").collect()}
    assert status == {1: (1985, "historical"), 2: (None, "unmatched_stale"), 3: (None, "unmatched_no_history"), 4: (None, "unmatched_no_history"), 5: (None, "unmatched_missing_key"), 6: (1985, "exact")}
    open_ = {r.sale_id: (r.snapshot_match_year, r.snapshot_alignment_status) for r in asof.align_snapshots(sales, shots, "pin", allow_future=True).collect()}
    assert open_[4] == (1990, "current_state_future") and open_[3] == (1984, "current_state_future") and open_[1] == status[1]
    twice = spark.createDataFrame([("north", 1985, "brick"), ("north", 1985, "frame")], "pin string, year int, wall string")
    with pytest.raises(ValueError, match="not unique"):
        asof.attach_snapshots(asof.align_snapshots(sales, shots, "pin"), twice, "pin", "year", "snapshot")


def test_metrics_and_ranks(spark):
    df = spark.createDataFrame([(8.0, 5.0), (40.0, 44.0), (None, 3.0), (9.0, float("nan"))], "y double, p double")
    m = validation.metrics(df, "y", "p").first()
    assert m.n == 2 and m.mae == 3.5 and m.rmse == pytest.approx(math.sqrt(12.5))
    scores = spark.createDataFrame([("m", float(i * i)) for i in range(7)], "model string, score double")
    # rank ceil(min(1, ceil(8 * 0.75) / 7) * 6) + 1 = 7 of 7
    assert validation.conformal_radius(scores, "model", "score", 0.75).first().radius == 36


def test_repeat_sales(spark):
    """Three houses that follow one price level, one with two sales on a day, one that moved."""
    level = {2003: 1.0, 2005: 1.3, 2006: 0.9}
    rows = [(f"{h}/{y}", h, dt.datetime(y, 3, 9), base * x, 4) for h, base in (("elm", 2e5), ("oak", 7e4), ("yew", 5e5)) for y, x in level.items()]
    rows += [("a", "fir", dt.datetime(2003, 1, 1), 1e5, 4), ("b", "fir", dt.datetime(2004, 1, 1), 9e5, 4), ("c", "fir", dt.datetime(2004, 1, 1), 8e5, 4), ("d", "fir", dt.datetime(2006, 1, 1), 9e4, 9)]
    sales = spark.createDataFrame(rows, "sale_id string, pin string, sale_date timestamp_ntz, sale_price double, nbhd int")
    pairs = indices.repeat_sale_pairs(sales).withColumns({"a": F.year("prior_sale_date"), "b": F.year("sale_date")})
    found = {(r.prior_sale_id, r.sale_id): r for r in pairs.collect()}
    assert len(found) == 7 and ("a", "d") in found and not found["a", "d"].geography_consistent
    assert found["a", "d"].days == 1096 and found["a", "d"].annual_appreciation == pytest.approx(0.9 ** (365.2425 / 1096) - 1)
    level_only = [round(v, 6) for _, v in indices.repeat_sales_index(pairs.where("geography_consistent"), "a", "b")]
    assert level_only == [100, 130, 90]
    assert [(g, p, round(v, 6)) for g, p, v in indices.repeat_index_by_geography(pairs, "a", "b")] == [("4" if isinstance(g, str) else 4, p, v) for g, p, v in ((4, 2003, 100), (4, 2005, 130), (4, 2006, 90))]


def test_prior_appreciation_sees_the_past_alone(spark):
    day = dt.datetime(2001, 1, 1)
    at = [(1, 0, 10.0), (2, 100, 12.0), (3, 200, 11.0), (4, 500, 20.0), (5, 600, 24.0), (6, 700, 22.0), (7, 720, 99.0), (8, 720, 77.0), (9, 1700, 5.0)]
    sales = spark.createDataFrame([(i, "h", day + dt.timedelta(days=d), p) for i, d, p in at], "sale_id int, nbhd string, sale_date timestamp_ntz, sale_price double")
    got = {r.sale_id: (r.n_recent, r.appreciation) for r in indices.prior_appreciation(sales, "nbhd").collect()}
    assert got[7] == got[8] == (6, 1.0) and got[1] == (0, None) and got[9] == (0, None) and got[6] == (5, None)


def test_knn_and_lag(spark):
    p = spark.createDataFrame([(10, 0.0, 0.0, 8.0), (20, 0.0, 2.0, 6.0), (30, 9.0, 2.0, 4.0), (40, 9.5, 2.0, 1.0)], "id long, x double, y double, v double")
    edges = spatial.knn(p.select("id", "x", "y"), "id", 1)
    assert sorted((r.i, r.j) for r in edges.collect()) == [(10, 20), (20, 10), (30, 40), (40, 30)]
    assert {r.id: r.lag for r in spatial.spatial_lag(p, edges, "id", "v").collect()} == {10: 6.0, 20: 8.0, 30: 1.0, 40: 4.0}


def test_nearest_far_from_all_places(spark):
    places = spark.createDataFrame([(f"p{k:03d}", float(k % 20), float(k // 20)) for k in range(400)] + [("twin", 3.0, 3.0)], "place string, x double, y double")
    points = spark.createDataFrame([(1, 3.0, 3.0), (2, 4000.0, 5.0), (3, -90.0, 2.0), (4, 7.4, 7.6)], "id int, x double, y double")
    got = {r.id: (r.nearest_place, round(r.nearest_distance, 4), r.near) for r in spatial.nearest(points, places, "id", "place", {"near": 1.0}).collect()}
    assert got == {1: ("p063", 0.0, 6), 2: ("p119", 3981.0, 0), 3: ("p040", 90.0, 0), 4: ("p167", 0.5657, 4)}
    assert spatial.nearest(points, places.limit(0), "id", "place", {"near": 1.0}).where("nearest_place is null and near = 0").count() == 4


def test_projection_against_its_definition(spark):
    x, y = spatial.project("lat", "lon")
    df = spark.createDataFrame([(36 + 40 / 60, -(88 + 20 / 60)), (41.9, -(88 + 20 / 60)), (41.9, -87.6), (41.9, -88.9)], "lat double, lon double")
    origin, north, east, west = ((r.x, r.y) for r in df.selectExpr(f"{x} as x", f"{y} as y").collect())
    feet = 3937 / 1200
    assert origin == pytest.approx((300_000 * feet, 0), abs=1e-4)
    e2, steps, arc = (2 - 1 / 298.257222101) / 298.257222101, 20_000, 0.0
    lo, hi = math.radians(36 + 40 / 60), math.radians(41.9)
    for k in range(steps):  # the meridian's length, summed up
        phi = lo + (k + 0.5) * (hi - lo) / steps
        arc += 6378137 * (1 - e2) / (1 - e2 * math.sin(phi) ** 2) ** 1.5 * (hi - lo) / steps
    assert north == pytest.approx((300_000 * feet, 0.999975 * arc * feet), abs=0.01)
    across = 6378137 / math.sqrt(1 - e2 * math.sin(hi) ** 2) * math.cos(hi) * math.radians(88 + 20 / 60 - 87.6)
    assert (east[0] - origin[0]) / feet == pytest.approx(0.999975 * across, rel=2e-5) and east[1] > north[1]
    assert west[0] < origin[0]


def test_robust_errors_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((2, 80))
    y = 1 + 0.5 * a - 0.2 * b + rng.standard_normal(80) * (0.1 + np.abs(a))
    df = spark.createDataFrame([*zip(y.tolist(), a.tolist(), b.tolist()), (None, 1.0, 1.0)], "y double, a double, b double")
    fit, smearing = hedonic.robust(df, "y", "a", "b")
    x = np.stack([np.ones(80), a, b], axis=1)
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    e, h = y - x @ beta, np.einsum("ij,jk,ik->i", x, inverse, x)
    want = np.sqrt(np.diag(inverse @ (x.T * (e / (1 - h)) ** 2) @ x @ inverse))
    assert list(fit.errors.values()) == pytest.approx(want.tolist()) and smearing == pytest.approx(np.exp(e).mean())
    table = hedonic.coefficient_table(fit)
    assert [r[0] for r in table] == ["const", "a", "b"] and all(r[5] < r[1] < r[6] and 0 <= r[4] <= 1 for r in table)
    price = df.limit(1).select(hedonic.predict_price(fit, smearing).alias("p")).first().p
    assert price == pytest.approx(np.exp(max(0.0, x[0] @ beta)) * smearing)


def test_folds_are_balanced(spark):
    sizes = {"a": 9, "b": 7, "c": 6, "d": 5, "e": 2, None: 1}
    df = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g string, i int")
    got = {r.g: r.fold for r in validation.group_folds(df, "g", 3).select("g", "fold").distinct().collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 2, "e": 1, None: 0}
    assert {r.fold for r in validation.group_folds(df.where("g = 'a'"), "g", 3).collect()} == {0}


def test_census_features(spark):
    row = {"geoid": "t", "poverty_population": 30, "poverty_universe": 120, "median_household_income": -222_222_222, "bachelors_degree": 4, "masters_degree": 3, "professional_degree": 2, "doctorate_degree": 1, "population_25_plus": 40, "occupied_units": 0, "owner_occupied_units": 3, "housing_units": 50, "vacant_units": 60, "acs_match_year": 1990, "median_year_structure_built": 1995}
    out = cleaning.acs_features(spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {'string' if c == 'geoid' else 'long'}" for c in row))).first()
    assert (out.geoid, out.poverty_rate, out.bachelors_or_higher_rate, out.graduate_degree_rate) == ("t", 0.25, 0.25, 0.15)
    assert out.median_household_income is None and out.owner_occupancy_rate is None and out.vacancy_rate is None and out.median_housing_age == 0
    assert out.transit_commute_share is None and "population_density" not in out.asDict()


def test_card_totals(spark):
    cards = spark.createDataFrame([(1, 2, 1999, 700.0, 90.0, 1, None, "1 car", "None", None), (1, 1, 1999, 300.0, 95.0, 2, 1, None, "Slab", "Ranch"), (1, 3, None, 50.0, 50.0, 9, 9, "No", "Full", "Loft"), (2, 1, 2001, None, None, None, None, None, None, None)], "sale_id int, card int, property_match_year int, char_bldg_sf double, char_land_sf double, char_fbath int, char_hbath int, char_gar1_size string, char_bsmt string, char_type_resd string")
    got = {r.sale_id: r for r in cleaning.aggregate_cards(cards).collect()}
    one, two = got[1], got[2]
    assert (one.card_count, one.building_sqft, one.land_sqft, one.bathrooms, one.garage_spaces, one.has_basement, one.residence_type) == (2, 1000.0, 95.0, 3.5, 1.0, True, "Ranch")
    assert (two.card_count, two.building_sqft, two.bathrooms, two.residence_type) == (1, None, None, None)


def test_comparables_are_prior(spark):
    rows = [(i, f"p{i % 6}", dt.datetime(2019, 1, 1) + dt.timedelta(days=90 * i), 1e5, "A" if i else None, float(i * 100), 0.0) for i in range(18)]
    sales = spark.createDataFrame(rows, "sale_id long, pin string, sale_date timestamp_ntz, sale_price double, residence_type string, x double, y double")
    links = spatial.comparables(sales, 2000.0, 2000, 4, 500.0, 365.0).collect()
    assert links and all(r.comparable_sale_id < r.target_sale_id and r.target_sale_id != 0 for r in links)
    total = {}
    for r in links:
        total.setdefault(r.target_sale_id, []).append(r.normalized_weight)
    assert all(len(w) <= 4 and sum(w) == pytest.approx(1) for w in total.values())


def test_chronological_split_labels_every_row_by_year(spark):
    df = spark.createDataFrame([(i, y) for i, y in enumerate([1990, 1990, 1995, 1995, 1997, None, 1990])], "id long, year int")
    got = {r.id: r.split for r in validation.chronological_split(df, "year").collect()}
    assert got == {0: "train", 1: "train", 2: "validation", 3: "validation", 4: "test", 5: None, 6: "train"}
    assert {r.split for r in validation.chronological_split(df, "year", 1991, 1996).where("id = 2").collect()} == {"validation"}
    for cuts in ((1997, 1995), (1980, 1995), (1991, 1994), (1995, 2000)):
        with pytest.raises(ValueError):
            validation.chronological_split(df, "year", *cuts)
    with pytest.raises(ValueError):
        validation.chronological_split(df.where("year < 1997"), "year")


def test_chronological_split_covers_all_sales(spark, duck):
    rows = valuation.chronological_split_by_year(spark, SF)
    assert rows.count() == duck.execute("SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey").fetchone()[0]
    assert rows.select("split").distinct().count() == 3 and rows.where("split is null").count() == 0


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="missing columns: pin"):
        cleaning.require(spark.range(1), "pin", "id")
