"""The sales audit: each check on rows that break it, missing columns, findings, profiles and the written tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plotline.operators import audit
from plotline.sources import files

SCHEMA = (
    "sale_id string, pin string, sale_date string, sale_price string, doc_no string, year int, class string, building_sqft double, land_sqft double, bedrooms int, "
    "bathrooms double, building_age int, latitude double, longitude double, property_alignment_status string, parcel_alignment_status string, acs_alignment_status string"
)
GOOD = ("1", "p1", "2015-03-01", "150000", "d1", 2015, "203", 1500.0, 4000.0, 3, 1.5, 40, 41.9, -87.7, "historical", "historical", "historical")


def _row(**changed):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return tuple(changed.get(n, v) for n, v in zip(names, GOOD, strict=True))


def _many(spark):
    rows = [_row(sale_id=str(i), pin=f"q{i}", doc_no=f"e{i}", building_sqft=1400.0 + i) for i in range(100, 140)]
    rows += [
        _row(sale_id="s1"), _row(sale_id="s1", pin="p2"),
        _row(sale_id="t1", pin="p3"), _row(sale_id="t2", pin="p3"),
        _row(sale_id="u1", pin="p4", sale_date="2010-01-01"), _row(sale_id="u2", pin="p4", sale_date="2010-12-31", **{"class": "205"}), _row(sale_id="u3", pin="p4", sale_date="2012-06-01"),
        _row(sale_id="v1", pin="p5", sale_price=None), _row(sale_id="v2", pin="p6", sale_price="many"), _row(sale_id="v3", pin="p7", sale_price="9999.99"), _row(sale_id="v4", pin="p8", sale_price="100000001"),
        _row(sale_id="w1", pin="p9", building_sqft=0.0), _row(sale_id="w2", pin="pa", building_sqft=19000.0), _row(sale_id="w3", pin="pb", building_sqft=None),
        _row(sale_id="x1", pin="pc", building_age=-1), _row(sale_id="x2", pin="pd", building_age=250), _row(sale_id="x3", pin="pe", building_age=251),
        _row(sale_id="y1", pin="pf", latitude=None), _row(sale_id="y2", pin="pg", longitude=-90.0),
        _row(sale_id="z1", pin="ph", property_alignment_status="unmatched_stale"), _row(sale_id="z2", pin="pi", parcel_alignment_status="unmatched_no_history", acs_alignment_status=None),
        _row(sale_id="n1", pin=None, sale_date="2001-01-01"), _row(sale_id="n2", pin=None, sale_date="2001-01-01", doc_no="other"), _row(sale_id="n3", pin="pj", sale_date="never"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_flags(spark):
    flags = audit.flagged(_many(spark))
    hit = {c: {r.sale_id for r in flags.where(f"dq_{c}").select("sale_id").collect()} for c in audit.CHECKS}
    assert hit["duplicate_sale_id"] == {"s1"} and hit["duplicate_transaction"] == {"t1", "t2"}
    assert hit["duplicate_pin_year"] == {"t1", "t2", "u1", "u2", "n1", "n2"} and hit["repeated_sale_property"] == {"t1", "t2", "u1", "u2", "u3", "n1", "n2"}
    assert hit["missing_sale_price"] == {"v1", "v2"} and hit["implausible_sale_price"] == {"v3", "v4"}
    assert hit["nonpositive_building_area"] == {"w1"} and hit["building_sqft_outlier"] == {"w1", "w2"}
    assert hit["impossible_building_age"] == {"x1", "x3"} and hit["missing_coordinates"] == {"y1"} and hit["coordinates_outside_cook_county"] == {"y2"}
    assert hit["failed_property_join"] == {"z1"} and hit["failed_pin_geography_join"] == {"z2"} and hit["failed_acs_join"] == set()
    assert hit["rapid_resale"] == {"t2", "u2"} and hit["property_class_inconsistency"] == {"u1", "u2"} and hit["missing_structural_characteristics"] == {"w3"}
    assert flags.count() == 64 and {r.dq_issue_count for r in flags.where("sale_id = 't2'").collect()} == {4}
    found = {r.check: r for r in audit.findings(flags).collect()}
    assert list(found) == list(audit.CHECKS) and all(found[c]["count"] == (2 if c == "duplicate_sale_id" else len(hit[c])) for c in hit)
    assert found["missing_sale_price"].rate == pytest.approx(2 / 64) and found["rapid_resale"].severity == "warning"
    assert {r.side: r.rate for r in audit.join_success(flags).collect()} == {"property": pytest.approx(63 / 64), "parcel": pytest.approx(63 / 64), "acs": 1.0}


def test_a_key_that_half_of_the_rows_share(spark):
    df = spark.range(0, 4000).selectExpr("cast(id as string) as sale_id", "if(id % 2 = 0, 'same', cast(id as string)) as pin", "timestamp_ntz '2000-01-01' + make_dt_interval(cast(id as int)) as sale_date", "50000D as sale_price")
    flags = audit.flagged(df)
    assert flags.where("dq_rapid_resale").count() == 1999 and flags.where("dq_repeated_sale_property").count() == 2000
    assert flags.where("dq_missing_structural_characteristics and not dq_property_class_inconsistency and not dq_building_sqft_outlier").count() == 4000


def test_audit_without_rows(spark):
    flags = audit.flagged(spark.createDataFrame([], SCHEMA))
    assert flags.count() == 0 and {(r["count"], r.rate) for r in audit.findings(flags).collect()} == {(0, 0.0)}
    with pytest.raises(ValueError, match="sale_price"):
        audit.flagged(spark.createDataFrame([("1", "2", dt.datetime(2020, 1, 1))], "sale_id string, pin string, sale_date timestamp"))


def test_written_tables(spark, tmp_path):
    sales = _many(spark).withColumn("open", F.col("sale_id") == "s1")
    made = files.write_audit(audit.flagged(sales), str(tmp_path / "audit"))
    tables = {n: spark.read.parquet(p) for n, p in made.items()}
    assert set(tables) == {"flagged_sales", "findings", "join_success", "feature_profiles", "coverage_by_year"}
    profile = {r.column: r for r in tables["feature_profiles"].collect()}
    assert set(profile) == set(sales.columns) and profile["latitude"].missing == 1 and profile["pin"].unique == 59 and profile["pin"].p50 is None
    assert profile["building_age"].p50 == 40.0 and profile["building_age"].p00 == -1.0 and profile["open"].unique == 2 and profile["bedrooms"].sd == 0
    top = audit.top_values(sales, ["class", "open"]).collect()
    assert {(r.column, r.value, r.n, r["rank"]) for r in top} == {("class", "203", 63, 1), ("class", "205", 1, 2), ("open", "false", 62, 1), ("open", "true", 2, 2)}
    cover = {(r.column, r.year): r.coverage for r in tables["coverage_by_year"].collect()}
    assert cover["latitude", "2015"] == pytest.approx(63 / 64)
