"""Readers and the streaming variant, on small files."""

import datetime as dt
import json

from plotline.operators import spatial
from plotline.operators.cleaning import QUALITY_FILTERS, classify_sales
from plotline.sources import files
from plotline.streaming import ingest


def test_union_of_mixed_pages(spark, tmp_path):
    spark.createDataFrame([(234, "a")], "class int, x string").write.parquet(f"{tmp_path}/p/1")
    spark.createDataFrame([("EX", 1.5)], "class string, y double").write.parquet(f"{tmp_path}/p/2")
    out = files.read_pages(spark, f"{tmp_path}/p/1", f"{tmp_path}/p/2")
    assert sorted((r["class"], r.x, r.y) for r in out.collect()) == [("234", "a", None), ("EX", None, 1.5)]


def test_census(spark, tmp_path):
    path = tmp_path / "acs.json"
    path.write_text(json.dumps([["B1", "state", "county", "tract"], ["5", "17", "031", "000100"], [None, "17", "031", "000200"]]))
    rows = files.read_census(spark, str(path), {"B1": "income"}).orderBy("geoid").collect()
    assert [(r.income, r.geoid) for r in rows] == [("5", "17031000100"), (None, "17031000200")]


def test_feed(spark, tmp_path):
    tables = {
        "stops": "stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station\nQ,Quarry Lane,52.11,5.02,1,\nQ-up,Quarry upper,52.11,5.02,0,Q\nQ-lo,Quarry lower,52.11,5.02,0,Q\nM,Mill Bridge,52.2,5.1,1,\nk9,Kerb,52.2,5.1,0,\n",
        "routes": "route_id,route_short_name,route_long_name,route_type\nmetro-a,A,Amber,1\nmetro-j,J,Jade,1\ncoach,77,Coach,3\n",
        "trips": "route_id,trip_id\nmetro-a,early\nmetro-j,noon\ncoach,late\n",
        "stop_times": "trip_id,stop_id\nearly,Q-up\nearly,M\nnoon,Q-lo\nlate,k9\n",
    }
    for name, text in tables.items():
        (tmp_path / f"{name}.txt").write_text(text)
    stations = files.rail_stations(*(files.read_feed(spark, str(tmp_path), t) for t in ("stops", "routes", "trips", "stop_times")))
    got = {r.station_id: (r.station_name, set(r.lines.split("|"))) for r in stations.collect()}
    assert set(got) == {"Q", "M"} and got["Q"][0] == "Quarry Lane" and len(got["Q"][1]) == 2 and len(got["M"][1]) == 1


def test_polygons(spark, tmp_path):
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    path = tmp_path / "parks.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"name": "P"}, "geometry": {"type": "Polygon", "coordinates": [square(0, 10)]}}, {"properties": {"name": "M"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(20, 30)], [square(40, 50)]]}}]}))
    rings = files.read_geojson(spark, str(path)).selectExpr("properties['name'] as name", "ring")
    assert rings.count() == 3
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 13.0, 14.0), (3, 55.0, 45.0)], "id int, x double, y double")
    got = {r.id: (r.nearest_name, r.polygon_distance) for r in spatial.polygon_distance(points, rings, "id", "name").collect()}
    assert got == {1: ("P", 0.0), 2: ("P", 5.0), 3: ("M", 5.0)}


SALES = "pin string, class string, sale_date timestamp, sale_price double, is_multisale string, " + ", ".join(f"{f} string" for f in QUALITY_FILTERS)


def _sales(spark):
    return spark.createDataFrame([("1", "203", dt.datetime(2023, 1, d), 2e5 if d % 2 else 5.0, "true" if d == 3 else "false", "f", "f", "f") for d in range(1, 9)] + [("2", "203", None, 3e5, "false", "f", "f", "f")], SALES)


def test_years_and_stream(spark, tmp_path):
    counts = files.write_by_year(_sales(spark).selectExpr("*", "year(sale_date) as sale_year"), f"{tmp_path}/years")
    assert {str(r.sale_year): r.n_rows for r in counts.collect()} == {"2023": 8, "unknown": 1}
    _sales(spark).repartition(2).write.parquet(f"{tmp_path}/in")
    stream = ingest.sales_stream(spark, f"{tmp_path}/in", SALES)
    ingest.classify_to(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    done = spark.read.parquet(f"{tmp_path}/out")
    key = lambda df: sorted((str(r.sale_date), r.population_status) for r in df.collect())
    assert key(done) == key(classify_sales(_sales(spark)))
    query = ingest.weekly_counts(stream).writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("weeks").where("window is not null").agg({"n": "sum"}).first()[0] == 8
