"""Nearest places, neighbours and polygons against brute force on awkward geometry."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.operators import amenities, polygons, spatial
from plotline.sources import files


def _points(seed: int, n: int):
    """Clusters of very different density, repeated places, grid points, and a few very far away."""
    rng = random.Random(seed)
    out = [(rng.gauss(0, 1e-3), rng.gauss(0, 1e-3)) for _ in range(n // 3)] + [(rng.uniform(-1e3, 1e3), rng.uniform(-1e3, 1e3)) for _ in range(n // 3)]
    out += [(5.0, 5.0)] * (n // 6) + [(float(i % 7), float(i // 7)) for i in range(n // 6)] + [(1e6, -1e6), (-1e6, 3.0)]
    return [(i, x, y) for i, (x, y) in enumerate(out)]


def test_knn(spark):
    rows = _points(1, 600)
    df = spark.createDataFrame([*rows, (10_000, None, 1.0)], "id long, x double, y double").repartition(3)
    for k in (1, 5, 150):
        got = {}
        for r in spatial.knn(df, "id", k).collect():
            got.setdefault(r.i, []).append((r["rank"], r.j, r.distance))
        assert set(got) == {r[0] for r in rows}
        for i, x, y in rows:
            want = sorted((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), j) for j, a, b in rows if j != i)[:k]
            assert [(n + 1, j) for n, (_, j) in enumerate(want)] == [e[:2] for e in sorted(got[i])]
    assert spatial.knn(df.limit(3).coalesce(1), "id", 9).count() == 6
    assert spatial.knn(df.limit(0), "id", 2).count() == 0


def test_nearest(spark):
    points, places = _points(2, 300), [(f"p{i:04}", x, y) for i, x, y in _points(3, 200)]
    df = spark.createDataFrame([*points, (99_999, None, None)], "id long, x double, y double").repartition(3)
    at = spark.createDataFrame(places, "place string, x double, y double")
    got = {r.id: r for r in spatial.nearest(df, at, "id", "place", {"close": 0.001, "near": 30.0}).collect()}
    assert len(got) == len(points) + 1 and got[99_999].nearest_place is None and got[99_999].near == 0
    for i, x, y in points:
        far = sorted((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), p) for p, a, b in places)
        r = got[i]
        assert (r.nearest_place, r.nearest_distance) == (far[0][1], pytest.approx(far[0][0])) and r.near == sum(d <= 30 for d, _ in far) and r.close == sum(d <= 0.001 for d, _ in far)


def _star(rng, x, y, size, corners):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    return [(x + size * f * math.cos(t), y + size * f * math.sin(t)) for t in turns for f in [rng.uniform(0.3, 1)]]


def _inside(part, x, y):
    odd = False
    for ring in part:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def _far(part, x, y):
    best = math.inf
    for ring in part:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            long = (bx - ax) ** 2 + (by - ay) ** 2
            t = 0 if not long else max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / long))
            best = min(best, math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
    return best


def test_polygons_with_holes(spark):
    rng = random.Random(5)
    layer = []
    for k in range(30):
        x, y, size = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.01, 3, 20, 80])
        rings = [_star(rng, x, y, size, rng.choice([3, 12, 300]))]
        if k % 2:
            rings.append(_star(rng, x, y, size * 0.2, rng.choice([3, 40])))
        layer.append((f"n{k % 20:02}", rings))
    layer.append(("square", [[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)], [(2.0, 2.0), (2.0, 6.0), (6.0, 6.0), (6.0, 2.0)]]))
    odd = [("none", None), ("none", []), ("line", [[(1.0, 1.0), (2.0, 2.0)]])]
    df = spark.createDataFrame([*layer, *odd], f"name string, part {polygons.PART}")
    points = [(i, rng.uniform(-90, 90), rng.uniform(-90, 90)) for i in range(300)] + [(900, 4.0, 4.0), (901, 1.0, 4.0), (902, 5e5, 1.0)]
    at = spark.createDataFrame([*points, (999, None, 0.0)], "id long, x double, y double").repartition(3)
    got = {(r.id, r.name) for r in polygons.containing(at, polygons.parts(df, "name"), "id").collect()}
    assert got == {(i, n) for i, x, y in points for n, part in layer if _inside(part, x, y)}
    near = {r.id: (r.nearest_name, r.polygon_distance) for r in spatial.polygon_distance(at, df, "id", "name").collect()}
    assert near.pop(999) == (None, None) and len(near) == len(points)
    for i, x, y in points:
        d, n = min((0.0 if _inside(part, x, y) else _far(part, x, y), n) for n, part in layer)
        assert near[i] == (n, pytest.approx(d))
    assert spatial.polygon_distance(at, df.limit(0), "id", "name").where("nearest_name is null and polygon_distance is null").count() == len(points) + 1


def test_dissolved_parts(spark):
    box = lambda a, b, c, d: [[(a, b), (c, b), (c, d), (a, d)]]
    rows = [("apart", box(0.0, 0.0, 2.0, 2.0)), ("apart", box(4.0, 0.0, 6.0, 2.0)), ("over", box(0.0, 0.0, 4.0, 4.0)), ("over", box(2.0, 1.0, 7.0, 3.0)), ("over", box(0.0, 0.0, 4.0, 4.0)), ("holed", [box(0.0, 0.0, 4.0, 4.0)[0], box(2.0, 0.0, 4.0, 4.0)[0]])]
    layer = polygons.parts(spark.createDataFrame(rows, f"name string, part {polygons.PART}"), "name")
    got = {r.name: (r.area, r.x, r.y) for r in amenities.dissolved(layer).collect()}
    assert got["apart"] == pytest.approx((8, 3, 1)) and got["holed"] == pytest.approx((8, 1, 2))
    assert got["over"] == pytest.approx((22, (32 + 45 - 12) / 22, (32 + 20 - 8) / 22))
    assert {r.name for r in polygons.largest(layer).collect()} == {"over"}
    rng = np.random.default_rng(1)
    star = [_star(random.Random(i), 0.0, 0.0, 1.0, 25) for i in (1, 2)]
    (r,) = amenities.dissolved(polygons.parts(spark.createDataFrame([("s", [x]) for x in star], f"name string, part {polygons.PART}"), "name")).collect()
    tried = rng.uniform(-1, 1, (20_000, 2))
    assert r.area == pytest.approx(4 * np.mean([any(_inside([x], *p) for x in star) for p in tried.tolist()]), abs=0.05)


def test_amenities_from_files(spark, tmp_path):
    square = lambda x, y, w: [[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]
    def write(name, *features):
        made = [{"type": "Feature", "properties": p, "geometry": {"type": k, "coordinates": c}} if k else {"properties": p, "geometry": None} for p, k, c in features]
        (tmp_path / name).write_text(json.dumps({"type": "FeatureCollection", "features": made}))
        return files.read_geojson(spark, str(tmp_path / name))

    parks = write("parks", ({"park": "Green", "acres": "25"}, "Polygon", [square(-87.7, 41.9, 0.02), square(-87.695, 41.905, 0.01)]), ({"park": "Tiny", "acres": "1"}, "Polygon", [square(-87.6, 41.8, 0.01)]), ({"park_no": "7", "acres": "10"}, "MultiPolygon", [[square(-87.9, 41.6, 0.01)], [square(-87.8, 41.6, 0.01)]]), ({"park": "None", "acres": "90"}, None, None))
    waters = write("waters", ({}, "Polygon", [square(-87.8, 41.9, 0.01)]), ({}, "MultiPolygon", [[square(-87.55, 41.7, 0.3)]]))
    downtown = write("downtown", ({}, "Polygon", [square(-87.64, 41.87, 0.02)]))
    homes = spark.createDataFrame([("a", 41.902, -87.698), ("b", 41.91, -87.69), ("c", 41.605, -87.805), ("d", None, -87.6), ("e", 95.0, -87.6)], "sale_id string, latitude double, longitude double")
    got = {r.sale_id: r for r in amenities.amenity_features(homes, parks, waters, downtown).collect()}
    assert got["a"].park_distance_miles == 0 and got["a"].nearest_major_park == "Green"
    assert 0 < got["b"].park_distance_miles < 0.5 and got["b"].nearest_major_park == "Green"  # in the hole
    assert got["c"].nearest_major_park == "7" and 0 < got["c"].park_distance_miles < 0.3
    assert got["a"].lake_distance_miles == pytest.approx(7.6, abs=0.3) and 3 < got["a"].downtown_distance_miles < 4
    assert got["d"].lake_distance_miles is None and got["e"].park_distance_miles is None and got["e"].downtown_distance_miles is None
    assert all(r.amenity_feature_temporal_status == "current_geometry_snapshot" for r in got.values())
    with pytest.raises(ValueError, match="parks"):
        amenities.amenity_features(homes, parks, waters, downtown, 1000.0)
    (tmp_path / "other").write_text(json.dumps({"type": "Feature"}))
    with pytest.raises(ValueError, match="collection"):
        files.read_geojson(spark, str(tmp_path / "other"))
