"""Queries over layers of polygons: parks with holes, a lake, a downtown of overlapping parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotline.operators import amenities, polygons
from plotline.plans import proxies
from plotline.plans.catalog import _rounded, query, read

_POINTS = "p AS (SELECT c_custkey AS id, CAST((c_custkey * 7919) % 52800 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 52800 AS DOUBLE) AS y FROM customer)"
#: Corner offsets of a park's and a lake's rings, in sizes: an outline and, in it, a hole.
_OUTLINE, _HOLE = ((0, 0), (1, 0), (1, 1), (0.5, 0.75), (0, 1)), ((0.25, 0.25), (0.5, 0.25), (0.5, 0.5))


def _edges(table: str, name: str) -> str:
    """SQL of the edges of shapes with ``lo_x, lo_y, w, h``."""
    sides = [(a, b) for ring in (_OUTLINE, _HOLE) for a, b in zip(ring, (*ring[1:], ring[0]), strict=True)]
    rows = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in sides)
    return f"SELECT {name} AS name, lo_x + w * CAST(o.ax AS DOUBLE) AS ax, lo_y + h * CAST(o.ay AS DOUBLE) AS ay, lo_x + w * CAST(o.zx AS DOUBLE) AS zx, lo_y + h * CAST(o.zy AS DOUBLE) AS zy FROM {table}, (VALUES {rows}) AS o(ax, ay, zx, zy)"


_PARKS = "SELECT n_name AS name, n_nationkey * 2 AS acres, (n_nationkey % 5) * 10560.0 + 1000 AS lo_x, (n_nationkey {div} 5) * 10560.0 + 2000 AS lo_y, 3000.0 + n_nationkey * 100 AS w, 4000.0 AS h FROM nation"
_WATERS = "SELECT r_name AS name, r_regionkey * 9000.0 - 6000 AS lo_x, 40000.0 - r_regionkey * 2000 AS lo_y, 2000.0 * (1 + r_regionkey) AS w, 9000.0 AS h FROM region"
_NEAR = f"""SELECT id, e.name, count(*) FILTER ((ay > y) <> (zy > y) AND x < (zx - ax) * (y - ay) / nullif(zy - ay, 0) + ax) % 2 = 1 AS inside,
 min(sqrt(pow(x - ax - greatest(0, least(1, ((x - ax) * (zx - ax) + (y - ay) * (zy - ay)) / ((zx - ax) * (zx - ax) + (zy - ay) * (zy - ay)))) * (zx - ax), 2) + pow(y - ay - greatest(0, least(1, ((x - ax) * (zx - ax) + (y - ay) * (zy - ay)) / ((zx - ax) * (zx - ax) + (zy - ay) * (zy - ay)))) * (zy - ay), 2))) AS far FROM p, {{}} e GROUP BY id, e.name"""
_LAYERS = f"""{_POINTS}, parks AS ({_PARKS.format(div='//')}), waters AS ({_WATERS}), park_edges AS ({_edges("parks", "name")}), water_edges AS ({_edges("waters", "name")})"""


def _shapes(spark: SparkSession, d: str, sql: str, table: str) -> DataFrame:
    """Features with ``id, properties, part`` of the shapes that ``sql`` makes from a table."""
    ring = lambda corners: "array(" + ", ".join(f"named_struct('x', cast(lo_x + w * {a}D as double), 'y', cast(lo_y + h * {b}D as double))" for a, b in corners) + ")"
    made = sql.rpartition(" FROM ")[0].removeprefix("SELECT ")
    acres = "cast(acres as string)" if "acres" in made else "'0'"
    rows = read(spark, d, table).selectExpr(*made.split(", "))
    return rows.selectExpr("name as id", f"map('park', name, 'acres', {acres}) as properties", f"array({ring(_OUTLINE)}, {ring(_HOLE)}) as part")


def _parks(spark, d):
    return _shapes(spark, d, _PARKS.format(div="div"), "nation")


def _waters(spark, d):
    return _shapes(spark, d, _WATERS, "region")


def _downtown(spark, d):
    """Two rectangles that overlap."""
    box = lambda a, b, c, e: f"array(named_struct('x', {a}D, 'y', {b}D), named_struct('x', {c}D, 'y', {b}D), named_struct('x', {c}D, 'y', {e}D), named_struct('x', {a}D, 'y', {e}D))"
    return read(spark, d, "region").where("r_regionkey < 2").selectExpr("r_name as id", f"array(if(r_regionkey = 0, {box(20000, 20000, 24000, 24000)}, {box(22000, 21000, 27000, 23000)})) as part")


@query(f"WITH {_LAYERS}, n AS ({_NEAR.format('park_edges')}) SELECT id, name FROM n WHERE inside")
def polygon_containment(spark, d):
    return polygons.containing(proxies.points(spark, d), polygons.parts(_parks(spark, d), "id"), "id")


@query(f"WITH waters AS ({_WATERS}) SELECT name, round(w * h * (1 - 0.125 - 0.03125), 3) AS area FROM waters")
def polygon_areas(spark, d):
    layer = polygons.parts(_waters(spark, d), "id")
    return _rounded(layer.select("name", polygons.area().alias("area")), 3)


@query(f"""WITH {_LAYERS}, park AS ({_NEAR.format("(SELECT k.* FROM park_edges k JOIN parks USING (name) WHERE acres >= 10)")}), lake AS ({_NEAR.format("(SELECT * FROM water_edges WHERE name = (SELECT arg_max(name, w * h) FROM waters))")}),
 best AS (SELECT id, min(CASE WHEN inside THEN 0 ELSE far END) AS d, arg_min(name, (CASE WHEN inside THEN 0 ELSE far END, name)) AS name FROM park GROUP BY id),
 c AS (SELECT (16.0 * 22000 + 10 * 24500 - 4 * 23000) / 22 AS cx, (16.0 * 22000 + 10 * 22000 - 4 * 22000) / 22 AS cy)
 SELECT p.id, round(CASE WHEN l.inside THEN 0 ELSE l.far END / 5280, 5) AS lake_distance_miles, round(sqrt(pow(x - cx, 2) + pow(y - cy, 2)) / 5280, 5) AS downtown_distance_miles, best.name AS nearest_major_park, round(best.d / 5280, 5) AS park_distance_miles
 FROM p JOIN best USING (id) JOIN lake l USING (id), c""")
def amenity_distances(spark, d):
    parks, lake = amenities.major_parks(_parks(spark, d)), amenities.lake(_waters(spark, d))
    return _rounded(amenities.distances(proxies.points(spark, d), "id", parks, lake, polygons.parts(_downtown(spark, d), "id")), 5)
