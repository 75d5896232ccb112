"""Radius, nearest and neighbour joins by grid cells, and statistics over the edge lists they give.

For a radius, a cell is as wide as the radius, so the partners of a point lie in its own cell and the eight around it.
One side is copied to the nine cells, the join is on the cell, and distances are tested inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotline.operators import nearby, polygons
from plotline.operators.pyramid import candidates
from plotline.operators.tables import settled

FEET_PER_MILE = 5280.0


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def radius_join(left: DataFrame, right: DataFrame, radius: float, condition: Column | None = None, on: tuple[str, ...] = (), wide_join: bool = False) -> DataFrame:
    """Pairs of ``left`` and ``right`` (columns ``x``, ``y``, prefixed ``l_`` and ``r_``) at most ``radius`` apart.

    ``on`` names columns that have to be equal and join the cell as keys; ``condition`` is tested in the join.
    ``wide_join`` is for few rows that make many pairs: the cells are dealt to a number of tasks that the size of the
    rows does not lower.
    """
    a = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns)).withColumns({"_cx": _cell(F.col("l_x"), radius), "_cy": _cell(F.col("l_y"), radius)})
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    b = b.withColumns({"_bx": _cell(F.col("r_x"), radius) + F.col("_dx"), "_by": _cell(F.col("r_y"), radius) + F.col("_dy")}).drop("_dx", "_dy")
    d = distance(F.col("l_x"), F.col("l_y"), F.col("r_x"), F.col("r_y"))
    test = (F.col("_cx") == F.col("_bx")) & (F.col("_cy") == F.col("_by")) & (d <= radius)
    for c in on:
        test &= F.col(f"l_{c}") == F.col(f"r_{c}")
    if condition is not None:
        test &= condition
    if wide_join:
        parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * a.sparkSession.sparkContext.defaultParallelism)
        a, b = a.repartition(parts, "_cx", "_cy").hint("shuffle_hash"), b.repartition(parts, "_bx", "_by")
    return a.join(b, test).withColumn("distance", d).drop("_cx", "_cy", "_bx", "_by")


def nearest(points: DataFrame, places: DataFrame, key: str, place: str, radii: dict[str, float]) -> DataFrame:
    """``key``, the nearest place (ties by name), its distance, and counts of places within each radius.

    One radius join, as wide as the widest radius and as a cell of some places in the mean, finds both for nearly
    all points. Points without a place so near descend a pyramid of the places' cells. Any number of places will do.
    """
    box = places.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    wide = max(radii.values(), default=0.0)
    if box[0] and box[1] is not None:
        wide = max(wide, ((box[2] - box[1]) * (box[4] - box[3]) / box[0]) ** 0.5)
    own = settled(points.select(key, "x", "y"))
    # points and places that share coordinates meet as one, with their number and least name
    spots = settled(own.where("x is not null and y is not null").select("x", "y").distinct())
    at = places.select(F.col(place).alias("place"), "x", "y")
    stops = settled(at.where("x is not null and y is not null").groupBy("x", "y").agg(F.min("place").alias("place"), F.count("*").alias("many")))
    counts = [F.sum(F.when(F.col("distance") <= r, F.col("r_many")).otherwise(0)).cast("long").alias(n) for n, r in radii.items()]
    best = F.min(F.struct("distance", F.col("r_place").alias("place"))).alias("best")
    met = radius_join(spots, stops, max(wide, 1e-9), wide_join=True).groupBy(F.col("l_x").alias("x"), F.col("l_y").alias("y")).agg(best, *counts)
    near = settled(own.join(met, ["x", "y"]).drop("x", "y"))
    columns = [key, F.col("best.place").alias(f"nearest_{place}"), F.col("best.distance").alias("nearest_distance"), *radii]
    left = settled(own.join(near, key, "left_anti"))
    if left.isEmpty():
        return near.select(*columns)
    box = {"min_x": F.col("x"), "max_x": F.col("x"), "min_y": F.col("y"), "max_y": F.col("y")}
    found = candidates(left, at.withColumns(box)).withColumn("distance", distance(F.col("place_x"), F.col("place_y"), F.col("x"), F.col("y")))
    found = found.groupBy("place_x", "place_y").agg(F.min(F.struct("distance", "place")).alias("best"))
    far = left.join(found, (F.col("x") == F.col("place_x")) & (F.col("y") == F.col("place_y")), "left").withColumns({n: F.lit(0).cast("long") for n in radii})
    return near.select(*columns).unionByName(far.select(*columns))


#: The state plane of eastern Illinois in US survey feet: ellipsoid, origin, scale, false easting (fixed values).
_AXIS, _FLATTENING = 6378137.0, 1 / 298.257222101
_ORIGIN_LATITUDE, _ORIGIN_LONGITUDE, _SCALE, _EASTING, _FEET = 36 + 40 / 60, -(88 + 20 / 60), 0.999975, 300_000.0, 3937 / 1200


def project(latitude: str, longitude: str) -> tuple[str, str]:
    """SQL of the plane coordinates, in feet, of columns of degrees: the transverse Mercator series."""
    from math import cos, radians, sin

    e = _FLATTENING * (2 - _FLATTENING)
    f = e / (1 - e)
    terms = (1 - e / 4 - 3 * e**2 / 64 - 5 * e**3 / 256, 3 * e / 8 + 3 * e**2 / 32 + 45 * e**3 / 1024, 15 * e**2 / 256 + 45 * e**3 / 1024, 35 * e**3 / 3072)
    o = radians(_ORIGIN_LATITUDE)
    start = _AXIS * (terms[0] * o - terms[1] * sin(2 * o) + terms[2] * sin(4 * o) - terms[3] * sin(6 * o))
    n = lambda v: f"CAST({v!r} AS DOUBLE)"
    p = f"radians({latitude})"
    sine, cosine, tangent = f"sin({p})", f"cos({p})", f"(sin({p}) / cos({p}))"
    arc = f"({n(_AXIS)} * ({n(terms[0])} * {p} - {n(terms[1])} * sin(2 * {p}) + {n(terms[2])} * sin(4 * {p}) - {n(terms[3])} * sin(6 * {p})))"
    bend = f"({n(_AXIS)} / sqrt(1 - {n(e)} * {sine} * {sine}))"
    t, c, a = f"({tangent} * {tangent})", f"({n(f)} * {cosine} * {cosine})", f"(radians({longitude} - {n(_ORIGIN_LONGITUDE)}) * {cosine})"
    east = f"{a} + (1 - {t} + {c}) * pow({a}, 3) / 6 + (5 - 18 * {t} + {t} * {t} + 72 * {c} - 58 * {n(f)}) * pow({a}, 5) / 120"
    north = f"pow({a}, 2) / 2 + (5 - {t} + 9 * {c} + 4 * {c} * {c}) * pow({a}, 4) / 24 + (61 - 58 * {t} + {t} * {t} + 600 * {c} - 330 * {n(f)}) * pow({a}, 6) / 720"
    x = f"({n(_EASTING)} + {n(_SCALE)} * {bend} * ({east})) * {n(_FEET)}"
    y = f"{n(_SCALE)} * ({arc} - {n(start)} + {bend} * {tangent} * ({north})) * {n(_FEET)}"
    return x, y


def comparables(sales: DataFrame, radius: float, max_days: int, keep: int, distance_scale: float, half_life_days: float) -> DataFrame:
    """Links from each sale to its best earlier comparables: same type, other property, near and recent.

    ``weight`` falls with distance and age; links are ranked by it, ties by id, and weights normalised.
    """
    rows = placed(sales).select("sale_id", "pin", "sale_date", "sale_price", "residence_type", "x", "y").dropna(subset=["pin", "sale_date", "residence_type"])
    units = {"x": distance_scale, "y": distance_scale}
    return nearby.best(settled(rows.withColumn("wanted", F.lit(True))), "sale_id", keep, units, {"x": radius, "y": radius}, half_life_days, max_days, on=("residence_type",), carry=("sale_price",)).select(
        F.col("target").alias("target_sale_id"),
        F.col("neighbour").alias("comparable_sale_id"),
        "distance",
        "days",
        F.col("neighbour_sale_price").alias("comparable_price"),
        "weight",
        "rank",
        F.col("share").alias("normalized_weight"),
    )


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` whose ``x`` and ``y`` are numbers, as doubles."""
    return rows.withColumns({c: F.col(c).cast("double") for c in ("x", "y")}).where("abs(x) < 1e300 and abs(y) < 1e300")


def knn(points: DataFrame, key: str, k: int) -> DataFrame:
    """Edges ``i, j, distance, rank`` to the ``k`` nearest others, ties by id; all others where there are fewer.

    Distinct places descend a pyramid of the points' cells. A place stands for its ``k + 1`` least ids, which are all
    that can be among anyone's ``k`` nearest; so any number of points at one place costs one descent.
    """
    own = settled(points.where("x is not null and y is not null").select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    least = F.row_number().over(Window.partitionBy("x", "y").orderBy(key))
    kept = own.withColumn("_r", least).where(F.col("_r") <= k + 1).select(F.col(key).alias("j"), "x", "y")
    box = {"min_x": F.col("x"), "max_x": F.col("x"), "min_y": F.col("y"), "max_y": F.col("y")}
    far = distance(F.col("place_x"), F.col("place_y"), F.col("x"), F.col("y"))
    near = candidates(own, kept.withColumns(box), k + 1).withColumn("distance", far)
    of_place = Window.partitionBy("place_x", "place_y").orderBy("distance", "j")
    near = near.withColumn("_r", F.row_number().over(of_place)).where(F.col("_r") <= k + 1)
    near = near.groupBy("place_x", "place_y").agg(F.array_sort(F.collect_list(F.struct("distance", "j"))).alias("near"))  # k + 1 at most
    edges = own.join(near.hint("merge"), (F.col("x") == F.col("place_x")) & (F.col("y") == F.col("place_y"))).select(F.col(key).alias("i"), F.posexplode(F.slice(F.filter("near", lambda e: e["j"] != F.col(key)), 1, k)).alias("at", "e"))
    return edges.select("i", F.col("e.j").alias("j"), F.col("e.distance").alias("distance"), (F.col("at") + 1).alias("rank"))


def spatial_lag(values: DataFrame, edges: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value, lag``: the mean of the neighbours' values (row-standardised weights)."""
    near = edges.join(values.select(F.col(key).alias("j"), F.col(value).alias("_v")), "j").groupBy(F.col("i").alias(key)).agg(F.avg("_v").alias("lag"))
    return values.select(key, value).join(near, key)


def moran(values: DataFrame, edges: DataFrame, key: str, value: str) -> DataFrame:
    """Moran's I with its expectation, from sums; one row."""
    lagged = spatial_lag(values, edges, key, value)
    mean = values.agg(F.avg(value).alias("_m"))
    z = F.col(value) - F.col("_m")
    return lagged.join(F.broadcast(mean)).agg(F.count("*").alias("n"), (F.sum(z * (F.col("lag") - F.col("_m"))) / F.sum(z * z)).alias("moran_i")).withColumn("expected_i", -1.0 / (F.col("n") - 1))


def polygon_distance(points: DataFrame, rings: DataFrame, key: str, name: str) -> DataFrame:
    """``key``, the nearest polygon (ties by name) and its distance, 0 inside.

    ``rings`` has a row for each polygon: ``name`` and ``ring``, an array of ``x, y``; or ``part``, an array of rings
    of which all but the first are holes. Rows of one name are parts of one shape.
    """
    layer = rings if "part" in rings.columns else rings.withColumn("part", F.array("ring"))
    found = polygons.nearest_name(points, polygons.parts(layer, name), key)
    return found.select(key, F.col("name").alias(f"nearest_{name}"), F.col("distance").alias("polygon_distance"))
