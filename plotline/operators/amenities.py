"""Distances to amenities: the nearest major park, the lake, and the middle of downtown, from layers of polygons.

Layers come as features (``id``, ``properties``, ``part``; a feature of several parts is several rows). Parks are those
with enough acres; the lake is the feature with the greatest area; downtown is all its features dissolved, whose
centroid counts. Cases: a layer that yields nothing is an error; a point without usable coordinates has null distances.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.operators import polygons
from plotline.operators.cleaning import require
from plotline.operators.spatial import FEET_PER_MILE, distance, project

MIN_ACRES = 10.0


def on_plane(features: DataFrame) -> DataFrame:
    """Features with their parts' degrees projected to feet."""
    x, y = project("p.y", "p.x")
    return features.withColumn("part", F.expr(f"transform(part, r -> transform(r, p -> named_struct('x', {x}, 'y', {y})))"))


def _some(layer: DataFrame, what: str) -> DataFrame:
    if layer.isEmpty():
        raise ValueError(f"no polygons in the layer of {what}")
    return layer


def major_parks(features: DataFrame, min_acres: float = MIN_ACRES) -> DataFrame:
    """``name, part`` of parks with ``min_acres`` or more; the name is the property ``park``, else ``park_no``."""
    of = lambda k: F.nullif(F.try_element_at("properties", F.lit(k)), F.lit(""))
    named = features.where(of("acres").try_cast("double") >= min_acres).withColumn("_name", F.coalesce(of("park"), of("park_no"), F.lit("Unknown park")))
    return _some(polygons.parts(named, "_name"), f"parks of {min_acres} acres")


def lake(features: DataFrame) -> DataFrame:
    """``name, part`` of the feature with the greatest area."""
    return polygons.largest(_some(polygons.parts(features, "id"), "waters"))


def _union(edge: np.ndarray, of: np.ndarray) -> tuple[float, float, float]:
    """Area and centroid of the union of parts (``of`` names each edge's): between two heights at which edges end or
    cross, the union is trapezoids, whose moments Simpson's rule gives exactly."""
    ax, ay, bx, by = edge.T
    heights = [ay, by]
    for i in range(len(edge)):  # where edge i crosses later ones
        dx, dy, ex, ey = bx[i] - ax[i], by[i] - ay[i], bx[i + 1 :] - ax[i + 1 :], by[i + 1 :] - ay[i + 1 :]
        with np.errstate(all="ignore"):
            cross = dx * ey - dy * ex
            t = ((ax[i + 1 :] - ax[i]) * ey - (ay[i + 1 :] - ay[i]) * ex) / cross
        heights.append(ay[i] + dy * t[np.isfinite(t) & (t > 0) & (t < 1)])
    heights = np.unique(np.concatenate(heights))
    total = np.zeros(3)
    for low, high in zip(heights[:-1], heights[1:], strict=True):
        spans = np.flatnonzero((ay > (low + high) / 2) != (by > (low + high) / 2))
        at = lambda y, k: ax[k] + (bx[k] - ax[k]) * (y - ay[k]) / (by[k] - ay[k])
        inside: dict = {}
        left = None
        for k in sorted(spans.tolist(), key=lambda k: at((low + high) / 2, k)):
            inside[of[k]] = not inside.get(of[k], False)
            if any(inside.values()):
                left = k if left is None else left
            elif left is not None:
                for y, w in ((low, 1), ((low + high) / 2, 4), (high, 1)):
                    a, b = at(y, left), at(y, k)
                    total += w * (high - low) / 6 * np.array([b - a, (b * b - a * a) / 2, y * (b - a)])
                left = None
    return (total[0], total[1] / total[0], total[2] / total[0]) if total[0] else (0.0, np.nan, np.nan)


def dissolved(layer: DataFrame) -> DataFrame:
    """``name, area, x, y``: area and centroid of each name's parts, taken together; places that parts share count once."""

    def of_name(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.asarray(flat, float).reshape(-1, 4) for flat in group["flat"]]
        part_of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        return pd.DataFrame([(group["name"].iloc[0], *_union(np.concatenate(parts), part_of))], columns=["name", "area", "x", "y"])

    return layer.select("name", polygons.flat_edges().alias("flat")).groupBy("name").applyInPandas(of_name, "name string, area double, x double, y double")


def distances(points: DataFrame, key: str, parks: DataFrame, water: DataFrame, downtown: DataFrame) -> DataFrame:
    """``key`` and the distances in miles of points (``x, y`` in feet), with the nearest park's name."""
    own = points.select(key, "x", "y")
    park = polygons.nearest_name(own, parks, key).select(key, F.col("name").alias("nearest_major_park"), (F.col("distance") / FEET_PER_MILE).alias("park_distance_miles"))
    shore = polygons.nearest_name(own, water, key).select(key, (F.col("distance") / FEET_PER_MILE).alias("lake_distance_miles"))
    middle = dissolved(downtown.withColumn("name", F.lit("downtown"))).select(F.col("x").alias("_mx"), F.col("y").alias("_my"))
    centre = own.join(F.broadcast(middle)).select(key, (distance(F.col("x"), F.col("y"), F.col("_mx"), F.col("_my")) / FEET_PER_MILE).alias("downtown_distance_miles"))
    return own.select(key).join(shore, key, "left").join(centre, key, "left").join(park, key, "left")


def amenity_features(properties: DataFrame, parks: DataFrame, waters: DataFrame, downtown: DataFrame, min_acres: float = MIN_ACRES) -> DataFrame:
    """The distances of each ``sale_id`` by its degrees, from features in degrees; ``pin`` is kept if there is one."""
    require(properties, "sale_id", "latitude", "longitude")
    lat, lon = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    usable = lat.between(-90, 90) & lon.between(-180, 180)
    plane = properties.select("sale_id", F.when(usable, lat).alias("_lat"), F.when(usable, lon).alias("_lon"))
    x, y = project("_lat", "_lon")
    points = plane.select("sale_id", F.expr(x).alias("x"), F.expr(y).alias("y"))
    out = distances(points, "sale_id", major_parks(on_plane(parks), min_acres), lake(on_plane(waters)), _some(polygons.parts(on_plane(downtown), "id"), "downtown"))
    keys = [c for c in ("sale_id", "pin") if c in properties.columns]
    return properties.select(*keys).join(out, "sale_id", "left").withColumn("amenity_feature_temporal_status", F.lit("current_geometry_snapshot"))
