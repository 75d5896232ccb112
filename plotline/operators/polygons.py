"""Layers of polygons: with holes, of many parts, indexed by cells, so that point in polygon and distance are equi-joins.

A part is an array of closed rings, the first outside, the others holes; whatever an odd number of rings surrounds is
inside. Parts of one name are dissolved: inside any of them is inside, the nearest edge of any of them is the name's.

The index cuts each part into square cells of a quadtree that all parts share: cells wholly inside are rows without
edges, cells that edges cross are split until few edges are left and then hold those, and whether their lower left
corner is inside. A point's cell thus says in or out at once, or after counting the edges between it and that corner.
Distances come from a pyramid over all edges. Cutting a part is the work of one row, as parts are single geometries.

Cases: null or empty parts and rings of fewer than three corners hold nothing; an open ring is closed; a null point is
in no polygon and has no distance; of names at one distance the first in order is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.operators import pyramid
from plotline.operators.tables import settled

PART = "array<array<struct<x: double, y: double>>>"
_FEW = 8  # edges of a cell that is not split
_LEVELS = 24
_OFF = (0.29384756, 0.71625341)  # of the grid's origin, so that round coordinates don't lie on its lines


def _closed(ring: Column) -> Column:
    last = F.element_at(ring, -1)
    return F.when(last == F.element_at(ring, 1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def parts(df: DataFrame, name: str, part: str = "part") -> DataFrame:
    """``name, part`` with closed rings of three corners or more, and no parts without any."""
    rings = F.filter(F.transform(F.filter(F.coalesce(F.col(part), F.array().cast(PART)), lambda r: F.size(r) >= 3), _closed), lambda r: F.size(r) >= 4)
    return df.select(F.col(name).cast("string").alias("name"), rings.alias("part")).where(F.size("part") > 0)


def edges(layer: DataFrame) -> DataFrame:
    """``name, ax, ay, bx, by`` of every edge."""
    ring = layer.select("name", F.explode("part").alias("r"))
    pairs = F.expr("transform(sequence(1, size(r) - 1), i -> named_struct('ax', r[i - 1].x, 'ay', r[i - 1].y, 'bx', r[i].x, 'by', r[i].y))")
    return ring.select("name", F.inline(pairs))


def flat_edges(part: str = "part") -> Column:
    """All edges of a part as one array of numbers, four for each edge."""
    return F.expr(f"flatten(transform({part}, r -> flatten(transform(sequence(1, size(r) - 1), i -> array(r[i - 1].x, r[i - 1].y, r[i].x, r[i].y)))))")


def area(part: str | Column = "part") -> Column:
    """The area within the first ring of a part, less its holes."""
    c = F.col(part) if isinstance(part, str) else part

    def of(ring: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(ring) - 1)
        at = lambda i, c: F.get(ring, i)[c]
        twice = F.aggregate(steps, F.lit(0.0), lambda s, i: s + at(i - 1, "x") * at(i, "y") - at(i, "x") * at(i - 1, "y"))
        return F.abs(twice) / 2

    sizes = F.transform(c, of)
    return F.get(sizes, F.lit(0)) - F.aggregate(F.slice(sizes, 2, 1_000_000_000), F.lit(0.0), lambda s, v: s + v)


def largest(layer: DataFrame) -> DataFrame:
    """The parts of the name with the greatest area, its parts added up; ties by name."""
    sizes = layer.groupBy("name").agg(F.sum(area()).alias("_area")).agg(F.min_by("name", F.struct(-F.col("_area"), F.col("name"))).alias("name"))
    return layer.join(F.broadcast(sizes), "name")


def _sides(edge: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points are inside what the edges bound: a ray to the right crosses an odd number."""
    ax, ay, bx, by = edge.T
    inside = np.zeros(len(x), bool)
    for at in range(0, len(x), 256):
        py, px = y[at : at + 256, None], x[at : at + 256, None]
        spans = (ay > py) != (by > py)
        with np.errstate(all="ignore"):
            inside[at : at + 256] = (spans & (px < (bx - ax) * (py - ay) / (by - ay) + ax)).sum(axis=1) % 2 == 1
    return inside


def _meets(edge: np.ndarray, x0: float, y0: float, width: float) -> np.ndarray:
    """Edges that have a point in common with a closed cell: boxes meet, and the corners aren't all on one side."""
    ax, ay, bx, by = edge.T
    boxes = (np.minimum(ax, bx) <= x0 + width) & (np.maximum(ax, bx) >= x0) & (np.minimum(ay, by) <= y0 + width) & (np.maximum(ay, by) >= y0)
    side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (x0, x0 + width) for y in (y0, y0 + width)]
    return boxes & ~(np.all([s > 0 for s in side], axis=0) | np.all([s < 0 for s in side], axis=0))


def _cut(edge: np.ndarray, x0: float, y0: float, width: float) -> Iterator[tuple]:
    """``level, cx, cy, corner_inside, edges`` of one part: the cells of the quadtree that it has to do with."""
    low, high = edge.reshape(-1, 2).min(axis=0), edge.reshape(-1, 2).max(axis=0)
    level = 0
    while level < _LEVELS and width / 2 ** (level + 1) >= max(high - low):
        level += 1
    w = width / 2**level
    first, last = ((np.floor((p - (x0, y0)) / w)).astype(int) for p in (low, high))
    todo = [(level, cx, cy, edge) for cx in range(first[0], last[0] + 1) for cy in range(first[1], last[1] + 1)]
    while todo:
        level, cx, cy, near = todo.pop()
        w = width / 2**level
        near = near[_meets(near, x0 + cx * w, y0 + cy * w, w)]
        corner = _sides(edge, np.array([x0 + cx * w]), np.array([y0 + cy * w]))[0] if len(near) <= _FEW or level == _LEVELS else None
        if len(near) > _FEW and level < _LEVELS:
            todo += [(level + 1, 2 * cx + i, 2 * cy + j, near) for i in (0, 1) for j in (0, 1)]
        elif len(near) or corner:
            yield level, cx, cy, bool(corner), near


def index(layer: DataFrame) -> tuple[DataFrame, tuple[float, float, float]]:
    """``name, level, cx, cy, corner_inside, edges`` of every cell, and the grid's origin and width."""
    box = edges(layer).agg(*(f(F.least(a, b) if f is F.min else F.greatest(a, b)) for a, b in (("ax", "bx"), ("ay", "by")) for f in (F.min, F.max))).first()
    if box[0] is None:
        width, x0, y0 = 1.0, 0.0, 0.0
    else:
        width = 2 * max(box[1] - box[0], box[3] - box[2], 1e-6)
        x0, y0 = box[0] - _OFF[0] * width / 4, box[2] - _OFF[1] * width / 4

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, flat in zip(batch["name"], batch["flat"], strict=True):
                edge = np.asarray(flat, float).reshape(-1, 4)
                rows += [(name, *cell[:4], [dict(zip(("ax", "ay", "bx", "by"), e, strict=True)) for e in cell[4].tolist()]) for cell in _cut(edge, x0, y0, width)]
            yield pd.DataFrame(rows, columns=["name", "level", "cx", "cy", "corner_inside", "edges"])

    cells = layer.select("name", flat_edges().alias("flat")).mapInPandas(cut, "name string, level int, cx long, cy long, corner_inside boolean, edges array<struct<ax: double, ay: double, bx: double, by: double>>")
    return settled(cells), (x0, y0, width)


def containing(points: DataFrame, layer: DataFrame, key: str) -> DataFrame:
    """``key, name`` for every name that a point is inside of."""
    cells, (x0, y0, width) = index(layer)
    levels = [r.level for r in cells.select("level").distinct().collect()]  # some two dozen at most
    if not levels:
        return points.select(key).limit(0).withColumn("name", F.lit(None).cast("string"))
    side = F.lit(width) / F.pow(F.lit(2.0), F.col("level").cast("double"))
    at = points.where("x is not null and y is not null").select(F.col(key), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"), F.explode(F.array(*map(F.lit, levels))).alias("level"))
    at = at.withColumns({"cx": F.floor((F.col("px") - x0) / side), "cy": F.floor((F.col("py") - y0) / side)}).alias("p")
    # from the point left to the cell's side, then down that side to the corner
    left = f"{x0!r}D + p.cx * ({width!r}D / pow(2D, p.level))"
    low = f"{y0!r}D + p.cy * ({width!r}D / pow(2D, p.level))"
    across = f"(e.ay > py) <> (e.by > py) and (e.bx - e.ax) * (py - e.ay) / nullif(e.by - e.ay, 0D) + e.ax between {left} and px"
    up = f"(e.ax > {left}) <> (e.bx > {left}) and (e.by - e.ay) * ({left} - e.ax) / nullif(e.bx - e.ax, 0D) + e.ay between {low} and py"
    crossed = F.expr(f"(size(filter(c.edges, e -> {across})) + size(filter(c.edges, e -> {up}))) % 2 = 1")
    inside = F.expr("p.level = c.level and p.cx = c.cx and p.cy = c.cy") & (F.col("c.corner_inside") != crossed)
    return at.join(cells.alias("c"), inside).select(F.col(f"p.{key}").alias(key), "c.name").distinct()


def nearest_name(points: DataFrame, layer: DataFrame, key: str) -> DataFrame:
    """``key, name, distance`` of the nearest name, 0 inside; null where there is none, or no point."""
    inside = containing(points, layer, key).groupBy(key).agg(F.min("name").alias("_in"))
    own = settled(points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(inside, key, "left"))
    box = {"min_x": F.least("ax", "bx"), "max_x": F.greatest("ax", "bx"), "min_y": F.least("ay", "by"), "max_y": F.greatest("ay", "by")}
    found = pyramid.candidates(own.where("_in is null"), edges(layer).withColumns(box))
    along = "greatest(0D, least(1D, coalesce(try_divide((place_x - ax) * (bx - ax) + (place_y - ay) * (by - ay), (bx - ax) * (bx - ax) + (by - ay) * (by - ay)), 0D)))"
    apart = F.expr(f"sqrt(pow(place_x - ax - {along} * (bx - ax), 2) + pow(place_y - ay - {along} * (by - ay), 2))")
    best = found.groupBy("place_x", "place_y").agg(F.min(F.struct(apart.alias("d"), F.col("name"))).alias("_near"))
    joined = own.join(best, (F.col("x") == F.col("place_x")) & (F.col("y") == F.col("place_y")) & F.col("_in").isNull(), "left")
    return joined.select(key, F.coalesce("_in", "_near.name").alias("name"), F.when(F.col("_in").isNotNull(), 0.0).otherwise(F.col("_near.d")).alias("distance"))
