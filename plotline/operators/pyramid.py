"""The nearest things to many places, by descending a pyramid of grid cells.

Things (points, segments: whatever has a box) are dealt into the cells of a grid, sixteen of which make one cell of the
level above, up to one that holds all. For each cell the box of its things and their number are known. Places descend
level by level: of the children of the cells still open to a place, those stay whose box is no farther than some boxes
that are sure to hold enough things. Each step is an equi-join on the parent cell and a window over a place's few
dozen cells, so no place meets all things however far away or unevenly spread they are. Only distinct places descend.

Cases: places and things without coordinates are left out; things as far as the last that counts all come out, so ties
are the caller's to settle; fewer things than wanted all come out; no things give no rows.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotline.operators.tables import settled

_LEAF = 8  # things of a finest cell, in the mean
_BOUNDED = 2  # levels with 16 and 256 cells at most


def gap(x: Column, y: Column) -> Column:
    """The distance from a point to the box ``min_x .. max_y``; 0 inside."""
    dx = F.greatest(F.col("min_x") - x, x - F.col("max_x"), F.lit(0.0))
    dy = F.greatest(F.col("min_y") - y, y - F.col("max_y"), F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def reach(x: Column, y: Column) -> Column:
    """The distance from a point to the farthest corner of the box."""
    dx = F.greatest(F.abs(F.col("min_x") - x), F.abs(F.col("max_x") - x))
    dy = F.greatest(F.abs(F.col("min_y") - y), F.abs(F.col("max_y") - y))
    return F.sqrt(dx * dx + dy * dy)


def _box() -> list[Column]:
    return [F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y")]


def candidates(places: DataFrame, things: DataFrame, k: int = 1) -> DataFrame:
    """``place_x, place_y`` and the columns of each of ``things`` that may be among the ``k`` nearest of that place.

    ``places`` has ``x, y``; ``things`` have ``min_x, max_x, min_y, max_y`` and whatever else.
    """
    things = settled(things.where("min_x + max_x + min_y + max_y is not null").withColumns({"_mx": F.expr("min_x / 2 + max_x / 2"), "_my": F.expr("min_y / 2 + max_y / 2")}))
    n, low_x, high_x, low_y, high_y = things.agg(F.count("*"), F.min("_mx"), F.max("_mx"), F.min("_my"), F.max("_my")).first()
    depth = max(1, ceil(log(max(n, 1) / _LEAF, 16))) if n else 1
    parts = 4**depth
    width = max((high_x - low_x) / parts, (high_y - low_y) / parts, 1e-9) if n else 1.0
    cell = lambda c, low: F.least(F.lit(parts - 1), F.floor((F.col(c) - F.lit(low or 0.0)) / width)).cast("long")
    dealt = things.withColumns({"_cx": cell("_mx", low_x), "_cy": cell("_my", low_y)})
    none = F.lit(0).cast("long")
    open_ = places.where("x is not null and y is not null").select(F.col("x").cast("double").alias("place_x"), F.col("y").cast("double").alias("place_y")).distinct().withColumns({"_px": none, "_py": none})
    x, y = F.col("place_x"), F.col("place_y")
    of_place = Window.partitionBy("place_x", "place_y")
    for level in range(1, depth + 1):
        shift = 2 * (depth - level)
        at = {"_cx": F.shiftright("_cx", shift), "_cy": F.shiftright("_cy", shift)}
        cells = dealt.withColumns(at).groupBy("_cx", "_cy").agg(*_box(), F.count("*").alias("_n")).withColumns({"_px": F.shiftright("_cx", 2), "_py": F.shiftright("_cy", 2)})
        near = open_.join(F.broadcast(cells) if level <= _BOUNDED else cells.hint("merge"), ["_px", "_py"]).withColumns({"_gap": gap(x, y), "_reach": reach(x, y)})
        if k == 1:
            bound = F.min("_reach").over(of_place)
        else:
            near = near.withColumn("_held", F.sum("_n").over(of_place.orderBy("_reach")))
            bound = F.coalesce(F.min(F.when(F.col("_held") >= k, F.col("_reach"))).over(of_place), F.lit(float("inf")))
        near = near.withColumn("_bound", bound).where("_gap <= _bound * (1 + 1e-12)")
        open_ = near.select("place_x", "place_y", F.col("_cx").alias("_px"), F.col("_cy").alias("_py"))
    found = open_.join(dealt.hint("merge"), (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")))
    return found.drop("_px", "_py", "_cx", "_cy", "_mx", "_my")
