"""Names for clusters of places, labels that keep their meaning from period to period, and how long places keep them.

Cases: a feature without spread, or that is not there, names nothing; a cluster that no rule fits is named by the feature
that it has most of; names that would be the same are numbered by cluster; a period with more clusters than the one
before gets new labels for the surplus; null keys and clusters take no part.
"""

from __future__ import annotations

from functools import reduce
from itertools import pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotline.operators.tables import settled

#: What a cluster is called when its mean, in standard deviations from all, lies beyond a bound: of each group the first
#: that fits, of all groups the first three (fixed values).
NAME_RULES = (
    (("median_sale_price", 0.5, "High-Value"), ("median_sale_price", -0.5, "Affordable")),
    (("annual_appreciation", 0.4, "Growth"),),
    (("transit_commute_share", 0.4, "Transit-Oriented"), ("cta_distance_miles", 0.5, "Transit-Distant")),
    (("annual_sale_velocity", -0.5, "Low-Turnover"),),
    (("owner_occupancy_rate", 0.5, "Owner-Occupied"),),
)
NAMES_MOST = 3


def archetype_names(profiles: DataFrame, cluster: str, features: list[str]) -> DataFrame:
    """``cluster, archetype``: a name for each cluster from how its members' means stand out."""
    known = profiles.where(F.col(cluster).isNotNull())
    scale = known.agg(*(f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    z = {c: (F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)) for c in features}
    means = known.join(F.broadcast(scale)).groupBy(F.col(cluster).alias("cluster")).agg(*(F.avg(v).alias(c) for c, v in z.items()))
    fits = lambda c, bound: F.col(c) > bound if bound > 0 else F.col(c) < bound
    groups = [[F.when(fits(c, bound), F.lit(name)) for c, bound, name in group if c in features] for group in NAME_RULES]
    named = F.array_join(F.slice(F.array_compact(F.array(*(F.coalesce(*g) for g in groups if g))), 1, NAMES_MOST), " ") if any(groups) else F.lit("")
    standing = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("z"), F.lit(-k).alias("k"), F.lit(c).alias("name"))) for k, c in enumerate(features))))
    lead = F.initcap(F.replace(F.array_max(standing)["name"], F.lit("_"), F.lit(" ")))
    base = means.select("cluster", F.when(named != "", named).otherwise(F.coalesce(lead, F.lit("Unnamed"))).alias("_base"))
    number = F.row_number().over(Window.partitionBy("_base").orderBy("cluster"))
    return base.withColumn("_n", number).select("cluster", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws(" ", "_base", F.col("_n").cast("string"))).alias("archetype"))


def assignment(cost: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs of rows and columns, one of each, with the least total cost: the best for each set of columns used so far.

    For a dozen clusters or so; the work doubles with each.
    """
    if not cost or not cost[0]:
        return []
    if len(cost) > len(cost[0]):
        return sorted((r, c) for c, r in assignment([list(x) for x in zip(*cost, strict=True)]))
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in cost:
        after: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (total, taken) in best.items():
            for c, x in enumerate(row):
                if not used >> c & 1:
                    new = (total + x, (*taken, c))
                    if used | 1 << c not in after or new < after[used | 1 << c]:
                        after[used | 1 << c] = new
        best = after
    return list(enumerate(min(best.values())[1]))


def align_periods(labelled: DataFrame, period: str, cluster: str, features: list[str]) -> DataFrame:
    """``labelled`` with ``segment``: clusters of consecutive periods are matched so that their centres lie nearest.

    A segment keeps its number however a period's clustering happens to number it. Centres, a row for each period and
    cluster, come to the driver.
    """
    known = labelled.where(F.col(period).isNotNull() & F.col(cluster).isNotNull())
    rows = known.groupBy(F.col(period).alias("p"), F.col(cluster).alias("c")).agg(*(F.avg(f).alias(f) for f in features)).orderBy("p", "c").collect()
    centres: dict = {}
    for r in rows:
        centres.setdefault(r.p, []).append((r.c, [r[f] or 0.0 for f in features]))
    segment: dict = {}
    fresh = 0
    for before, now in [(None, p) for p in list(centres)[:1]] + list(pairwise(centres)):
        matched = {}
        if before is not None:
            apart = [[sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5 for _, b in centres[now]] for _, a in centres[before]]
            matched = {centres[now][j][0]: segment[before, centres[before][i][0]] for i, j in assignment(apart)}
        for c, _ in centres[now]:
            if c not in matched:
                matched[c], fresh = fresh, fresh + 1
            segment[now, c] = matched[c]
    kinds = dict(labelled.dtypes)
    named = labelled.sparkSession.createDataFrame([(p, c, s) for (p, c), s in segment.items()], f"_p {kinds[period]}, _c {kinds[cluster]}, segment int")
    return labelled.join(F.broadcast(named), (F.col(period) == F.col("_p")) & (F.col(cluster) == F.col("_c")), "left").drop("_p", "_c")


def _steps(labels: DataFrame, key: str, period: str, segment: str) -> DataFrame:
    """Moves of each key between periods that follow each other in the whole table."""
    known = settled(labels.select(key, period, segment).dropna())
    order = Window.orderBy(period)  # a row for each period
    periods = known.select(period).distinct().withColumn("_at", F.row_number().over(order))
    placed = known.join(F.broadcast(periods), period)
    after = placed.select(F.col(key), (F.col("_at") - 1).alias("_at"), F.col(period).alias("to_period"), F.col(segment).alias("to_segment"))
    return placed.withColumnsRenamed({period: "from_period", segment: "from_segment"}).join(after, [key, "_at"]).drop("_at")


def segment_transitions(labels: DataFrame, key: str, period: str, segment: str) -> DataFrame:
    """``from_period, to_period, from_segment, to_segment, n, probability`` of the moves between consecutive periods."""
    n = _steps(labels, key, period, segment).groupBy("from_period", "to_period", "from_segment", "to_segment").agg(F.count("*").alias("n"))
    return n.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("from_period", "to_period", "from_segment")))


def persistence(labels: DataFrame, key: str, period: str, segment: str) -> DataFrame:
    """``key, periods, dominant_segment, distinct_segments, persistence_rate``: the share of moves that stay; ties of the dominant go to the least."""
    counts = labels.select(key, period, segment).dropna().groupBy(key, segment).agg(F.count("*").alias("_n"))
    own = counts.groupBy(key).agg(F.sum("_n").alias("periods"), F.min_by(segment, F.struct(-F.col("_n"), F.col(segment))).alias("dominant_segment"), F.count("*").alias("distinct_segments"))
    rates = _steps(labels, key, period, segment).groupBy(key).agg(F.avg((F.col("from_segment") == F.col("to_segment")).cast("double")).alias("persistence_rate"))
    return own.join(rates, key, "left")


def agreements(labels: DataFrame, key: str, period: str, segment: str) -> DataFrame:
    """``from_period, to_period, shared, adjusted_rand`` of each two consecutive periods, all from their contingency tables."""
    cells = _steps(labels, key, period, segment).groupBy("from_period", "to_period", "from_segment", "to_segment").agg(F.count("*").alias("n"))
    pair = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    by = ["from_period", "to_period"]
    side = lambda s: cells.groupBy(*by, s).agg(F.sum("n").alias("m")).groupBy(*by).agg(pair("m").alias(f"_{s}"))
    both = cells.groupBy(*by).agg(F.sum("n").alias("shared"), pair("n").alias("_both"))
    out = reduce(lambda a, b: a.join(b, by), (both, side("from_segment"), side("to_segment")))
    expected = F.try_divide(F.col("_from_segment") * F.col("_to_segment"), F.col("shared") * (F.col("shared") - 1) / 2)
    most = (F.col("_from_segment") + F.col("_to_segment")) / 2
    rand = F.when(F.col("shared") < 2, F.lit(None)).when(most == expected, 1.0).otherwise((F.col("_both") - expected) / (most - expected))
    return out.select(*by, "shared", rand.alias("adjusted_rand"))
