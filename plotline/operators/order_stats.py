"""Exact order statistics of groups of any size, by refined histograms.

A group's values are counted by bins that are the same for all data (about 1.6 % wide), which is summed up in the
tasks; running totals over a group's bins, a few hundred rows, say which bin holds a wanted rank. Only what lies in such
bins is looked at again: bins of at most ``GATHER`` values are sorted, larger ones are cut into ``PARTS`` equal parts
between their least and greatest value, round by round, each round narrowing the range some thousandfold. A bin whose
values are all the same is settled by its count. So no group is sorted, buffered or sent to one task as a whole.

With weights, the statistic is the first value at which the running weight reaches a wanted mass; without, each row
weighs one and the mass is a rank from 1.

Cases: null values and NaN are left out, infinite ones are the outermost; a group without values has no row; null keys
are a group; values that tie are one; a mass beyond the total stands for the total, one below the first for the first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotline.operators.tables import settled

GATHER = 10_000
PARTS = 4096
_PER_LOG = 64


def _coarse() -> Column:
    """A bin number that never falls as the value rises."""
    v = F.col("value")
    return F.floor(F.signum(v) * F.least(F.log1p(F.abs(v)), F.lit(1000.0)) * _PER_LOG).cast("long")


def _fine(parts: int) -> Column:
    """The part of its bin that a value lies in; halves keep the largest doubles' differences finite."""
    share = (F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    inner = F.floor(F.greatest(F.lit(0.0), F.least(share, F.lit(1.0))) * (parts - 2)).cast("long") + 1
    # bins with an infinite end are cut into that end and the rest
    return F.when(F.col("value") == F.col("hi"), F.lit(parts)).when(F.col("value") == F.col("lo"), F.lit(0)).when(F.isnan(share), F.lit(1)).otherwise(inner).cast("long")


def _counted(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Bins with their ends, and the mass before and up to each within its ``keys``."""
    along = Window.partitionBy(*keys).orderBy(order)
    bins = rows.groupBy(*keys, order).agg(F.sum("weight").alias("mass"), F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    upto = bins.withColumn("upto", F.sum("mass").over(along))
    return upto.withColumns({"before": F.lag("upto").over(along), "whole": F.max("upto").over(Window.partitionBy(*keys)), "id": F.monotonically_increasing_id()})


def _same(keys: list[str], a: str, b: str) -> Column:
    return F.expr(" and ".join(f"{a}.{k} <=> {b}.{k}" for k in keys))


def first_reaching(df: DataFrame, by: list[str], value: str | Column, wanted: Callable[[Column], list[tuple[str, Column]]], weight: str | Column | None = None, gather: int = GATHER, parts: int = PARTS, reread: bool = False) -> DataFrame:
    """``*by, name, total, statistic``: of each group, for each wanted ``(name, mass)``, the first value whose running weight reaches it.

    ``wanted`` makes the pairs from the column of the group's total weight (a long, the count, without weights).
    ``reread`` says that ``df`` is cheap to read again and the same each time; else it is written first.
    """
    v = F.col(value) if isinstance(value, str) else value
    w = F.lit(1).cast("long") if weight is None else F.col(weight) if isinstance(weight, str) else weight
    rows = df.select(*by, v.cast("double").alias("value"), w.alias("weight")).where("value is not null and not isnan(value)")
    rows = rows if reread else settled(rows)
    binned = rows.withColumns({"bin": _coarse(), "all_rows": F.lit(0)})
    keys = by or ["all_rows"]
    bins = _counted(binned, keys, "bin").withColumnRenamed("whole", "total")
    named = F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.least(F.greatest(m, F.lit(0)), F.col("total")).alias("target")) for n, m in wanted(F.col("total")))))
    targets = bins.select("*", named).where("(before is null or target > before) and (target <= upto)")
    targets = settled(targets.select(*keys, "bin", "id", "n", "lo", "hi", "name", "total", (F.col("target") - F.coalesce("before", F.lit(0))).alias("rest")))
    outs = [targets.where("lo = hi").select(*keys, "name", "total", F.col("lo").alias("statistic"))]
    open_ = targets.where("lo < hi")
    held = open_.select(*keys, "bin", "id", "n", "lo", "hi").distinct()
    inside = binned.alias("r").join(held.alias("h"), _same([*keys, "bin"], "r", "h")).select("r.value", "r.weight", "h.id", "h.n", "h.lo", "h.hi")
    while True:
        small = inside.where(F.col("n") <= gather).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("value", "weight"))).alias("sorted"))
        outs.append(open_.join(small, "id").select(*keys, "name", "total", _at("sorted", "rest", weight is None).alias("statistic")))
        large = open_.where(F.col("n") > gather)
        if large.isEmpty():
            break
        cut = settled(inside.where(F.col("n") > gather).withColumnRenamed("id", "up").withColumn("part", _fine(parts)).drop("n", "lo", "hi"))
        found = _counted(cut, ["up"], "part").join(large.select(F.col("id").alias("up"), *keys, "name", "total", "rest"), "up")
        found = found.withColumn("rest", F.least("rest", "whole")).where("(before is null or rest > before) and rest <= upto")
        targets = settled(found.select(*keys, "up", "part", "id", "n", "lo", "hi", "name", "total", (F.col("rest") - F.coalesce("before", F.lit(0))).alias("rest")))
        outs.append(targets.where("lo = hi").select(*keys, "name", "total", F.col("lo").alias("statistic")))
        open_ = targets.where("lo < hi")
        held = open_.select("up", "part", "id", "n", "lo", "hi").distinct()
        inside = cut.join(held, ["up", "part"]).select("value", "weight", "id", "n", "lo", "hi")
    return reduce(DataFrame.unionByName, outs).select(*by, "name", "total", "statistic")


def _at(values: str, rest: str, counted: bool) -> Column:
    """The first of the sorted values at which the running weight reaches ``rest``."""
    if counted:
        return F.expr(f"element_at({values}, cast(greatest(1, least({rest}, size({values}))) as int)).value")
    run = f"aggregate({values}, named_struct('left', cast({rest} as double), 'found', cast(null as double)), (a, x) -> if(a.found is not null, a, named_struct('left', a.left - x.weight, 'found', if(a.left <= x.weight, x.value, null))), a -> a.found)"
    return F.expr(f"coalesce({run}, element_at({values}, -1).value)")


def quantiles(df: DataFrame, by: list[str], value: str | Column, probs: dict[str, float], **options: int) -> DataFrame:
    """``*by, n`` and a column for each of ``probs``: exact quantiles, interpolated linearly between neighbouring ranks."""

    def wanted(total: Column) -> list[tuple[str, Column]]:
        return [(f"{side}_{name}", to((total - 1) * F.lit(float(q))).cast("long") + 1) for name, q in probs.items() for side, to in (("lo", F.floor), ("hi", F.ceil))]

    found = first_reaching(df, by, value, wanted, **options)
    of = {f"{side}_{n}": F.max(F.when(F.col("name") == f"{side}_{n}", F.col("statistic"))) for n in probs for side in ("lo", "hi")}
    wide = found.groupBy(*by).agg(F.max("total").alias("n"), *(c.alias(n) for n, c in of.items()))

    def between(name: str, q: float) -> Column:
        at = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"lo_{name}"), F.col(f"hi_{name}")
        return F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (at - F.floor(at)))

    return wide.select(*by, "n", *(between(n, q).alias(n) for n, q in probs.items()))


def many_quantiles(df: DataFrame, by: list[str], measures: dict[str, Column], probs: dict[str, float], reread: bool = False) -> DataFrame:
    """``*by`` and ``{measure}_{prob}`` for every measure and prob, all from the same passes; null where a measure has no values."""
    long = df.select(*by, F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), c.cast("double").alias("value")) for m, c in measures.items()))))
    found = quantiles(long, [*by, "measure"], "value", probs, reread=reread)
    pick = [F.max(F.when(F.col("measure") == m, F.col(p))).alias(f"{m}_{p}") for m in measures for p in probs]
    return found.groupBy(*by).agg(*pick)
