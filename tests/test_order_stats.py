"""Exact order statistics: the same figures as sorting, whatever the bins, the group sizes and the rounds needed."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.operators import order_stats, validation

PROBS = {"low": 0.0, "p10": 0.1, "median": 0.5, "p99": 0.99, "high": 1.0}


def _values():
    rng = random.Random(3)
    rows = [("one", rng.lognormvariate(12, 1)) for _ in range(3000)]
    rows += [("ties", float(rng.choice([5, 5, 5, 7, -2]))) for _ in range(500)] + [("same", 4.25)] * 300
    rows += [("wide", rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300)) for _ in range(400)] + [("near", 1e9 + rng.random() * 1e-3) for _ in range(400)]
    rows += [(None, float(i)) for i in range(7)] + [("single", -0.0), ("gone", None), ("gone", math.nan), ("ties", None), ("ties", math.nan)]
    return rows + [("ends", x) for x in (-math.inf, -math.inf, -1.0, 0.0, 2.0, math.inf)]


@pytest.mark.parametrize("limits", [{}, {"gather": 3, "parts": 4}, {"gather": 1, "parts": 4096}])
def test_quantiles(spark, limits):
    rows = _values()
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None and not math.isnan(v):
            groups[g].append(v)
    got = {r.g: r for r in order_stats.quantiles(df, ["g"], "v", PROBS, **limits).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g].n == len(values)
        s = sorted(values)
        for name, q in PROBS.items():
            at = (len(s) - 1) * q
            lo, hi = s[math.floor(at)], s[math.ceil(at)]
            want = lo if lo == hi else lo + (hi - lo) * (at - math.floor(at))
            assert got[g][name] == pytest.approx(want, rel=1e-12, nan_ok=True), (g, name)


def test_all_rows_as_one_group(spark):
    df = spark.range(0, 200_000, numPartitions=6).select(((F.col("id") * 7919) % 200_000).cast("double").alias("v"))
    (r,) = order_stats.quantiles(df, [], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, gather=50).collect()
    assert (r.n, r.q1, r["median"], r.q3) == (200_000, 49_999.75, 99_999.5, 149_999.25)
    (r,) = order_stats.quantiles(df.limit(0), [], "v", {"median": 0.5}).collect()
    assert r.n is None and r["median"] is None
    # no task sorts or buffers a group: one task holds no more than a bin
    assert order_stats.quantiles(df.withColumn("g", F.lit(None).cast("int")), ["g"], "v", {"m": 0.5}).first().m == 99_999.5


@pytest.mark.parametrize("limits", [{}, {"gather": 2, "parts": 5}])
def test_weights(spark, limits):
    rng = random.Random(8)
    rows = [(g, rng.choice([1.0, 2.5, rng.random() * 100, -rng.random()]), float(rng.choice([1, 2, 3, 10]))) for g in "ab" for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(3)
    for q in (0.01, 0.5, 0.9, 1.0):
        found = order_stats.first_reaching(df, ["g"], "v", lambda total, q=q: [("q", (q - 1e-12) * total)], "w", **limits)
        for r in found.collect():
            own = sorted((v, w) for g, v, w in rows if g == r.g)
            running = np.cumsum([w for _, w in own])
            assert r.total == running[-1] and r.statistic == own[int(np.argmax(running >= q * running[-1] - 1e-9))][0]


def test_many_measures(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, None), ("b", None, None), ("a", 4.0, 7)], "g string, x double, y int")
    got = {r.g: (r.x_m, r.y_m) for r in order_stats.many_quantiles(df, ["g"], {"x": F.col("x"), "y": F.col("y")}, {"m": 0.5}).collect()}
    assert got == {"a": (2.0, 6.0)}


def test_chronological_split(spark):
    years = spark.createDataFrame([(y,) for y in (2001, 2003, 2003, 2004, 2007, None)], "year int")
    split = lambda **k: {r.year: r.split for r in validation.chronological_split(years, "year", **k).collect()}
    assert split() == {2001: "train", 2003: "train", 2004: "validation", 2007: "test", None: None}
    assert split(validation_start=2003) == {2001: "train", 2003: "validation", 2004: "validation", 2007: "test", None: None}
    assert split(validation_start=2002, test_start=2004)[2004] == "test"
    for bad in ({"validation_start": 2007}, {"test_start": 2010}, {"validation_start": 1999}, {"validation_start": 2005, "test_start": 2003}):
        with pytest.raises(ValueError, match="no years in"):
            split(**bad)
    with pytest.raises(ValueError):
        validation.chronological_split(years.where("year > 2003"), "year")


def test_conformal_radius_of_one_large_group(spark):
    df = spark.range(0, 5000).select(F.lit("m").alias("model"), F.col("id").cast("double").alias("score"))
    got = {r.level: r.radius for r in validation.conformal_radius(df, "model", "score", 0.5, 0.9).collect()}
    assert got == {0.5: 2501.0, 0.9: 4501.0}  # ceil(5001 q) of 5000, then the next rank up
