"""Names and alignment of segments, their persistence, and what models listen to, against plain Python."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plotline.operators import archetypes, explain, spatial_models


def test_names(spark):
    rows = [(0, 9.0, 0.2, 10.0, 1.0), (0, 9.5, 0.2, 11.0, 1.0), (1, 1.0, 0.9, 10.5, 1.0), (1, 1.2, 0.9, 10.0, 1.0), (2, 5.0, 0.2, 1.0, 1.0), (2, 5.2, 0.2, 1.2, 1.0), (3, 5.1, 0.2, 15.0, 1.0), (4, 5.1, 0.2, 15.0, 1.0), (None, 99.0, 9.0, 9.0, 1.0)]
    df = spark.createDataFrame(rows, "cluster int, median_sale_price double, transit_commute_share double, annual_sale_velocity double, same double").repartition(3)
    features = ["median_sale_price", "transit_commute_share", "annual_sale_velocity", "same"]
    got = {r.cluster: r.archetype for r in archetypes.archetype_names(df, "cluster", features).collect()}
    assert got == {0: "High-Value", 1: "Affordable Transit-Oriented", 2: "Low-Turnover", 3: "Annual Sale Velocity", 4: "Annual Sale Velocity 2"}
    assert archetypes.archetype_names(df.limit(0), "cluster", features).count() == 0


def test_assignment():
    rng = random.Random(2)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 4), (7, 7)):
        cost = [[rng.random() for _ in range(m)] for _ in range(n)]
        got = archetypes.assignment(cost)
        small, large = min(n, m), max(n, m)
        best = min(sum(cost[a][b] if n <= m else cost[b][a] for a, b in zip(range(small), p)) for p in itertools.permutations(range(large), small))
        assert sum(cost[i][j] for i, j in got) == pytest.approx(best) and len({i for i, _ in got}) == len({j for _, j in got}) == small
    assert archetypes.assignment([]) == []


def test_labels_keep_their_meaning(spark):
    """However a period's clusters are numbered, a place that stays where it is keeps its segment."""
    rng = random.Random(4)
    centres = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]
    for trial in range(3):
        rows = []
        for period in range(4):
            names = rng.sample(range(4 if period == 3 else 3), 4 if period == 3 else 3)
            for place in range(12):
                x, y = centres[place % 3]
                extra = period == 3 and place == 11
                rows.append((period, place, names[3 if extra else place % 3], (50.0 if extra else x + period) + rng.random(), y + rng.random()))
        df = spark.createDataFrame([*rows, (None, 1, 1, 0.0, 0.0)], "period int, place int, cluster int, a double, b double").repartition(3)
        out = archetypes.align_periods(df, "period", "cluster", ["a", "b"])
        seen = defaultdict(set)
        for r in out.where("period is not null").collect():
            seen[r.place].add(r.segment)
        assert all(len(s) == 1 for p, s in seen.items() if p != 11) and len(seen[11]) == 2 and max(seen[11]) == 3
        assert out.where("period is null and segment is null").count() == 1


def test_persistence_and_transitions(spark):
    rng = random.Random(9)
    labels = [(place, period, rng.randrange(3)) for place in range(20) for period in (2001, 2003, 2008, 2009) if rng.random() < 0.8] + [(50, 2001, 1)]
    df = spark.createDataFrame([*labels, (None, 2001, 1), (51, 2001, None)], "place int, period int, segment int").repartition(3)
    at = {(p, t): s for p, t, s in labels}
    periods = sorted({t for _, t, _ in labels})
    moves = [(p, a, b, at[p, a], at[p, b]) for a, b in zip(periods, periods[1:]) for p in {x[0] for x in labels} if (p, a) in at and (p, b) in at]
    n, total = Counter(m[1:] for m in moves), Counter(m[1:4] for m in moves)
    got = {(r.from_period, r.to_period, r.from_segment, r.to_segment): (r.n, r.probability) for r in archetypes.segment_transitions(df, "place", "period", "segment").collect()}
    assert got == {k: (v, pytest.approx(v / total[k[:3]])) for k, v in n.items()}
    for r in archetypes.persistence(df, "place", "period", "segment").collect():
        own = [s for p, _, s in labels if p == r.place]
        stays = [a == b for p, _, _, a, b in moves if p == r.place]
        counts = Counter(own)
        assert (r.periods, r.distinct_segments) == (len(own), len(counts)) and r.dominant_segment == min(counts, key=lambda s: (-counts[s], s))
        assert r.persistence_rate == (pytest.approx(sum(stays) / len(stays)) if stays else None)
    pairs = lambda c: sum(math.comb(v, 2) for v in c.values())
    for r in archetypes.agreements(df, "place", "period", "segment").collect():
        own = [m for m in moves if m[1] == r.from_period]
        both, a, b = pairs(Counter(m[3:] for m in own)), pairs(Counter(m[3] for m in own)), pairs(Counter(m[4] for m in own))
        expected = a * b / math.comb(len(own), 2)
        assert r.shared == len(own) and r.adjusted_rand == pytest.approx((both - expected) / ((a + b) / 2 - expected))


def _predict(df):
    return df.withColumn("prediction", 3 * F.col("strong") + 0.5 * F.col("weak") + F.when(F.col("kind") == "x", 1.0).otherwise(0.0))


def test_importance_finds_the_planted_feature_first(spark):
    rng = random.Random(1)
    rows = [(i % 150, rng.random(), rng.random(), rng.random(), rng.choice("xy")) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, strong double, weak double, noise double, kind string").repartition(3).withColumn("actual", 3 * F.col("strong") + 0.5 * F.col("weak") + F.when(F.col("kind") == "x", 1.0).otherwise(0.0))
    features = ["noise", "weak", "strong", "kind"]
    got = {r.feature: r for r in explain.permutation_importance(df, _predict, features, "actual", "id", repeats=4).collect()}
    order = sorted(got, key=lambda f: -got[f].importance)
    assert order == ["strong", "kind", "weak", "noise"] and got["noise"].importance == 0 and all(abs(r.baseline) < 1e-12 for r in got.values())
    # a shuffle of independent values adds the mean distance of two of them, a third, times the weight
    assert got["strong"].importance == pytest.approx(1, abs=0.15) and got["weak"].importance == pytest.approx(1 / 6, abs=0.03) and got["strong"].spread > 0
    assert explain.permutation_importance(df.withColumn("actual", F.lit(None).cast("double")), _predict, features, "actual", "id").count() == 0


def test_numbers_are_dense(spark):
    df = spark.createDataFrame([(i * 7 % 100,) for i in range(250)], "k long").repartition(5)
    got = spatial_models.numbered(df, "k").collect()
    assert sorted(r.number for r in got) == list(range(250)) and all(a.k <= b.k for a, b in itertools.pairwise(sorted(got, key=lambda r: r.number)))


def test_partial_dependence(spark):
    df = spark.range(101).selectExpr("cast(id as double) / 100 as strong", "cast(id % 10 as double) as weak", "'x' as kind", "1.0D as flat")
    got = {(r.feature, round(r.value, 6)): r.prediction for r in explain.partial_dependence(df, _predict, ["strong", "weak", "flat"], points=5).collect()}
    weak = sum(i % 10 for i in range(101)) / 101
    assert len([f for f, _ in got if f == "strong"]) == 5 and not any(f == "flat" for f, _ in got)
    for (f, v), p in got.items():
        assert p == pytest.approx(3 * (v if f == "strong" else 0.5) + 0.5 * (v if f == "weak" else weak) + 1)
    assert explain.partial_dependence(df.limit(0), _predict, ["strong"]).count() == 0
