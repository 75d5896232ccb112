"""Learners and explanations by their properties on made-up tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plotline.operators import hedonic, models, spatial


@pytest.fixture(scope="module")
def houses(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        size, age, kind = rng.uniform(800, 4000), rng.uniform(0, 100), rng.choice(("brick", "frame"))
        price = 100 * size * math.exp(-age / 200) * (1.2 if kind == "brick" else 1.0) * math.exp(rng.gauss(0, 0.05))
        rows.append((i, price, size if i % 29 else None, age, kind, float(i % 20) * 10, float(i // 20) * 10))
    return spark.createDataFrame(rows, "id long, price double, size double, age double, kind string, x double, y double").cache()


def test_trees_and_shapley(spark, houses):
    model = models.train_trees(houses.where("id < 320"), "price", ["size", "age"], ["kind"], trees=20)
    test = model.predict(houses.where("id >= 320 and size is not null"))
    assert test.agg(F.avg(F.abs(F.col("prediction") / F.col("price") - 1))).first()[0] < 0.15
    unseen = model.predict(houses.limit(1).withColumn("kind", F.lit("stone"))).first()
    assert unseen.prediction > 0
    some, reference = houses.where("id in (330, 331)"), {"size": 2000.0, "age": 50.0, "kind": "frame"}
    parts = models.shapley(model, some, reference, "id", ["size", "age", "kind"], permutations=4)
    base = model.predict(some.limit(1).withColumns({k: F.lit(v) for k, v in reference.items()})).first().prediction
    want = {r.id: r.prediction - base for r in model.predict(some).collect()}
    got = {r.id: r.total for r in parts.groupBy("id").agg(F.sum("contribution").alias("total")).collect()}
    assert got == pytest.approx(want, rel=1e-6)


def test_segments_and_agreement(spark):
    rows = [(i, float(i % 2 * 10) + i * 0.01, 5.0 - i % 2 * 4) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    out = models.segments(df, "id", ["a", "b"], range(2, 5)).withColumn("truth", F.col("id") % 2)
    assert out.select("cluster").distinct().count() == 2 and out.first().silhouette > 0.9
    assert models.adjusted_rand(out, "cluster", "truth") == pytest.approx(1)
    assert abs(models.adjusted_rand(out.withColumn("noise", F.col("id") % 3), "cluster", "noise")) < 0.2


def test_spatial_lag_model_finds_its_parameters(spark, houses):
    import numpy as np

    edges = spatial.knn(houses.select("id", "x", "y"), "id", 4)
    w = np.zeros((400, 400))
    for r in edges.collect():
        w[r.i, r.j] = 0.25
    rng = np.random.default_rng(0)
    x = rng.standard_normal(400)
    y = np.linalg.solve(np.eye(400) - 0.5 * w, 1 + 2 * x + rng.standard_normal(400) * 0.1)
    df = spark.createDataFrame([(i, float(y[i]), float(x[i])) for i in range(400)], "id long, v double, c double")
    fit = models.spatial_two_stage(df, edges, "id", "v", "c")
    assert fit.coefficients["rho"] == pytest.approx(0.5, abs=0.1) and fit.coefficients["c"] == pytest.approx(2, abs=0.1)


def test_bootstrap_spline_and_vif(spark, houses):
    df = houses.withColumn("p", F.col("price") * 1.1)
    b = {r.metric: r for r in models.bootstrap_metrics(df, "price", "p", "id", draws=60).collect()}
    mae = df.agg(F.avg(F.abs(F.col("price") - F.col("p")))).first()[0]
    assert b["mae"].low < mae < b["mae"].high and b["mae"].low > 0.8 * mae
    s = models.spline_basis(houses, "age")
    assert s.agg(F.avg("spline_1")).first()[0] == pytest.approx(0, abs=1e-9) and s.where("spline_k3 < 0").count() == 0
    v = models.variance_inflation(houses.withColumn("age2", F.col("age") + F.col("x") * 0.001), "age", "age2", "y")
    assert v["age"] > 100 and v["y"] < 1.5


def test_least_squares(spark, houses):
    df = houses.dropna().withColumn("t", 3 + 2 * F.col("age") - F.col("x"))
    fit = hedonic.ols(df, "t", "age", "x")
    assert fit.coefficients == pytest.approx({"const": 3, "age": 2, "x": -1}, abs=1e-6)
    hot = hedonic.one_hot(houses, "kind", hedonic.top_levels(houses, "kind", 20, 5))
    assert hot.where("`kind=__OTHER__` = 1").count() == 0
    filled = hedonic.impute_median(houses, "size")
    assert filled.where("size is null").count() == 0 and filled.where("size_missing").count() == houses.where("size is null").count()
