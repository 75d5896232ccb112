"""Regressions from cross products against dense fits, and what is built on their covariances."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.operators import blocks

RNG = np.random.default_rng(11)
N = 400
X = np.column_stack([RNG.normal(size=N), 2000 + RNG.integers(0, 20, N), RNG.random(N) * 4])
Y = 1.5 + X @ [0.7, 0.02, -0.3] + RNG.normal(size=N) * (0.1 + X[:, 2] / 10)
NAMES = ["a", "year", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    made = [(int(i % 4), *map(float, X[i]), float(Y[i]), float(math.exp(Y[i]))) for i in range(N)]
    awkward = [(0, None, 1.0, 1.0, 1.0, 1.0), (1, float("nan"), 1.0, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, None, 1.0)]
    return spark.createDataFrame(made + awkward, "fold int, a double, year double, d double, y double, price double").repartition(3)


def _dense(x, y):
    z = np.column_stack([np.ones(len(x)), x])
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    e = y - z @ beta
    inv = np.linalg.inv(z.T @ z)
    w = (e / (1 - np.einsum("ij,jk,ik->i", z, inv, z))) ** 2
    return beta, 1 - e @ e / ((y - y.mean()) ** 2).sum(), inv @ (z.T * w) @ z @ inv, np.exp(e).mean()


def test_nested_models_and_folds(rows):
    block = blocks.gram(rows, "y", NAMES)
    for name, m in blocks.nested(block, {"one": ["a"], "two": ["a", "year"], "all": NAMES}).items():
        at = {"one": [0], "two": [0, 1], "all": [0, 1, 2]}[name]
        beta, r2, *_ = _dense(X[:, at], Y)
        assert list(m.coefficients.values()) == pytest.approx(beta.tolist(), rel=1e-6) and m.r2 == pytest.approx(r2, abs=1e-9) and m.n == N
        assert m.adjusted_r2 == pytest.approx(1 - (1 - r2) * (N - 1) / (N - len(at) - 1), abs=1e-9)
    own = blocks.grams(rows, "y", NAMES, "fold")
    assert set(own) == {"0", "1", "2", "3"}
    for fold, m in blocks.leave_out(own, NAMES).items():
        keep = np.arange(N) % 4 != int(fold)
        assert list(m.coefficients.values()) == pytest.approx(_dense(X[keep], Y[keep])[0].tolist(), rel=1e-6) and m.n == keep.sum()
    assert np.allclose((own["0"] + own["1"] + own["2"] + own["3"]).sums, block.sums)
    steps = blocks.increments(blocks.nested(block, {"one": ["a"], "all": NAMES}), {"one": (9.0, 12.0), "all": (7.0, 11.0)})
    assert steps[0][:2] == ("one", "all") and steps[0][2] > 0 and steps[0][4:] == (2.0, 1.0)


def test_robust_covariance_contrasts_and_wald(rows):
    fit = blocks.robust(rows, "y", NAMES)
    beta, _, cov, smear = _dense(X, Y)
    assert np.allclose(fit.covariance, cov, rtol=1e-4, atol=1e-12) and fit.smearing == pytest.approx(smear) and fit.terms == ["const", *NAMES]
    effect, error = fit.contrast({"a": 1.0, "d": -2.0})
    w = np.array([0, 1, 0, -2])
    assert effect == pytest.approx(w @ beta) and error == pytest.approx(math.sqrt(w @ cov @ w), rel=1e-4)
    statistic, p = fit.wald(["a", "d"])
    assert statistic == pytest.approx(beta[[1, 3]] @ np.linalg.inv(cov[np.ix_([1, 3], [1, 3])]) @ beta[[1, 3]], rel=1e-4) and p < 1e-10
    z, q = fit.wald(["year"])
    assert q == pytest.approx(math.erfc(math.sqrt(z / 2)))


def test_chi_square_tail():
    # fixed points of the distribution's table
    for freedom, x, p in ((1, 3.841459, 0.05), (2, 5.991465, 0.05), (3, 7.814728, 0.05), (4, 9.487729, 0.05), (7, 14.067140, 0.05), (10, 18.307038, 0.05), (5, 1.145476, 0.95)):
        assert blocks.chi_square_tail(x, freedom) == pytest.approx(p, abs=1e-6)
    assert blocks.chi_square_tail(0.0, 3) == 1.0


def test_a_column_that_others_explain(rows):
    fit = blocks.gram(rows.withColumns({"twice": F.col("a") * 2, "same": F.lit(7.0)}), "y", ["a", "twice", "same"]).fit(["a", "twice", "same"])
    beta = _dense(X[:, [0]], Y)[0]
    assert fit.coefficients["a"] + 2 * fit.coefficients["twice"] == pytest.approx(beta[1]) and fit.coefficients["same"] == 0
    with pytest.raises(ValueError, match="no rows"):
        blocks.gram(rows.limit(0), "y", ["a"])


def test_bases(spark, rows):
    known = rows.where("y is not null and not isnan(a) and a is not null")
    bands = blocks.basis(known, "d", "bands", "cta")
    assert [list(v.values()) for v in bands.at(known, [0.25, 0.3, 2.0, 2.1])] == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 1], [0, 0, 0, 0]]
    cubic = blocks.basis(known, "d", "cubic_spline", "cta")
    d = X[:, 2]
    assert (cubic.mean, cubic.scale) == pytest.approx((d.mean(), d.std())) and cubic.knots == pytest.approx(np.quantile((d - d.mean()) / d.std(), [0.25, 0.5, 0.75]).tolist())
    z = (3.5 - d.mean()) / d.std()
    assert list(cubic.at(known, [3.5])[0].values()) == pytest.approx([z, z**2, z**3, *(max(z - k, 0) ** 3 for k in cubic.knots)])
    gam = blocks.basis(known, "d", "gam_style", "cta")
    assert len(gam.knots) == 7 and len(gam.terms("d")) == 8
    values = np.array([list(v.values()) for v in gam.at(known, [*np.linspace(d.min(), d.max(), 40), d.max() + 1, d.max() + 2, d.max() + 3])])
    assert (values[:40] >= -1e-12).all() and (values[:39].sum(axis=1) <= 1 + 1e-9).all() and values[10].sum() == pytest.approx(1)
    assert np.allclose(values[41] - values[40], values[42] - values[41])  # straight beyond the last knot
    with pytest.raises(ValueError):
        blocks.basis(known, "d", "other", "cta")


@pytest.mark.parametrize("kind", ["linear", "cubic_spline", "gam_style"])
def test_premium_curve_finds_a_planted_premium(spark, kind):
    made = spark.range(3000).selectExpr("id", "(id * 37 % 500) / 100D as d", "(id * 101 % 97) / 97D - 0.5 as e")
    sales = made.select("d", (12 + 0.4 * F.exp(-F.col("d")) + F.col("e") * 0.1).alias("y"))
    form = blocks.basis(sales, "d", kind, "cta")
    fit = blocks.robust(sales.withColumns(form.terms("d")), "y", list(form.terms("d")))
    curve = blocks.premium_curve(fit, form, sales, [k / 20 for k in range(101)], 3.0)
    planted = {d: math.exp(0.4 * (math.exp(-d) - math.exp(-3))) - 1 for d, *_ in curve}
    if kind != "linear":
        assert max(abs(v - planted[d]) for d, v, *_ in curve if d > 0.05) < 0.02
        assert blocks.half_decay(curve) == pytest.approx(0.75, abs=0.15)
    assert all(low <= v <= high for _, v, low, high in curve) and abs(dict((r[0], r[1]) for r in curve)[3.0]) < 1e-12
    evidence = blocks.premium_evidence(curve)
    assert evidence["premium_within_a_mile"] and not evidence["lower_next_to_it"] and evidence["falls_off"] and fit.wald(list(form.terms("d")))[1] < 1e-6
    assert blocks.half_decay([(d, -v, lo, hi) for d, v, lo, hi in curve]) is None


def test_out_of_time(spark, rows):
    df = rows.where("y is not null and not isnan(a) and a is not null").withColumn("split", F.when(F.col("year") < 2014, "train").when(F.col("year") < 2017, "validation").otherwise("test"))
    chosen, board = blocks.out_of_time(df, "y", "price", "split", {"poor": ["year"], "good": NAMES})
    got = {(r.stage, r.model): r for r in board.collect()}
    assert chosen == "good" and len(got) == 4 and got["test", "good"].selected and not got["test", "poor"].selected
    fitted, scored = X[:, 1] < 2017, X[:, 1] >= 2017
    beta, _, _, smear = _dense(X[fitted], Y[fitted])
    guess = np.exp(np.column_stack([np.ones(scored.sum()), X[scored]]) @ beta) * smear
    assert got["test", "good"].mae == pytest.approx(np.abs(guess - np.exp(Y[scored])).mean(), rel=1e-6) and got["test", "good"].n == scored.sum()
    with pytest.raises(ValueError):
        blocks.out_of_time(df.where("split <> 'train'"), "y", "price", "split", {"good": NAMES})
