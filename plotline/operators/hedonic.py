"""Hedonic regression from sums: design columns, fitted coefficients, residuals and what is built on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.operators.order_stats import many_quantiles, quantiles
from plotline.operators.validation import gram


def impute_median(df: DataFrame, *columns: str) -> DataFrame:
    """``column`` filled with its exact median, and ``column_missing``; all medians from the same passes."""
    fit = many_quantiles(df, [], {c: F.col(c) for c in columns}, {"median": 0.5})
    filled = df.join(F.broadcast(fit.select(*(F.col(f"{c}_median").alias(f"_m_{c}") for c in columns))))
    for c in columns:
        filled = filled.withColumn(f"{c}_missing", F.col(c).isNull()).withColumn(c, F.coalesce(c, f"_m_{c}"))
    return filled.drop(*(f"_m_{c}" for c in columns))


def top_levels(df: DataFrame, column: str, min_count: int, most: int) -> list[str]:
    """Levels with enough rows, the most frequent first, ties by name; at most ``most`` of them."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level")).agg(F.count("*").alias("n"))
    return [r.level for r in counts.where(F.col("n") >= min_count).orderBy(F.desc("n"), "level").limit(most).collect()]


def one_hot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """A 0/1 column for each level but the first, and one for all others together."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("__OTHER__"))
    known = value.isin(*levels)
    cols = {f"{column}={x}": (value == x).cast("double") for x in levels[1:]}
    return df.withColumns(cols | {f"{column}=__OTHER__": (~known).cast("double")})


@dataclass(frozen=True)
class Fit:
    """Coefficients by name, their standard errors, and the residual variance."""

    coefficients: dict[str, float]
    errors: dict[str, float]
    sigma2: float
    n: int

    def predict(self) -> Column:
        out = F.lit(self.coefficients["const"])
        for name, b in self.coefficients.items():
            if name != "const":
                out = out + F.col(f"`{name}`") * b
        return out


def ols(df: DataFrame, target: str, *features: str) -> Fit:
    """Least squares by one pass of sums; the driver sees a matrix of the features' number squared."""
    import numpy as np

    rows = {(r.i, r.j): r.value for r in gram(df, target, *features).collect()}
    names = ["const", *features]
    xx = np.array([[rows.get((a, b), rows.get((b, a))) for b in names] for a in names])
    xy = np.array([rows[(a, "y")] for a in names])
    beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
    n = int(rows[("const", "const")])
    yy = df.dropna(subset=[target, *features]).agg(F.sum(F.col(target) * F.col(target))).first()[0]
    sigma2 = max(0.0, yy - beta @ xy) / max(1, n - len(names))
    errors = np.sqrt(np.maximum(0, np.diag(np.linalg.pinv(xx)) * sigma2))
    return Fit(dict(zip(names, beta.tolist(), strict=True)), dict(zip(names, errors.tolist(), strict=True)), sigma2, n)


def robust(df: DataFrame, target: str, *features: str) -> tuple[Fit, float]:
    """Least squares with HC3 errors, and the smearing factor, the mean exponent of the residuals.

    Two passes: the cross products, and, with their inverse as literals, the leverages and the squared residuals.
    """
    import numpy as np

    fit = ols(df, target, *features)
    rows = {(r.i, r.j): r.value for r in gram(df, target, *features).collect()}
    names = ["const", *features]
    inverse = np.linalg.pinv(np.array([[rows.get((a, b), rows.get((b, a))) for b in names] for a in names]))
    x = [F.lit(1.0), *(F.col(f"`{f}`").cast("double") for f in features)]
    leverage = sum(x[i] * x[j] * float(inverse[i, j]) for i in range(len(x)) for j in range(len(x)))
    residual = F.col(f"`{target}`") - fit.predict()
    known = df.dropna(subset=[target, *features]).withColumns({"_w": residual * residual / ((1 - leverage) * (1 - leverage)), "_e": F.exp(residual)})
    cells = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = known.agg(F.avg("_e").alias("smearing"), *(F.sum(F.col("_w") * x[i] * x[j]).alias(f"m{i}_{j}") for i, j in cells)).first()
    meat = np.zeros((len(x), len(x)))
    for i, j in cells:
        meat[i, j] = meat[j, i] = sums[f"m{i}_{j}"]
    errors = np.sqrt(np.maximum(0, np.diag(inverse @ meat @ inverse)))
    return Fit(fit.coefficients, dict(zip(names, errors.tolist(), strict=True)), fit.sigma2, fit.n), sums.smearing


def predict_price(fit: Fit, smearing: float) -> Column:
    """Price from a model of its logarithm, which is held between 0 and 50."""
    return F.exp(F.greatest(F.lit(0.0), F.least(F.lit(50.0), fit.predict()))) * smearing


def coefficient_table(fit: Fit) -> list[tuple[str, float, float, float, float, float, float]]:
    """``term, coefficient, error, t, p, low, high`` of each term, by the normal distribution."""
    from statistics import NormalDist

    z, out = NormalDist().inv_cdf(0.975), []
    for term, b in fit.coefficients.items():
        e = fit.errors[term]
        t = b / e if e else float("inf")
        out.append((term, b, e, t, 2 * (1 - NormalDist().cdf(abs(t))), b - z * e, b + z * e))
    return out


def stability(a: Fit, b: Fit) -> list[tuple[str, float, float, bool, float | None]]:
    """Terms that both fits have: both coefficients, whether their signs agree, and the relative change."""
    shared = [t for t in a.coefficients if t in b.coefficients]
    return [(t, x := a.coefficients[t], y := b.coefficients[t], (x > 0) == (y > 0), abs(y - x) / abs(x) if x else None) for t in shared]


def adjusted_index(df: DataFrame, geo: str, year: str, residual: Column) -> DataFrame:
    """``geo, year, n, adjusted_level``: exponent of the median residual."""
    found = quantiles(df, [geo, year], residual, {"middle": 0.5}).drop("n")
    counts = df.groupBy(geo, year).agg(F.count("*").alias("n")).alias("c")
    same = F.expr(f"c.{geo} <=> q.{geo} and c.{year} <=> q.{year}")
    return counts.join(found.alias("q"), same, "left").select(F.col(f"c.{geo}").alias("geo"), F.col(f"c.{year}").alias("year"), "n", F.exp("middle").alias("adjusted_level"))
