"""Regressions from blocks of cross products: one pass over the rows, then any sub-model, fold or merged period.

:func:`grams` sums the products of all columns, target and constant included, by group in the tasks; the driver holds
a matrix of the columns' number squared for each group. A model on some of the columns is a sub-block of it; a model
that leaves a fold out is the whole less that fold; a refit on more data is a sum of blocks. Robust covariances (HC3)
take one more pass, and with the whole matrix come contrasts with their errors and joint tests.

Cases: rows with a null or NaN in any of the columns take no part; a column that the others explain gets a coefficient
of least norm; groups without rows are not there; no rows at all is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.operators.order_stats import quantiles
from plotline.operators.validation import metrics

CONSTANT = "const"


@dataclass(frozen=True)
class Model:
    """Coefficients by name, constant first, how much they explain, and the residual variance."""

    coefficients: dict[str, float]
    n: int
    r2: float
    adjusted_r2: float
    sigma2: float

    def predict(self) -> Column:
        return sum((F.col(f"`{f}`").cast("double") * b for f, b in self.coefficients.items() if f != CONSTANT), F.lit(self.coefficients[CONSTANT]))


@dataclass(frozen=True)
class Gram:
    """Cross products of ``names``: the constant first, the target last."""

    names: tuple[str, ...]
    sums: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.names, self.sums + other.sums)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.names, self.sums - other.sums)

    @property
    def n(self) -> int:
        return round(self.sums[0, 0])

    def fit(self, features: Sequence[str]) -> Model:
        """Least squares of the target on ``features`` and a constant, from the block about the means."""
        n = self.n
        if not n:
            raise ValueError("no rows to fit on")
        at = [self.names.index(f) for f in features]
        means = self.sums[0] / n
        about = self.sums - n * np.outer(means, means)
        scale = np.sqrt(np.maximum(np.diag(about), 0))
        # what rounding leaves of a column without spread is no spread
        scale[scale < 1e-9 * np.sqrt(np.diag(self.sums))] = 0
        unit = np.divide(1, scale, out=np.zeros_like(scale), where=scale > 0)
        xx, xy = about[np.ix_(at, at)] * np.outer(unit[at], unit[at]), about[at, -1] * unit[at]
        beta = (np.linalg.lstsq(xx, xy, rcond=1e-12)[0] if at else np.zeros(0)) * unit[at]
        left = max(0.0, about[-1, -1] - beta @ about[at, -1])
        r2 = float(1 - left / about[-1, -1]) if about[-1, -1] > 0 else float("nan")
        free = max(1, n - len(at) - 1)
        return Model({CONSTANT: float(means[-1] - beta @ means[at]), **dict(zip(features, beta.tolist(), strict=True))}, n, r2, 1 - (1 - r2) * (n - 1) / free, float(left / free))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict = {}
    for batch in batches:
        group = np.array(batch.column(0).to_pylist(), object)
        x = np.column_stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])])
        for g in set(group.tolist()):
            own = x[[i for i, v in enumerate(group) if v == g]] if len(set(group.tolist())) > 1 else x
            totals[g] = totals.get(g, 0) + own.T @ own
    if totals:
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([t.ravel().tolist() for t in totals.values()], pa.list_(pa.float64()))], ["block", "sums"])


def grams(df: DataFrame, target: str, features: Sequence[str], by: str | Column | None = None) -> dict[str | None, Gram]:
    """The cross products of each group of ``by`` (as strings; one block named None without it). Groups are few: folds, periods."""
    block = F.lit(None) if by is None else by if isinstance(by, Column) else F.col(by)
    known = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in (*features, target)]
    rows = df.select(block.cast("string").alias("_block"), *(c.alias(f"_{k}") for k, c in enumerate(known))).dropna(subset=[f"_{k}" for k in range(len(known))])
    parts = rows.mapInArrow(_summed, "block string, sums array<double>")
    cells = parts.select("block", F.posexplode("sums").alias("at", "value")).groupBy("block", "at").agg(F.sum("value").alias("value"))
    names, found = (CONSTANT, *features, target), {}
    for r in cells.collect():  # groups times columns squared
        found.setdefault(r.block, np.zeros(len(names) ** 2))[r.at] = r.value
    return {g: Gram(names, s.reshape(len(names), -1)) for g, s in found.items()}


def gram(df: DataFrame, target: str, features: Sequence[str]) -> Gram:
    found = grams(df, target, features)
    if not found:
        raise ValueError("no rows to fit on")
    return found[None]


def nested(block: Gram, specs: dict[str, Sequence[str]]) -> dict[str, Model]:
    """A model for each of the specifications, all from one block."""
    return {name: block.fit(features) for name, features in specs.items()}


def increments(models: dict[str, Model], scores: dict[str, tuple[float, float]]) -> list[tuple]:
    """``before, after, delta_r2, delta_adjusted_r2, mae_improvement, rmse_improvement`` of consecutive models; ``scores`` are MAE and RMSE."""
    names = list(models)
    return [
        (a, b, models[b].r2 - models[a].r2, models[b].adjusted_r2 - models[a].adjusted_r2, scores[a][0] - scores[b][0], scores[a][1] - scores[b][1])
        for a, b in zip(names, names[1:], strict=False)
    ]


def leave_out(blocks: dict[str, Gram], features: Sequence[str]) -> dict[str, Model]:
    """For each fold the model of all other folds: the whole block less the fold's own."""
    whole = sum(blocks.values(), Gram(next(iter(blocks.values())).names, np.zeros_like(next(iter(blocks.values())).sums))) if blocks else None
    return {fold: (whole - own).fit(features) for fold, own in blocks.items() if whole.n > own.n}


def scored(df: DataFrame, price: str, models: dict[str, Model], smearing: dict[str, float]) -> DataFrame:
    """``model`` and the metrics of exponentiated predictions of all models, in one pass."""
    each = [F.struct(F.lit(name).alias("model"), predicted(m, smearing[name]).alias("prediction")) for name, m in models.items()]
    return metrics(df.select(F.col(price).cast("double").alias("actual"), F.inline(F.array(*each))), "actual", "prediction", "model")


def predicted(model: Model, smearing: float) -> Column:
    """Price from a model of its logarithm, which is held below 50."""
    return F.exp(F.least(F.lit(50.0), model.predict())) * smearing


def smearings(df: DataFrame, target: str, models: dict[str, Model]) -> dict[str, float]:
    """The mean exponent of each model's residuals, all in one pass."""
    row = df.agg(*(F.avg(F.exp(F.col(target) - m.predict())).alias(name) for name, m in models.items())).first()
    return {name: row[name] for name in models}


@dataclass(frozen=True)
class Robust:
    """A model with the HC3 covariance of its coefficients, in their order, and its smearing factor."""

    model: Model
    covariance: np.ndarray
    smearing: float

    @property
    def terms(self) -> list[str]:
        return list(self.model.coefficients)

    def contrast(self, weights: dict[str, float]) -> tuple[float, float]:
        """A weighted sum of coefficients and its standard error."""
        w = np.array([weights.get(t, 0.0) for t in self.terms])
        return float(w @ np.array(list(self.model.coefficients.values()))), math.sqrt(max(0.0, w @ self.covariance @ w))

    def wald(self, terms: Sequence[str]) -> tuple[float, float]:
        """The statistic of all of ``terms`` being zero, and its p-value by the chi-square distribution."""
        at = [self.terms.index(t) for t in terms]
        b = np.array([self.model.coefficients[t] for t in terms])
        statistic = float(b @ np.linalg.pinv(self.covariance[np.ix_(at, at)]) @ b)
        return statistic, chi_square_tail(statistic, len(terms))


def chi_square_tail(x: float, freedom: int) -> float:
    """The probability beyond ``x``, by the recurrence from one or two degrees of freedom."""
    half = x / 2
    a, tail = (0.5, math.erfc(math.sqrt(half))) if freedom % 2 else (1.0, math.exp(-half))
    while a < freedom / 2 - 0.25:
        tail += math.exp(a * math.log(half) - half - math.lgamma(a + 1)) if half > 0 else 0.0
        a += 1
    return min(1.0, tail)


def robust(df: DataFrame, target: str, features: Sequence[str], block: Gram | None = None) -> Robust:
    """Least squares with HC3 covariance in two passes, or one if the block is there already."""
    block = block or gram(df, target, features)
    model = block.fit(features)
    at = [0, *(block.names.index(f) for f in features)]
    inverse = np.linalg.pinv(block.sums[np.ix_(at, at)], rcond=1e-13, hermitian=True)
    beta = np.array(list(model.coefficients.values()))

    def meat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, spread = 0, 0.0
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1])])
            residual = batch.columns[-1].to_numpy(zero_copy_only=False) - x @ beta
            leverage = np.einsum("ij,jk,ik->i", x, inverse, x)
            weight = (residual / np.maximum(1e-12, 1 - leverage)) ** 2
            total = total + (x * weight[:, None]).T @ x
            spread += float(np.exp(residual).sum())
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([[*total.ravel().tolist(), spread]], pa.list_(pa.float64()))], ["sums"])

    known = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(f"_{k}") for k, c in enumerate((*features, target))]
    parts = df.select(*known).dropna().mapInArrow(meat, "sums array<double>")
    cells = parts.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros(len(at) ** 2 + 1)
    for r in cells:
        sums[r.at] = r.value
    return Robust(model, inverse @ sums[:-1].reshape(len(at), -1) @ inverse, sums[-1] / model.n)


#: Edges of the distance bands in miles, the last band being the one left out, and their names (fixed values).
BAND_EDGES, BAND_NAMES = (0.25, 0.5, 1.0, 2.0), ("0-0.25", "0.25-0.50", "0.50-1.00", "1.00-2.00")
GAM_KNOTS = 7


@dataclass(frozen=True)
class Basis:
    """Functions of a distance, fitted on training rows: ``terms`` gives a column for each, ``at`` their values at a point."""

    kind: str
    prefix: str
    mean: float = 0.0
    scale: float = 1.0
    knots: tuple[float, ...] = ()

    def terms(self, distance: str) -> dict[str, Column]:
        d = F.col(distance).cast("double")
        if self.kind == "linear":
            return {f"{self.prefix}_distance_linear": d}
        if self.kind == "bands":
            low = (-math.inf, *BAND_EDGES)
            return {f"{self.prefix}_band={n}": ((d > a) & (d <= b)).cast("double") for n, a, b in zip(BAND_NAMES, low, BAND_EDGES, strict=False)}
        if self.kind == "cubic_spline":
            z = (d - self.mean) / self.scale
            out = {f"{self.prefix}_spline=x": z, f"{self.prefix}_spline=x2": z * z, f"{self.prefix}_spline=x3": z * z * z}
            for k, knot in enumerate(self.knots):
                over = F.greatest(z - knot, F.lit(0.0))
                out[f"{self.prefix}_spline=hinge_{k}"] = over * over * over
            return out
        # cubic B-splines on the knots, a straight line beyond them; all but the last, which the constant implies
        t = _padded(self.knots)
        inside = F.greatest(F.lit(self.knots[0]), F.least(F.lit(self.knots[-1]), d))
        out = {}
        for i in range(len(t) - 5):
            edge = [(self.knots[0], d < self.knots[0]), (self.knots[-1], d > self.knots[-1])]
            value = _spline(t, i, 3, inside, self.knots[-1])
            for at, beyond in edge:
                value = F.when(beyond, F.lit(_spline_at(t, i, 3, at)) + (d - at) * F.lit(_slope_at(t, i, at))).otherwise(value)
            out[f"{self.prefix}_gam_basis_{i}"] = value
        return out

    def at(self, df: DataFrame, values: Sequence[float]) -> list[dict[str, float]]:
        spark = df.sparkSession
        rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "_k int, _d double").select("_k", *(c.alias(n) for n, c in self.terms("_d").items())).orderBy("_k").collect()
        return [{n: r[n] for n in r.__fields__ if n != "_k"} for r in rows]


def _padded(knots: tuple[float, ...]) -> list[float]:
    """Knots with three more on each side, as far apart as the outermost two."""
    first, last = knots[1] - knots[0], knots[-1] - knots[-2]
    return [knots[0] - k * first for k in (3, 2, 1)] + list(knots) + [knots[-1] + k * last for k in (1, 2, 3)]


def _spline(t: list[float], i: int, degree: int, x: Column, end: float) -> Column:
    """The i-th B-spline by its recurrence; the last knot belongs to the interval before it."""
    if degree == 0:
        return ((x >= t[i]) & ((x < t[i + 1]) | (F.lit(t[i + 1] == end) & (x == end)))).cast("double")
    out = F.lit(0.0)
    if t[i + degree] > t[i]:
        out = out + (x - t[i]) / (t[i + degree] - t[i]) * _spline(t, i, degree - 1, x, end)
    if t[i + degree + 1] > t[i + 1]:
        out = out + (t[i + degree + 1] - x) / (t[i + degree + 1] - t[i + 1]) * _spline(t, i + 1, degree - 1, x, end)
    return out


def _spline_at(t: list[float], i: int, degree: int, x: float) -> float:
    if degree == 0:
        return float(t[i] <= x < t[i + 1] or (x == t[-4] and t[i + 1] == x))
    a = (x - t[i]) / (t[i + degree] - t[i]) * _spline_at(t, i, degree - 1, x) if t[i + degree] > t[i] else 0.0
    b = (t[i + degree + 1] - x) / (t[i + degree + 1] - t[i + 1]) * _spline_at(t, i + 1, degree - 1, x) if t[i + degree + 1] > t[i + 1] else 0.0
    return a + b


def _slope_at(t: list[float], i: int, x: float) -> float:
    a = 3 / (t[i + 3] - t[i]) * _spline_at(t, i, 2, x) if t[i + 3] > t[i] else 0.0
    b = 3 / (t[i + 4] - t[i + 1]) * _spline_at(t, i + 1, 2, x) if t[i + 4] > t[i + 1] else 0.0
    return a - b


def basis(df: DataFrame, distance: str, kind: str, prefix: str) -> Basis:
    """A basis fitted on the distances of ``df``: moments and exact quantiles, no more."""
    if kind in ("linear", "bands"):
        return Basis(kind, prefix)
    if kind == "cubic_spline":
        q = {"a": 0.25, "b": 0.5, "c": 0.75}
        m = df.agg(F.avg(distance).alias("m"), F.stddev_pop(distance).alias("s")).first()
        r = quantiles(df, [], distance, q).first()
        scale = m.s or 1.0
        return Basis(kind, prefix, m.m, scale, tuple(sorted({(r[c] - m.m) / scale for c in q})))
    if kind == "gam_style":
        q = {f"q{k}": k / (GAM_KNOTS - 1) for k in range(GAM_KNOTS)}
        r = quantiles(df, [], distance, q).first()
        knots = tuple(sorted({r[c] for c in q}))
        if len(knots) < 2:
            raise ValueError("distances that are all the same have no spline")
        return Basis(kind, prefix, knots=knots)
    raise ValueError(f"no basis of the kind {kind!r}")


def premium_curve(fit: Robust, form: Basis, df: DataFrame, distances: Sequence[float], reference: float) -> list[tuple[float, float, float, float]]:
    """``distance, premium, low, high`` against the price at the ``reference`` distance, by the delta method at 95 %."""
    *points, origin = form.at(df, [*distances, reference])
    out = []
    for d, values in zip(distances, points, strict=True):
        effect, error = fit.contrast({t: v - origin[t] for t, v in values.items()})
        out.append((d, *(math.exp(min(50.0, effect + z * error)) - 1 for z in (0, -1.96, 1.96))))
    return out


def premium_evidence(curve: list[tuple[float, float, float, float]]) -> dict[str, float | bool]:
    """What a premium curve shows near the place, within a walk and at two miles."""
    at = lambda v: min(curve, key=lambda r: (abs(r[0] - v), r[0]))[1]
    return {
        "premium_within_a_mile": any(r[2] > 0 for r in curve if r[0] <= 1),
        "lower_next_to_it": at(0.1) < at(0.4),
        "falls_off": at(0.4) > at(2.0),
        "near": at(0.1),
        "walkable": at(0.4),
        "two_miles": at(2.0),
    }


def half_decay(curve: list[tuple[float, float, float, float]], near: float = 0.1) -> float | None:
    """The first distance from ``near`` on at which half of the premium there is gone; None if it has none, or keeps it."""
    start = min(curve, key=lambda r: (abs(r[0] - near), r[0]))[1]
    if not math.isfinite(start) or start <= 0:
        return None
    return next((r[0] for r in sorted(curve) if r[0] >= near and r[1] <= start / 2), None)


def out_of_time(df: DataFrame, target: str, price: str, split: str, candidates: dict[str, Sequence[str]]) -> tuple[str, DataFrame]:
    """The candidate with the least MAE on the validation rows, and ``stage, model`` with the metrics of every candidate.

    Candidates are fitted on the training rows, chosen on the validation rows, refitted on both (the sum of two blocks,
    no new pass) and scored once on the test rows. ``split`` is ``train``, ``validation`` or ``test``; ties go by name.
    """
    features = sorted({f for c in candidates.values() for f in c})
    blocks = grams(df.where(F.col(split).isin("train", "validation")), target, features, split)
    if set(blocks) != {"train", "validation"}:
        raise ValueError("no training or no validation rows")

    def stage(name: str, block: Gram, fitted: DataFrame, on: str) -> DataFrame:
        models = {c: block.fit(f) for c, f in sorted(candidates.items())}
        return scored(df.where(F.col(split) == on), price, models, smearings(fitted.dropna(subset=[target, *features]), target, models)).withColumn("stage", F.lit(name))

    first = stage("validation", blocks["train"], df.where(F.col(split) == "train"), "validation")
    chosen = first.orderBy("mae", "model").first().model
    last = stage("test", blocks["train"] + blocks["validation"], df.where(F.col(split).isin("train", "validation")), "test")
    return chosen, first.unionByName(last).withColumn("selected", F.col("model") == chosen)
