"""What goes into a regression and what comes out of it: controls, usable columns, effects, ladders of specifications."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotline.operators import blocks
from plotline.operators.cleaning import first_present, number
from plotline.operators.order_stats import many_quantiles

#: Columns that may hold the distance to a station, the first there is counts (fixed values).
DISTANCE_COLUMNS = ("cta_distance_miles", "cta_distance")


def available(df: DataFrame, names: Sequence[str], least: int = 2) -> list[str]:
    """Those of ``names`` that are columns with ``least`` readable numbers or more, from one aggregate."""
    there = [n for n in names if n in df.columns]
    if not there:
        return []
    counts = df.agg(*(F.count(number(n)).alias(n) for n in there)).first()
    return [n for n in there if counts[n] >= least]


def distance_column(df: DataFrame) -> str:
    return first_present(df, DISTANCE_COLUMNS)


def nuisance_controls(train: DataFrame, columns: Sequence[str]) -> tuple[dict, dict[str, float]]:
    """Control columns, as expressions by name that hold for any table, and the training medians that fill their gaps.

    Distances are held above zero and logged (log1p); columns with fewer than two numbers control nothing.
    """
    used = available(train, columns)
    if not used:
        return {}, {}
    row = many_quantiles(train, [], {c: number(c) for c in used}, {"median": 0.5}).first()
    medians = {c: row[f"{c}_median"] for c in used}
    out = {}
    for c, m in medians.items():
        logged = "distance" in c
        low = F.when(number(c).isNotNull(), F.greatest(number(c), F.lit(0.0))) if logged else number(c)
        filled = F.coalesce(low, F.lit(m))
        out[f"control_{'log1p_' if logged else ''}{c}"] = F.log1p(filled) if logged else filled
    return out, medians


def independent(block: blocks.Gram, features: Sequence[str], tolerance: float = 1e-9) -> list[str]:
    """The features that those before them, and the constant, don't explain: a column stays if some of its spread is its own."""
    means = block.sums[0] / block.n
    about = block.sums - block.n * np.outer(means, means)
    at = {f: block.names.index(f) for f in features}
    kept: list[str] = []
    for f in features:
        whole = about[at[f], at[f]]
        if whole <= tolerance * max(1.0, block.sums[at[f], at[f]]):
            continue
        own = whole
        if kept:
            k = [at[x] for x in kept]
            cross = about[k, at[f]]
            own -= float(cross @ np.linalg.lstsq(about[np.ix_(k, k)], cross, rcond=None)[0])
        if own > tolerance * whole:
            kept.append(f)
    return kept


def effects(model: blocks.Model, elastic: Sequence[str] = ("log_building_sqft",)) -> list[tuple[str, float, float, str]]:
    """``term, coefficient, effect, meaning`` of a model of log price: elasticities as they are, others as proportional changes."""
    out = []
    for term, b in model.coefficients.items():
        if term != blocks.CONSTANT:
            out.append((term, b, b, "elasticity") if term in elastic else (term, b, math.expm1(b), "proportional change"))
    return out


def ladder(df: DataFrame, target: str, specs: dict[str, Sequence[str]], term: str, subset: str | None = None, least: int = 30) -> DataFrame:
    """``subset, specification, n, coefficient, error, r2`` of one term over specifications and subsets (``all`` first).

    One pass of sums by subset serves every specification of all of them; the errors are those of least squares.
    Subsets with fewer than ``least`` rows, and specifications without the term, are left out.
    """
    features = sorted({f for s in specs.values() for f in s})
    own = blocks.grams(df, target, features, subset) if subset else {}
    whole = blocks.gram(df, target, features) if not subset else sum(own.values(), blocks.Gram(next(iter(own.values())).names, 0.0))
    rows = []
    for name, block in [("all", whole), *sorted((str(k), v) for k, v in own.items() if k is not None)]:
        if block.n < least:
            continue
        for spec, columns in specs.items():
            used = independent(block, columns)
            if term not in used:
                continue
            model = block.fit(used)
            at = [0, *(block.names.index(f) for f in used)]
            inverse = np.linalg.pinv(block.sums[np.ix_(at, at)], rcond=1e-13, hermitian=True)
            k = 1 + used.index(term)
            rows.append((name, spec, block.n, model.coefficients[term], math.sqrt(max(0.0, model.sigma2 * inverse[k, k])), model.r2))
    return df.sparkSession.createDataFrame(rows, "subset string, specification string, n long, coefficient double, error double, r2 double")


def matching_terms(model: blocks.Model, *parts: str) -> list[str]:
    """Terms whose names hold one of ``parts``, whatever their case."""
    return [t for t in model.coefficients if any(p.lower() in t.lower() for p in parts)]


def roll_up(contributions: DataFrame, key: str, component: str, value: str) -> DataFrame:
    """``key, component, contribution, rank``: contributions summed by component, the strongest (by size) first, ties by name."""
    sums = contributions.groupBy(key, component).agg(F.sum(value).alias("contribution"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs("contribution")), component)).cast("long"))


def cluster_profiles(profiles: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``*by, n`` and the median of each feature within each cluster."""
    counts = profiles.groupBy(*by).agg(F.count("*").alias("n"))
    middle = many_quantiles(profiles, list(by), {f: F.col(f) for f in features}, {"median": 0.5})
    same = F.expr(" and ".join(f"c.{b} <=> m.{b}" for b in by))
    return counts.alias("c").join(middle.alias("m"), same, "left").select(*(F.col(f"c.{b}").alias(b) for b in by), "n", *(F.col(f"{f}_median").alias(f) for f in features))
