"""Splits, metrics, intervals and audits of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotline.operators.indices import median
from plotline.operators.order_stats import first_reaching, quantiles


def metrics(df: DataFrame, actual: str, predicted: str, *by: str) -> DataFrame:
    """n, MAE, median AE, median APE, MAPE, RMSE and R2 over pairs that are both finite."""
    y, p = F.col(actual), F.col(predicted)
    finite = ~F.isnan(y) & ~F.isnan(p) & (F.abs(y) < float("inf")) & (F.abs(p) < float("inf"))
    error = F.abs(y - p)
    ape = F.when(y != 0, error / F.abs(y))
    rows = df.where(y.isNotNull() & p.isNotNull() & finite)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(error).alias("mae"),
        median(error).alias("median_ae"),
        median(ape).alias("median_ape"),
        F.avg(ape).alias("mape"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        (1 - F.sum((y - p) * (y - p)) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))).alias("r2"),
    )


def unpivot_predictions(df: DataFrame, *keep: str, prefix: str = "prediction_") -> DataFrame:
    """One row for each model: every column with the prefix is a model's output."""
    models = sorted(c for c in df.columns if c.startswith(prefix))
    return df.unpivot(list(keep), models, "model", "prediction")


def conformal_rank(n: Column, coverage: float) -> Column:
    """The rank (from 1) of the conformal quantile among n scores, rounded up."""
    p = F.least(F.lit(1.0), F.ceil((n + 1) * coverage) / n)
    return F.ceil(p * (n - 1)) + 1


def conformal_radius(scores: DataFrame, group: str, score: str, *levels: float) -> DataFrame:
    """``group, level, radius``: an order statistic of the calibration scores, not an interpolation."""
    named = {f"level_{k}": c for k, c in enumerate(levels)}
    found = first_reaching(scores, [group], score, lambda n: [(name, conformal_rank(n, c).cast("long")) for name, c in named.items()])
    level = F.element_at(F.array(*map(F.lit, levels)), F.regexp_extract("name", "[0-9]+", 0).cast("int") + 1)
    return found.select(group, level.alias("level"), F.col("statistic").alias("radius"))


def coverage(df: DataFrame, actual: str, low: str, high: str, *dimensions: str) -> DataFrame:
    """Share of actual values inside their intervals, overall and by each dimension."""
    sides = F.array(F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("segment")), *(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("segment")) for d in dimensions))
    inside = F.col(actual).between(F.col(low), F.col(high))
    return df.select(inside.cast("double").alias("_in"), (F.col(high) - F.col(low)).alias("_width"), F.inline(sides)).where("segment is not null").groupBy("dimension", "segment").agg(F.count("*").alias("n"), F.avg("_in").alias("coverage"), median("_width").alias("median_width"))


def weighted_quantile(df: DataFrame, group: str, value: str, weight: str, q: float) -> DataFrame:
    """The first value at which the running share of weight reaches ``q``; rows without weight or value count for nothing."""
    rows = df.where((F.col(weight) > 0) & F.col(value).isNotNull())
    found = first_reaching(rows, [group], value, lambda total: [("q", (q - 1e-12) * total)], F.col(weight).cast("double"))
    return found.select(group, F.col("statistic").alias("weighted_quantile"))


def temporal_split(df: DataFrame, year: str, test_years: int) -> DataFrame:
    """``split``: the last years are the test set."""
    last = df.agg(F.max(year).alias("_last"))
    return df.join(F.broadcast(last)).withColumn("split", F.when(F.col(year) > F.col("_last") - test_years, "test").otherwise("train")).drop("_last")


def chronological_split(df: DataFrame, year: str, validation_start: int | None = None, test_start: int | None = None) -> DataFrame:
    """``split``: three spans of time, the second and third from the given years on, by default the last two years there are.

    Every row is kept; one without a year is in no split (null). Years are ranked from the latest, and the split is
    read off a table of a row for each year, whose three labels must all be there.
    """
    y = F.col(year).cast("int")
    latest = Window.orderBy(F.desc("_year"))  # of a row for each year
    ranked = df.select(y.alias("_year")).where("_year is not null").distinct().withColumn("_rank", F.row_number().over(latest))

    def begins(given: int | None, rank: int) -> Column:
        return F.col("_rank") <= rank if given is None else F.col("_year") >= given

    label = F.when(begins(test_start, 1), "test").when(begins(validation_start, 2), "validation").otherwise("train")
    spans = ranked.select("_year", label.alias("split"))
    there = {r.split: r["count"] for r in spans.groupBy("split").count().collect()}
    if empty := [s for s in ("train", "validation", "test") if s not in there]:
        raise ValueError(f"no years in: {', '.join(empty)}")
    return df.join(F.broadcast(spans), y == F.col("_year"), "left").drop("_year")


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """``fold``, balanced: the largest group first, each to the fold with the fewest rows; a group is never split.

    A null group is a group of its own. Groups are tracts or neighbourhoods: their sizes come to the driver.
    """
    key = F.coalesce(F.col(group).cast("string"), F.lit("<missing>"))
    sizes = sorted(((r["count"], r.g) for r in df.groupBy(key.alias("g")).count().collect()), key=lambda x: (-x[0], x[1]))
    load, rows = [0] * min(folds, max(1, len(sizes))), []
    for n, g in sizes:
        k = load.index(min(load))
        load[k] += n
        rows.append((g, k))
    of_group = df.sparkSession.createDataFrame(rows, "_g string, fold int")
    return df.withColumn("_g", key).join(F.broadcast(of_group), "_g", "left").drop("_g")


def worst_groups(metrics: DataFrame, model: str, measure: str, size: str, least: int, keep: int = 10) -> DataFrame:
    """Of each model, the ``keep`` groups of ``least`` rows or more with the greatest measure (to nine places), and their rank."""
    along = Window.partitionBy(model).orderBy(F.desc(F.round(measure, 9)), *(c for c in metrics.columns if c not in (model, measure, size)))
    return metrics.where(F.col(size) >= least).withColumn("rank", F.row_number().over(along).cast("long")).where(F.col("rank") <= keep)


def quantile_groups(df: DataFrame, value: str, groups: int) -> DataFrame:
    """Right-closed groups at linearly interpolated quantiles; equal edges fall together."""
    names = {f"_q{k}": k / groups for k in range(1, groups)}
    edges = quantiles(df, [], value, names).select(F.array_distinct(F.array(*names)).alias("_edges"))
    return df.join(F.broadcast(edges), how="left").withColumn("quantile_group", F.size(F.filter("_edges", lambda e: e < F.col(value))) + 1).drop("_edges")


def log_fence(df: DataFrame, value: str | Column, factor: float) -> DataFrame:
    """One row, ``low_fence, high_fence``: the quartiles of the positive values' logarithms, ``factor`` spreads outward.

    Null fences where no value is positive.
    """
    v = F.col(value) if isinstance(value, str) else value
    box = quantiles(df, [], F.when(v > 0, F.ln(v)), {"q1": 0.25, "q3": 0.75})
    spread = factor * (F.col("q3") - F.col("q1"))
    return box.agg(F.max(F.col("q1") - spread).alias("low_fence"), F.max(F.col("q3") + spread).alias("high_fence"))


def iqr_outliers(df: DataFrame, value: str, factor: float = 1.5, low: float = 200, high: float = 20_000) -> DataFrame:
    """``is_outlier``: outside the fence on the logarithm, or outside hard bounds."""
    log = F.when(F.col(value) > 0, F.ln(value))
    bad = (log < F.col("low_fence")) | (log > F.col("high_fence")) | (F.col(value) < low) | (F.col(value) > high)
    return df.join(F.broadcast(log_fence(df, value, factor))).withColumn("is_outlier", F.coalesce(bad, F.lit(False))).drop("low_fence", "high_fence")


def missingness(df: DataFrame, *columns: str) -> DataFrame:
    """``column, n_missing, missing_rate``, all columns in one pass."""
    counts = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.unpivot(["_n"], list(columns), "column", "n_missing").select("column", "n_missing", (F.col("n_missing") / F.col("_n")).alias("missing_rate"))


def numeric_profile(df: DataFrame, *columns: str) -> DataFrame:
    """Count, mean, deviation and quantiles of each column, from the unpivoted values; null figures for a column without any."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], list(columns), "column", "value")
    at = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    moments = long.groupBy("column").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))
    return moments.join(quantiles(long, ["column"], "value", at).drop("n"), "column", "left")


def gram(df: DataFrame, target: str, *features: str) -> DataFrame:
    """``i, j, value``: X'X and X'y (j = "y") of a regression with a constant, as sums; one pass, few rows."""
    rows = df.dropna(subset=[target, *features])
    cols = {"const": F.lit(1.0), **{f: F.col(f).cast("double") for f in features}}
    names = list(cols)
    cells = [(i, j, F.sum(cols[i] * cols[j])) for a, i in enumerate(names) for j in names[a:]] + [(i, "y", F.sum(cols[i] * F.col(target))) for i in names]
    one = rows.agg(*(c.alias(f"c{k}") for k, (_, _, c) in enumerate(cells)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{k}").alias("value")) for k, (i, j, _) in enumerate(cells)))))


def correlation_pairs(df: DataFrame, *columns: str) -> DataFrame:
    """``a, b, correlation`` of each two columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("correlation")) for k, (a, b) in enumerate(pairs)))))
