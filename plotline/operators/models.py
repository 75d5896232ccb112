"""Valuation models, segments and explanations on Spark's own learners and on sums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, RobustScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotline.operators.hedonic import Fit, ols
from plotline.operators.indices import median
from plotline.operators.spatial import spatial_lag

MAX_LOG_PRICE = 50.0


def preprocessing(numeric: list[str], categorical: list[str]) -> list:
    """Stages that fill numbers with medians, encode categories (unseen ones too) and assemble ``features``."""
    return [
        Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}_filled" for c in numeric]),
        *(StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in categorical),
        *([OneHotEncoder(inputCols=[f"{c}_index" for c in categorical], outputCols=[f"{c}_hot" for c in categorical], handleInvalid="keep")] if categorical else []),
        VectorAssembler(inputCols=[*(f"{c}_filled" for c in numeric), *(f"{c}_hot" for c in categorical)], outputCol="features"),
    ]


@dataclass(frozen=True)
class Valuation:
    """A fitted pipeline on log price and its smearing factor."""

    pipeline: PipelineModel
    smearing: float

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        raw = self.pipeline.transform(df)
        log = F.greatest(F.lit(0.0), F.least(F.lit(MAX_LOG_PRICE), F.col("_log_prediction")))
        return raw.withColumn(name, F.exp(log) * self.smearing).select(*df.columns, name)


def train_trees(train: DataFrame, price: str, numeric: list[str], categorical: list[str], kind: str = "forest", trees: int = 400, seed: int = 42) -> Valuation:
    """A forest or boosted trees on log price, with Duan's smearing from the training residuals."""
    common = {"labelCol": "_log_price", "featuresCol": "features", "predictionCol": "_log_prediction", "seed": seed}
    learner = RandomForestRegressor(numTrees=trees, minInstancesPerNode=3, featureSubsetStrategy="0.8", maxDepth=10, **common) if kind == "forest" else GBTRegressor(maxIter=trees, stepSize=0.06, maxDepth=5, **common)
    rows = train.where(F.col(price) > 0).withColumn("_log_price", F.ln(price))
    fitted = Pipeline(stages=[*preprocessing(numeric, categorical), learner]).fit(rows)
    smearing = fitted.transform(rows).agg(F.avg(F.exp(F.col("_log_price") - F.col("_log_prediction")))).first()[0]
    return Valuation(fitted, float(smearing))


def segments(profiles: DataFrame, key: str, features: list[str], ks: range = range(2, 9), seed: int = 42) -> DataFrame:
    """``key, cluster, silhouette``: KMeans on robustly scaled features, k by silhouette (ties: the smaller)."""
    stages = [Imputer(strategy="median", inputCols=features, outputCols=[f"{c}_filled" for c in features]), VectorAssembler(inputCols=[f"{c}_filled" for c in features], outputCol="raw"), RobustScaler(inputCol="raw", outputCol="scaled", withCentering=True)]
    ready = Pipeline(stages=stages).fit(profiles).transform(profiles).cache()
    judge, best = ClusteringEvaluator(featuresCol="scaled", predictionCol="cluster"), None
    n = ready.count()
    for k in (k for k in ks if k < n):
        out = KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol="cluster", maxIter=50).fit(ready).transform(ready)
        score = judge.evaluate(out)
        if best is None or score > best[0] + 1e-12:
            best = (score, out)
    if best is None:
        raise ValueError("too few profiles for two clusters")
    return best[1].select(key, F.col("cluster").cast("int").alias("cluster"), F.lit(best[0]).alias("silhouette"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> float:
    """Agreement of two labellings, from their contingency table."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    pairs = lambda d: d.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]
    both, pa, pb = pairs(cells), pairs(cells.groupBy(a).agg(F.sum("n").alias("n"))), pairs(cells.groupBy(b).agg(F.sum("n").alias("n")))
    n = cells.agg(F.sum("n")).first()[0] or 0
    expected, most = pa * pb / max(1.0, n * (n - 1) / 2), (pa + pb) / 2
    return 1.0 if most == expected else float((both - expected) / (most - expected))


def spatial_two_stage(df: DataFrame, edges: DataFrame, key: str, target: str, *features: str) -> Fit:
    """The spatial-lag model y = rho Wy + Xb by two-stage least squares, WX being the instruments.

    All sums are over joins on the edge list; no n-by-n matrix or determinant is formed, so it holds at any
    number of rows, unlike the likelihood form.
    """
    rows = df.select(key, target, *features)
    for c in (target, *features):
        rows = rows.join(spatial_lag(df, edges, key, c).select(key, F.col("lag").alias(f"w_{c}")), key)
    first = ols(rows, f"w_{target}", *features, *(f"w_{c}" for c in features))
    return ols(rows.withColumn("rho", first.predict()), target, "rho", *features)


def bootstrap_metrics(df: DataFrame, actual: str, predicted: str, key: str, draws: int = 200, coverage: float = 0.95) -> DataFrame:
    """``metric, low, median, high``: each row counts Poisson(1) times in each draw, by a hash of key and draw.

    The weights are the same on every run and machine; draws are summed in the map tasks.
    """
    u = (F.pmod(F.xxhash64(F.col(key), F.col("draw")), F.lit(1_000_003)) + 0.5) / 1_000_003
    total, p, times = 0.0, 0.36787944117144233, F.lit(0)
    for k in range(1, 9):  # 1 / (e k!)
        total += p
        times = times + F.when(u > total, 1).otherwise(0)
        p /= k
    error = F.col(actual) - F.col(predicted)
    drawn = df.select(key, F.abs(error).alias("ae"), (error * error).alias("se"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("w", times)
    one = drawn.groupBy("draw").agg((F.sum(F.col("w") * F.col("ae")) / F.sum("w")).alias("mae"), F.sqrt(F.sum(F.col("w") * F.col("se")) / F.sum("w")).alias("rmse"))
    tail = (1 - coverage) / 2
    return one.unpivot(["draw"], ["mae", "rmse"], "metric", "value").groupBy("metric").agg(F.percentile("value", F.lit(tail)).alias("low"), median("value").alias("median"), F.percentile("value", F.lit(1 - tail)).alias("high"))


def shapley(model: Valuation, properties: DataFrame, reference: dict[str, object], key: str, features: list[str], permutations: int = 32) -> DataFrame:
    """``key, feature, contribution``: mean change of the prediction as features turn from the reference's to the property's.

    All steps of all permutations are rows of one table, scored by one transform. Orders follow from hashes, and
    the contributions of a property sum to its prediction less the reference's.
    """
    n = len(features)
    order = F.array_sort(F.array(*(F.struct(F.xxhash64(F.col("permutation"), F.lit(f)).alias("h"), F.lit(f).alias("f")) for f in features)))
    steps = properties.select(key, *features).withColumn("permutation", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("order", F.transform(order, lambda x: x.f)).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n))))
    types = dict(properties.dtypes)
    on = {f: F.when(F.array_position("order", f) <= F.col("step"), F.col(f)).otherwise(F.lit(reference[f]).cast(types[f])) for f in features}
    scored = model.predict(steps.withColumns(on), "value")
    before = F.lag("value").over(Window.partitionBy(key, "permutation").orderBy("step"))
    changes = scored.withColumn("change", F.col("value") - before).where("step > 0").withColumn("feature", F.element_at("order", F.col("step")))
    return changes.groupBy(key, "feature").agg((F.sum("change") / permutations).alias("contribution"))


def spline_basis(df: DataFrame, value: str, prefix: str = "spline") -> DataFrame:
    """Standardised value, its square and cube, and truncated cubes at the quartiles."""
    at = [0.25, 0.5, 0.75]
    fit = df.agg(F.avg(value).alias("_a"), F.stddev_pop(value).alias("_s"), F.percentile(value, F.array(*map(F.lit, at))).alias("_q"))
    z = (F.col(value) - F.col("_a")) / F.nullif(F.col("_s"), F.lit(0.0))
    knots = {f"{prefix}_k{i + 1}": F.pow(F.greatest(F.lit(0.0), z - (F.get("_q", F.lit(i)) - F.col("_a")) / F.nullif(F.col("_s"), F.lit(0.0))), F.lit(3)) for i in range(len(at))}
    cols = {f"{prefix}_1": z, f"{prefix}_2": z * z, f"{prefix}_3": z * z * z} | knots
    return df.join(F.broadcast(fit)).withColumns({n: F.when(F.col(value).isNotNull(), c) for n, c in cols.items()}).drop("_a", "_s", "_q")


def variance_inflation(df: DataFrame, *features: str) -> dict[str, float]:
    """VIF of each feature: the diagonal of the inverse correlation matrix, from one pass of sums."""
    import numpy as np

    rows = df.dropna(subset=list(features))
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    one = rows.agg(*(F.corr(a, b) for a, b in pairs)).first() if pairs else ()
    r = np.eye(len(features))
    for (a, b), v in zip(pairs, one, strict=True):
        i, j = features.index(a), features.index(b)
        r[i, j] = r[j, i] = v
    return dict(zip(features, np.diag(np.linalg.pinv(r)).tolist(), strict=True))
