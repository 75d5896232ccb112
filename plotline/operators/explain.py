"""What a model listens to: the error that shuffling a feature adds, and the mean prediction along a feature.

A model is a function that adds a ``prediction`` column to a table. Every shuffle of every feature, and every value of
every feature's grid, is a copy of the rows in one long table, which the model scores in a single pass. Shuffles are
seeded permutations of all rows, worked out from dense row numbers and joined, never sorted or collected.

Cases: rows without an actual value take no part; a feature without two distinct values has no partial dependence;
repeated keys are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.operators.order_stats import many_quantiles
from plotline.operators.spatial_models import numbered, places
from plotline.operators.tables import settled

Predict = Callable[[DataFrame], DataFrame]


def permutation_importance(df: DataFrame, predict: Predict, features: list[str], actual: str, key: str, repeats: int = 5, seed: int = 42) -> DataFrame:
    """``feature, baseline, importance, spread``: by how much the mean absolute error grows, over ``repeats`` shuffles, and how that varies."""
    rows = settled(numbered(settled(df.where(F.col(actual).isNotNull())), key))
    n = rows.count()
    draws = len(features) * repeats

    def shuffled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            for draw in range(draws):
                yield pa.RecordBatch.from_arrays([pa.array(places(n, draw, at, seed)), pa.array(np.full(len(at), draw)), batch.column(0)], ["number", "draw", "source"])

    moved = rows.select("number").mapInArrow(shuffled, "number long, draw long, source long")
    given = rows.select(F.col("number").alias("source"), F.struct(*features).alias("_given"))
    copies = moved.join(given.hint("merge"), "source").join(rows.hint("merge"), "number").withColumn("feature", F.element_at(F.array(*map(F.lit, features)), (F.floor(F.col("draw") / repeats) + 1).cast("int")))
    changed = {f: F.when(F.col("feature") == f, F.col(f"_given.{f}")).otherwise(F.col(f)) for f in features}
    long = copies.withColumns(changed).drop("_given", "source").unionByName(rows.withColumns({"draw": F.lit(-1).cast("long"), "feature": F.lit(None).cast("string")}))
    errors = predict(long).groupBy("feature", "draw").agg(F.avg(F.abs(F.col("prediction") - F.col(actual))).alias("error"))
    errors = settled(errors)
    base = errors.where("draw < 0").select(F.col("error").alias("baseline"))
    added = F.col("error") - F.col("baseline")
    return errors.where("draw >= 0").join(F.broadcast(base)).groupBy("feature").agg(F.first("baseline").alias("baseline"), F.avg(added).alias("importance"), F.stddev_pop(added).alias("spread"))


def partial_dependence(df: DataFrame, predict: Predict, features: list[str], points: int = 20, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """``feature, value, prediction``: the mean prediction with a feature held at each of its evenly spaced quantiles, for numeric features."""
    rows = settled(df)
    probs = {f"q{k}": low + (high - low) * k / (points - 1) for k in range(points)}
    found = many_quantiles(rows, [], {f: F.col(f) for f in features}, probs | {"least": 0.0, "most": 1.0}, reread=True).first()
    grid = [(f, v) for f in features if found[f"{f}_least"] is not None and found[f"{f}_least"] < found[f"{f}_most"] for v in sorted({found[f"{f}_{q}"] for q in probs})]
    if not grid:
        return rows.sparkSession.createDataFrame([], "feature string, value double, prediction double")
    held = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(v).alias("value")) for f, v in grid)))
    copies = rows.withColumn("_held", held).withColumns({f: F.when(F.col("_held.feature") == f, F.col("_held.value")).otherwise(F.col(f).cast("double")) for f in features})
    scored = predict(copies).groupBy(F.col("_held.feature").alias("feature"), F.col("_held.value").alias("value"))
    return scored.agg(F.avg("prediction").alias("prediction"))
