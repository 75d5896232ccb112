"""As-of joins of sales to yearly snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.operators.cleaning import require, require_unique


def align_snapshots(sales: DataFrame, snapshots: DataFrame, key: str, snapshot_year: str = "year", max_lag: int = 3, prefix: str = "snapshot", allow_future: bool = False, unique: str | None = None) -> DataFrame:
    """``sales`` with ``{prefix}_match_year``, ``_lag_years`` and ``_alignment_status``.

    The latest vintage not after the sale is taken if it is at most ``max_lag`` years old. The distinct
    years of a key are gathered into one short sorted array, so the sales side is joined once, on the
    key alone, and neither side grows by the join. With ``unique``, an id column, sales that share one are an error.
    """
    require(sales, key, "sale_year")
    if unique:
        require_unique(sales, unique)
    vintages = snapshots.where(F.col(snapshot_year).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(F.col(snapshot_year).cast("int"))).alias("_years"))
    joined = sales.join(vintages, key, "left").withColumn("_year", F.col("sale_year").cast("int"))
    past = F.array_max(F.filter("_years", lambda y: y <= F.col("_year")))
    future = F.array_min(F.filter("_years", lambda y: y > F.col("_year")))
    fresh = (F.col("_year") - F.col("_past")) <= max_lag
    status = F.when(F.col(key).isNull() | F.col("_year").isNull(), "unmatched_missing_key").when(fresh, F.when(F.col("_past") == F.col("_year"), "exact").otherwise("historical"))
    match = F.when(fresh, F.col("_past"))
    if allow_future:
        status = status.when(F.col("_future").isNotNull(), "current_state_future")
        match = F.coalesce(match, F.col("_future"))
    status = status.when(F.col("_past").isNotNull(), "unmatched_stale").otherwise("unmatched_no_history")
    out = joined.withColumns({"_past": past, "_future": future}).withColumns({f"{prefix}_match_year": match, f"{prefix}_alignment_status": status})
    return out.withColumn(f"{prefix}_lag_years", F.col("_year") - F.col(f"{prefix}_match_year")).drop("_years", "_year", "_past", "_future")


def attach_snapshots(aligned: DataFrame, snapshots: DataFrame, key: str, snapshot_year: str, prefix: str, many: bool = False) -> DataFrame:
    """The rows of the chosen vintage, left-joined; an error if several match and ``many`` is not set."""
    if not many and duplicate_keys(snapshots, key, snapshot_year).limit(1).count():
        raise ValueError(f"{prefix}: snapshots are not unique on ({key}, {snapshot_year})")
    right = snapshots.withColumnRenamed(snapshot_year, f"{prefix}_match_year").withColumn(f"{prefix}_match_year", F.col(f"{prefix}_match_year").cast("int"))
    return aligned.join(right, [key, f"{prefix}_match_year"], "left")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand in more than one row, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")
