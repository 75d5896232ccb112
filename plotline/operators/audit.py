"""A quality audit of a table of sales: flags for every row, findings, feature profiles and coverage. Nothing is dropped.

Checks that compare rows (repeated identities, several classes in a year, quick resales) are counted by key, and only
keys that break a rule are joined back, so a key that very many rows share is summed up in the tasks and its rows stay
spread. All of them meet in one bit set for each row. The fence on areas comes from exact quartiles found by histograms.

Cases: a column that is not there counts as null (``class`` alone then raises no flag, a missing structural column flags
every row); null keys repeat like others, as null-safe equality has it, but a resale needs an identifier and a date;
unreadable numbers and dates are null; an empty table has no flags and findings of zero.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotline.operators.cleaning import col_or_null, require
from plotline.operators.order_stats import quantiles
from plotline.operators.tables import settled
from plotline.operators.validation import log_fence

#: Names of the checks and their severities (fixed values).
CHECKS = {
    "duplicate_sale_id": "error",
    "duplicate_transaction": "error",
    "duplicate_pin_year": "info",
    "missing_sale_price": "error",
    "implausible_sale_price": "error",
    "nonpositive_building_area": "error",
    "building_sqft_outlier": "warning",
    "impossible_building_age": "error",
    "missing_coordinates": "warning",
    "coordinates_outside_cook_county": "error",
    "failed_property_join": "warning",
    "failed_pin_geography_join": "warning",
    "failed_acs_join": "warning",
    "repeated_sale_property": "info",
    "rapid_resale": "warning",
    "property_class_inconsistency": "warning",
    "missing_structural_characteristics": "warning",
}
STRUCTURAL = ("building_sqft", "land_sqft", "bedrooms", "bathrooms", "building_age")


@dataclass(frozen=True)
class AuditRules:
    """Bounds of the checks; the defaults are fixed values."""

    price: tuple[float, float] = (10_000, 100_000_000)
    building_sqft: tuple[float, float] = (200, 20_000)
    max_age: float = 250
    resale_days: int = 365
    latitude: tuple[float, float] = (41.45, 42.16)
    longitude: tuple[float, float] = (-88.27, -87.50)
    fence: float = 1.5


def _number(df: DataFrame, name: str) -> Column:
    return F.col(name).try_cast("double") if name in df.columns else F.lit(None).cast("double")


def _outside(v: Column, bounds: tuple[float, float]) -> Column:
    return (v < bounds[0]) | (v > bounds[1])


def _unmatched(df: DataFrame, side: str) -> Column:
    return F.startswith(col_or_null(df, f"{side}_alignment_status", "string"), F.lit("unmatched"))


def _broken(rows: DataFrame, keys: list[str], rule: Column, check: str) -> DataFrame:
    """``_row, check`` of the rows whose key breaks a rule, an aggregate over the key."""
    bad = rows.groupBy(*keys).agg(rule.alias("_bad")).where("_bad").drop("_bad")
    same = F.expr(" and ".join(f"r.{k} <=> b.{k}" for k in keys))
    return rows.alias("r").join(settled(bad).alias("b"), same).select("r._row", F.lit(check).alias("check"))


def _resales(rows: DataFrame, days: int) -> DataFrame:
    """Rows whose property was sold ``days`` whole days before at most; of sales at one time, all but the first by id.

    What is put in order is a property's distinct times, not its rows.
    """
    known = rows.where("pin is not null and _date is not null")
    times = known.groupBy("pin", "_date").agg(F.min(F.struct("sale_id", "_row")).alias("_first"), F.count("*").alias("_n"))
    before = F.lag("_date").over(Window.partitionBy("pin").orderBy("_date"))
    near = F.coalesce(F.timestamp_diff("DAY", before, F.col("_date")) <= days, F.lit(False))
    quick = settled(times.withColumn("_near", near).where("_near or _n > 1").select("pin", "_date", "_near", F.col("_first._row").alias("_first")))
    return known.join(quick, ["pin", "_date"]).where("_near or _row <> _first").select("_row", F.lit("rapid_resale").alias("check"))


def flagged(sales: DataFrame, rules: AuditRules = AuditRules()) -> DataFrame:
    """``sales`` with a boolean ``dq_`` column for each check and ``dq_issue_count``."""
    require(sales, "sale_id", "pin", "sale_date", "sale_price")
    date = F.col("sale_date").try_cast("timestamp_ntz")
    base = settled(sales.withColumns({"_row": F.monotonically_increasing_id(), "_date": date, "_year": F.year(date)}))
    extra = [c for c in ("doc_no", "class") if c in sales.columns]
    rows = base.select("_row", "sale_id", "pin", "sale_price", "_date", "_year", *extra)
    many = F.count("*") > 1
    broken = [
        _broken(rows, ["sale_id"], many, "duplicate_sale_id"),
        _broken(rows, ["pin", "_date", "sale_price", *(c for c in extra if c == "doc_no")], many, "duplicate_transaction"),
        _broken(rows, ["pin", "_year"], many, "duplicate_pin_year"),
        _broken(rows, ["pin"], many, "repeated_sale_property"),
        _resales(rows, rules.resale_days),
    ]
    if "class" in extra:
        broken.append(_broken(rows, ["pin", "_year"], F.min("class") < F.max("class"), "property_class_inconsistency"))
    hits = reduce(DataFrame.unionByName, broken).groupBy("_row").agg(F.collect_set("check").alias("_checks"))  # six at most
    price, sqft, age = (_number(base, c) for c in ("sale_price", "building_sqft", "building_age"))
    lat, lon = _number(base, "latitude"), _number(base, "longitude")
    log = F.when(sqft > 0, F.ln(sqft))
    structural = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in STRUCTURAL)) if set(STRUCTURAL) <= set(base.columns) else F.lit(True)
    own = {
        "missing_sale_price": price.isNull(),
        "implausible_sale_price": _outside(price, rules.price),
        "nonpositive_building_area": sqft <= 0,
        "building_sqft_outlier": F.coalesce((log < F.col("low_fence")) | (log > F.col("high_fence")), F.lit(False)) | _outside(sqft, rules.building_sqft),
        "impossible_building_age": _outside(age, (0, rules.max_age)),
        "missing_coordinates": lat.isNull() | lon.isNull(),
        "coordinates_outside_cook_county": lat.isNotNull() & lon.isNotNull() & (_outside(lat, rules.latitude) | _outside(lon, rules.longitude)),
        "failed_property_join": _unmatched(base, "property"),
        "failed_pin_geography_join": _unmatched(base, "parcel"),
        "failed_acs_join": _unmatched(base, "acs"),
        "missing_structural_characteristics": structural,
    }
    met = {c: F.coalesce(own[c], F.lit(False)) if c in own else F.coalesce(F.array_contains("_checks", c), F.lit(False)) for c in CHECKS}
    fence = log_fence(base.select(sqft.alias("v")), "v", rules.fence)
    out = base.join(F.broadcast(fence), how="left").join(hits, "_row", "left").withColumns({f"dq_{c}": f for c, f in met.items()})
    count = reduce(lambda a, b: a + b, (F.col(f"dq_{c}").cast("long") for c in CHECKS))
    return out.withColumn("dq_issue_count", count).drop("_row", "_date", "_year", "_checks", "low_fence", "high_fence")


def findings(flags: DataFrame) -> DataFrame:
    """``check, severity, count, rate`` of every check, from one aggregate over flagged rows."""
    one = flags.agg(F.count("*").alias("rows"), *(F.count_if(F.col(f"dq_{c}")).alias(c) for c in CHECKS))
    named = F.inline(F.array(*(F.struct(F.lit(c).alias("check"), F.lit(s).alias("severity"), F.col(c).alias("count")) for c, s in CHECKS.items())))
    return one.select("rows", named).select("check", "severity", "count", F.coalesce(F.try_divide("count", "rows"), F.lit(0.0)).alias("rate"))


def join_success(flags: DataFrame) -> DataFrame:
    """``side, rate``: the share of rows whose snapshot was found."""
    sides = {"property": "failed_property_join", "parcel": "failed_pin_geography_join", "acs": "failed_acs_join"}
    one = flags.agg(*(F.avg((~F.col(f"dq_{c}")).cast("double")).alias(s) for s, c in sides.items()))
    return one.unpivot([], list(sides), "side", "rate")


def _long(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    return df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns))))


def feature_profiles(df: DataFrame) -> DataFrame:
    """``column, dtype, n, missing, missing_rate, unique``, and for numbers ``mean, sd`` and exact quantiles ``p00`` to ``p100``."""
    kinds = dict(df.dtypes)
    numbers = [c for c, t in kinds.items() if t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    values = _long(df, list(kinds), "string").groupBy("column", "value").agg(F.count("*").alias("n"))
    counts = values.groupBy("column").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("value").alias("unique"))
    kind = F.create_map(*(F.lit(x) for c, t in kinds.items() for x in (c, t)))
    out = counts.select("column", kind[F.col("column")].alias("dtype"), (F.col("rows") - F.col("missing")).alias("n"), "missing", (F.col("missing") / F.col("rows")).alias("missing_rate"), "unique")
    if not numbers:
        return out
    long = _long(df, numbers, "double")
    moments = long.groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    probs = {f"p{round(100 * q):02d}": q for q in (0, 0.01, 0.25, 0.5, 0.75, 0.99, 1)}
    return out.join(moments, "column", "left").join(quantiles(long, ["column"], "value", probs).drop("n"), "column", "left")


def top_values(df: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """``column, value, n, rank``: the most frequent known values of each column, ties by value."""
    counts = _long(df, columns, "string").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))  # cut down before the shuffle
    return counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def coverage_by_year(df: DataFrame, year: str = "year") -> DataFrame:
    """``column, year, coverage``: the share of known values by year, ``unknown`` for rows without one."""
    columns = [c for c in df.columns if c != year]
    name = F.coalesce(F.col(year).cast("int").cast("string"), F.lit("unknown"))
    shares = df.groupBy(name.alias("_by")).agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns))
    return shares.unpivot(["_by"], columns, "column", "coverage").select("column", F.col("_by").alias("year"), "coverage")
