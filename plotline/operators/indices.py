"""Price indices, repeat sales, market cycles and neighbourhood profiles by windows and exact quantiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotline.operators.order_stats import many_quantiles
from plotline.operators.tables import settled


def median(c: str | Column) -> Column:
    return F.percentile(F.col(c) if isinstance(c, str) else c, F.lit(0.5))


def quantile(c: str | Column, q: float) -> Column:
    return F.percentile(F.col(c) if isinstance(c, str) else c, F.lit(q))


DAYS_PER_YEAR = 365.2425


def repeat_sale_pairs(sales: DataFrame, min_days: int = 1) -> DataFrame:
    """Consecutive sales of a property, at least ``min_days`` apart, with log change and yearly growth.

    All sales of a property on a day with several of them go first, since their order is not known. With a
    ``nbhd`` column, ``geography_consistent`` says whether it stayed; with a ``prediction`` one, the log
    residuals of both sales are given.
    """
    carried = [c for c in ("sale_id", "sale_date", "sale_price", "nbhd", "residence_type", "prediction") if c in sales.columns]
    known = sales.where("pin is not null and sale_date is not null and sale_price > 0")
    single = known.withColumn("_same_day", F.count("*").over(Window.partitionBy("pin", "sale_date"))).where("_same_day = 1").drop("_same_day")
    prior = {f"prior_{c}": F.lag(c).over(Window.partitionBy("pin").orderBy("sale_date")) for c in carried}
    days = F.timestamp_diff("DAY", F.col("prior_sale_date"), F.col("sale_date"))
    pairs = single.withColumns(prior).where("prior_sale_id is not null").withColumn("days", days).where(F.col("days") >= min_days)
    log_change = F.ln(F.col("sale_price") / F.col("prior_sale_price"))
    pairs = pairs.withColumn("log_change", log_change).withColumn("annual_appreciation", F.exp(F.col("log_change") * DAYS_PER_YEAR / F.col("days")) - 1)
    if "nbhd" in carried:
        pairs = pairs.withColumn("geography_consistent", F.coalesce(F.col("prior_nbhd") == F.col("nbhd"), F.lit(False)))
    if "prediction" in carried:
        pairs = pairs.withColumns({"residual": F.ln(F.col("sale_price") / F.col("prediction")), "prior_residual": F.ln(F.col("prior_sale_price") / F.col("prior_prediction"))})
    return pairs


def repeat_sales_statistics(pairs: DataFrame, start: str, end: str) -> DataFrame:
    """Sufficient statistics of the repeat-sales regression: one row for each pair of periods."""
    return pairs.groupBy(F.col(start).alias("start_period"), F.col(end).alias("end_period")).agg(F.count("*").alias("n_pairs"), F.sum("log_change").alias("sum_log_change"))


def repeat_sales_index(pairs: DataFrame, start: str, end: str) -> list[tuple[int, float]]:
    """Period and index (first period 100), by least squares on the statistics, of which there are few."""
    return _solve(repeat_sales_statistics(pairs, start, end).collect())


def _solve(rows: list) -> list[tuple[int, float]]:
    rows = [r for r in rows if r.start_period != r.end_period]
    periods = sorted({p for r in rows for p in (r.start_period, r.end_period)})
    at = {p: i for i, p in enumerate(periods)}
    gram, rhs = np.zeros((len(periods),) * 2), np.zeros(len(periods))
    for r in rows:
        d = np.zeros(len(periods))
        d[at[r.end_period]], d[at[r.start_period]] = 1, -1
        gram += r.n_pairs * np.outer(d, d)
        rhs += r.sum_log_change * d
    beta = np.concatenate([[0.0], np.linalg.lstsq(gram[1:, 1:], rhs[1:], rcond=None)[0]]) if periods else []
    return [(p, float(100 * np.exp(b))) for p, b in zip(periods, beta, strict=True)]


def level_index(sales: DataFrame, geo: str, level: Column, min_count: int) -> DataFrame:
    """``geo, year, n, level, index``: median level by year, relative to the first year with enough sales (100)."""
    panel = sales.where(F.col(geo).isNotNull()).groupBy(F.col(geo).alias("geo"), F.col("sale_year").alias("year")).agg(F.count("*").alias("n"), median(level).alias("level")).where(F.col("n") >= min_count)
    first = F.first("level").over(Window.partitionBy("geo").orderBy("year").rowsBetween(Window.unboundedPreceding, 0))
    return panel.withColumn("index", 100 * F.col("level") / first)


def growth(panel: DataFrame, level: str = "index") -> DataFrame:
    """``log_growth`` over the panel's previous year; null where the geography lacks that year."""
    years = panel.select("year").distinct()
    before = years.withColumn("previous_year", F.lag("year").over(Window.orderBy("year")))  # a row for each year
    old = panel.select("geo", F.col("year").alias("previous_year"), F.col(level).alias("_old"))
    return panel.join(F.broadcast(before), "year").join(old, ["geo", "previous_year"], "left").withColumn("log_growth", F.ln(F.col(level) / F.col("_old"))).drop("_old")


def comovement(growths: DataFrame, min_overlap: int) -> DataFrame:
    """Correlation of growth between each two geographies that share enough years."""
    a = growths.where("log_growth is not null").select("year", F.col("geo").alias("a"), F.col("log_growth").alias("ga"))
    b = a.select("year", F.col("a").alias("b"), F.col("ga").alias("gb"))
    return a.join(b, "year").where("a < b").groupBy("a", "b").agg(F.count("*").alias("overlap"), F.corr("ga", "gb").alias("correlation")).where(F.col("overlap") >= min_overlap)


def market_cycles(panel: DataFrame, boom: float = 0.10, bust: float = -0.10) -> DataFrame:
    """Yearly growth of the median price and of the number of sales, and the phase; the first year is the baseline."""
    every = Window.orderBy("year")  # a row for each year
    grown = {g: F.col(c) / F.lag(c).over(every) - 1 for g, c in (("growth", "median_price"), ("volume_growth", "n"))}
    return panel.withColumns(grown).withColumn("phase", F.when(F.col("growth").isNull(), "baseline").when(F.col("growth") >= boom, "boom").when(F.col("growth") <= bust, "bust").otherwise("stable"))


def prior_appreciation(sales: DataFrame, geo: str, window_days: int = 730, least: int = 3) -> DataFrame:
    """``sale_id, n_recent, appreciation``: median price of the newer over that of the older half of the window before a sale.

    Only sales of the geography strictly before the target count; the newer half is the last ``window_days`` / 2
    whole days; each half needs ``least`` priced sales. Time is cut into spans as long as the window, and each sale
    stands in its own span and, as history alone, in the next one. A half of a window is a run of a span's sales in
    order of time, and :func:`kth_of_runs` finds the medians of all runs together; so a sale costs as many steps as
    the number of a span's sales has digits, however crowded the place, and what is held is a span and its history.
    """
    span = 86_400 * window_days
    second = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("sale_date").cast("timestamp_ntz"))
    known = sales.where(F.col(geo).isNotNull() & F.col("sale_date").isNotNull()).select("sale_id", F.xxhash64(geo).alias("_hash"), F.col(geo).cast("string").alias("_geo"), F.col("sale_price").cast("double").alias("_price"), second.alias("_at"))
    own = known.withColumns({"_span": F.floor(F.col("_at") / span), "_guest": F.lit(False)})
    both = own.unionByName(own.withColumns({"_span": F.col("_span") + 1, "_guest": F.lit(True)}))
    context = sales.sparkSession.sparkContext
    parts = max(int(sales.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * context.defaultParallelism)  # few bytes, much work
    dealt = both.repartition(parts, "_hash", "_span").sortWithinPartitions("_hash", "_geo", "_span", "_at")
    kind = sales.schema["sale_id"].dataType.simpleString()
    middle = (window_days // 2 + 1) * 86_400  # from here on a sale is in the older half

    def told(rows: pa.Table) -> pa.RecordBatch:
        at, guest, price = rows["_at"].to_numpy(), rows["_guest"].to_numpy(), rows["_price"]
        priced = np.concatenate([[0], np.cumsum(price.is_valid().to_numpy())])  # how many have a price before each
        mine = at[~guest]
        end, start = np.searchsorted(at, mine), np.searchsorted(at, mine - span)
        cut = np.clip(np.searchsorted(at, mine - middle, "right"), start, end)
        lo, mid, hi = priced[start], priced[cut], priced[end]
        enough = np.flatnonzero(np.minimum(hi - mid, mid - lo) >= max(least, 1))
        new, old = _medians(price.drop_null().to_numpy(), np.concatenate([mid[enough], lo[enough]]), np.concatenate([hi[enough], mid[enough]])).reshape(2, -1)
        enough, new, old = (x[old != 0] for x in (enough, new, old))
        found, is_null = np.zeros(len(mine)), np.ones(len(mine), bool)
        found[enough], is_null[enough] = new / old - 1, False
        sale_id = rows["sale_id"].filter(pa.array(~guest)).combine_chunks()
        return pa.RecordBatch.from_arrays([sale_id, pa.array((end - start).astype(np.int64)), pa.array(found, mask=is_null)], ["sale_id", "n_recent", "appreciation"])

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # a new group starts where the place or the span is not that of the row before
            moved = [pc.not_equal(batch.column(c)[1:], batch.column(c)[:-1]).to_numpy(zero_copy_only=False) for c in ("_geo", "_span")]
            starts = [0, *(np.flatnonzero(moved[0] | moved[1]) + 1).tolist()]
            if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("_geo", "_span")):
                yield told(pa.Table.from_batches(held))
                held = []
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if lo:
                    yield told(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield told(pa.Table.from_batches(held))

    return dealt.select("sale_id", "_geo", "_price", "_at", "_span", "_guest").mapInArrow(halves, f"sale_id {kind}, n_recent long, appreciation double")


def kth_of_runs(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The ``k``-th least (from 0) of each run ``values[lo:hi]``, for all runs together.

    Bit by bit of the rank, from the highest: the values are dealt stably by the bit, the run's share of each side is
    again a run, and the side that holds the wanted one is known by counting.
    """
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    lo, hi, k, found = (np.array(x, np.int64) for x in (lo, hi, k, np.zeros(len(lo))))
    for bit in reversed(range(max(0, len(values) - 1).bit_length())):
        upper = (rank >> bit) & 1 == 1
        lower = np.concatenate([[0], np.cumsum(~upper)])  # how many are lower before each
        a, b = lower[lo], lower[hi]
        up = k >= b - a
        k -= np.where(up, b - a, 0)
        found |= up.astype(np.int64) << bit
        lo, hi = np.where(up, lower[-1] + lo - a, a), np.where(up, lower[-1] + hi - b, b)
        rank = np.concatenate([rank[~upper], rank[upper]])
    return values[order[found]]


def _medians(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of runs that hold something."""
    n = hi - lo
    out, even = kth_of_runs(values, lo, hi, (n - 1) // 2), n % 2 == 0
    above = out.copy()
    above[even] = kth_of_runs(values, lo[even], hi[even], n[even] // 2)
    return (out + above) / 2


def index_growth(index: DataFrame, value: str, *by: str, period: str = "year") -> DataFrame:
    """``annual_index_growth``: the change over the index's own previous period, within ``by``; null for the first."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(period))  # a row for each period
    return index.withColumn("annual_index_growth", F.try_divide(F.col(value), before) - 1)


def repeat_index_by_geography(pairs: DataFrame, start: str, end: str, least: int = 5) -> list[tuple[str, int, float]]:
    """Geography, period and index of pairs that stayed in their ``nbhd``, where it has ``least`` pairs.

    Each geography's regression is solved from its own sums, a row for each two periods.
    """
    stayed = pairs.where("geography_consistent")
    sums = stayed.groupBy("nbhd", F.col(start).alias("start_period"), F.col(end).alias("end_period")).agg(F.count("*").alias("n_pairs"), F.sum("log_change").alias("sum_log_change"))
    by_geo: dict = {}
    for r in sums.collect():  # geographies times pairs of periods
        by_geo.setdefault(r.nbhd, []).append(r)
    return [(geo, p, x) for geo, rows in sorted(by_geo.items()) if sum(r.n_pairs for r in rows) >= least for p, x in _solve(rows)]


def group_summary(sales: DataFrame, *groupings: str) -> DataFrame:
    """Counts and exact quantiles for several groupings: ``grouping, level`` and the figures."""
    sides = F.array(*(F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("level")) for g in groupings))
    ppsf = F.when((F.col("sale_price") > 0) & (F.col("building_sqft") > 0), F.col("sale_price") / F.col("building_sqft"))
    narrow = settled(sales.select("sale_price", ppsf.alias("ppsf"), *groupings))
    long = narrow.select("sale_price", "ppsf", F.inline(sides)).where("level is not null")
    means = long.groupBy("grouping", "level").agg(F.count("*").alias("n"), F.avg("sale_price").alias("mean_price"))
    spread = many_quantiles(long, ["grouping", "level"], {"sale_price": F.col("sale_price"), "ppsf": F.col("ppsf")}, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, reread=True)
    named = {"sale_price_p50": "median_price", "sale_price_p25": "p25_price", "sale_price_p75": "p75_price", "ppsf_p50": "median_ppsf"}
    return means.join(spread.select("grouping", "level", *(F.col(c).alias(n) for c, n in named.items())), ["grouping", "level"], "left")


def market_profiles(sales: DataFrame, geo: str) -> DataFrame:
    """One row for each geography: volume, span, velocity, medians and spread of log price per foot."""
    ppsf = F.when((F.col("sale_price") > 0) & (F.col("building_sqft") > 0), F.col("sale_price") / F.col("building_sqft"))
    out = sales.where(F.col(geo).isNotNull()).groupBy(F.col(geo).alias("geo")).agg(F.count("*").alias("n"), F.min("sale_year").alias("first_year"), F.max("sale_year").alias("last_year"), median("sale_price").alias("median_price"), median(ppsf).alias("median_ppsf"), F.stddev_samp(F.ln(ppsf)).alias("sd_log_ppsf"))
    return out.withColumn("velocity", F.col("n") / F.greatest(F.lit(1), F.col("last_year") - F.col("first_year")))


def latest_per_group(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_r = 1").drop("_r")


def dominant(df: DataFrame, group: str, name: str) -> DataFrame:
    """The most frequent name of each group, ties by name."""
    counts = df.where(F.col(name).isNotNull() & F.col(group).isNotNull()).groupBy(group, name).agg(F.count("*").alias("n"))
    return latest_per_group(counts, group, F.desc("n"), F.asc(name))


def transitions(labels: DataFrame, key: str, period: str, label: str) -> DataFrame:
    """Counts and shares of moves between the labels of consecutive periods."""
    after = labels.select(key, (F.col(period) - 1).alias(period), F.col(label).alias("to_label"))
    moves = labels.withColumnRenamed(label, "from_label").join(after, [key, period]).groupBy("from_label", "to_label").agg(F.count("*").alias("n"))
    return moves.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("from_label")))
