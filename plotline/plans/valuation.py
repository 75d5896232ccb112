"""Valuation, validation and serving queries over the stand-in tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotline.operators import asof, cleaning, hedonic, indices, spatial, validation
from plotline.plans import proxies
from plotline.plans.catalog import _COMPS, _LONG, _links, _long, _rounded, query
from plotline.plans.proxies import PREDICTED, SALES, SIZED, read


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false ELSE true END AS basement, TRY_CAST(nullif(regexp_extract(p_size || ' story', '([0-9]+)', 1), '') AS DOUBLE) AS stories FROM part")
def card_flags(spark, d):
    t = read(spark, d, "part").select("p_partkey", F.expr("case p_partkey % 4 when 0 then ' None ' when 1 then 'Full' when 2 then null else 'Partial' end").alias("b"), F.expr("p_size || ' story'").alias("s"))
    return t.select("p_partkey", cleaning.has_basement("b").alias("basement"), F.regexp_extract("s", r"(\d+)", 1).try_cast("double").alias("stories"))


@query(f"""WITH {SIZED}, cards AS (SELECT l_orderkey AS sale_id, count(*) AS n_cards, min(year(l_shipdate)) - 40 AS year_built FROM lineitem GROUP BY l_orderkey)
 SELECT sale_id, sale_year, CAST(month(sale_date) AS BIGINT) AS sale_month, CAST(quarter(sale_date) AS BIGINT) AS sale_quarter, building_sqft, n_cards, CASE WHEN year_built IS NOT NULL THEN greatest(sale_year - year_built, 0) END AS building_age FROM sized LEFT JOIN cards USING (sale_id)""")
def core_sales(spark, d):
    cards = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sale_id")).agg(F.count("*").alias("n_cards"), (F.min(F.year("l_shipdate")) - 40).alias("year_built"))
    s = proxies.sized(spark, d).join(cards, "sale_id", "left")
    return s.select("sale_id", "sale_year", F.month("sale_date").cast("long").alias("sale_month"), F.quarter("sale_date").cast("long").alias("sale_quarter"), "building_sqft", "n_cards", cleaning.not_negative(F.col("sale_year") - F.col("year_built")).alias("building_age"))


@query(f"""WITH {SALES}, a AS (SELECT DISTINCT pin, sale_year AS year, nbhd FROM sales WHERE sale_id % 3 = 0), c AS (SELECT DISTINCT nbhd, sale_year AS year FROM sales WHERE sale_id % 500 = 0),
 x AS (SELECT s.sale_id, s.sale_year, s.nbhd, max(a.year) AS y FROM sales s LEFT JOIN a ON a.pin = s.pin AND a.year <= s.sale_year AND a.year >= s.sale_year - 3 GROUP BY ALL),
 z AS (SELECT x.sale_id, x.y, max(c.year) AS acs FROM x LEFT JOIN c ON x.y IS NOT NULL AND c.nbhd = x.nbhd AND c.year <= x.sale_year AND c.year >= x.sale_year - 5 GROUP BY ALL) SELECT sale_id, y AS parcel_match_year, acs AS acs_match_year FROM z""")
def asof_chained(spark, d):
    s = proxies.sales(spark, d)
    parcels = s.where("sale_id % 3 = 0").select("pin", F.col("sale_year").alias("year"))
    acs = s.where("sale_id % 500 = 0").select(F.col("nbhd").alias("tract"), F.col("sale_year").alias("year"))
    first = asof.align_snapshots(s, parcels, "pin", max_lag=3, prefix="parcel").withColumn("tract", F.when(F.col("parcel_match_year").isNotNull(), F.col("nbhd")))
    return _rounded(asof.align_snapshots(first, acs, "tract", max_lag=5, prefix="acs").select("sale_id", "parcel_match_year", "acs_match_year"))


_STAGE = "CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE -1 END"


@query(f"SELECT o_orderkey, CASE WHEN {_STAGE} > 0 THEN 'board' WHEN o_orderkey % 2 = 0 THEN 'certified' ELSE 'mailed' END AS stage, round(CASE WHEN {_STAGE} > 0 THEN o_totalprice ELSE o_totalprice * 0.9 END / 0.1, 2) AS market_value FROM orders")
def assessment_stage(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.expr(_STAGE).alias("board"), F.expr("if(o_orderkey % 2 = 0, o_totalprice * 0.9, null)").alias("certified"), (F.col("o_totalprice") * 0.9).alias("mailed"))
    of = lambda c: F.when(F.col(c) > 0, F.col(c))
    stage = F.when(of("board").isNotNull(), "board").when(of("certified").isNotNull(), "certified").when(of("mailed").isNotNull(), "mailed")
    return o.select("o_orderkey", stage.alias("stage"), F.round(F.coalesce(of("board"), of("certified"), of("mailed")) / 0.1, 2).alias("market_value"))


@query("SELECT count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types, count(DISTINCT p_size) AS sizes FROM part")
def column_cardinality(spark, d):
    return read(spark, d, "part").agg(F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_type").alias("types"), F.count_distinct("p_size").alias("sizes"))


@query(f"WITH {_LONG} SELECT model, count(*) AS n, round(avg(abs(sale_price - prediction)), 4) AS mae FROM long WHERE sale_id IN (SELECT sale_id FROM long WHERE sale_id % 7 <> 0 GROUP BY sale_id HAVING count(*) = 2) GROUP BY model")
def common_sample_metrics(spark, d):
    long = _long(spark, d)
    both = long.where("sale_id % 7 <> 0").groupBy("sale_id").agg(F.count("*").alias("n")).where("n = 2").select("sale_id")
    return _rounded(long.join(both, "sale_id", "left_semi").groupBy("model").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("sale_price") - F.col("prediction"))).alias("mae")))


@query(f"{_COMPS}, p AS (SELECT target_sale_id, sum(weight * comparable_price) / sum(weight) AS prediction FROM links GROUP BY target_sale_id) SELECT count(*) AS n, round(avg(abs(sale_price - prediction)), 2) AS mae FROM p JOIN sales ON sale_id = target_sale_id")
def comparable_metrics(spark, d):
    p = _links(spark, d).groupBy(F.col("target_sale_id").alias("sale_id")).agg((F.sum(F.col("weight") * F.col("comparable_price")) / F.sum("weight")).alias("prediction"))
    return _rounded(proxies.sales(spark, d).join(p, "sale_id").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("sale_price") - F.col("prediction"))).alias("mae")), 2)


@query(f"""WITH {SALES}, t AS (SELECT max(sale_year) AS last FROM sales), v AS (SELECT max(sale_year) AS first FROM sales, t WHERE sale_year < last)
 SELECT CASE WHEN sale_year < first THEN 'train' WHEN sale_year < last THEN 'validation' ELSE 'test' END AS split, min(sale_year) AS first_year, max(sale_year) AS last_year, count(*) AS n FROM sales, t, v WHERE sale_year IS NOT NULL GROUP BY 1""")
def chronological_split(spark, d):
    rows = validation.chronological_split(proxies.sales(spark, d), "sale_year").where("split is not null")
    return rows.groupBy("split").agg(F.min("sale_year").alias("first_year"), F.max("sale_year").alias("last_year"), F.count("*").alias("n"))


@query(f"""WITH {SALES}, y AS (SELECT DISTINCT sale_year AS year FROM sales WHERE sale_year IS NOT NULL), t AS (SELECT max(year) AS last FROM y), v AS (SELECT max(year) AS first FROM y, t WHERE year < last)
 SELECT sale_id, sale_year, CASE WHEN sale_year < first THEN 'train' WHEN sale_year < last THEN 'validation' WHEN sale_year >= last THEN 'test' END AS split FROM sales, t, v""")
def chronological_split_by_year(spark, d):
    return validation.chronological_split(proxies.sales(spark, d), "sale_year").select("sale_id", "sale_year", "split")


@query(f"""WITH {SIZED}, m AS (SELECT quantile_cont(building_sqft, 0.5) AS m FROM sized) SELECT sale_id, coalesce(building_sqft, m) AS building_sqft, building_sqft IS NULL AS building_sqft_missing FROM sized, m""")
def impute_median(spark, d):
    return hedonic.impute_median(proxies.sized(spark, d), "building_sqft").select("sale_id", "building_sqft", "building_sqft_missing")


@query(f"""WITH {SALES}, c AS (SELECT residence_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, residence_type) AS k FROM sales GROUP BY residence_type), t AS (SELECT * FROM c WHERE k <= 3)
 SELECT sale_id, round(ln(sale_price), 6) AS log_price, CASE WHEN residence_type = (SELECT residence_type FROM t WHERE k = 2) THEN 1.0 ELSE 0.0 END AS second, CASE WHEN residence_type NOT IN (SELECT residence_type FROM t) THEN 1.0 ELSE 0.0 END AS other FROM sales""")
def hedonic_design(spark, d):
    s = proxies.sales(spark, d)
    levels = hedonic.top_levels(s, "residence_type", 1, 3)
    x = hedonic.one_hot(s, "residence_type", levels)
    return x.select("sale_id", F.round(F.ln("sale_price"), 6).alias("log_price"), F.col(f"`residence_type={levels[1]}`").alias("second"), F.col("`residence_type=__OTHER__`").alias("other"))


_OLS = f"""WITH {SIZED}, t AS (SELECT *, ln(sale_price) AS ly, ln(building_sqft) AS ls FROM sized WHERE sale_price > 0 AND building_sqft > 0), f AS (SELECT regr_slope(ly, ls) AS b, regr_intercept(ly, ls) AS a, count(*) AS n FROM t)"""


def _logs(spark, d):
    return proxies.sized(spark, d).where("sale_price > 0 and building_sqft > 0").withColumns({"ly": F.ln("sale_price"), "ls": F.ln("building_sqft")})


@query(f"{_OLS} SELECT n, round(a, 5) AS intercept, round(b, 5) AS slope FROM f")
def hedonic_fit(spark, d):
    fit = hedonic.ols(_logs(spark, d), "ly", "ls")
    return spark.createDataFrame([(fit.n, round(fit.coefficients["const"], 5), round(fit.coefficients["ls"], 5))], "n long, intercept double, slope double")


@query(f"{_OLS} SELECT nbhd AS geo, sale_year AS year, count(*) AS n, round(exp(quantile_cont(ly - a - b * ls, 0.5)), 4) AS adjusted_level FROM t, f GROUP BY nbhd, sale_year")
def adjusted_index(spark, d):
    t = _logs(spark, d)
    return _rounded(hedonic.adjusted_index(t, "nbhd", "sale_year", F.col("ly") - hedonic.ols(t, "ly", "ls").predict()))


@query(f"""{_OLS}, r AS (SELECT nbhd, sale_year, avg(ly - a - b * ls) AS e FROM t, f GROUP BY nbhd, sale_year) SELECT round(corr(x.e, z.e), 4) AS persistence, count(*) AS n FROM r x JOIN r z ON x.nbhd = z.nbhd AND z.sale_year = x.sale_year + 1""")
def residual_persistence(spark, d):
    t = _logs(spark, d)
    e = t.groupBy("nbhd", "sale_year").agg(F.avg(F.col("ly") - hedonic.ols(t, "ly", "ls").predict()).alias("e"))
    after = e.select("nbhd", (F.col("sale_year") - 1).alias("sale_year"), F.col("e").alias("e2"))
    return _rounded(e.join(after, ["nbhd", "sale_year"]).agg(F.corr("e", "e2").alias("persistence"), F.count("*").alias("n")))


_SQUARES = "squares AS (SELECT n_name AS place, CAST((n_nationkey % 5) * 10560 + 1000 AS DOUBLE) AS lo_x, CAST((n_nationkey // 5) * 10560 + 2000 AS DOUBLE) AS lo_y FROM nation)"


@query(f"""WITH {_SQUARES}, p AS (SELECT c_custkey AS id, CAST((c_custkey * 7919) % 52800 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 52800 AS DOUBLE) AS y FROM customer),
 f AS (SELECT id, place, sqrt(pow(greatest(lo_x - x, 0, x - lo_x - 3000), 2) + pow(greatest(lo_y - y, 0, y - lo_y - 3000), 2)) AS dist FROM p, squares) SELECT id, arg_min(place, (dist, place)) AS nearest_place, round(min(dist), 3) AS polygon_distance FROM f GROUP BY id""")
def nearest_polygon(spark, d):
    corner = "named_struct('x', {x}, 'y', {y})"
    ring = ", ".join(corner.format(x=f"lo_x + {a}D", y=f"lo_y + {b}D") for a, b in ((0, 0), (3000, 0), (3000, 3000), (0, 3000), (0, 0)))
    squares = read(spark, d, "nation").selectExpr("n_name as place", "cast((n_nationkey % 5) * 10560 + 1000 as double) as lo_x", "cast((n_nationkey div 5) * 10560 + 2000 as double) as lo_y").selectExpr("place", f"array({ring}) as ring")
    return spatial.polygon_distance(proxies.points(spark, d), squares, "id", "place").withColumn("polygon_distance", F.round("polygon_distance", 3))


_RECENT = "p.nbhd = t.nbhd AND p.sale_date < t.sale_date AND p.sale_date >= t.sale_date - INTERVAL 730 DAY"


@query(f"""WITH {SALES}, r AS (SELECT t.sale_id, count(p.sale_id) AS n_recent, count(p.sale_id) FILTER (datesub('day', p.sale_date, t.sale_date) <= 365) AS n_new, count(p.sale_id) FILTER (datesub('day', p.sale_date, t.sale_date) > 365) AS n_old,
 quantile_cont(p.sale_price, 0.5) FILTER (datesub('day', p.sale_date, t.sale_date) <= 365) AS newer, quantile_cont(p.sale_price, 0.5) FILTER (datesub('day', p.sale_date, t.sale_date) > 365) AS older FROM sales t LEFT JOIN sales p ON {_RECENT} GROUP BY t.sale_id)
 SELECT sale_id, n_recent, round(CASE WHEN n_new >= 3 AND n_old >= 3 THEN newer / older - 1 END, 6) AS appreciation FROM r""")
def neighborhood_appreciation(spark, d):
    return _rounded(indices.prior_appreciation(proxies.sales(spark, d), "nbhd"), 6)


@query(f"WITH {PREDICTED}, c AS (SELECT *, abs(sale_price - prediction_a) AS score FROM predicted WHERE sale_year < 2000), r AS (SELECT score, row_number() OVER (ORDER BY score) AS k, count(*) OVER () AS n FROM c), q AS (SELECT min(score) AS radius FROM r WHERE k = ceil(least(1.0, ceil((n + 1) * 0.9) / n) * (n - 1)) + 1) SELECT sale_id, round(prediction_a - radius, 3) AS low, round(prediction_a + radius, 3) AS high FROM predicted, q WHERE sale_year >= 2000")
def conformal_intervals(spark, d):
    p = proxies.predicted(spark, d)
    scores = p.where("sale_year < 2000").select(F.lit("a").alias("model"), F.abs(F.col("sale_price") - F.col("prediction_a")).alias("score"))
    radius = validation.conformal_radius(scores, "model", "score", 0.9).select("radius")
    out = p.where("sale_year >= 2000").join(F.broadcast(radius))
    return out.select("sale_id", F.round(F.col("prediction_a") - F.col("radius"), 3).alias("low"), F.round(F.col("prediction_a") + F.col("radius"), 3).alias("high"))


@query(f"WITH {_LONG}, m AS (SELECT model, avg(abs(sale_price - prediction)) AS mae FROM long GROUP BY model) SELECT model, round(mae, 4) AS mae, rank() OVER (ORDER BY mae) AS place, round(mae / min(mae) OVER () - 1, 6) AS behind FROM m")
def model_scoreboard(spark, d):
    m = _long(spark, d).groupBy("model").agg(F.avg(F.abs(F.col("sale_price") - F.col("prediction"))).alias("mae"))
    every = Window.orderBy("mae")  # a row for each model
    return m.select("model", F.round("mae", 4).alias("mae"), F.rank().over(every).cast("long").alias("place"), F.round(F.col("mae") / F.min("mae").over(every) - 1, 6).alias("behind"))


@query(f"WITH {PREDICTED} SELECT sale_id, round(abs(prediction_a - prediction_b), 3) AS gap FROM predicted ORDER BY abs(prediction_a - prediction_b) DESC, sale_id LIMIT 20")
def divergence_topk(spark, d):
    gap = F.abs(F.col("prediction_a") - F.col("prediction_b"))
    return proxies.predicted(spark, d).orderBy(F.desc(gap), "sale_id").limit(20).select("sale_id", F.round(gap, 3).alias("gap"))


@query(f"WITH {SALES}, c AS (SELECT residence_type, count(*) AS n FROM sales GROUP BY 1 ORDER BY n DESC, residence_type LIMIT 1) SELECT round(quantile_cont(sale_price, 0.5), 4) AS sale_price, (SELECT residence_type FROM c) AS residence_type FROM sales")
def reference_profile(spark, d):
    return _rounded(proxies.sales(spark, d).agg(indices.median("sale_price").alias("sale_price"), F.mode("residence_type", True).alias("residence_type")))


@query(f"""WITH {PREDICTED}, q AS (SELECT quantile_cont(sale_price, 0.01) AS lo, quantile_cont(sale_price, 0.99) AS hi FROM predicted), t AS (SELECT 'all' AS slice, * FROM predicted UNION ALL SELECT 'trimmed', p.* FROM predicted p, q WHERE sale_price BETWEEN lo AND hi UNION ALL SELECT 'recent', * FROM predicted WHERE sale_year >= 1999)
 SELECT slice, count(*) AS n, round(avg(abs(sale_price - prediction_a)), 3) AS mae FROM t GROUP BY slice""")
def sample_sensitivity(spark, d):
    p = proxies.predicted(spark, d)
    q = p.agg(indices.quantile("sale_price", 0.01).alias("lo"), indices.quantile("sale_price", 0.99).alias("hi"))
    tags = F.array_compact(F.array(F.lit("all"), F.when(F.col("sale_price").between(F.col("lo"), F.col("hi")), "trimmed"), F.when(F.col("sale_year") >= 1999, "recent")))
    t = p.join(F.broadcast(q)).select("sale_price", "prediction_a", F.explode(tags).alias("slice"))
    return _rounded(t.groupBy("slice").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("sale_price") - F.col("prediction_a"))).alias("mae")), 3)


@query(f"WITH {SALES}, r AS (SELECT *, row_number() OVER (PARTITION BY nbhd ORDER BY sale_date DESC, sale_id DESC) AS k FROM sales) SELECT nbhd, sale_id FROM r WHERE k = 1")
def latest_per_group(spark, d):
    return indices.latest_per_group(proxies.sales(spark, d), "nbhd", F.desc("sale_date"), F.desc("sale_id")).select("nbhd", "sale_id")


@query(f"WITH {SALES}, t AS (SELECT *, datesub('day', lag(sale_date) OVER (PARTITION BY pin ORDER BY sale_date, sale_id), sale_date) AS since FROM sales) SELECT sale_year, round(avg(since), 4) AS mean_days, count(since) AS n FROM t GROUP BY sale_year")
def repeat_sales_lag(spark, d):
    since = F.timestamp_diff("DAY", F.lag("sale_date").over(Window.partitionBy("pin").orderBy("sale_date", "sale_id")), F.col("sale_date"))
    return _rounded(proxies.sales(spark, d).withColumn("since", since).groupBy("sale_year").agg(F.avg("since").alias("mean_days"), F.count("since").alias("n")))
