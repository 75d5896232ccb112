"""Queries of controls, usable columns, effects, ladders of specifications, samples, index growth and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.operators import blocks, cleaning, design, indices
from plotline.plans import proxies
from plotline.plans.catalog import _rounded, query
from plotline.plans.insight import _PROFILES, _profiles
from plotline.plans.proxies import PREDICTED, SALES
from plotline.plans.regressions import _ROWS, _rows

_GAPS = "SELECT sale_id, CASE WHEN sale_id % 5 = 0 THEN NULL ELSE x / 5280 - 1 END AS cta_distance_miles, CASE WHEN sale_id % 3 = 0 THEN NULL ELSE y END AS lake, sale_year < 1997 AS early FROM sales"


@query(f"""WITH {SALES}, g AS ({_GAPS}), m AS (SELECT quantile_cont(cta_distance_miles, 0.5) AS a, quantile_cont(lake, 0.5) AS b FROM g WHERE early)
 SELECT sale_id, round(ln(1 + coalesce(greatest(cta_distance_miles, 0), a)), 6) AS control_log1p_cta_distance_miles, round(coalesce(lake, b), 4) AS control_lake FROM g, m WHERE NOT early""".replace("greatest(cta_distance_miles, 0)", "CASE WHEN cta_distance_miles IS NOT NULL THEN greatest(cta_distance_miles, 0) END"))
def nuisance_controls(spark, d):
    rows = proxies.sales(spark, d).selectExpr("sale_id", "if(sale_id % 5 = 0, null, x / 5280 - 1) as cta_distance_miles", "if(sale_id % 3 = 0, null, y) as lake", "sale_year < 1997 as early")
    controls, _ = design.nuisance_controls(rows.where("early"), ["cta_distance_miles", "lake", "absent"])
    return rows.where("not early").select("sale_id", *(F.round(c, 6 if "log1p" in n else 4).alias(n) for n, c in controls.items()))


@query(f"WITH {_ROWS} SELECT 'miles' AS term, round(regr_slope(y, miles), 8) AS coefficient, round(exp(regr_slope(y, miles)) - 1, 8) AS effect, 'proportional change' AS meaning FROM t")
def hedonic_effects(spark, d):
    model = blocks.gram(_rows(spark, d), "y", ["miles"]).fit(["miles"])
    return spark.createDataFrame([(t, round(b, 8), round(e, 8), m) for t, b, e, m in design.effects(model)], "term string, coefficient double, effect double, meaning string")


@query(f"""WITH {_ROWS}, s AS (SELECT 'all' AS subset, * FROM t UNION ALL SELECT CAST(fold AS VARCHAR), * FROM t), m AS (SELECT subset, count(*) AS n, regr_slope(y, ls) AS b, regr_r2(y, ls) AS r2, regr_syy(y, ls) AS s, regr_sxx(y, ls) AS x FROM s GROUP BY subset)
 SELECT subset, 'size' AS specification, n, round(b, 6) AS coefficient, round(sqrt((1 - r2) * s / (n - 2) / x), 6) AS error, round(r2, 6) AS r2 FROM m""")
def robustness_ladder(spark, d):
    return _rounded(design.ladder(_rows(spark, d), "y", {"size": ["ls"]}, "ls", "fold"), 6)


@query(f"WITH {SALES} SELECT sale_id FROM sales ORDER BY md5('7:' || sale_id), sale_id LIMIT 500")
def capped_sample(spark, d):
    return cleaning.capped_sample(proxies.sales(spark, d).select("sale_id"), "sale_id", 500, seed=7)


@query(f"WITH {SALES}, i AS (SELECT nbhd AS geo, sale_year AS year, avg(sale_price) AS level FROM sales GROUP BY ALL) SELECT geo, year, round(level / lag(level) OVER (PARTITION BY geo ORDER BY year) - 1, 8) AS annual_index_growth FROM i")
def index_growth(spark, d):
    level = proxies.sales(spark, d).groupBy(F.col("nbhd").alias("geo"), F.col("sale_year").alias("year")).agg(F.avg("sale_price").alias("level"))
    return indices.index_growth(level, "level", "geo").select("geo", "year", F.round("annual_index_growth", 8).alias("annual_index_growth"))


@query(f"""WITH {PREDICTED}, c AS (SELECT nbhd, residence_type AS component, sale_price - prediction_a AS v FROM predicted), s AS (SELECT nbhd, component, round(sum(v), 2) AS contribution FROM c GROUP BY ALL)
 SELECT *, row_number() OVER (PARTITION BY nbhd ORDER BY abs(contribution) DESC, component) AS rank FROM s""")
def component_roll_up(spark, d):
    rows = proxies.predicted(spark, d).select("nbhd", F.col("residence_type").alias("component"), (F.col("sale_price") - F.col("prediction_a")).alias("v"))
    return design.roll_up(rows, "nbhd", "component", "v").withColumn("contribution", F.round("contribution", 2))


@query(f"WITH {_PROFILES} SELECT cluster, count(*) AS n, round(quantile_cont(median_sale_price, 0.5), 4) AS median_sale_price, round(quantile_cont(annual_sale_velocity, 0.5), 4) AS annual_sale_velocity FROM m GROUP BY cluster")
def cluster_profiles(spark, d):
    return _rounded(design.cluster_profiles(_profiles(spark, d), ["cluster"], ["median_sale_price", "annual_sale_velocity"]))
