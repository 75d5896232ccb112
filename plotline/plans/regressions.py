"""Nested models, models by fold, premium curves and out-of-time selection over the stand-in sales, beside closed-form SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.operators import blocks, validation
from plotline.plans import proxies
from plotline.plans.catalog import _rounded, query
from plotline.plans.proxies import SIZED

_ROWS = f"{SIZED}, t AS (SELECT sale_id, sale_year, sale_price, ln(sale_price) AS y, ln(building_sqft) AS ls, CAST(sale_year AS DOUBLE) AS yr, x / 5280 AS miles, sale_id % 5 AS fold FROM sized WHERE sale_price > 0 AND building_sqft > 0)"


def _rows(spark, d):
    s = proxies.sized(spark, d).where("sale_price > 0 and building_sqft > 0")
    return s.select("sale_id", "sale_year", "sale_price", F.ln("sale_price").alias("y"), F.ln("building_sqft").alias("ls"), F.col("sale_year").cast("double").alias("yr"), (F.col("x") / 5280).alias("miles"), (F.col("sale_id") % 5).alias("fold"))


@query(f"""WITH {_ROWS}, m AS (SELECT count(*) AS n, regr_sxx(ls, ls) AS a, regr_sxx(yr, yr) AS b, covar_pop(ls, yr) * count(*) AS c, covar_pop(ls, y) * count(*) AS p, covar_pop(yr, y) * count(*) AS q, regr_sxx(y, y) AS s FROM t),
 r AS (SELECT 'A_size' AS model, n, 1 AS k, p * p / a / s AS r2 FROM m UNION ALL SELECT 'B_size_market', n, 2, (p * (b * p - c * q) + q * (a * q - c * p)) / (a * b - c * c) / s FROM m)
 SELECT model, n, round(r2, 8) AS r2, round(1 - (1 - r2) * (n - 1) / (n - k - 1), 8) AS adjusted_r2 FROM r""")
def nested_models(spark, d):
    block = blocks.gram(_rows(spark, d), "y", ["ls", "yr"])
    models = blocks.nested(block, {"A_size": ["ls"], "B_size_market": ["ls", "yr"]})
    return spark.createDataFrame([(name, m.n, round(m.r2, 8), round(m.adjusted_r2, 8)) for name, m in models.items()], "model string, n long, r2 double, adjusted_r2 double")


@query(f"""WITH {_ROWS}, f AS (SELECT DISTINCT fold FROM t) SELECT CAST(f.fold AS VARCHAR) AS fold, count(*) AS n, round(regr_intercept(y, ls), 6) AS intercept, round(regr_slope(y, ls), 6) AS slope, round(regr_r2(y, ls), 6) AS r2
 FROM f JOIN t ON t.fold <> f.fold GROUP BY f.fold""")
def fold_models(spark, d):
    found = blocks.leave_out(blocks.grams(_rows(spark, d), "y", ["ls"], "fold"), ["ls"])
    rows = [(fold, m.n, round(m.coefficients["const"], 6), round(m.coefficients["ls"], 6), round(m.r2, 6)) for fold, m in found.items()]
    return spark.createDataFrame(rows, "fold string, n long, intercept double, slope double, r2 double")


_GRID = [k / 4 for k in range(21)]


@query(f"""WITH {_ROWS}, m AS (SELECT count(*) AS n, avg(miles) AS c, regr_sxx(miles, miles) AS s, regr_slope(y, miles) AS b, regr_intercept(y, miles) AS a FROM t),
 v AS (SELECT any_value(b) AS b, sqrt(sum(pow((miles - c) * (y - a - b * miles) / (1 - 1.0 / n - (miles - c) * (miles - c) / s), 2))) / any_value(s) AS e FROM t, m)
 SELECT CAST(g AS DOUBLE) / 4 AS distance, round(exp(b * (g / 4 - 3)) - 1, 6) AS premium, round(exp(b * (g / 4 - 3) - 1.96 * e * abs(g / 4 - 3)) - 1, 6) AS low, round(exp(b * (g / 4 - 3) + 1.96 * e * abs(g / 4 - 3)) - 1, 6) AS high FROM v, range(21) r(g)""")
def premium_curve(spark, d):
    rows = _rows(spark, d)
    form = blocks.basis(rows, "miles", "linear", "station")
    fit = blocks.robust(rows.withColumns(form.terms("miles")), "y", list(form.terms("miles")))
    curve = blocks.premium_curve(fit, form, rows, _GRID, 3.0)
    return spark.createDataFrame([tuple(round(v, 6) for v in r) for r in curve], "distance double, premium double, low double, high double")


@query(f"""WITH {_ROWS}, b AS (SELECT miles, y, CASE WHEN miles <= 0.25 THEN 0 WHEN miles <= 0.5 THEN 1 WHEN miles <= 1 THEN 2 WHEN miles <= 2 THEN 3 ELSE 4 END AS band FROM t),
 g AS (SELECT band, count(*) AS n, avg(y) AS m, sum(pow(y - mean, 2)) AS ss FROM (SELECT *, avg(y) OVER (PARTITION BY band) AS mean FROM b) GROUP BY band), v AS (SELECT band, m, ss / n / n / pow(1 - 1.0 / n, 2) AS v FROM g)
 SELECT v.band AS band, round(v.m - r.m, 6) AS coefficient, round(sqrt(v.v + r.v), 6) AS error FROM v, v r WHERE r.band = 4 AND v.band < 4""")
def premium_bands(spark, d):
    rows = _rows(spark, d)
    form = blocks.basis(rows, "miles", "bands", "station")
    names = list(form.terms("miles"))
    fit = blocks.robust(rows.withColumns(form.terms("miles")), "y", names)
    found = [(k, *(round(v, 6) for v in fit.contrast({n: 1.0}))) for k, n in enumerate(names)]
    return spark.createDataFrame(found, "band int, coefficient double, error double")


def _stage_sql(name: str, fitted: str, on: str) -> str:
    models = []
    for c, f in (("market", "yr"), ("size", "ls")):
        models.append(f"""SELECT '{name}' AS stage, '{c}' AS model, p.sale_price AS actual, exp(least(50, m.a + m.b * p.{f})) * e.s AS predicted FROM (SELECT * FROM s WHERE split IN ({on})) p,
 (SELECT regr_intercept(y, {f}) AS a, regr_slope(y, {f}) AS b FROM s WHERE split IN ({fitted})) m, (SELECT avg(exp(y - m.a - m.b * {f})) AS s FROM s, (SELECT regr_intercept(y, {f}) AS a, regr_slope(y, {f}) AS b FROM s WHERE split IN ({fitted})) m WHERE split IN ({fitted})) e""")
    return " UNION ALL ".join(models)


@query(f"""WITH {_ROWS}, years AS (SELECT sale_year, row_number() OVER (ORDER BY sale_year DESC) AS k FROM (SELECT DISTINCT sale_year FROM t)), s AS (SELECT t.*, CASE WHEN k = 1 THEN 'test' WHEN k = 2 THEN 'validation' ELSE 'train' END AS split FROM t JOIN years USING (sale_year)),
 p AS ({_stage_sql('validation', "'train'", "'validation'")} UNION ALL {_stage_sql('test', "'train', 'validation'", "'test'")}), q AS (SELECT stage, model, count(*) AS n, avg(abs(actual - predicted)) AS mae, sqrt(avg(pow(actual - predicted, 2))) AS rmse FROM p GROUP BY ALL)
 SELECT stage, model, n, round(mae, 3) AS mae, round(rmse, 3) AS rmse, model = (SELECT arg_min(model, mae) FROM q WHERE stage = 'validation') AS selected FROM q""")
def out_of_time_scoreboard(spark, d):
    rows = validation.chronological_split(_rows(spark, d), "sale_year")
    _, board = blocks.out_of_time(rows, "y", "sale_price", "split", {"size": ["ls"], "market": ["yr"]})
    return _rounded(board.select("stage", "model", "n", "mae", "rmse", "selected"), 3)
