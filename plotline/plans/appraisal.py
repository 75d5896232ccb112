"""Queries of projection, census features, card totals, robust hedonic fits, folds and coefficient stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.operators import cleaning, hedonic, indices, spatial, validation
from plotline.plans import proxies
from plotline.plans.catalog import _REPEAT, _rounded, query
from plotline.plans.proxies import SALES, SIZED, read

_DEGREES = "c_custkey AS id, 41.6 + ((c_custkey * 7919) % 5000) / 10000.0 AS latitude, -88.2 + ((c_custkey * 104729) % 7000) / 10000.0 AS longitude"
_X, _Y = spatial.project("latitude", "longitude")


@query(f"WITH d AS (SELECT {_DEGREES} FROM customer) SELECT id, round({_X}, 2) AS x, round({_Y}, 2) AS y FROM d")
def project_points(spark, d):
    return read(spark, d, "customer").selectExpr(*_DEGREES.split(", ")).selectExpr("id", f"round({_X}, 2) as x", f"round({_Y}, 2) as y")


_TRACTS = """c_custkey AS sale_id, CASE WHEN c_custkey % 11 = 0 THEN -666666666 ELSE 20000 + c_custkey % 90000 END AS median_household_income, c_custkey % 300 AS poverty_population, c_custkey % 7 * 100 AS poverty_universe,
 c_custkey % 50 AS bachelors_degree, c_custkey % 30 AS masters_degree, c_custkey % 9 AS professional_degree, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 5 END AS doctorate_degree, 90 AS population_25_plus,
 c_custkey % 80 AS owner_occupied_units, 100 AS occupied_units, 2000 AS acs_match_year, 1900 + c_custkey % 120 AS median_year_structure_built, c_custkey % 4000 AS population, c_custkey % 4 AS tract_land_sq_miles"""


@query(f"""WITH t AS (SELECT {_TRACTS} FROM customer), r AS (SELECT sale_id, CASE WHEN median_household_income > -100000000 THEN CAST(median_household_income AS DOUBLE) END AS income, poverty_population / nullif(CAST(poverty_universe AS DOUBLE), 0) AS poverty,
 (bachelors_degree + masters_degree + professional_degree + doctorate_degree) / 90.0 AS bachelors, owner_occupied_units / 100.0 AS owners, CAST(greatest(0, acs_match_year - median_year_structure_built) AS DOUBLE) AS age, population / nullif(CAST(tract_land_sq_miles AS DOUBLE), 0) AS density FROM t)
 SELECT sale_id, income AS median_household_income, round(CASE WHEN poverty BETWEEN 0 AND 1 THEN poverty END, 6) AS poverty_rate, round(CASE WHEN bachelors BETWEEN 0 AND 1 THEN bachelors END, 6) AS bachelors_or_higher_rate, round(owners, 6) AS owner_occupancy_rate, age AS median_housing_age, round(density, 4) AS population_density FROM r""")
def acs_features(spark, d):
    rows = cleaning.acs_features(read(spark, d, "customer").selectExpr(*_TRACTS.replace("\n", "").split(", ")))
    return rows.select("sale_id", "median_household_income", *(F.round(c, 6).alias(c) for c in ("poverty_rate", "bachelors_or_higher_rate", "owner_occupancy_rate")), "median_housing_age", F.round("population_density", 4).alias("population_density"))


@query("""WITH c AS (SELECT l_orderkey AS sale_id, l_linenumber AS card, l_quantity AS sqft, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_returnflag END AS kind, l_linenumber % 2 AS half, year(l_shipdate) - 40 AS built, l_linestatus = 'O' AS used FROM lineitem)
 SELECT sale_id, count(*) FILTER (used) AS card_count, sum(sqft) FILTER (used) AS building_sqft, max(sqft) FILTER (used) AS land_sqft, CAST(min(built) FILTER (used) AS DOUBLE) AS year_built, CAST(nullif(count(*) FILTER (used), 0) AS DOUBLE) + 0.5 * sum(half) FILTER (used) AS bathrooms, arg_min(kind, (card, kind)) FILTER (kind IS NOT NULL AND used) AS residence_type FROM c GROUP BY sale_id""")
def card_totals(spark, d):
    cards = read(spark, d, "lineitem").selectExpr("l_orderkey as sale_id", "l_linenumber as card", "if(l_linestatus = 'O', 2000, null) as property_match_year", "l_quantity as char_bldg_sf", "l_quantity as char_land_sf", "1 as char_fbath", "l_linenumber % 2 as char_hbath", "year(l_shipdate) - 40 as char_yrblt", "if(l_linenumber % 3 = 0, null, l_returnflag) as char_type_resd")
    return cleaning.aggregate_cards(cards).select("sale_id", "card_count", "building_sqft", "land_sqft", "year_built", "bathrooms", "residence_type")


def _logs(spark, d):
    return proxies.sized(spark, d).where("sale_price > 0 and building_sqft > 0").withColumns({"ly": F.ln("sale_price"), "ls": F.ln("building_sqft")})


_T = f"WITH {SIZED}, t AS (SELECT *, ln(sale_price) AS ly, ln(building_sqft) AS ls FROM sized WHERE sale_price > 0 AND building_sqft > 0)"


@query(f"""{_T}, f AS (SELECT regr_slope(ly, ls) AS b, regr_intercept(ly, ls) AS a, avg(ls) AS m, regr_sxx(ly, ls) AS s, count(*) AS n FROM t), r AS (SELECT ls, m, s, n, ly - a - b * ls AS e, 1.0 / n + (ls - m) * (ls - m) / s AS h FROM t, f)
 SELECT round(any_value(a), 5) AS intercept, round(any_value(b), 5) AS slope, round(sqrt(sum(pow(1.0 / r.n - m_ * (r.ls - m_) / s_, 2) * w)), 5) AS intercept_error, round(sqrt(sum(pow((r.ls - m_) / s_, 2) * w)), 5) AS slope_error, round(avg(exp(e)), 5) AS smearing FROM (SELECT *, m AS m_, s AS s_, e * e / ((1 - h) * (1 - h)) AS w FROM r) r, f""")
def hedonic_robust(spark, d):
    fit, smearing = hedonic.robust(_logs(spark, d), "ly", "ls")
    row = (*(round(x, 5) for x in (*fit.coefficients.values(), *fit.errors.values())), round(smearing, 5))
    return spark.createDataFrame([row], "intercept double, slope double, intercept_error double, slope_error double, smearing double")


@query(f"""{_T}, g AS (SELECT regr_intercept(ly, ls) AS a, regr_slope(ly, ls) AS b, regr_intercept(ly, ls) FILTER (sale_price >= 100000) AS a2, regr_slope(ly, ls) FILTER (sale_price >= 100000) AS b2 FROM t),
 p AS (SELECT 'const' AS term, a AS moderate, a2 AS strict FROM g UNION ALL SELECT 'ls', b, b2 FROM g) SELECT term, round(moderate, 5) AS moderate, round(strict, 5) AS strict, (moderate > 0) = (strict > 0) AS same_sign, round(abs(strict - moderate) / abs(moderate), 5) AS relative_change FROM p""")
def coefficient_stability(spark, d):
    t = _logs(spark, d)
    rows = hedonic.stability(hedonic.ols(t, "ly", "ls"), hedonic.ols(t.where("sale_price >= 100000"), "ly", "ls"))
    return _rounded(spark.createDataFrame(rows, "term string, moderate double, strict double, same_sign boolean, relative_change double"), 5)


@query(f"""WITH RECURSIVE {SALES}, g AS (SELECT CAST(nbhd AS VARCHAR) AS g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST(nbhd AS VARCHAR)) AS k FROM sales GROUP BY nbhd),
 f AS (SELECT CAST(0 AS BIGINT) AS k, [CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)] AS load, CAST(-1 AS BIGINT) AS fold
 UNION ALL SELECT g.k, list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + g.n ELSE x END), CAST(list_position(load, list_min(load)) - 1 AS BIGINT) FROM f JOIN g ON g.k = f.k + 1)
 SELECT fold, count(*) AS n_groups, sum(n)::BIGINT AS n FROM f JOIN g USING (k) GROUP BY fold""")
def group_folds(spark, d):
    rows = validation.group_folds(proxies.sales(spark, d), "nbhd", 5)
    return rows.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count_distinct("nbhd").alias("n_groups"), F.count("*").alias("n"))


@query(f"""{_REPEAT}, p AS (SELECT nbhd, year(prior_sale_date) AS a, sale_year AS b, log_change FROM pairs WHERE prior_nbhd = nbhd AND sale_year - year(prior_sale_date) = 1 AND sale_year = 1997)
 SELECT nbhd, CAST(1997 AS BIGINT) AS period, round(100 * exp(avg(log_change)), 4) AS index FROM p GROUP BY nbhd HAVING count(*) >= 5""")
def repeat_index_by_geography(spark, d):
    pairs = indices.repeat_sale_pairs(proxies.sales(spark, d)).withColumns({"a": F.year("prior_sale_date"), "b": F.col("sale_year")})
    rows = indices.repeat_index_by_geography(pairs.where("a = 1996 and b = 1997"), "a", "b")
    return spark.createDataFrame([(g, p, round(x, 4)) for g, p, x in rows if p == 1997], "nbhd long, period long, index double")
