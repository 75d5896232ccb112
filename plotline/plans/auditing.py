"""The sales audit over a stand-in table with every fault the checks know, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotline.operators import audit
from plotline.plans import proxies
from plotline.plans.catalog import _rounded, query
from plotline.plans.proxies import SIZED

#: Columns of the audited table and their types; the expressions mean the same in both dialects.
_COLUMNS = {
    "sale_id": ("bigint", "CASE WHEN sale_id % 64 = 1 THEN sale_id + 1 ELSE sale_id END"),
    "pin": ("string", "CASE WHEN sale_id % 41 = 0 THEN NULL ELSE pin END"),
    "sale_date": ("timestamp_ntz", "CASE WHEN sale_id % 43 = 0 THEN NULL ELSE sale_date END"),
    "sale_price": ("double", "CASE WHEN sale_id % 37 = 0 THEN NULL WHEN sale_id % 39 = 0 THEN sale_price * 10000 WHEN sale_id % 29 = 0 THEN CAST(5 AS DOUBLE) ELSE sale_price END"),
    "year": ("bigint", "CASE WHEN sale_id % 43 = 0 THEN NULL ELSE sale_year END"),
    "class": ("string", "class"),
    "building_sqft": ("double", "CASE WHEN sale_id % 31 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(building_sqft AS DOUBLE) END"),
    "land_sqft": ("bigint", "CASE WHEN sale_id % 23 = 0 THEN NULL ELSE 4000 + sale_id % 1000 END"),
    "bedrooms": ("bigint", "sale_id % 6"),
    "bathrooms": ("double", "CAST(1 + sale_id % 3 AS DOUBLE)"),
    "building_age": ("bigint", "(sale_id * 13) % 280 - 5"),
    "latitude": ("double", "CASE WHEN sale_id % 19 = 0 THEN NULL ELSE CAST(4140 + sale_id % 90 AS DOUBLE) / 100 END"),
    "longitude": ("double", "CAST(sale_id % 85 - 8830 AS DOUBLE) / 100"),
    "property_alignment_status": ("string", "CASE WHEN sale_id % 9 = 0 THEN 'unmatched_stale' ELSE 'historical' END"),
    "parcel_alignment_status": ("string", "CASE WHEN sale_id % 7 = 0 THEN 'unmatched_no_history' WHEN sale_id % 7 = 1 THEN NULL ELSE 'historical' END"),
    "acs_alignment_status": ("string", "'historical'"),
}
AUDITED = f"""{SIZED}, audited AS (SELECT {', '.join(f'{e} AS {c}' for c, (_, e) in _COLUMNS.items())} FROM sized)"""

_FLAGS = f"""{AUDITED}, marked AS (SELECT *, row_number() OVER () AS r, year(sale_date) AS y FROM audited), fence AS (SELECT quantile_cont(ln(building_sqft), 0.25) AS q1, quantile_cont(ln(building_sqft), 0.75) AS q3 FROM audited WHERE building_sqft > 0),
 compared AS (SELECT *, count(*) OVER (PARTITION BY sale_id) > 1 AS dq_duplicate_sale_id, count(*) OVER (PARTITION BY pin, sale_date, sale_price) > 1 AS dq_duplicate_transaction, count(*) OVER (PARTITION BY pin, y) > 1 AS dq_duplicate_pin_year,
  count(*) OVER (PARTITION BY pin) > 1 AS dq_repeated_sale_property, min(class) OVER (PARTITION BY pin, y) <> max(class) OVER (PARTITION BY pin, y) AS dq_property_class_inconsistency,
  pin IS NOT NULL AND sale_date IS NOT NULL AND coalesce(datesub('day', lag(sale_date) OVER (PARTITION BY pin ORDER BY sale_date NULLS LAST, sale_id), sale_date) <= 365, false) AS dq_rapid_resale FROM marked),
 checked AS (SELECT *, sale_price IS NULL AS dq_missing_sale_price, coalesce(sale_price < 10000 OR sale_price > 100000000, false) AS dq_implausible_sale_price, coalesce(building_sqft <= 0, false) AS dq_nonpositive_building_area,
  coalesce(CASE WHEN building_sqft > 0 THEN ln(building_sqft) < q1 - 1.5 * (q3 - q1) OR ln(building_sqft) > q3 + 1.5 * (q3 - q1) END, false) OR coalesce(building_sqft < 200 OR building_sqft > 20000, false) AS dq_building_sqft_outlier,
  building_age < 0 OR building_age > 250 AS dq_impossible_building_age, latitude IS NULL OR longitude IS NULL AS dq_missing_coordinates,
  latitude IS NOT NULL AND longitude IS NOT NULL AND (latitude NOT BETWEEN 41.45 AND 42.16 OR longitude NOT BETWEEN -88.27 AND -87.50) AS dq_coordinates_outside_cook_county,
  coalesce(starts_with(property_alignment_status, 'unmatched'), false) AS dq_failed_property_join, coalesce(starts_with(parcel_alignment_status, 'unmatched'), false) AS dq_failed_pin_geography_join, coalesce(starts_with(acs_alignment_status, 'unmatched'), false) AS dq_failed_acs_join,
  building_sqft IS NULL OR land_sqft IS NULL OR bedrooms IS NULL OR bathrooms IS NULL OR building_age IS NULL AS dq_missing_structural_characteristics FROM compared, fence)"""
_NAMES = [f"dq_{c}" for c in audit.CHECKS]


def audited(spark: SparkSession, d: str) -> DataFrame:
    return proxies.sized(spark, d).selectExpr(*(f"{e} AS {c}" for c, (_, e) in _COLUMNS.items()))


@query(f"WITH {_FLAGS} SELECT sale_id, pin, sale_date, {', '.join(_NAMES)}, {' + '.join(f'CAST({c} AS BIGINT)' for c in _NAMES)} AS dq_issue_count FROM checked")
def sales_audit_flags(spark, d):
    return audit.flagged(audited(spark, d)).select("sale_id", "pin", "sale_date", *_NAMES, "dq_issue_count")


_FINDINGS = " UNION ALL ".join(f"SELECT '{c}' AS \"check\", '{s}' AS severity, count(*) FILTER (dq_{c}) AS count, round(count(*) FILTER (dq_{c}) / count(*), 6) AS rate FROM checked" for c, s in audit.CHECKS.items())


@query(f"WITH {_FLAGS} {_FINDINGS}")
def sales_audit_findings(spark, d):
    return _rounded(audit.findings(audit.flagged(audited(spark, d))), 6)


@query(f"""WITH {_FLAGS} SELECT 'property' AS side, round(1 - avg(CAST(dq_failed_property_join AS INTEGER)), 6) AS rate FROM checked UNION ALL SELECT 'parcel', round(1 - avg(CAST(dq_failed_pin_geography_join AS INTEGER)), 6) FROM checked
 UNION ALL SELECT 'acs', round(1 - avg(CAST(dq_failed_acs_join AS INTEGER)), 6) FROM checked""")
def sales_audit_join_success(spark, d):
    return _rounded(audit.join_success(audit.flagged(audited(spark, d))), 6)


def _profile(c: str, kind: str) -> str:
    of = f"quantile_cont({c}, {{}})"
    shape = [f"avg({c})", f"stddev_samp({c})", *(of.format(q) for q in (0, 0.01, 0.25, 0.5, 0.75, 0.99, 1))] if kind in ("double", "bigint") else ["NULL::DOUBLE"] * 9
    named = ", ".join(f"round({x}, 3) AS {n}" for x, n in zip(shape, ("mean", "sd", "p00", "p01", "p25", "p50", "p75", "p99", "p100"), strict=True))
    return f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, count({c}) AS n, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*), 3) AS missing_rate, count(DISTINCT {c}) AS \"unique\", {named} FROM audited"


@query(f"WITH {AUDITED} {' UNION ALL '.join(_profile(c, kind) for c, (kind, _) in _COLUMNS.items())}")
def sales_audit_profiles(spark, d):
    return _rounded(audit.feature_profiles(audited(spark, d)), 3)


_TOP = ("class", "pin", "parcel_alignment_status")


@query(f"""WITH {AUDITED}, v AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, {c} AS value FROM audited" for c in _TOP)}), n AS (SELECT col, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY col, value)
 SELECT col AS "column", value, n, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS rank FROM n QUALIFY rank <= 10""")
def sales_audit_top_values(spark, d):
    return audit.top_values(audited(spark, d), list(_TOP))


_COVERED = [c for c in _COLUMNS if c != "year"]


@query(f"""WITH {AUDITED} {' UNION ALL '.join(f"SELECT '{c}' AS column, coalesce(CAST(year AS VARCHAR), 'unknown') AS year, round(avg(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END), 6) AS coverage FROM audited GROUP BY year" for c in _COVERED)}""".replace("AS column,", 'AS "column",'))
def sales_audit_coverage(spark, d):
    return _rounded(audit.coverage_by_year(audited(spark, d)), 6)
