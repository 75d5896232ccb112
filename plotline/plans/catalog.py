"""The domain queries over the stand-in tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotline.operators import asof, cleaning, comparables, indices, spatial, validation
from plotline.plans import proxies
from plotline.plans.proxies import PREDICTED, SALES, SIZED, read

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


# --- scans and projections ---------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
def src_projection_pushdown(spark, d):
    return read(spark, d, "orders").where("o_orderdate >= timestamp_ntz '1998-01-01' and o_orderdate < timestamp_ntz '1999-01-01'").select("o_orderkey", "o_totalprice")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, NULL AS brand FROM customer UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name, p_brand FROM part")
def src_union_by_name(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    p = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return c.unionByName(p, allowMissingColumns=True)


@query(f"WITH {SALES} SELECT DISTINCT pin FROM sales")
def pin_distinct(spark, d):
    return proxies.sales(spark, d).select("pin").where("pin is not null").distinct()


_PINS = "CASE o_orderkey % 5 WHEN 0 THEN o_orderkey || '-12.5' WHEN 1 THEN 'none' WHEN 2 THEN '01-02-003-' || o_custkey WHEN 3 THEN '123456789012345' ELSE CAST(o_custkey AS VARCHAR) END"


@query(f"""WITH t AS (SELECT o_orderkey, regexp_replace(split_part({_PINS}, '.', 1), '[^0-9]', '', 'g') AS digits FROM orders)
SELECT o_orderkey, CASE WHEN length(digits) BETWEEN 1 AND 14 THEN lpad(digits, 14, '0') END AS pin FROM t""")
def normalize_pin(spark, d):
    raw = _PINS.replace("VARCHAR", "string")
    return read(spark, d, "orders").select("o_orderkey", cleaning.normalize_pin(F.expr(raw)).alias("pin"))


_WORDS = "CASE o_orderkey % 7 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' WHEN 2 THEN '1' WHEN 3 THEN 'F' WHEN 4 THEN 'maybe' WHEN 5 THEN 'Yes' ELSE NULL END"


@query(f"""WITH t AS (SELECT o_orderkey, lower({_WORDS}) AS w FROM orders)
SELECT o_orderkey, CASE WHEN w IN ('true','t','yes','1') THEN 'true' WHEN w IN ('false','f','no','0') THEN 'false' END AS flag FROM t""")
def lenient_boolean(spark, d):
    return read(spark, d, "orders").select("o_orderkey", cleaning.lenient_boolean(F.expr(_WORDS)).cast("string").alias("flag"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE substr(sha256(o_custkey || '|' || o_orderpriority), 1, 24) END AS id FROM orders")
def stable_id(spark, d):
    return read(spark, d, "orders").select("o_orderkey", cleaning.stable_id(F.expr("if(o_orderkey % 3 = 0, cast(o_orderkey as string), null)"), "o_custkey", "o_orderpriority").alias("id"))


_GARAGE = "CASE p_partkey % 4 WHEN 0 THEN p_size || ' cars' WHEN 1 THEN 'No' WHEN 2 THEN '1.5 spaces' ELSE 'attached' END"


@query(f"""WITH t AS (SELECT p_partkey, {_GARAGE} AS g FROM part)
SELECT p_partkey, CASE WHEN lower(trim(g)) = 'no' THEN 0.0 ELSE TRY_CAST(nullif(regexp_extract(g, '([0-9]+([.][0-9]+)?)', 1), '') AS DOUBLE) END AS spaces FROM t""")
def garage_parse(spark, d):
    return read(spark, d, "part").select("p_partkey", cleaning.garage_spaces(F.expr(_GARAGE)).alias("spaces"))


@query("SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN CAST(p_retailprice AS VARCHAR) ELSE p_brand END AS DOUBLE) AS price FROM part")
def coerce_numeric(spark, d):
    return read(spark, d, "part").select("p_partkey", cleaning.number(F.expr("if(p_partkey % 3 = 0, cast(p_retailprice as string), p_brand)")).alias("price"))


@query("""WITH t AS (SELECT s_nationkey, count(*) AS suppliers, count(*) FILTER (WHERE s_acctbal > 0) AS solvent, count(*) FILTER (WHERE s_acctbal > 5000) AS rich FROM supplier GROUP BY s_nationkey)
SELECT CAST(s_nationkey AS BIGINT) AS nation, round(CAST(solvent AS DOUBLE) / nullif(suppliers, 0), 6) AS solvent_rate, round(CASE WHEN CAST(rich AS DOUBLE) / nullif(solvent, 0) BETWEEN 0 AND 1 THEN CAST(rich AS DOUBLE) / nullif(solvent, 0) END, 6) AS rich_rate FROM t""")
def acs_rates(spark, d):
    t = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"), F.count_if(F.col("s_acctbal") > 0).alias("solvent"), F.count_if(F.col("s_acctbal") > 5000).alias("rich"))
    return _rounded(t.select(F.col("s_nationkey").alias("nation"), cleaning.rate("solvent", "suppliers").alias("solvent_rate"), cleaning.rate("rich", "solvent").alias("rich_rate")), 6)


@query(f"""WITH {SIZED}, v AS (SELECT sale_id, (sale_id * 7) % 130 - 5 AS age, CASE WHEN sale_id % 17 = 0 THEN -building_sqft ELSE building_sqft / 3 END AS size FROM sized)
SELECT sale_id, CASE WHEN age <= 9 THEN '0-9' WHEN age <= 24 THEN '10-24' WHEN age <= 49 THEN '25-49' WHEN age <= 74 THEN '50-74' WHEN age <= 99 THEN '75-99' WHEN age IS NOT NULL THEN '100+' END AS age_band,
 CASE WHEN size > 2999 THEN '3,000+' WHEN size > 1999 THEN '2,000-2,999' WHEN size > 1499 THEN '1,500-1,999' WHEN size > 999 THEN '1,000-1,499' WHEN size > 0 THEN '<1,000' END AS size_band FROM v""")
def age_size_bands(spark, d):
    v = proxies.sized(spark, d).selectExpr("sale_id", "(sale_id * 7) % 130 - 5 as age", "if(sale_id % 17 = 0, -building_sqft, building_sqft / 3) as size")
    return v.select("sale_id", cleaning.age_band("age").alias("age_band"), cleaning.size_band("size").alias("size_band"))


_RAW = """SELECT sale_id, pin, sale_date, CASE WHEN sale_id % 11 = 0 THEN sale_price / 1000 ELSE sale_price END AS sale_price,
 CASE sale_id % 4 WHEN 0 THEN '211' WHEN 1 THEN '299' ELSE '203' END AS class, CASE sale_id % 13 WHEN 0 THEN NULL WHEN 1 THEN 'true' ELSE 'false' END AS sale_filter_deed_type,
 CASE sale_id % 23 WHEN 0 THEN 'true' ELSE 'false' END AS sale_filter_same_sale_within_365, CASE WHEN sale_id % 11 = 0 AND sale_price < 10000000 THEN 'true' WHEN sale_id % 29 = 0 THEN NULL ELSE 'false' END AS sale_filter_less_than_10k,
 CASE sale_id % 17 WHEN 0 THEN 'true' WHEN 1 THEN NULL ELSE 'false' END AS is_multisale FROM sales"""


def _raw_sales(spark, d):
    return proxies.sales(spark, d).selectExpr("sale_id", "pin", "sale_date", "if(sale_id % 11 = 0, sale_price / 1000, sale_price) as sale_price", "case sale_id % 4 when 0 then '211' when 1 then '299' else '203' end as class", "case sale_id % 13 when 0 then null when 1 then 'true' else 'false' end as sale_filter_deed_type", "case sale_id % 23 when 0 then 'true' else 'false' end as sale_filter_same_sale_within_365", "case when sale_id % 11 = 0 and sale_price < 10000000 then 'true' when sale_id % 29 = 0 then null else 'false' end as sale_filter_less_than_10k", "case sale_id % 17 when 0 then 'true' when 1 then null else 'false' end as is_multisale")


_CLASSIFIED = f"""WITH {SALES}, raw AS ({_RAW}), c AS (SELECT sale_id, concat_ws('|', CASE WHEN sale_price < 10000 THEN 'price_below_minimum' END, CASE WHEN class <> '203' THEN 'non_target_property_class' END,
 CASE WHEN sale_filter_same_sale_within_365 = 'true' THEN 'sale_filter_same_sale_within_365' END, CASE WHEN sale_filter_less_than_10k = 'true' THEN 'sale_filter_less_than_10k' END, CASE WHEN sale_filter_deed_type = 'true' THEN 'sale_filter_deed_type' END) AS exclusion_reasons,
 concat_ws('|', CASE WHEN sale_filter_deed_type IS NULL OR sale_filter_less_than_10k IS NULL THEN 'missing_sale_filter_metadata' END, CASE WHEN is_multisale = 'true' THEN 'multi_parcel_sale' END) AS ambiguity_reasons FROM raw),
 done AS (SELECT *, CASE WHEN exclusion_reasons <> '' THEN 'excluded' WHEN ambiguity_reasons <> '' THEN 'ambiguous' ELSE 'market' END AS population_status FROM c)"""


@query(f"{_CLASSIFIED} SELECT *, population_status = 'market' AS is_primary_population FROM done")
def classify_sales(spark, d):
    c = cleaning.classify_sales(_raw_sales(spark, d))
    return c.select("sale_id", F.array_join("exclusion_reasons", "|").alias("exclusion_reasons"), F.array_join("ambiguity_reasons", "|").alias("ambiguity_reasons"), "population_status", "is_primary_population")


@query(f"{_CLASSIFIED} SELECT population_status, count(*) AS n FROM done GROUP BY population_status")
def population_status_counts(spark, d):
    return cleaning.classify_sales(_raw_sales(spark, d)).groupBy("population_status").agg(F.count("*").alias("n"))


@query(f"""WITH {SALES}, raw AS ({_RAW}) SELECT sale_id, coalesce(sale_filter_deed_type = 'false', false) AND coalesce(is_multisale = 'false', false) AND sale_price >= 25000 AND class = '203' AS strict_market,
 coalesce(sale_filter_deed_type, 'false') = 'false' AND coalesce(is_multisale = 'false', false) AND sale_price >= 10000 AND class IN ('203', '211') AS moderate_market FROM raw""")
def filter_definitions(spark, d):
    return cleaning.market_samples(_raw_sales(spark, d), ["sale_filter_deed_type"]).select("sale_id", "strict_market", "moderate_market")


# --- joins -------------------------------------------------------------------------------------

_ASOF = f"""WITH {SALES}, snapshots AS (SELECT DISTINCT pin, sale_year AS year FROM sales WHERE status = 'F' AND sale_id % 3 = 0),
 best AS (SELECT s.sale_id, s.sale_year, max(n.year) AS past, count(n.year) AS matched FROM sales s LEFT JOIN snapshots n ON s.pin = n.pin AND n.year <= s.sale_year GROUP BY s.sale_id, s.sale_year),
 done AS (SELECT sale_id, CASE WHEN sale_year - past <= 2 THEN past END AS snapshot_match_year, CASE WHEN sale_year = past THEN 'exact' WHEN sale_year - past <= 2 THEN 'historical' WHEN past IS NOT NULL THEN 'unmatched_stale' ELSE 'unmatched_no_history' END AS snapshot_alignment_status,
 CASE WHEN sale_year - past <= 2 THEN sale_year - past END AS snapshot_lag_years FROM best)"""


def _aligned(spark, d):
    sales = proxies.sales(spark, d)
    shots = sales.where("status = 'F' and sale_id % 3 = 0").select("pin", F.col("sale_year").alias("year"))
    return asof.align_snapshots(sales, shots, "pin", max_lag=2)


@query(f"{_ASOF} SELECT * FROM done")
def asof_alignment(spark, d):
    return _rounded(_aligned(spark, d).select("sale_id", "snapshot_match_year", "snapshot_alignment_status", "snapshot_lag_years"))


@query(f"{_ASOF} SELECT snapshot_alignment_status, count(*) AS n FROM done GROUP BY snapshot_alignment_status")
def alignment_status_counts(spark, d):
    return _aligned(spark, d).groupBy("snapshot_alignment_status").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderdate, count(*) AS n_rows FROM orders GROUP BY ALL HAVING count(*) > 1")
def dup_key_check(spark, d):
    return asof.duplicate_keys(read(spark, d, "orders"), "o_custkey", "o_orderdate")


@query(f"WITH {SIZED} SELECT sale_id, building_sqft, ppsf FROM sized")
def enrich_left_join(spark, d):
    return proxies.sized(spark, d).select("sale_id", "building_sqft", "ppsf")


_CARDS = "sum(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END)"


@query(f"""SELECT l_orderkey AS sale_id, count(*) AS n_cards, {_CARDS} AS rooms, max(l_extendedprice) AS land, CAST(min(year(l_shipdate)) AS BIGINT) AS year_built, bool_or(l_discount > 0.05) AS basement FROM lineitem GROUP BY l_orderkey""")
def card_aggregation(spark, d):
    t = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sale_id"))
    return t.agg(F.count("*").alias("n_cards"), F.sum(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity"))).alias("rooms"), F.max("l_extendedprice").alias("land"), F.min(F.year("l_shipdate")).cast("long").alias("year_built"), F.bool_or(F.col("l_discount") > 0.05).alias("basement"))


@query("""SELECT s.s_suppkey, count(*) AS n, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS brands FROM supplier s JOIN lineitem l ON s.s_suppkey = l.l_suppkey JOIN part p ON p.p_partkey = l.l_partkey
 WHERE p_size > 40 AND EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F') GROUP BY s.s_suppkey""")
def semi_join_chain(spark, d):
    big = read(spark, d, "part").where("p_size > 40").select("p_partkey", "p_brand")
    done = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").join(done, "l_orderkey", "left_semi").join(big, F.col("l_partkey") == F.col("p_partkey"))
    s = read(spark, d, "supplier").select("s_suppkey")
    return s.join(lines, F.col("s_suppkey") == F.col("l_suppkey")).groupBy("s_suppkey").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("p_brand")), "|").alias("brands"))


_STATIONS = "stations AS (SELECT s_name AS station, CAST((s_suppkey * 7919) % 52800 AS DOUBLE) AS x, CAST((s_suppkey * 104729) % 52800 AS DOUBLE) AS y FROM supplier)"


@query(f"""WITH {_STATIONS}, points AS (SELECT c_custkey AS id, CAST((c_custkey * 7919 + 13) % 52800 AS DOUBLE) AS x, CAST((c_custkey * 104729 + 7) % 52800 AS DOUBLE) AS y FROM customer),
 far AS (SELECT id, station, sqrt((p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y)) AS dist FROM points p, stations s)
 SELECT id, arg_min(station, (dist, station)) AS nearest_station, round(min(dist), 4) AS nearest_distance, count(*) FILTER (WHERE dist <= 2640) AS stations_half_mile, count(*) FILTER (WHERE dist <= 5280) AS stations_one_mile FROM far GROUP BY id""")
def nearest_station(spark, d):
    s = read(spark, d, "supplier").selectExpr("s_name as station", "cast((s_suppkey * 7919) % 52800 as double) as x", "cast((s_suppkey * 104729) % 52800 as double) as y")
    p = read(spark, d, "customer").selectExpr("c_custkey as id", "cast((c_custkey * 7919 + 13) % 52800 as double) as x", "cast((c_custkey * 104729 + 7) % 52800 as double) as y")
    return _rounded(spatial.nearest(p, s, "id", "station", {"stations_half_mile": 2640, "stations_one_mile": 5280}))


_COMPS = f"""WITH {SALES}, pairs AS (SELECT t.sale_id AS target_sale_id, c.sale_id AS comparable_sale_id, c.sale_price AS comparable_price, sqrt((t.x-c.x)*(t.x-c.x)+(t.y-c.y)*(t.y-c.y)) AS distance, CAST(datesub('day', c.sale_date, t.sale_date) AS BIGINT) AS days
 FROM sales t JOIN sales c ON t.residence_type = c.residence_type AND c.sale_date < t.sale_date AND t.pin <> c.pin AND abs(t.x-c.x) <= 2640 AND abs(t.y-c.y) <= 2640),
 weighted AS (SELECT *, exp(-distance / 1320) * pow(2.0, -days / 180.0) AS weight FROM pairs WHERE distance <= 2640 AND days BETWEEN 1 AND 365),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY target_sale_id ORDER BY weight DESC, comparable_sale_id) AS rank FROM weighted),
 links AS (SELECT *, weight / sum(weight) OVER (PARTITION BY target_sale_id) AS normalized_weight FROM ranked WHERE rank <= 5)"""


def _links(spark, d):
    return spatial.comparables(proxies.sales(spark, d), 2640.0, 365, 5, 1320.0, 180.0)


@query(f"{_COMPS} SELECT target_sale_id, comparable_sale_id, CAST(rank AS BIGINT) AS rank, days, round(distance, 4) AS distance, round(normalized_weight, 6) AS normalized_weight FROM links")
def comparable_sales(spark, d):
    return _rounded(_links(spark, d).select("target_sale_id", "comparable_sale_id", "rank", "days", F.round("distance", 4).alias("distance"), F.round("normalized_weight", 6).alias("normalized_weight")), 6)


@query(f"""{_COMPS} SELECT target_sale_id, count(*) FILTER (WHERE distance <= 1320) AS n_quarter, count(*) AS n_half, round(sum(weight * comparable_price) / sum(weight), 2) AS estimate, round(pow(sum(weight), 2) / sum(weight * weight), 6) AS effective_n FROM links GROUP BY target_sale_id""")
def information_decay(spark, d):
    w, p = F.col("weight"), F.col("comparable_price")
    t = _links(spark, d).groupBy("target_sale_id").agg(F.count_if(F.col("distance") <= 1320).alias("n_quarter"), F.count("*").alias("n_half"), (F.sum(w * p) / F.sum(w)).alias("estimate"), (F.pow(F.sum(w), 2) / F.sum(w * w)).alias("effective_n"))
    return t.withColumns({"estimate": F.round("estimate", 2), "effective_n": F.round("effective_n", 6)})


@query(f"""WITH {SALES} SELECT t.sale_id, count(c.sale_id) AS prior_count, round(quantile_cont(c.sale_price, 0.5), 4) AS prior_median FROM sales t LEFT JOIN sales c ON c.sale_date < t.sale_date AND t.pin <> c.pin AND abs(t.x-c.x) <= 5280 AND abs(t.y-c.y) <= 5280
 AND sqrt((t.x-c.x)*(t.x-c.x)+(t.y-c.y)*(t.y-c.y)) <= 5280 AND datesub('day', c.sale_date, t.sale_date) BETWEEN 1 AND 1095 GROUP BY t.sale_id""")
def prior_nearby_features(spark, d):
    s = proxies.sales(spark, d).select("sale_id", "pin", "sale_date", "sale_price", "x", "y")
    return _rounded(comparables.prior_medians(s, 5280.0, 1095))


_KNN = """WITH p AS (SELECT c_custkey AS id, CAST((c_custkey * 7919) % 52800 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 52800 AS DOUBLE) AS y, c_acctbal AS value FROM customer),
 r AS (SELECT a.id AS i, b.id AS j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), b.id) AS rank FROM p a JOIN p b ON a.id <> b.id),
 e AS (SELECT * FROM r WHERE rank <= 8), lagged AS (SELECT e.i AS id, avg(p.value) AS lag FROM e JOIN p ON p.id = e.j GROUP BY e.i)"""


def _edges(spark, d):
    p = proxies.points(spark, d)
    return p, spatial.knn(p.select("id", "x", "y"), "id", 8)


@query(f"{_KNN} SELECT i, j, CAST(rank AS BIGINT) AS rank, round(distance, 4) AS distance FROM e")
def knn_weights(spark, d):
    return _rounded(_edges(spark, d)[1])


@query(f"{_KNN} SELECT p.id, p.value, round(lag, 6) AS lag FROM p JOIN lagged USING (id)")
def wx_spatial_lag(spark, d):
    p, e = _edges(spark, d)
    return spatial.spatial_lag(p, e, "id", "value").withColumn("lag", F.round("lag", 6))


@query(f"{_KNN}, m AS (SELECT avg(value) AS m FROM p) SELECT count(*) AS n, round(sum((value - m) * (lag - m)) / sum((value - m) * (value - m)), 6) AS moran_i, round(-1.0 / (count(*) - 1), 6) AS expected_i FROM p JOIN lagged USING (id), m")
def moran_i(spark, d):
    p, e = _edges(spark, d)
    return _rounded(spatial.moran(p, e, "id", "value"), 6)


# --- aggregates and windows --------------------------------------------------------------------


@query(f"""WITH {SIZED}, long AS (SELECT 'nbhd' AS "grouping", CAST(nbhd AS VARCHAR) AS level, * FROM sized UNION ALL SELECT 'residence_type', residence_type, * FROM sized UNION ALL SELECT 'class', class, * FROM sized)
 SELECT "grouping", level, count(*) AS n, round(avg(sale_price), 5) AS mean_price, round(quantile_cont(sale_price, 0.5), 5) AS median_price, round(quantile_cont(sale_price, 0.25), 5) AS p25_price, round(quantile_cont(sale_price, 0.75), 5) AS p75_price, round(quantile_cont(ppsf, 0.5), 5) AS median_ppsf FROM long GROUP BY "grouping", level""")
def group_summary(spark, d):
    return _rounded(indices.group_summary(proxies.sized(spark, d), "nbhd", "residence_type", "class"), 5)


@query(f"WITH {SALES} SELECT nbhd, sale_year, round(quantile_cont(sale_price, 0.75) - quantile_cont(sale_price, 0.25), 4) AS iqr FROM sales GROUP BY nbhd, sale_year")
def neighborhood_dispersion(spark, d):
    return _rounded(proxies.sales(spark, d).groupBy("nbhd", "sale_year").agg((indices.quantile("sale_price", 0.75) - indices.quantile("sale_price", 0.25)).alias("iqr")))


_PANEL = f"""WITH {SIZED}, panel AS (SELECT nbhd AS geo, sale_year AS year, count(*) AS n, quantile_cont(ppsf, 0.5) AS level FROM sized GROUP BY nbhd, sale_year HAVING count(*) >= 5),
 idx AS (SELECT *, 100 * level / first_value(level) OVER (PARTITION BY geo ORDER BY year) AS index FROM panel),
 years AS (SELECT year, lag(year) OVER (ORDER BY year) AS previous_year FROM (SELECT DISTINCT year FROM panel)),
 grown AS (SELECT i.*, ln(i.index / o.index) AS log_growth FROM idx i JOIN years USING (year) LEFT JOIN idx o ON o.geo = i.geo AND o.year = years.previous_year)"""


def _panel(spark, d):
    return indices.level_index(proxies.sized(spark, d), "nbhd", F.col("ppsf"), 5)


@query(f"{_PANEL} SELECT geo, year, n, round(level, 6) AS level, round(index, 6) AS index FROM idx")
def ppsf_index(spark, d):
    return _rounded(_panel(spark, d), 6)


@query(f"{_PANEL} SELECT geo, year, round(log_growth, 6) AS log_growth FROM grown")
def neighborhood_panel(spark, d):
    return _rounded(indices.growth(_panel(spark, d)).select("geo", "year", "log_growth"), 6)


@query(f"{_PANEL} SELECT x.geo AS a, y.geo AS b, count(*) AS overlap, round(corr(x.log_growth, y.log_growth), 6) AS correlation FROM grown x JOIN grown y ON x.year = y.year AND x.geo < y.geo WHERE x.log_growth IS NOT NULL AND y.log_growth IS NOT NULL GROUP BY x.geo, y.geo HAVING count(*) >= 4")
def growth_comovement(spark, d):
    return _rounded(indices.comovement(indices.growth(_panel(spark, d)), 4), 6)


_REPEAT = f"""WITH {SALES}, d AS (SELECT *, count(*) OVER (PARTITION BY pin, sale_date) AS same_day FROM sales WHERE sale_price > 0),
 l AS (SELECT *, lag(sale_id) OVER w AS prior_sale_id, lag(sale_date) OVER w AS prior_sale_date, lag(sale_price) OVER w AS prior_sale_price, lag(nbhd) OVER w AS prior_nbhd FROM d WHERE same_day = 1 WINDOW w AS (PARTITION BY pin ORDER BY sale_date)),
 pairs AS (SELECT *, CAST(datesub('day', prior_sale_date, sale_date) AS BIGINT) AS days, ln(sale_price / prior_sale_price) AS log_change FROM l WHERE prior_sale_id IS NOT NULL AND datesub('day', prior_sale_date, sale_date) >= 1)"""


def _pairs(spark, d):
    return indices.repeat_sale_pairs(proxies.sales(spark, d))


@query(f"{_REPEAT} SELECT sale_id, prior_sale_id, days, round(log_change, 6) AS log_change, round(log_change * 365.2425 / days, 6) AS annual_log_growth, prior_nbhd = nbhd AS geography_consistent FROM pairs WHERE days >= 30")
def repeat_sale_pairs(spark, d):
    p = _pairs(spark, d).where("days >= 30")
    return p.select("sale_id", "prior_sale_id", "days", F.round("log_change", 6).alias("log_change"), F.round(F.col("log_change") * indices.DAYS_PER_YEAR / F.col("days"), 6).alias("annual_log_growth"), "geography_consistent")


@query(f"{_REPEAT} SELECT CAST(year(prior_sale_date) AS BIGINT) AS start_period, sale_year AS end_period, count(*) AS n_pairs, round(sum(log_change), 6) AS sum_log_change FROM pairs GROUP BY 1, 2")
def bmn_sufficient_stats(spark, d):
    p = _pairs(spark, d).withColumn("start_year", F.year("prior_sale_date"))
    return _rounded(indices.repeat_sales_statistics(p, "start_year", "sale_year"), 6)


@query(f"{_REPEAT} SELECT nbhd, sale_year, count(*) AS n, round(quantile_cont(log_change, 0.5), 6) AS median_log_change FROM pairs GROUP BY nbhd, sale_year")
def repeat_sales_summary(spark, d):
    return _rounded(_pairs(spark, d).groupBy("nbhd", "sale_year").agg(F.count("*").alias("n"), indices.median("log_change").alias("median_log_change")), 6)


@query(f"""WITH {SALES}, y AS (SELECT sale_year AS year, count(*) AS n, quantile_cont(sale_price, 0.5) AS median_price FROM sales GROUP BY sale_year), g AS (SELECT *, median_price / lag(median_price) OVER (ORDER BY year) - 1 AS growth, CAST(n AS DOUBLE) / lag(n) OVER (ORDER BY year) - 1 AS volume_growth FROM y)
 SELECT year, n, round(median_price, 4) AS median_price, round(growth, 6) AS growth, round(volume_growth, 6) AS volume_growth, CASE WHEN growth IS NULL THEN 'baseline' WHEN growth >= 0.1 THEN 'boom' WHEN growth <= -0.1 THEN 'bust' ELSE 'stable' END AS phase FROM g""")
def market_cycles(spark, d):
    y = proxies.sales(spark, d).groupBy(F.col("sale_year").alias("year")).agg(F.count("*").alias("n"), indices.median("sale_price").alias("median_price"))
    return indices.market_cycles(y).withColumns({"median_price": F.round("median_price", 4), "growth": F.round("growth", 6), "volume_growth": F.round("volume_growth", 6)})


@query(f"""WITH {SIZED} SELECT nbhd AS geo, count(*) AS n, min(sale_year) AS first_year, max(sale_year) AS last_year, round(quantile_cont(sale_price, 0.5), 4) AS median_price, round(quantile_cont(ppsf, 0.5), 4) AS median_ppsf, round(stddev_samp(ln(ppsf)), 4) AS sd_log_ppsf,
 round(CAST(count(*) AS DOUBLE) / greatest(1, max(sale_year) - min(sale_year)), 4) AS velocity FROM sized GROUP BY nbhd""")
def market_profiles(spark, d):
    return _rounded(indices.market_profiles(proxies.sized(spark, d), "nbhd"))


@query(f"WITH {SALES}, r AS (SELECT *, row_number() OVER (PARTITION BY pin ORDER BY sale_date DESC, sale_id DESC) AS k FROM sales) SELECT pin, sale_id, sale_price FROM r WHERE k = 1")
def latest_per_pin(spark, d):
    return indices.latest_per_group(proxies.sales(spark, d), "pin", F.desc("sale_date"), F.desc("sale_id")).select("pin", "sale_id", "sale_price")


@query(f"WITH {SALES}, c AS (SELECT nbhd, residence_type, count(*) AS n FROM sales GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY nbhd ORDER BY n DESC, residence_type) AS k FROM c) SELECT nbhd, residence_type, n FROM r WHERE k = 1")
def dominant_category(spark, d):
    return indices.dominant(proxies.sales(spark, d), "nbhd", "residence_type")


_LABELS = f"""WITH {SALES}, g AS (SELECT nbhd, sale_year, quantile_cont(sale_price, 0.5) AS m FROM sales GROUP BY nbhd, sale_year), labels AS (SELECT nbhd, sale_year, CASE WHEN m > 155000 THEN 'high' WHEN m > 145000 THEN 'middle' ELSE 'low' END AS label FROM g)"""


@query(f"""{_LABELS}, t AS (SELECT a.label AS from_label, b.label AS to_label, count(*) AS n FROM labels a JOIN labels b ON a.nbhd = b.nbhd AND b.sale_year = a.sale_year + 1 GROUP BY ALL)
 SELECT from_label, to_label, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY from_label), 6) AS share FROM t""")
def segment_transitions(spark, d):
    m = proxies.sales(spark, d).groupBy("nbhd", "sale_year").agg(indices.median("sale_price").alias("m"))
    labels = m.select("nbhd", "sale_year", F.when(F.col("m") > 155000, "high").when(F.col("m") > 145000, "middle").otherwise("low").alias("label"))
    return _rounded(indices.transitions(labels, "nbhd", "sale_year", "label"), 6)


@query(f"WITH {SALES} SELECT max(sale_year) AS year, count(DISTINCT nbhd) AS geographies, count(*) AS n, round(quantile_cont(sale_price, 0.5), 4) AS median_price FROM sales WHERE sale_year = (SELECT max(sale_year) FROM sales)")
def market_summary(spark, d):
    s = proxies.sales(spark, d)
    last = s.where(F.col("sale_year") == s.agg(F.max("sale_year")).first()[0])
    return _rounded(last.agg(F.max("sale_year").alias("year"), F.count_distinct("nbhd").alias("geographies"), F.count("*").alias("n"), indices.median("sale_price").alias("median_price")))


@query(f"WITH {SALES} SELECT nbhd, count(*) AS n FROM sales GROUP BY nbhd ORDER BY n DESC, nbhd LIMIT 10")
def topk_volume(spark, d):
    return proxies.sales(spark, d).groupBy("nbhd").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "nbhd").limit(10)


@query(f"WITH {SALES} SELECT sale_id, sale_price FROM sales ORDER BY sale_date DESC, sale_id LIMIT 50 OFFSET 100")
def paginate(spark, d):
    return proxies.sales(spark, d).orderBy(F.desc("sale_date"), "sale_id").offset(100).limit(50).select("sale_id", "sale_price")


@query(f"""WITH {SALES}, t AS (SELECT * FROM sales WHERE sale_id = (SELECT max(sale_id) FROM sales)) SELECT c.sale_id, round(sqrt((t.x-c.x)*(t.x-c.x)+(t.y-c.y)*(t.y-c.y)), 4) AS distance FROM sales c, t
 WHERE c.sale_date < t.sale_date AND c.pin <> t.pin AND c.residence_type = t.residence_type AND sqrt((t.x-c.x)*(t.x-c.x)+(t.y-c.y)*(t.y-c.y)) <= 10560 ORDER BY distance, c.sale_date DESC, c.sale_id LIMIT 5""")
def serve_comparables(spark, d):
    s = proxies.sales(spark, d)
    t = s.orderBy(F.desc("sale_id")).first()
    far = F.round(spatial.distance(F.col("x"), F.col("y"), F.lit(t.x), F.lit(t.y)), 4)
    near = s.where((F.col("sale_date") < F.lit(t.sale_date)) & (F.col("pin") != t.pin) & (F.col("residence_type") == t.residence_type)).withColumn("distance", far).where("distance <= 10560")
    return near.orderBy("distance", F.desc("sale_date"), "sale_id").limit(5).select("sale_id", "distance")


# --- validation --------------------------------------------------------------------------------

_METRICS = """count(*) AS n, round(avg(abs(sale_price - prediction)), 4) AS mae, round(quantile_cont(abs(sale_price - prediction), 0.5), 4) AS median_ae, round(quantile_cont(abs(sale_price - prediction) / sale_price, 0.5), 4) AS median_ape,
 round(avg(abs(sale_price - prediction) / sale_price), 4) AS mape, round(sqrt(avg((sale_price - prediction) ** 2)), 4) AS rmse, round(1 - sum((sale_price - prediction) ** 2) / (var_pop(sale_price) * count(*)), 4) AS r2"""
_LONG = f"{PREDICTED}, long AS (SELECT sale_id, sale_price, nbhd, residence_type, 'prediction_a' AS model, prediction_a AS prediction FROM predicted UNION ALL SELECT sale_id, sale_price, nbhd, residence_type, 'prediction_b', prediction_b FROM predicted)"


def _long(spark, d):
    return validation.unpivot_predictions(proxies.predicted(spark, d), "sale_id", "sale_price", "nbhd", "residence_type")


@query(f"WITH {_LONG} SELECT model, {_METRICS} FROM long GROUP BY model")
def regression_metrics(spark, d):
    return _rounded(validation.metrics(_long(spark, d), "sale_price", "prediction", "model"))


@query(f"WITH {_LONG} SELECT model, residence_type, {_METRICS} FROM long GROUP BY model, residence_type")
def error_segments(spark, d):
    return _rounded(validation.metrics(_long(spark, d), "sale_price", "prediction", "model", "residence_type"))


@query(f"""WITH {_LONG}, m AS (SELECT model, nbhd, count(*) AS n, quantile_cont(abs(sale_price - prediction) / sale_price, 0.5) AS median_ape FROM long WHERE sale_price <> 0 GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(median_ape, 9) DESC, nbhd) AS rank FROM m WHERE n >= 5) SELECT model, nbhd, n, round(median_ape, 6) AS median_ape, rank FROM r WHERE rank <= 10""")
def worst_segments(spark, d):
    ape = F.abs(F.col("sale_price") - F.col("prediction")) / F.col("sale_price")
    m = _long(spark, d).where("sale_price <> 0").groupBy("model", "nbhd").agg(F.count("*").alias("n"), indices.median(ape).alias("median_ape"))
    return _rounded(validation.worst_groups(m, "model", "median_ape", "n", least=5), 6)


@query(f"""WITH {_LONG}, s AS (SELECT model, abs(sale_price - prediction) AS score, row_number() OVER (PARTITION BY model ORDER BY abs(sale_price - prediction)) AS r, count(*) OVER (PARTITION BY model) AS n FROM long), lv AS (SELECT unnest([0.5, 0.8, 0.9]) AS level)
 SELECT model, CAST(level AS DOUBLE) AS level, round(score, 4) AS radius FROM s, lv WHERE r = ceil(least(1.0, ceil((n + 1) * CAST(level AS DOUBLE)) / n) * (n - 1)) + 1""")
def conformal_radius(spark, d):
    s = _long(spark, d).withColumn("score", F.abs(F.col("sale_price") - F.col("prediction")))
    return _rounded(validation.conformal_radius(s, "model", "score", 0.5, 0.8, 0.9))


@query(f"""WITH {PREDICTED}, i AS (SELECT *, prediction_a * 0.95 AS low, prediction_a * 1.05 AS high FROM predicted), l AS (SELECT 'overall' AS dimension, 'all' AS segment, * FROM i UNION ALL SELECT 'residence_type', residence_type, * FROM i)
 SELECT dimension, segment, count(*) AS n, round(avg(CASE WHEN sale_price BETWEEN low AND high THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(quantile_cont(high - low, 0.5), 4) AS median_width FROM l GROUP BY ALL""")
def interval_coverage(spark, d):
    i = proxies.predicted(spark, d).withColumns({"low": F.col("prediction_a") * 0.95, "high": F.col("prediction_a") * 1.05})
    return validation.coverage(i, "sale_price", "low", "high", "residence_type").withColumns({"coverage": F.round("coverage", 6), "median_width": F.round("median_width", 4)})


@query("""WITH l AS (SELECT l_suppkey AS supplier, l_extendedprice AS v, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice ROWS UNBOUNDED PRECEDING) / sum(l_quantity) OVER (PARTITION BY l_suppkey) AS share FROM lineitem WHERE l_quantity > 0)
 SELECT supplier, min(v) FILTER (WHERE share >= 0.5 - 1e-12) AS weighted_quantile FROM l GROUP BY supplier""")
def weighted_quantile(spark, d):
    t = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), "l_extendedprice", "l_quantity")
    return validation.weighted_quantile(t, "supplier", "l_extendedprice", "l_quantity", 0.5)


@query(f"WITH {SALES} SELECT sale_id, CASE WHEN sale_year > (SELECT max(sale_year) FROM sales) - 2 THEN 'test' ELSE 'train' END AS split FROM sales")
def temporal_split(spark, d):
    return validation.temporal_split(proxies.sales(spark, d), "sale_year", 2).select("sale_id", "split")


@query(f"""WITH {SALES}, e AS (SELECT list_distinct(quantile_cont(sale_price, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS edges FROM sales) SELECT sale_id, CAST(len(list_filter(edges, lambda q: q < sale_price)) + 1 AS BIGINT) AS decile FROM sales, e""")
def price_deciles(spark, d):
    return validation.quantile_groups(proxies.sales(spark, d), "sale_price", 10).select("sale_id", F.col("quantile_group").cast("long").alias("decile"))


@query(f"""WITH {SIZED}, q AS (SELECT quantile_cont(ln(building_sqft), 0.25) AS q1, quantile_cont(ln(building_sqft), 0.75) AS q3 FROM sized WHERE building_sqft > 0)
 SELECT sale_id, coalesce((building_sqft > 0 AND (ln(nullif(building_sqft, 0)) < q1 - (q3 - q1) * 1.5 OR ln(nullif(building_sqft, 0)) > q3 + (q3 - q1) * 1.5)) OR building_sqft < 200 OR building_sqft > 20000, false) AS is_outlier FROM sized, q""")
def iqr_outliers(spark, d):
    return validation.iqr_outliers(proxies.sized(spark, d), "building_sqft").select("sale_id", "is_outlier")


@query(f"WITH {SIZED} SELECT 'building_sqft' AS \"column\", count(*) FILTER (WHERE building_sqft IS NULL) AS n_missing, round(avg(CASE WHEN building_sqft IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM sized UNION ALL SELECT 'nbhd', count(*) FILTER (WHERE nbhd IS NULL), round(avg(CASE WHEN nbhd IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM sized")
def missingness_profile(spark, d):
    return _rounded(validation.missingness(proxies.sized(spark, d), "building_sqft", "nbhd"), 6)


@query(f"""WITH {SIZED}, l AS (SELECT 'sale_price' AS "column", sale_price AS v FROM sized UNION ALL SELECT 'building_sqft', building_sqft FROM sized) SELECT "column", count(v) AS n, round(avg(v), 2) AS mean, round(stddev_samp(v), 2) AS sd, min(v) AS low, max(v) AS high,
 round(quantile_cont(v, 0.01), 2) AS p01, round(quantile_cont(v, 0.25), 2) AS p25, round(quantile_cont(v, 0.5), 2) AS p50, round(quantile_cont(v, 0.75), 2) AS p75, round(quantile_cont(v, 0.99), 2) AS p99 FROM l GROUP BY "column" """)
def feature_profile(spark, d):
    return _rounded(validation.numeric_profile(proxies.sized(spark, d), "sale_price", "building_sqft"), 2)


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def correlation_pairs(spark, d):
    return _rounded(validation.correlation_pairs(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_discount"), 6)


@query("""WITH t AS (SELECT ln(l_extendedprice) AS y, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS s FROM lineitem) SELECT 'const' AS i, 'const' AS j, round(CAST(count(*) AS DOUBLE), 2) AS value FROM t UNION ALL SELECT 'const', 'q', round(sum(q), 2) FROM t UNION ALL SELECT 'const', 's', round(sum(s), 2) FROM t
 UNION ALL SELECT 'q', 'q', round(sum(q*q), 2) FROM t UNION ALL SELECT 'q', 's', round(sum(q*s), 2) FROM t UNION ALL SELECT 's', 's', round(sum(s*s), 2) FROM t UNION ALL SELECT 'const', 'y', round(sum(y), 2) FROM t UNION ALL SELECT 'q', 'y', round(sum(q*y), 2) FROM t UNION ALL SELECT 's', 'y', round(sum(s*y), 2) FROM t""")
def hedonic_gram(spark, d):
    t = read(spark, d, "lineitem").select(F.ln("l_extendedprice").alias("y"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("s"))
    return _rounded(validation.gram(t, "y", "q", "s"), 2)


@query(f"""WITH {SALES}, g AS (SELECT quantile_cont(sale_price, 0.5) AS overall FROM sales WHERE sale_year < 2000), t AS (SELECT residence_type, quantile_cont(sale_price, 0.5) AS by_type FROM sales WHERE sale_year < 2000 AND residence_type <> 'BUILDING' GROUP BY residence_type)
 SELECT sale_id, round(coalesce(by_type, overall), 4) AS prediction_median FROM sales LEFT JOIN t USING (residence_type), g WHERE sale_year >= 2000""")
def median_baselines(spark, d):
    s = proxies.sales(spark, d)
    train = s.where("sale_year < 2000")
    by_type = train.where("residence_type <> 'BUILDING'").groupBy("residence_type").agg(indices.median("sale_price").alias("by_type"))
    overall = train.agg(indices.median("sale_price").alias("overall"))
    out = s.where("sale_year >= 2000").join(by_type, "residence_type", "left").join(F.broadcast(overall))
    return _rounded(out.select("sale_id", F.coalesce("by_type", "overall").alias("prediction_median")))


@query(f"""WITH {SALES}, r AS (SELECT *, CAST(datesub('day', lag(sale_date) OVER (PARTITION BY pin ORDER BY sale_date, sale_id), sale_date) AS BIGINT) AS since FROM sales) SELECT sale_id, sale_price < 20000 AS dq_low_price, coalesce(since < 180, false) AS dq_rapid_resale, CAST((CASE WHEN sale_price < 20000 THEN 1 ELSE 0 END) + (CASE WHEN since < 180 THEN 1 ELSE 0 END) AS BIGINT) AS dq_issue_count FROM r""")
def quality_audit(spark, d):
    since = F.timestamp_diff("DAY", F.lag("sale_date").over(Window.partitionBy("pin").orderBy("sale_date", "sale_id")), F.col("sale_date"))
    flags = proxies.sales(spark, d).select("sale_id", (F.col("sale_price") < 20000).alias("dq_low_price"), F.coalesce(since < 180, F.lit(False)).alias("dq_rapid_resale"))
    return flags.withColumn("dq_issue_count", F.col("dq_low_price").cast("long") + F.col("dq_rapid_resale").cast("long"))


@query(f"WITH {SALES}, n AS (SELECT CAST(n_nationkey AS BIGINT) AS nbhd, n_name AS place FROM nation), g AS (SELECT nbhd, count(*) AS n FROM sales GROUP BY nbhd) SELECT nbhd, place, coalesce(g.n, 0) AS n FROM n LEFT JOIN g USING (nbhd)")
def segments_named(spark, d):
    names = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("nbhd"), F.col("n_name").alias("place"))
    g = proxies.sales(spark, d).groupBy("nbhd").agg(F.count("*").alias("n"))
    return names.join(g, "nbhd", "left").select("nbhd", "place", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {SALES}, a AS (SELECT pin, sale_year AS year, sum(sale_price) * 0.09 AS assessed FROM sales GROUP BY ALL) SELECT s.sale_id, round(a.assessed, 4) AS assessed FROM sales s JOIN a ON s.pin = a.pin AND s.sale_year = a.year")
def assessment_match(spark, d):
    s = proxies.sales(spark, d)
    a = s.groupBy("pin", F.col("sale_year").alias("year")).agg((F.sum("sale_price") * 0.09).alias("assessed"))
    return _rounded(s.join(a, (s.pin == a.pin) & (F.col("sale_year") == F.col("year"))).select("sale_id", "assessed"))


@query(f"WITH {SALES} SELECT CAST(floor(x / 5280) AS BIGINT) AS cell_x, CAST(floor(y / 5280) AS BIGINT) AS cell_y, count(*) AS n, round(quantile_cont(sale_price, 0.5), 4) AS median_price FROM sales GROUP BY 1, 2")
def spatial_grid_median(spark, d):
    return _rounded(proxies.sales(spark, d).groupBy(F.floor(F.col("x") / 5280).alias("cell_x"), F.floor(F.col("y") / 5280).alias("cell_y")).agg(F.count("*").alias("n"), indices.median("sale_price").alias("median_price")))


@query("SELECT p_partkey, round((coalesce(CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice END, m) - a) / s, 6) AS z FROM part, (SELECT quantile_cont(v, 0.5) AS m, avg(v) AS a, stddev_samp(v) AS s FROM (SELECT CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice END AS v FROM part))")
def zscore_controls(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.expr("if(p_partkey % 9 <> 0, p_retailprice, null)").alias("v"))
    fit = p.agg(indices.median("v").alias("m"), F.avg("v").alias("a"), F.stddev_samp("v").alias("s"))
    return _rounded(p.join(F.broadcast(fit)).select("p_partkey", ((F.coalesce("v", "m") - F.col("a")) / F.col("s")).alias("z")), 6)


@query("SELECT c_custkey, CASE WHEN dist <= 1320 THEN '0-0.25' WHEN dist <= 2640 THEN '0.25-0.5' WHEN dist <= 5280 THEN '0.5-1' WHEN dist <= 10560 THEN '1-2' ELSE '2+' END AS band FROM (SELECT c_custkey, CAST((c_custkey * 7919) % 26400 AS DOUBLE) AS dist FROM customer)")
def distance_bands(spark, d):
    c = read(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") * 7919) % 26400).cast("double").alias("dist"))
    return c.select("c_custkey", cleaning.banded("dist", (1320, 2640, 5280, 10560), ("0-0.25", "0.25-0.5", "0.5-1", "1-2", "2+")).alias("band"))
