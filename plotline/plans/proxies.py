"""Stand-ins for the domain's tables, made from the star schema, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALES = """sales AS (SELECT o_orderkey AS sale_id, lpad(CAST(o_custkey AS VARCHAR), 14, '0') AS pin, o_orderdate AS sale_date,
 CAST(year(o_orderdate) AS BIGINT) AS sale_year, o_totalprice AS sale_price, CAST(c_nationkey AS BIGINT) AS nbhd, c_mktsegment AS residence_type,
 o_orderpriority AS class, o_orderstatus AS status, CAST((c_custkey * 7919) % 52800 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 52800 AS DOUBLE) AS y
 FROM orders JOIN customer ON o_custkey = c_custkey)"""
SIZED = SALES + """, sized AS (SELECT s.*, l.building_sqft, CASE WHEN s.sale_price > 0 AND l.building_sqft > 0 THEN s.sale_price / l.building_sqft END AS ppsf FROM sales s
 LEFT JOIN (SELECT l_orderkey, 50 * sum(l_quantity) AS building_sqft FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = s.sale_id)"""
PREDICTED = SALES + """, predicted AS (SELECT *, sale_price * (0.9 + 0.2 * ((sale_id * 31) % 100) / 100) AS prediction_a, sale_price * (0.85 + 0.3 * ((sale_id * 17) % 100) / 100) AS prediction_b FROM sales)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("sale_id"),
        F.lpad(F.col("o_custkey").cast("string"), 14, "0").alias("pin"),
        F.col("o_orderdate").alias("sale_date"),
        F.year("o_orderdate").cast("long").alias("sale_year"),
        F.col("o_totalprice").alias("sale_price"),
        F.col("c_nationkey").cast("long").alias("nbhd"),
        F.col("c_mktsegment").alias("residence_type"),
        F.col("o_orderpriority").alias("class"),
        F.col("o_orderstatus").alias("status"),
        ((F.col("c_custkey") * 7919) % 52800).cast("double").alias("x"),
        ((F.col("c_custkey") * 104729) % 52800).cast("double").alias("y"),
    )


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sale_id")).agg((50 * F.sum("l_quantity")).alias("building_sqft"))
    out = sales(spark, sf_dir).join(size, "sale_id", "left")
    return out.withColumn("ppsf", F.when((F.col("sale_price") > 0) & (F.col("building_sqft") > 0), F.col("sale_price") / F.col("building_sqft")))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    def times(low: float, span: float, prime: int):
        return F.col("sale_price") * (F.lit(low) + F.lit(span) * ((F.col("sale_id") * prime) % 100) / 100)

    return sales(spark, sf_dir).withColumns({"prediction_a": times(0.9, 0.2, 31), "prediction_b": times(0.85, 0.3, 17)})


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 7919) % 52800).cast("double").alias("x"), ((F.col("c_custkey") * 104729) % 52800).cast("double").alias("y"), F.col("c_acctbal").alias("value"))
