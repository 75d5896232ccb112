"""Sales classified as they arrive: the same rules as in batch, over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plotline.operators.cleaning import PopulationRules, classify_sales


def sales_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def classify_to(stream: DataFrame, out: str, checkpoint: str, rules: PopulationRules = PopulationRules()) -> StreamingQuery:
    """Classify without state and append, exactly once, to Parquet; ends when the folder is read."""
    writer = classify_sales(stream, rules).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def weekly_counts(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Sales and their status by week; rows later than ``late`` no longer change a week."""
    classified = classify_sales(stream).withColumn("at", F.col("sale_date").cast("timestamp"))
    return classified.withWatermark("at", late).groupBy(F.window("at", "7 days"), "population_status").agg(F.count("*").alias("n"))
