"""Readers and writers of the domain's files, all through Spark's own sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.operators import audit
from plotline.operators.cleaning import normalize_pin

#: Columns read of each table of a transit feed (fixed values).
FEED_COLUMNS = {
    "stops": ("stop_id", "stop_name", "stop_lat", "stop_lon", "location_type", "parent_station"),
    "routes": ("route_id", "route_short_name", "route_long_name", "route_type"),
    "trips": ("route_id", "trip_id"),
    "stop_times": ("trip_id", "stop_id"),
}


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; missing columns are null, and columns of different types become strings."""
    types: dict[str, set[str]] = {}
    for f in frames:
        for c, t in f.dtypes:
            types.setdefault(c, set()).add(t)
    mixed = {c for c, t in types.items() if len(t) > 1}
    cast = [f.withColumns({c: F.col(c).cast("string") for c in f.columns if c in mixed}) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def read_pages(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files or folders whose pages may differ in columns and types."""
    return union_by_name(*(spark.read.option("recursiveFileLookup", True).parquet(p) for p in paths))


def read_pins(spark: SparkSession, path: str) -> DataFrame:
    """Distinct normalised pins of a Parquet or CSV file with a ``pin`` column."""
    raw = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    return raw.select(normalize_pin("pin").alias("pin")).where("pin is not null").distinct()


def read_census(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """A JSON array of arrays whose first row is the header; codes renamed, ``geoid`` put together."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("rows"))
    header = rows.select(F.get("rows", F.lit(0))).first()
    if not header or header[0] is None:
        raise ValueError(f"{path} is not an array of arrays")
    cells = rows.select(F.explode(F.slice("rows", 2, 2_000_000_000)).alias("r"))
    out = cells.select(*(F.get("r", F.lit(i)).alias(names.get(c, c)) for i, c in enumerate(header[0])))
    return out.withColumn("geoid", F.concat("state", "county", "tract"))


def read_feed(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of a transit feed, all strings."""
    frame = spark.read.option("header", True).csv(f"{folder}/{table}.txt")
    if missing := sorted(set(FEED_COLUMNS[table]) - set(frame.columns)):
        raise ValueError(f"{table}: missing columns: {', '.join(missing)}")
    return frame.select(*FEED_COLUMNS[table])


def rail_stations(stops: DataFrame, routes: DataFrame, trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Parent stations served by rail (route type 1), with their lines as sorted text."""
    lines = routes.where(F.trim("route_type") == "1").select("route_id", F.coalesce(F.nullif(F.trim("route_short_name"), F.lit("")), "route_long_name").alias("line"))
    served = stop_times.join(trips, "trip_id").join(lines, "route_id").select("stop_id", "line").distinct()
    parent = stops.select("stop_id", F.coalesce(F.nullif(F.trim("parent_station"), F.lit("")), "stop_id").alias("station_id"))
    grouped = served.join(parent, "stop_id").groupBy("station_id").agg(F.array_join(F.array_sort(F.collect_set("line")), "|").alias("lines"))
    named = stops.select(F.col("stop_id").alias("station_id"), F.col("stop_name").alias("station_name"), F.col("stop_lat").try_cast("double").alias("latitude"), F.col("stop_lon").try_cast("double").alias("longitude"))
    return grouped.join(named, "station_id")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """``id, properties map<string,string>, part, ring`` of each part of each feature of one feature collection.

    ``part`` is an array of rings, arrays of ``x, y``, the first outside and the others holes; ``ring`` is the first of
    them. Features without polygons have no rows. ``id`` numbers the features.
    """
    schema = "type string, features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("g"))
    kinds = {r.kind for r in text.select(F.col("g.type").alias("kind")).collect()}  # a row for each file
    if kinds != {"FeatureCollection"}:
        raise ValueError(f"{path} is not a feature collection")
    feature = text.select(F.posexplode("g.features").alias("id", "f")).repartition(spark.sparkContext.defaultParallelism)
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    single, many = F.from_json(raw, "array<array<array<double>>>"), F.from_json(raw, "array<array<array<array<double>>>>")
    parts = F.when(kind == "Polygon", F.array(single)).when(kind == "MultiPolygon", many)
    corner = lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))
    part = F.transform("p", lambda r: F.transform(r, corner))
    return feature.select("id", F.col("f.properties").alias("properties"), F.explode(parts).alias("p")).select("id", "properties", part.alias("part"), F.get(part, F.lit(0)).alias("ring"))


def write_audit(flags: DataFrame, path: str) -> dict[str, str]:
    """The tables of an audit (:mod:`plotline.operators.audit`) below ``path``: flagged sales, findings, joins, profiles.

    The names of the tables and their paths come back; each is written anew.
    """
    own = [c for c in flags.columns if not c.startswith("dq_")]
    written = f"{path}/flagged_sales"
    flags.write.mode("overwrite").parquet(written)
    flags = flags.sparkSession.read.parquet(written)
    tables = {"findings": audit.findings(flags), "join_success": audit.join_success(flags), "feature_profiles": audit.feature_profiles(flags.select(*own))}
    if "year" in own:
        tables["coverage_by_year"] = audit.coverage_by_year(flags.select(*own))
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    return {"flagged_sales": written} | {name: f"{path}/{name}" for name in tables}


def write_by_year(df: DataFrame, path: str, year: str = "sale_year") -> DataFrame:
    """One folder for each year, ``unknown`` where it is null; rows by year come back as a manifest."""
    marked = df.withColumn(year, F.coalesce(F.col(year).cast("string"), F.lit("unknown")))
    marked.repartition(year, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").partitionBy(year).parquet(path)
    return df.sparkSession.read.parquet(path).groupBy(year).agg(F.count("*").alias("n_rows"))
