"""Reading and writing fields. Everything goes through Spark's readers, so any Hadoop path works."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELD_SCHEMA = "model string, variable string, t0 double, t1 double, z0 double, z1 double, site int, lat0 double, lat1 double, lon0 double, lon1 double, value double, value_lo double, value_hi double"


def normalised(df: DataFrame) -> DataFrame:
    """Longitudes into [-180, 180), latitudes within the poles, NaN to null."""
    shift = F.when(F.col("lon0") >= 180.0, F.lit(360.0)).otherwise(F.lit(0.0))
    return df.withColumns({"lon0": F.col("lon0") - shift, "lon1": F.col("lon1") - shift, "lat0": F.greatest("lat0", F.lit(-90.0)), "lat1": F.least("lat1", F.lit(90.0)), "value": F.nanvl("value", F.lit(None).cast("double"))})


def write_field(df: DataFrame, path: str) -> None:
    """Partitioned by variable and model and sorted by time, so that time limits skip row groups."""
    df.repartition("variable", "model", F.floor(F.col("t0") / 3650)).sortWithinPartitions("t0").write.partitionBy("variable", "model").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_field(spark: SparkSession, path: str, variable: str, alternates: list[str] = (), t0: float | None = None, tf: float | None = None) -> DataFrame:
    """The first of ``variable`` and ``alternates`` that a model has; partitions and time limits are pruned at the scan."""
    wanted = [variable, *alternates]
    df = spark.read.parquet(path).filter(F.col("variable").isin(wanted))
    if t0 is not None:
        df = df.filter(F.col("t1") > t0)
    if tf is not None:
        df = df.filter(F.col("t0") < tf)
    if not alternates:
        return df
    rank = F.array_position(F.lit(wanted), F.col("variable"))
    best = df.groupBy("model").agg(F.min(rank).alias("_best"))
    return df.join(best, "model").filter(rank == F.col("_best")).drop("_best")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per model and variable: time span, extents and number of values."""
    return spark.read.parquet(path).groupBy("model", "variable").agg(F.min("t0").alias("t_min"), F.max("t1").alias("t_max"), F.min("lat0").alias("lat_min"), F.max("lat1").alias("lat_max"), F.min("lon0").alias("lon_min"), F.max("lon1").alias("lon_max"), F.count("value").alias("n"))


def read_point_csv(spark: SparkSession, path: str, time_column: str = "date") -> DataFrame:
    """Daily means from CSV files with ``name [unit]`` headers and # comments: site (the file's name), variable, unit, day, value."""
    df = spark.read.option("header", True).option("comment", "#").csv(path)
    named = {c: re.fullmatch(r"\s*(.*?)\s*\[(.*)\]\s*", c) for c in df.columns if c != time_column}
    values = F.array(*(F.struct(F.lit(m[1]).alias("variable"), F.lit(m[2]).alias("unit"), F.col(f"`{c}`").try_cast("double").alias("value")) for c, m in named.items() if m))
    rows = df.select(F.regexp_extract("_metadata.file_name", r"^[^.]*", 0).alias("site"), F.to_date(time_column).alias("day"), F.explode(values).alias("x"))
    return rows.groupBy("site", "x.variable", "x.unit", "day").agg(F.avg("x.value").alias("value"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Region boxes from CSV: label,name,lat_min,lat_max,lon_min,lon_max."""
    return spark.read.option("header", False).option("ignoreLeadingWhiteSpace", True).option("comment", "#").schema("label string, name string, lat_min double, lat_max double, lon_min double, lon_max double").csv(path).filter("lat_min is not null")


def check_manifest(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Entries (sha1, file) of a manifest that are missing or differ: file and what is wrong. Files are named by their path
    below ``folder``, so equal names in two folders are two files."""
    root = folder.rstrip("/").removeprefix("file:") + "/"
    below = F.expr(f"substring(path, instr(path, '{root}') + {len(root)})")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(below.alias("file"), F.sha1("content").alias("_own"))
    return manifest.join(found, "file", "left").filter("_own is null or _own <> sha1").select("file", F.when(F.col("_own").isNull(), "missing").otherwise("differs").alias("state"))


def latest_complete(results: DataFrame, keys: list[str]) -> DataFrame:
    """The last complete result of each key, for runs that go on where one stopped."""
    last = Window.partitionBy(*keys).orderBy(F.desc("run"))
    return results.filter("complete").withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")


def with_statistics(df: DataFrame, keys: list[str]) -> DataFrame:
    """By ``keys``: least and greatest value, the 1st and 99th percentile, and the number of values, for a table that is
    written next to its field."""
    from ..operators.compare import exact_quantiles

    q = exact_quantiles(df, keys, F.col("value"), [0.0, 0.01, 0.99, 1.0])
    ends = q.groupBy(*keys).agg(*(F.max(F.when(F.col("quantile") == x, F.col("value"))).alias(n) for n, x in (("min", 0.0), ("dn99", 0.01), ("up99", 0.99), ("max", 1.0))))
    return ends.join(df.groupBy(*keys).agg(F.count("value").alias("n")), keys)


#: Columns that place a value: no variables of their own.
PLACES = {"model", "variable", "source", "t", "t0", "t1", "z0", "z1", "site", "lat", "lon", "lat0", "lat1", "lon0", "lon1"}


def variables(df: DataFrame) -> list[str]:
    """The data columns of a table: those that are neither a place nor the bounds of another column."""
    names = set(df.columns)
    return sorted(c for c in names - PLACES if not any(c == f"{n}_{end}" for n in names for end in ("lo", "hi")))
