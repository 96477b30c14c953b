"""Catalogs of files by their names alone: which files hold a model's variable in which years, before any is opened."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import CELL
from ..operators.space import area_column

#: variable_table_model_experiment_member[_grid]_from-to, years first in the dates.
PATTERN = r"(?P<variable>[^_/]+)_[^_/]+_(?P<model>[^_/]+)_[^/]*?_?(?P<first>\d{4})\d*-(?P<last>\d{4})\d*\.[^./]+$"


def file_catalog(spark: SparkSession, folder: str, pattern: str = PATTERN, glob: str = "*") -> DataFrame:
    """``path``, ``model``, ``variable``, ``first``, ``last`` (years) of the files below ``folder`` whose names match the pattern,
    which names these groups; only names are read."""
    names = list(re.compile(pattern).groupindex)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path")
    java = pattern.replace("(?P<", "(?<")
    part = lambda n: F.regexp_extract("path", java, re.compile(pattern).groupindex[n]) if n in names else F.lit(None).cast("string")
    rows = files.filter(F.col("path").rlike(java))
    return rows.select("path", part("model").alias("model"), part("variable").alias("variable"), part("first").cast("int").alias("first"), part("last").cast("int").alias("last"))


def select_files(catalog: DataFrame, variable: str, synonyms: DataFrame | None = None, years: tuple[int, int] | None = None, models: list[str] | None = None) -> DataFrame:
    """The rows of a catalog that hold ``variable``, or for a model without it the first of its ``synonyms`` (variable, synonym,
    place), in any of the ``years``."""
    rows = catalog.filter(F.col("model").isin(models)) if models is not None else catalog
    names: Column = F.when(F.col("variable") == variable, F.lit(0))
    if synonyms is not None:
        own = synonyms.filter(F.col("variable") == variable).select(F.col("synonym").alias("variable"), F.col("place").alias("_place"))
        rows = rows.join(F.broadcast(own), "variable", "left")
        names = F.coalesce(names, F.col("_place"))
    ranked = rows.withColumn("_rank", names).filter("_rank is not null").drop("_place")
    best = ranked.groupBy("model").agg(F.min("_rank").alias("_rank"))
    out = ranked.join(best, ["model", "_rank"]).drop("_rank")
    return out if years is None else out.filter((F.coalesce("last", F.lit(9999)) >= years[0]) & (F.coalesce("first", F.lit(0)) <= years[1]))


def read_files(files: DataFrame) -> DataFrame | None:
    """The fields in the files of a catalog's rows, with ``model`` and ``variable`` of their names; None without any. The list of
    files is metadata, so the driver holds it, as for any read."""
    rows = files.select("path", "model", "variable").collect()
    if not rows:
        return None
    spark = files.sparkSession
    found = spark.read.parquet(*sorted(r["path"] for r in rows))
    found = found.drop("model", "variable").withColumn("_path", F.col("_metadata.file_path"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    own = spark.createDataFrame([tuple(r) for r in rows], "_path string, model string, variable string").withColumn("_path", plain("_path"))
    return found.withColumn("_path", plain("_path")).join(F.broadcast(own), "_path").drop("_path")


def with_areas(df: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """``df`` with ``area``: of a field of cell areas where it has the cell, else from the cell's bounds."""
    if areas is None:
        return df.withColumn("area", area_column())
    own = areas.select(*CELL, F.col("value").alias("_area"))
    return df.join(own, CELL, "left").withColumn("area", F.coalesce("_area", area_column())).drop("_area")


def sites_of_files(catalog: DataFrame, sites: DataFrame, lat: float, lon: float, within: float) -> DataFrame:
    """The files of a catalog (with ``site``) whose site (site, lat, lon) lies under ``within`` degrees of a place."""
    near = sites.filter(F.sqrt(F.pow(F.col("lat") - lat, F.lit(2)) + F.pow(F.col("lon") - lon, F.lit(2))) < within).select("site")
    return catalog.join(near, "site", "left_semi")
