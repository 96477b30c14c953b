"""The library of regions: fixed boxes, and rasters of region numbers as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import CELL
from .space import axes, axis_lookup

#: Label, name, and the limits of latitude and longitude of the whole globe and of 14 fire-emission regions.
BOXES = [
    ("global", "Globe", -89.999, 89.999, -179.999, 179.999),
    ("globe", "Global - All", -89.999, 89.999, -179.999, 179.999),
    ("bona", "Boreal North America", 49.75, 79.75, -170.25, -60.25),
    ("tena", "Temperate North America", 30.25, 49.75, -125.25, -66.25),
    ("ceam", "Central America", 9.75, 30.25, -115.25, -80.25),
    ("nhsa", "Northern Hemisphere South America", 0.25, 12.75, -80.25, -50.25),
    ("shsa", "Southern Hemisphere South America", -59.75, 0.25, -80.25, -33.25),
    ("euro", "Europe", 35.25, 70.25, -10.25, 30.25),
    ("mide", "Middle East", 20.25, 40.25, -10.25, 60.25),
    ("nhaf", "Northern Hemisphere Africa", 0.25, 20.25, -20.25, 45.25),
    ("shaf", "Southern Hemisphere Africa", -34.75, 0.25, 10.25, 45.25),
    ("boas", "Boreal Asia", 54.75, 70.25, 30.25, 179.75),
    ("ceas", "Central Asia", 30.25, 54.75, 30.25, 142.58),
    ("seas", "Southeast Asia", 5.25, 30.25, 65.25, 120.25),
    ("eqas", "Equatorial Asia", -10.25, 10.25, 99.75, 150.25),
    ("aust", "Australia", -41.25, -10.50, 112.00, 154.00),
]


def fixed_regions(spark: SparkSession) -> DataFrame:
    """``label``, ``name``, ``lat_min``, ``lat_max``, ``lon_min``, ``lon_max`` of the fixed boxes."""
    return spark.createDataFrame(BOXES, "label string, name string, lat_min double, lat_max double, lon_min double, lon_max double")


def in_raster(df: DataFrame, raster: DataFrame) -> DataFrame:
    """Rows of each region of a raster (``label`` and the cells it covers): that of the raster's cell nearest to the
    row's centre on each axis. A raster cell may be in several regions, or in none.

    The axes meet in broadcast lookups of at most MAX_AXIS rows; cells and raster in an equi join.
    """
    own, other = axes(df), axes(raster)
    for lower, upper, cells, targets in zip(("lat0", "lon0"), ("lat1", "lon1"), own, other, strict=True):
        lookup = axis_lookup(df.sparkSession, cells, targets, f"{lower} double, {upper} double, _{lower} double, _{upper} double")
        df = df.join(F.broadcast(lookup), [lower, upper])
    named = raster.select(F.col("label").alias("region"), *(F.col(c).alias(f"_{c}") for c in CELL))
    return df.join(named, [f"_{c}" for c in CELL]).drop(*(f"_{c}" for c in CELL))
