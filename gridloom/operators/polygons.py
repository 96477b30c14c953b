"""Points and cells in polygons, such as drainage basins: counts of crossed edges, by equi joins on tiles.

A basin is any number of rings (``basin``, ``ring``, ``at``, ``lat``, ``lon``: the vertices in the order of ``at``, closed
from the last to the first). A point is inside where a ray eastwards from it crosses an odd number of the basin's edges, so
rings within rings are holes. Polygons are in degrees and do not go round the date line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import CELL
from .space import area_column, space_mean


def edges(rings: DataFrame) -> DataFrame:
    """``basin``, ``y1``, ``x1``, ``y2``, ``x2``: the sides of all rings but for level ones, which no such ray crosses."""
    along = Window.partitionBy("basin", "ring").orderBy("at")
    own = Window.partitionBy("basin", "ring").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = lambda c: F.coalesce(F.lead(c).over(along), F.first(c).over(own))
    sides = rings.select("basin", F.col("lat").alias("y1"), F.col("lon").alias("x1"), following("lat").alias("y2"), following("lon").alias("x2"))
    return sides.filter("y1 <> y2")


def _tile(c: str | Column, tile: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / tile).cast("int")


def inside(points: DataFrame, rings: DataFrame, tile: float = 1.0) -> DataFrame:
    """``lat``, ``lon``, ``basin``: which of the distinct places of ``points`` lie in which basins.

    Places meet the basins whose bounding boxes share their tile, and then only the edges of these basins that pass through
    the tile's latitudes: two equi joins, whose sizes follow those of the polygons, and a count that is summed map-side.
    """
    sides = edges(rings)
    boxes = sides.groupBy("basin").agg(F.min(F.least("y1", "y2")).alias("s"), F.max(F.greatest("y1", "y2")).alias("n"), F.min(F.least("x1", "x2")).alias("w"), F.max(F.greatest("x1", "x2")).alias("e"))
    tiled = boxes.withColumn("_y", F.explode(F.sequence(_tile("s", tile), _tile("n", tile)))).withColumn("_x", F.explode(F.sequence(_tile("w", tile), _tile("e", tile))))
    places = points.select("lat", "lon").distinct().withColumns({"_y": _tile("lat", tile), "_x": _tile("lon", tile)})
    near = places.join(tiled, ["_y", "_x"]).filter("lat between s and n and lon between w and e").select("lat", "lon", "basin", "_y")
    rows = sides.withColumn("_y", F.explode(F.sequence(_tile(F.least("y1", "y2"), tile), _tile(F.greatest("y1", "y2"), tile))))
    lat = F.col("lat")
    crossed = ((F.col("y1") > lat) != (F.col("y2") > lat)) & (F.col("lon") < (F.col("x2") - F.col("x1")) * (lat - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    counted = near.join(rows, ["basin", "_y"]).groupBy("lat", "lon", "basin").agg(F.count(F.when(crossed, 1)).alias("k"))
    return counted.filter("k % 2 = 1").select("lat", "lon", "basin")


def cells_in_basins(cells: DataFrame, rings: DataFrame, tile: float = 1.0) -> DataFrame:
    """``basin`` and the bounds of the distinct cells whose centres lie in it."""
    centre = {"lat": (F.col("lat0") + F.col("lat1")) / 2, "lon": (F.col("lon0") + F.col("lon1")) / 2}
    own = cells.select(*CELL).distinct().withColumns(centre)
    return own.join(inside(own, rings, tile), ["lat", "lon"]).select("basin", *CELL)


def basin_areas(cells: DataFrame, rings: DataFrame, tile: float = 1.0) -> DataFrame:
    """``basin``, ``n``, ``area``: number and area of the cells in each basin."""
    return cells_in_basins(cells, rings, tile).groupBy("basin").agg(F.count(F.lit(1)).alias("n"), F.sum(area_column()).alias("area"))


def basin_means(df: DataFrame, rings: DataFrame, keys: list[str], tile: float = 1.0) -> DataFrame:
    """The area-weighted means of a field over basins, by ``keys``, ``site`` (the basin) and time: the series of a field as if
    the basins were sites, to be compared with those of gauges."""
    rows = df.join(cells_in_basins(df, rings, tile), CELL)
    return space_mean(rows, [*keys, "basin"]).withColumnRenamed("basin", "site")
