"""Joins that look values up: near sites, region tables, names, lags, bilinear corners, painted basins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import CELL

#: The longest kernel; its lags are literals of the plan.
MAX_LAGS = 1000
#: Squares of more places than LEAF are parted further, over MAX_LEVELS levels below the first at the most.
LEAF, MAX_LEVELS = 32, 12


def _finite(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Rows with numbers for both, as doubles: no other place is near to any."""
    inside = lambda c: F.abs(F.col(c)) < float("inf")
    return df.withColumns({c: F.col(c).cast("double") for c in (lat, lon)}).filter(inside(lat) & inside(lon))


def sites_within(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """For each site of ``a`` (site, lat, lon) the nearest one of ``b`` (other, lat2, lon2) under ``radius`` degrees, the least
    ``other`` of equals.

    Places meet, not sites: each place of ``a`` is searched once, and a place of ``b`` stands for its least ``other``. A place
    of ``a`` begins with the squares of the radius around it and goes down, a level at a time, to their sixteenths, until
    none of a level holds over LEAF places. At each level it keeps the squares whose bounds (those of the places in them)
    are no farther off than another's farthest corner. Differences, products and roots keep their order when rounded, so
    no nearest place is lost. Thus a place meets a few squares a level rather than all places in the radius, unless these
    are all about equally far from it. ``b`` is read once a level.
    """
    # a little wider than the radius, so that rounding does not part places by two squares
    side = radius * (1 + 1e-9)
    square = lambda c, level: F.floor(F.col(c) / (side / 4**level))
    places = _finite(b, "lat2", "lon2").groupBy("lat2", "lon2").agg(F.min("other").alias("other"))

    def squares(level: int) -> DataFrame:
        """Squares of a level (_y, _x) with the bounds of their places, by those (_py, _px) in which they are searched."""
        above = max(level - 1, 0)
        of = {"_y": square("lat2", level), "_x": square("lon2", level), "_py": square("lat2", above), "_px": square("lon2", above)}
        bounds = [F.min("lat2").alias("_s"), F.max("lat2").alias("_n"), F.min("lon2").alias("_w"), F.max("lon2").alias("_e")]
        found = places.withColumns(of).groupBy(*of).agg(*bounds)
        if level:
            return found
        around = F.sequence(F.lit(-1), F.lit(1))
        spread = found.withColumn("_dy", F.explode(around)).withColumn("_dx", F.explode(around))
        # there is no square beyond the greatest long
        return spread.withColumns({"_py": F.try_add("_y", "_dy"), "_px": F.try_add("_x", "_dx")}).drop("_dy", "_dx")

    last = 0
    while last < MAX_LEVELS:
        most = places.groupBy(square("lat2", last), square("lon2", last)).count().agg(F.max("count")).first()[0] or 0
        if most <= LEAF:
            break
        # a level parts a square into 16 at most
        last = min(last + max(1, math.ceil(math.log(most / LEAF, 16))), MAX_LEVELS)

    distance = lambda y, x: F.sqrt(y * y + x * x)
    beyond = lambda c, lower, upper: F.greatest(F.col(lower) - F.col(c), F.col(c) - F.col(upper), F.lit(0.0))
    across = lambda c, lower, upper: F.greatest(F.abs(F.col(lower) - F.col(c)), F.abs(F.col(upper) - F.col(c)))
    own = Window.partitionBy("lat", "lon")
    near = _finite(a, "lat", "lon").select("lat", "lon").distinct().withColumns({"_y": square("lat", 0), "_x": square("lon", 0), "_u": F.lit(float(radius))})
    for level in range(last + 1):
        asked = near.withColumnsRenamed({"_y": "_py", "_x": "_px"})
        met = asked.join(squares(level), ["_py", "_px"]).withColumn("_d", distance(beyond("lat", "_s", "_n"), beyond("lon", "_w", "_e"))).filter("_d <= _u")
        met = met.withColumn("_u", F.least("_u", F.min(distance(across("lat", "_s", "_n"), across("lon", "_w", "_e"))).over(own)))
        near = met.filter("_d <= _u").select("lat", "lon", "_y", "_x", "_u")
    ends = places.withColumns({"_y": square("lat2", last), "_x": square("lon2", last)})
    pairs = near.join(ends, ["_y", "_x"]).withColumn("_d", distance(F.col("lat") - F.col("lat2"), F.col("lon") - F.col("lon2")))
    nearest = pairs.filter((F.col("_d") < radius) & (F.col("_d") <= F.col("_u"))).groupBy("lat", "lon").agg(F.min(F.struct(F.col("_d").alias("distance"), "other")).alias("m"))
    return _finite(a, "lat", "lon").select("site", "lat", "lon").join(nearest, ["lat", "lon"]).groupBy("site").agg(F.min(F.struct("m.distance", "m.other")).alias("m")).select("site", "m.other", "m.distance")


def regional_threshold(in_regions: DataFrame, table: DataFrame) -> DataFrame:
    """A threshold by cell: the sum over its regions of the table's value (region, value); no row where it is in none."""
    cells = in_regions.select("region", *CELL).distinct()
    return cells.join(table, "region").groupBy(*CELL).agg(F.sum("value").alias("threshold"))


def match_names(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """``wanted`` (name) with the ``id`` of the known long name that is equal but for case; null where there is none."""
    return wanted.join(known.select(F.lower("name").alias("_key"), "id"), F.lower("name") == F.col("_key"), "left").drop("_key")


def lagged_response(flux: DataFrame, kernel: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over lags of flux (step, value) x kernel (lag, weight), the last weight held for all longer lags.

    Each flux is spread over the kernel's lags and summed by step; what lies beyond the kernel is a running sum.
    """
    rows = kernel.orderBy("lag").limit(MAX_LAGS + 1).collect()
    if not rows or len(rows) > MAX_LAGS:
        raise ValueError(f"a kernel has 1 to {MAX_LAGS} lags")
    last = rows[-1]
    weights = F.array(*(F.struct(F.lit(r["lag"]).alias("lag"), F.lit(r["weight"]).alias("weight")) for r in rows))
    parts = flux.withColumn("_k", F.explode(weights)).select(*keys, (F.col("step") + F.col("_k.lag")).alias("step"), (F.col("value") * F.col("_k.weight")).alias("value"))
    near = parts.groupBy(*keys, "step").agg(F.sum("value").alias("near"))
    own = Window.partitionBy(*keys).orderBy("step").rangeBetween(Window.unboundedPreceding, -int(last["lag"]) - 1)
    out = flux.withColumn("_far", F.coalesce(F.sum("value").over(own), F.lit(0.0)) * F.lit(last["weight"]))
    return out.join(near, [*keys, "step"]).select(*keys, "step", (F.col("near") + F.col("_far")).alias("value"))


def paint(values: DataFrame, cells: DataFrame) -> DataFrame:
    """Values of basins (basin, value) on their cells (basin, lat0, lon0); overlapping basins add up."""
    return cells.join(values, "basin").groupBy("lat0", "lon0").agg(F.sum("value").alias("value"))


def bilinear(grid: DataFrame, points: DataFrame, step: float, origin: tuple[float, float] = (-90.0, -180.0)) -> DataFrame:
    """Values at points (site, lat, lon) between the four centres of a regular grid whose lowest edges are ``origin``;
    centres without a value are left out and the weights of the others scaled up. Longitudes go round."""
    round_ = round(360 / step)
    y, x = (F.col("lat") - origin[0]) / step - 0.5, (F.col("lon") - origin[1]) / step - 0.5
    i0, j0 = F.floor(y), F.floor(x)
    fi, fj = y - i0, x - j0
    corners = F.array(*(F.struct((i0 + a).alias("i"), F.pmod(j0 + b, F.lit(round_)).alias("j"), ((fi if a else 1 - fi) * (fj if b else 1 - fj)).alias("w")) for a in (0, 1) for b in (0, 1)))
    asked = points.withColumn("_c", F.explode(corners)).select("site", "_c.i", "_c.j", "_c.w")
    place = lambda lower, upper, start: F.floor(((F.col(lower) + F.col(upper)) / 2 - start) / step)
    centres = grid.select(place("lat0", "lat1", origin[0]).alias("i"), F.pmod(place("lon0", "lon1", origin[1]), F.lit(round_)).alias("j"), "value").filter("value is not null")
    return asked.join(centres, ["i", "j"]).groupBy("site").agg(F.try_divide(F.sum(F.col("value") * F.col("w")), F.sum("w")).alias("value"))


def filled_from_neighbours(grid: DataFrame, step: float, origin: tuple[float, float] = (-90.0, -180.0)) -> DataFrame:
    """Masked cells of a regular grid with the mean of those of their eight neighbours that have a value; longitudes go round."""
    round_ = round(360 / step)
    place = lambda lower, upper, start: F.floor(((F.col(lower) + F.col(upper)) / 2 - start) / step)
    cells = grid.withColumns({"_i": place("lat0", "lat1", origin[0]), "_j": F.pmod(place("lon0", "lon1", origin[1]), F.lit(round_))})
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b))
    given = cells.filter("value is not null").withColumn("_n", F.explode(around)).select((F.col("_i") + F.col("_n.a")).alias("_i"), F.pmod(F.col("_j") + F.col("_n.b"), F.lit(round_)).alias("_j"), F.col("value").alias("_v"))
    means = given.groupBy("_i", "_j").agg(F.avg("_v").alias("_mean"))
    return cells.join(means, ["_i", "_j"], "left").withColumn("value", F.coalesce("value", "_mean")).drop("_i", "_j", "_mean")


def regridded_points(points: DataFrame, cells: DataFrame, most: float = 2.0) -> DataFrame:
    """``cells`` (lat0, ...) with the value of the point (lat, lon, value) nearest to their centre, masked where it is
    ``most`` degrees away: for fields on two-dimensional coordinates."""
    centres = cells.select(*CELL, ((F.col("lat0") + F.col("lat1")) / 2).alias("lat"), ((F.col("lon0") + F.col("lon1")) / 2).alias("lon"))
    asked = centres.withColumn("site", F.struct(*CELL))
    given = points.filter("value is not null").select(F.struct("lat", "lon", "value").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    near = sites_within(asked, given, most).select("site", F.col("other.value").alias("value"))
    return asked.join(near, "site", "left").select(*CELL, "value")


def first_available(df: DataFrame, names: list[str], keys: list[str], years: float = 0.0) -> DataFrame:
    """By ``keys`` the rows of the first of the variables ``names`` that has any value there, ``years`` added to its times."""
    order = F.coalesce(*(F.when(F.col("variable") == n, F.lit(i)) for i, n in enumerate(names)))
    rows = df.withColumn("_order", order).filter("_order is not null")
    best = rows.filter("value is not null").groupBy(*keys).agg(F.min("_order").alias("_order"))
    moved = {c: F.col(c) + 365.0 * years for c in ("t0", "t1") if c in df.columns} if years else {}
    return rows.join(best, [*keys, "_order"]).drop("_order").withColumns(moved)


def sign_changes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Times at which a series goes through zero, by linear interpolation, and whether it rises there."""
    along = Window.partitionBy(*keys).orderBy("t")
    rows = df.filter("value is not null").withColumns({"_v": F.lag("value").over(along), "_t": F.lag("t").over(along)})
    crossing = rows.filter((F.col("_v") * F.col("value") < 0) | ((F.col("value") == 0) & (F.col("_v") != 0)))
    at = F.col("_t") + (F.col("t") - F.col("_t")) * F.col("_v") / (F.col("_v") - F.col("value"))
    return crossing.select(*keys, at.alias("t"), (F.col("_v") < 0).alias("rising"))


def monthly_means(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, sample deviation and number of the values of each calendar month (``t`` in days, no leap days)."""
    from .time import nearest_month

    rows = df.filter("value is not null").withColumns({"year": F.floor(F.col("t") / 365.0 + 1850).cast("int"), "month": nearest_month(F.col("t"))})
    return rows.groupBy(*keys, "year", "month").agg(F.avg("value").alias("value"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("n"))


def annual_means(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, sample deviation and number of the values of each year."""
    rows = df.filter("value is not null").withColumn("year", F.floor(F.col("t") / 365.0 + 1850).cast("int"))
    return rows.groupBy(*keys, "year").agg(F.avg("value").alias("value"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("n"))


def annual_amplitudes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest less least value of each year with their times, the first of equals; the last year, which may go on, is
    left out."""
    v, t = F.col("value"), F.col("t")
    rows = df.filter("value is not null").withColumn("year", F.floor(t / 365.0 + 1850).cast("int"))
    last = F.max("year").over(Window.partitionBy(*keys))
    whole = rows.withColumn("_last", last).filter(F.col("year") < F.col("_last"))
    return whole.groupBy(*keys, "year").agg((F.max(v) - F.min(v)).alias("amplitude"), F.min_by(t, F.struct(-v, t)).alias("t_max"), F.min_by(t, F.struct(v, t)).alias("t_min"))
