"""Spatial reductions, grid alignment and regions."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import cell_area
from . import CELL

#: The longest axis that the driver handles as metadata (a global grid of 0.0036 degrees has 100,000 longitudes).
MAX_AXIS = 100_000
MAX_REGIONS = 1_000
#: The names that stand for no mask at all.
GLOBAL = ("global", "globe")


def area_column():
    return cell_area(F.col("lat0"), F.col("lat1"), F.col("lon0"), F.col("lon1"))


def in_region(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows of each region: the cell's centre in (min, max] on both axes; every row for a global label.

    ``regions`` is (label, lat_min, lat_max, lon_min, lon_max), at most MAX_REGIONS of them. Each distinct cell is tested
    once, and the rows meet their cells in an equi join, which Spark broadcasts where the cells are few.
    """
    listed = regions.select("label", "lat_min", "lat_max", "lon_min", "lon_max").limit(MAX_REGIONS + 1).collect()
    if len(listed) > MAX_REGIONS:
        raise ValueError(f"over {MAX_REGIONS} regions; make them a raster")
    lat, lon = (F.col("lat0") + F.col("lat1")) / 2, (F.col("lon0") + F.col("lon1")) / 2
    inside = [F.when(F.lit(b["label"] in GLOBAL) | ((lat > b["lat_min"]) & (lat <= b["lat_max"]) & (lon > b["lon_min"]) & (lon <= b["lon_max"])), F.lit(b["label"])) for b in listed]
    cells = df.select(*CELL).distinct().withColumn("region", F.explode(F.array_compact(F.array(*inside))))
    return df.join(cells, CELL)


def space_mean(df: DataFrame, keys: list[str], mean: bool = True, absolute: bool = False) -> DataFrame:
    """Area-weighted mean (or integral) by ``keys`` and time.

    The denominator is the area of cells with any unmasked time: masks that change in time do not change it. Two
    aggregates that share the scan; the cell table is small beside the field.
    """
    v = F.abs("value") if absolute else F.col("value")
    area = area_column()
    sums = df.groupBy(*keys, "t0", "t1").agg(F.sum(v * area).alias("value"))
    if not mean:
        return sums
    cells = df.groupBy(*keys, *CELL).agg(F.count("value").alias("n")).filter("n > 0")
    whole = cells.groupBy(*keys).agg(F.sum(area).alias("_area")) if keys else cells.agg(F.sum(area).alias("_area"))
    if not keys:
        total = whole.first()["_area"]
        return sums.withColumn("value", F.try_divide(F.col("value"), F.lit(total)))
    return sums.join(whole, keys, "left").withColumn("value", F.try_divide("value", "_area")).drop("_area")


def site_mean(df: DataFrame, keys: list[str], weight: str | None = None, absolute: bool = False) -> DataFrame:
    """Weighted mean over the sites that have a value."""
    v = F.abs("value") if absolute else F.col("value")
    w = F.col(weight) if weight else F.lit(1.0)
    return df.groupBy(*keys).agg(F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w))).alias("value"))


def regions_with_data(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions with an unmasked value."""
    return in_region(df.filter("value is not null"), regions).select(F.col("region").alias("label")).distinct()


def axes(df: DataFrame) -> tuple[list[tuple[float, float]], list[tuple[float, float]]]:
    """The distinct intervals of latitude and of longitude, in order: metadata of the grid, of bounded size, by one job."""
    sets = [F.collect_set(F.when(F.col(a).isNotNull(), F.struct(a, b))) for a, b in (("lat0", "lat1"), ("lon0", "lon1"))]
    row = df.select(*CELL).distinct().agg(*(F.when(F.size(s) <= MAX_AXIS, s) for s in sets)).first()
    if row[0] is None or row[1] is None:
        raise ValueError(f"an axis has over {MAX_AXIS} values; regrid by blocks")
    return tuple(sorted((r[0], r[1]) for r in own) for own in row)


def nearest(centres: list[float], x: float) -> int:
    """The index of the nearest centre, the lower one of equals."""
    k = bisect.bisect_left(centres, x)
    near = [i for i in (k - 1, k) if 0 <= i < len(centres)]
    return min(near, key=lambda i: (abs(centres[i] - x), i))


def composed_axis(a: list[tuple[float, float]], b: list[tuple[float, float]], limit: float) -> list[tuple[float, float]]:
    """The cells between all edges of both axes, clipped to +-limit."""
    edges = sorted({max(-limit, min(limit, e)) for cell in (*a, *b) for e in cell})
    return list(zip(edges[:-1], edges[1:], strict=True))


def axis_lookup(spark, own: list[tuple[float, float]], targets: list[tuple[float, float]], ddl: str) -> DataFrame:
    """Each cell of an axis with the target cell of nearest centre."""
    centres = [(x + y) / 2 for x, y in targets]
    return spark.createDataFrame([(x, y, *targets[nearest(centres, (x + y) / 2)]) for x, y in own], ddl)


def cell_edges(frames: list[DataFrame], lower: str, upper: str) -> DataFrame:
    """``lo``, ``hi``: the cells between all edges of an axis of several fields. The edges are distinct before they are
    put in order, and an axis is short, so the one window holds metadata alone."""
    edges = frames[0].select(F.col(lower).alias("lo"))
    for df in frames:
        edges = edges.union(df.select(lower)).union(df.select(upper))
    along = Window.orderBy("lo")
    return edges.filter("lo is not null").distinct().withColumn("hi", F.lead("lo").over(along)).filter("hi is not null")


def trimmed(df: DataFrame, lat: tuple[float, float] | None = None, lon: tuple[float, float] | None = None, depth: tuple[float, float] | None = None) -> DataFrame:
    """The cells from the one that holds the lower limit to the one that holds the upper limit; limits outside the axis
    are taken to its end, and of two cells that share a limit the lower one counts. Layers that touch the depth limits."""
    for (lower, upper), ends in ((("lat0", "lat1"), lat), (("lon0", "lon1"), lon)):
        if ends is None:
            continue
        least, most = (F.min(lower), F.max(upper))
        span = df.agg(least.alias("a"), most.alias("b")).first()
        if span["a"] is None:
            continue
        at = [min(max(v, span["a"]), span["b"]) for v in ends]
        holds = df.agg(*(F.min(F.when((F.col(lower) <= v) & (F.col(upper) >= v), F.col(lower))).alias(n) for n, v in zip("ij", at, strict=True))).first()
        df = df.filter((F.col(lower) >= holds["i"]) & (F.col(lower) <= holds["j"]))
    return df if depth is None else df.filter((F.col("z1") >= depth[0]) & (F.col("z0") <= depth[1]))


def extents(df: DataFrame) -> list[tuple[float, float]]:
    row = df.agg(F.min("lat0"), F.max("lat1"), F.min("lon0"), F.max("lon1")).first()
    return [(row[0], row[1]), (row[2], row[3])]


def uniform_clip(ref: DataFrame, com: DataFrame, within: tuple = ((-90.0, 90.0), (-180.0, 180.0)), least: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Both fields cut to the area that they share, on those edges only where a field reaches ``least`` degrees beyond it."""
    a, b = extents(ref), extents(com)
    shared = [(max(x[0], y[0], w[0]), min(x[1], y[1], w[1])) for x, y, w in zip(a, b, within, strict=True)]
    out = []
    for df, own in ((ref, a), (com, b)):
        limits = [tuple(s if abs(o - s) >= least else e for o, s, e in zip(x, y, whole, strict=True)) for x, y, whole in zip(own, shared, ((-90.0, 90.0), (-180.0, 180.0)), strict=True)]
        far = any(abs(o - s) >= least for x, y in zip(own, shared, strict=True) for o, s in zip(x, y, strict=True))
        out.append(trimmed(df, *limits) if far else df)
    return out[0], out[1]


def shared_extents(models: DataFrame, snap: float = 2.0) -> DataFrame:
    """The area that all models cover (``models`` has rows of cells), ends within ``snap`` degrees of the globe's taken there."""
    own = models.groupBy("model").agg(F.min("lat0").alias("a"), F.max("lat1").alias("b"), F.min("lon0").alias("c"), F.max("lon1").alias("d"))
    all_ = own.agg(F.max("a").alias("lat_min"), F.min("b").alias("lat_max"), F.max("c").alias("lon_min"), F.min("d").alias("lon_max"))
    ends = {"lat_min": -90.0, "lat_max": 90.0, "lon_min": -180.0, "lon_max": 180.0}
    return all_.select(*(F.when(F.abs(F.col(c) - e) <= snap, F.lit(e)).otherwise(F.col(c)).alias(c) for c, e in ends.items()))


def land_only(df: DataFrame, land: DataFrame, least: float = 0.3, glacier: DataFrame | None = None) -> DataFrame:
    """``value`` where the land fraction (a field of fractions or per cents on the same cells) is at least ``least`` and no
    glacier lies; masked elsewhere."""
    share = land.agg(F.max("value").alias("m")).first()["m"] or 0.0
    rows = df.join(land.select(*CELL, (F.col("value") / (100.0 if share > 10 else 1.0)).alias("_land")), CELL, "left")
    keep = F.coalesce(F.col("_land"), F.lit(0.0)) >= least
    if glacier is not None:
        rows = rows.join(glacier.filter("value > 0").select(*CELL, F.lit(True).alias("_ice")), CELL, "left")
        keep = keep & F.col("_ice").isNull()
    return rows.withColumn("value", F.when(keep, F.col("value"))).drop("_land", "_ice")


def on_axes(df: DataFrame, lats: list[tuple[float, float]], lons: list[tuple[float, float]], own_axes=None) -> DataFrame:
    """``df`` on another grid by nearest centres, one axis at a time.

    Each axis is a lookup table of at most MAX_AXIS rows, so both joins are broadcast equi joins and the field itself
    is not shuffled.
    """
    spark = df.sparkSession
    for lower, upper, target, own in zip(("lat0", "lon0"), ("lat1", "lon1"), (lats, lons), own_axes or axes(df), strict=True):
        lookup = axis_lookup(spark, target, own, f"_a double, _b double, {lower} double, {upper} double")
        df = df.join(F.broadcast(lookup), [lower, upper]).drop(lower, upper).withColumnsRenamed({"_a": lower, "_b": upper})
    return df


def compose(ref: DataFrame, com: DataFrame, axes_of: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both fields on the grid of all their cell edges. ``axes_of``: fields on the same grids whose axes are cheaper to read."""
    a, b = (axes(df) for df in axes_of or (ref, com))
    lats, lons = composed_axis(a[0], b[0], 90.0), composed_axis(a[1], b[1], 180.0)
    return on_axes(ref, lats, lons, a), on_axes(com, lats, lons, b)


#: The bounds of each axis and its greatest value.
_AXES = {"lat": ("lat0", "lat1", 90.0), "lon": ("lon0", "lon1", 180.0)}


def _axis_cells(df: DataFrame, *keys: str) -> DataFrame:
    """``keys``, ``axis``, ``lo``, ``hi``: the distinct cells of both axes."""
    cells = F.array(*(F.struct(F.lit(name).alias("axis"), F.col(lower).alias("lo"), F.col(upper).alias("hi")) for name, (lower, upper, _) in _AXES.items()))
    return df.select(*keys, *CELL).distinct().select(*keys, F.explode(cells).alias("c")).select(*keys, "c.axis", "c.lo", "c.hi").filter("lo is not null").distinct()


def _for_models(axes: DataFrame, models: DataFrame) -> DataFrame:
    """The axes of one grid once for each ``model`` of others."""
    names = models.select("model").distinct().withColumn("_k", F.lit(0))
    return axes.withColumn("_k", F.lit(0)).join(names, "_k").select("model", "axis", "lo", "hi")


def nearest_on_axes(asked: DataFrame, **own: DataFrame) -> DataFrame:
    """``asked`` (model, axis, lo, hi) with, for each of ``own`` (alike) by its name, the lower bound of that cell of the
    model's axis whose centre is nearest, the lower one of equals.

    All are put in order along the axis, and each asked cell looks to the nearest centre on either side. Axes are distinct
    cells, so a window holds one axis of one model.
    """
    none = F.lit(None).cast("double")
    x = ((F.col("lo") + F.col("hi")) / 2).alias("x")
    points = asked.select("model", "axis", x, "lo", "hi", *(none.alias(n) for n in own))
    for name, df in own.items():
        points = points.union(df.select("model", "axis", x, none, none, *(F.col("lo") if n == name else none for n in own)))
    along = Window.partitionBy("model", "axis").orderBy("x", F.col("lo").isNotNull())
    found = points
    for name in own:
        held = F.when(F.col(name).isNotNull(), F.struct("x", name))
        found = found.withColumns({f"_a_{name}": F.last(held, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)), f"_b_{name}": F.first(held, ignorenulls=True).over(along.rowsBetween(0, Window.unboundedFollowing))})
    below = lambda n: F.col(f"_b_{n}").isNull() | (F.col("x") - F.col(f"_a_{n}.x") <= F.col(f"_b_{n}.x") - F.col("x"))
    return found.filter("lo is not null").select("model", "axis", "lo", "hi", *(F.when(below(n), F.col(f"_a_{n}.{n}")).otherwise(F.col(f"_b_{n}.{n}")).alias(n) for n in own))


def axis_meetings(ref: DataFrame, com: DataFrame) -> DataFrame:
    """``model``, ``axis``, ``lo``, ``hi``, ``r``, ``c``: by model of ``com``, whose models lie on grids of their own, the cells
    between all edges of the model's axis and the reference's on the globe, with the lower bounds of the reference's
    nearest cell and of the model's."""
    own = _axis_cells(com, "model")
    base = _for_models(_axis_cells(ref), own)
    both = own.union(base)
    limit = F.coalesce(*(F.when(F.col("axis") == name, F.lit(most)) for name, (_, _, most) in _AXES.items()))
    edges = both.select("model", "axis", "lo").union(both.select("model", "axis", "hi")).filter(F.abs("lo") <= limit).distinct()
    cells = edges.withColumn("hi", F.lead("lo").over(Window.partitionBy("model", "axis").orderBy("lo"))).filter("hi is not null")
    return nearest_on_axes(cells, r=base, c=own)


def one_axis(meetings: DataFrame, axis: str) -> DataFrame:
    """The rows of one axis, with the names of its bounds (``r_lat0`` for the reference's, ``c_lat0`` for the model's)."""
    lower, upper, _ = _AXES[axis]
    return meetings.filter(F.col("axis") == axis).drop("axis").withColumnsRenamed({"lo": lower, "hi": upper, "r": f"r_{lower}", "c": f"c_{lower}"})


def on_one_grid(models: DataFrame, cells: DataFrame) -> DataFrame:
    """``models`` (model, cells of their own grids, more) on the ``cells`` of one grid, by nearest centres on each axis."""
    own, out = _axis_cells(models, "model"), models
    near = nearest_on_axes(_for_models(_axis_cells(cells), own), c=own)
    for axis, (lower, upper, _) in _AXES.items():
        out = out.withColumnRenamed(lower, f"c_{lower}").drop(upper).join(one_axis(near, axis), ["model", f"c_{lower}"]).drop(f"c_{lower}")
    return out.select(*models.columns)


def at_sites(grid: DataFrame, sites: DataFrame) -> DataFrame:
    """The grid's values at sites (site, lat, lon), from the nearest centre on each axis, the lower one of equals.

    A site is looked for in the slots of one degree around it: an axis is a table of its centres by slot, each slot with
    the cells that can be nearest to a place in it. So sites meet each axis, and then the grid, in equi joins.
    """
    spark, out = grid.sparkSession, sites
    for lower, upper, at, own in zip(("lat0", "lon0"), ("lat1", "lon1"), ("lat", "lon"), axes(grid), strict=True):
        centres = [(x + y) / 2 for x, y in own]
        slots = {k: range(nearest(centres, k), nearest(centres, k + 1) + 1) for k in range(-181, 362)}
        rows = [(k, centres[i], *own[i]) for k, near in slots.items() for i in near]
        table = spark.createDataFrame(rows, f"_slot int, _centre double, {lower} double, {upper} double")
        slot = F.least(F.greatest(F.floor(at), F.lit(-181)), F.lit(361)).cast("int")
        near = out.select(at).distinct().withColumn("_slot", slot).join(F.broadcast(table), "_slot")
        best = near.groupBy(at).agg(F.min(F.struct(F.abs(F.col("_centre") - F.col(at)).alias("d"), lower, upper)).alias("_best"))
        out = out.join(best.select(at, F.col(f"_best.{lower}").alias(lower), F.col(f"_best.{upper}").alias(upper)), at)
    return out.join(grid, CELL)


def regular_grid(spark, degrees: float) -> DataFrame:
    """All cells of a regular global grid, made by Spark."""
    lats = spark.range(round(180 / degrees)).select((-90 + F.col("id") * degrees).alias("lat0"), (-90 + (F.col("id") + 1) * degrees).alias("lat1"))
    rows = lats.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(round(360 / degrees) - 1))))
    return rows.select("lat0", "lat1", (-180 + F.col("j") * degrees).alias("lon0"), (-180 + (F.col("j") + 1) * degrees).alias("lon1"))
