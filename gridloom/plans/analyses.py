"""Analyses of particular quantities, each a composition of field operators: one job over all cells, sites or models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import day_shift_score, exp_score, gated_ratio, q10, taylor_score, wrap_shift
from ..operators import CELL
from ..operators.compare import correlation, paired
from ..operators.space import area_column
from ..operators.time import accumulate, annual_cycle, anomaly, consecutive_years_below, detrend, integrate, nearest_month, root_mean_square

#: Fixed values of the method: decay of the score of a final difference, and the differences it is measured by, in Pg.
DIFFERENCE_DECAY = 0.287
DIFFERENCE_SCALES = {"GCP": 21.6 / 2, "Hoffman": 84.6 / 2}


def energy_masked(le: Column, sh: Column) -> Column:
    """Latent and sensible heat that can be used: neither negative, 20 W m-2 together."""
    return (le >= 0) & (sh >= 0) & (le + sh >= 20)


def albedo(up: DataFrame, down: DataFrame, on: list[str], least: float = 10.0) -> DataFrame:
    """Reflected over incoming radiation where the latter is at least ``least``; masked elsewhere."""
    both = paired(down, up, on)
    return both.select(*on, gated_ratio(F.col("com"), F.col("ref"), least).alias("value"))


def ratio_of_means(top: DataFrame, bottom: DataFrame, keys: list[str], least: float = 10.0) -> DataFrame:
    """The time mean of one over that of the other, over the times at which the ratio can be taken."""
    both = paired(bottom, top, [*keys, "t0", "t1"])
    usable = F.when((F.col("ref") >= least) & F.col("com").isNotNull(), F.col("t1") - F.col("t0"))
    return both.groupBy(*keys).agg(F.try_divide(F.sum(F.col("com") * usable), F.sum(F.col("ref") * usable)).alias("value"))


def evaporative_fraction(le: DataFrame, sh: DataFrame, on: list[str]) -> DataFrame:
    both = paired(le, sh, on)
    a, b = F.col("ref"), F.col("com")
    return both.select(*on, F.when(energy_masked(a, b), a / (a + b)).alias("value"))


def net_balance(ref: DataFrame, com: DataFrame, scale: float = DIFFERENCE_SCALES["GCP"], taylor: bool = True, keys: list[str] | None = None) -> DataFrame:
    """Two global series (t0, t1, value) over the times that both have: both accumulations at the end, their difference and
    its score, the score of the path and the temporal distribution score.

    The path is scored where the reference has a lower bound ``value_lo``: differences beyond the accumulated uncertainty,
    divided by it; the start, where both are zero, does not count. ``com`` may hold series of several ``keys``, such as models.
    """
    own = keys or ["_k"]
    low = F.col("value") - F.col("value_lo") if "value_lo" in ref.columns else F.lit(None).cast("double")
    rows = ref.withColumn("_u", low).select("t0", "t1", F.col("value").alias("x"), "_u").join(com.select(*(keys or []), "t0", "t1", F.col("value").alias("y")), ["t0", "t1"]).withColumn("_k", F.lit(0))
    sums = [accumulate(rows.select(*own, "t0", "t1", F.col(c).alias("value")), own).withColumnRenamed("value", c) for c in ("x", "y", "_u")]
    path = sums[0].join(sums[1], [*own, "t"]).join(sums[2], [*own, "t"])
    beyond = F.greatest(F.abs(F.col("y") - F.col("x")) - F.col("_u"), F.lit(0.0))
    ends = path.groupBy(*own).agg(
        F.max_by("x", "t").alias("ref_end"), F.max_by("y", "t").alias("com_end"), F.avg(F.when(F.col("_u") > 0, F.exp(-beyond / F.col("_u")))).alias("trajectory_score"),
    )
    pairs = rows.groupBy(*own).agg(correlation("x", "y").alias("r"), F.try_divide(F.stddev_pop("y"), F.stddev_pop("x")).alias("sigma"))
    diff = F.col("com_end") - F.col("ref_end")
    out = ends.join(pairs, own).select(*(keys or []), "ref_end", "com_end", diff.alias("diff"), F.exp(-DIFFERENCE_DECAY * F.abs(diff / scale)).alias("difference_score"), "trajectory_score", taylor_score(F.col("sigma"), F.col("r")).alias("temporal_score"))
    return out if taylor else out.drop("temporal_score")


def late_starters(runs: DataFrame, benchmark_start: float, days: float = 10.0) -> DataFrame:
    """The models of ``runs`` (model, t0, ...) that start more than ``days`` after the benchmark, which a plot of
    accumulations leaves out."""
    return runs.groupBy("model").agg(F.min("t0").alias("t0")).filter(F.col("t0") > benchmark_start + days).select("model")


def basin_means(df: DataFrame, cells: DataFrame) -> DataFrame:
    """Area means by basin and time; ``cells`` is (basin, lat0, lon0) and a cell may be in several basins."""
    area = area_column()
    return df.join(cells, ["lat0", "lon0"]).groupBy("basin", "t0", "t1").agg(F.try_divide(F.sum(F.col("value") * area), F.sum(F.when(F.col("value").isNotNull(), area))).alias("value"))


def water_storage(ref: DataFrame, com: DataFrame) -> DataFrame:
    """Basin means: the magnitude of the reference's anomaly, the error of the other's and its score."""
    a, b = anomaly(ref, ["basin"]), anomaly(com, ["basin"])
    pairs = paired(a, b, ["basin", "t0", "t1"])
    squared = lambda v: integrate(pairs.withColumn("value", v), ["basin"], mean=True).withColumn("value", F.sqrt("value"))
    size = squared(F.col("ref") * F.col("ref")).withColumnRenamed("value", "magnitude")
    error = squared(F.pow(F.col("com") - F.col("ref"), 2)).withColumnRenamed("value", "rmse")
    return size.join(error, "basin").withColumn("score", F.exp(-F.try_divide(F.col("rmse"), F.col("magnitude"))))


def runoff(ref: DataFrame, com: DataFrame) -> DataFrame:
    """Yearly basin means: period mean, bias, bias score by the reference's mean, and variability score."""
    stats = lambda df, p: df.groupBy("basin").agg(F.avg("value").alias(f"{p}_mean"), F.stddev_pop("value").alias(f"{p}_std"))
    out = stats(ref, "ref").join(stats(com, "com"), "basin").withColumn("bias", F.col("com_mean") - F.col("ref_mean"))
    return out.select("basin", "ref_mean", "com_mean", "bias", exp_score(F.col("bias"), F.col("ref_mean")).alias("bias_score"), exp_score(F.col("com_std") - F.col("ref_std"), F.col("ref_std")).alias("iav_score"))


def permafrost(soil: DataFrame, mapped: DataFrame, threshold: float = 273.15, deepest: float = 3.5) -> DataFrame:
    """Areas (1e6 km2) frozen in both, in the map only and in the field only, and the scores of what was missed and
    what is in excess. ``soil`` has year, depth z0 and value (yearly maxima); ``mapped`` has frozen cells."""
    layers = consecutive_years_below(soil.filter(F.col("z0") <= deepest), [*CELL, "z0"], threshold)
    modelled = layers.groupBy(*CELL).agg(F.bool_or("frozen").alias("frozen")).filter("frozen").select(*CELL, F.lit(1).alias("m"))
    both = mapped.select(*CELL, F.lit(1).alias("o")).join(modelled, CELL, "full")
    area = area_column() / 1e12
    sums = both.agg(
        F.coalesce(F.sum(F.when(F.col("m").isNotNull() & F.col("o").isNotNull(), area)), F.lit(0.0)).alias("overlap"),
        F.coalesce(F.sum(F.when(F.col("m").isNull(), area)), F.lit(0.0)).alias("missed"), F.coalesce(F.sum(F.when(F.col("o").isNull(), area)), F.lit(0.0)).alias("excess"),
    )
    share = lambda c: F.try_divide(F.col("overlap"), F.col("overlap") + F.col(c))
    return sums.withColumns({"missed_score": share("missed"), "excess_score": share("excess")})


def turnover(df: DataFrame) -> DataFrame:
    """Carbon turnover (columns soilc, npp, tas in degC, pr, pet, fracpeat): the quadratic of log10 time in temperature
    by its power sums, and Q10 at -10, 10 and 25 degC."""
    kept = df.filter((F.col("soilc") >= 1e-12) & (F.col("npp") >= 1e-4) & (F.col("pr") - F.col("pet") >= -1000) & (F.coalesce("fracpeat", F.lit(0.0)) <= 0.5))
    x, y = F.col("tas"), F.log10(F.col("soilc") / F.col("npp"))
    sums = kept.agg(*(F.sum(F.pow(x, F.lit(k))).alias(f"s{k}") for k in range(5)), *(F.sum(y * F.pow(x, F.lit(k))).alias(f"p{k}") for k in range(3)))
    s, p = [F.col(f"s{k}") for k in range(5)], [F.col(f"p{k}") for k in range(3)]
    m = [[s[i + j] for j in range(3)] for i in range(3)]

    def det(a) -> Column:
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    c = [F.try_divide(det([[p[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]), det(m)) for k in range(3)]
    out = sums.select(*(x.alias(f"c{k}") for k, x in enumerate(c)))
    return out.select("c0", "c1", "c2", *(q10(F.col("c1") + 2 * F.col("c2") * t).alias(f"q10_{name}") for name, t in (("cold", -10.0), ("mild", 10.0), ("warm", 25.0))))


def detrended_cycle(df: DataFrame, keys: list[str]) -> DataFrame:
    """Amplitude and time of the greatest and least month of a mean yearly cycle."""
    cycle = annual_cycle(df, keys)
    v = F.col("value")
    return cycle.groupBy(*keys).agg((F.max(v) - F.min(v)).alias("amplitude"), F.min_by("month", F.struct(-v, "month")).alias("peak"), F.min_by("month", F.struct(v, "month")).alias("trough"))


def station_cycle(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of a series of concentrations, without its quadratic trend: amplitude of the mean yearly cycle, its greatest and least
    month, and the root mean square of what the cycle leaves (the year-to-year variability)."""
    rows = detrend(df, keys).withColumn("month", nearest_month((F.col("t0") + F.col("t1")) / 2)).filter("value is not null")
    rest = F.col("value") - F.avg("value").over(Window.partitionBy(*keys, "month"))
    by_month = rows.withColumn("_r", rest).groupBy(*keys, "month").agg(F.avg("value").alias("v"), F.sum(F.col("_r") * F.col("_r")).alias("_rr"), F.count(F.lit(1)).alias("_n"))
    v, m = F.col("v"), F.col("month")
    return by_month.groupBy(*keys).agg(
        (F.max(v) - F.min(v)).alias("amplitude"), F.min_by(m, F.struct(-v, m)).alias("peak"), F.min_by(m, F.struct(v, m)).alias("trough"), F.sqrt(F.sum("_rr") / F.sum("_n")).alias("iav"),
    )


def station_scores(ref: DataFrame, com: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of amplitude, variability, and the phases of the greatest and the least month of two series by station."""
    a, b = station_cycle(ref, keys), station_cycle(com, keys)
    both = a.select(*keys, *(F.col(c).alias(f"_{c}") for c in ("amplitude", "peak", "trough", "iav"))).join(b, keys)
    phase = lambda c: day_shift_score(wrap_shift((F.col(c) - F.col(f"_{c}")).cast("double") * 365.0 / 12))
    size = lambda c: exp_score(F.col(c) - F.col(f"_{c}"), F.col(f"_{c}"))
    return both.select(*keys, size("amplitude").alias("amplitude_score"), size("iav").alias("iav_score"), phase("peak").alias("max_phase_score"), phase("trough").alias("min_phase_score"))


def growing_season_flux(cycle: DataFrame, keys: list[str], days: float = 365.0 / 12) -> DataFrame:
    """The uptake (sum of the negative months) of mean cycles, the first and last month of it, and the strongest one."""
    v, m = F.col("value"), F.col("month")
    negative = F.when(v < 0, m)
    return cycle.groupBy(*keys).agg(F.coalesce(F.sum(F.when(v < 0, v * days)), F.lit(0.0)).alias("uptake"), F.min(negative).alias("begin"), F.max(negative).alias("end"), F.min_by(m, F.struct(v, m)).alias("strongest"))


def season_score(days: Column) -> Column:
    """1 - |d| / 60 of a difference of season marks in days, at least 0."""
    return F.greatest(1 - F.abs(days) / 60.0, F.lit(0.0))


def growing_season_scores(ref: DataFrame, com: DataFrame, keys: list[str]) -> DataFrame:
    """Mean cycles (keys, month, value): uptakes, the differences of the season's begin, end and strongest month in days, the
    mean of their scores, and the score of the uptake by its relative error."""
    a, b = growing_season_flux(ref, keys), growing_season_flux(com, keys)
    marks = ("begin", "end", "strongest")
    both = a.select(*keys, F.col("uptake").alias("ref_uptake"), *(F.col(c).alias(f"_{c}") for c in marks)).join(b, keys)
    out = both.select(*keys, "ref_uptake", "uptake", *(((F.col(c) - F.col(f"_{c}")) * (365.0 / 12)).alias(c) for c in marks))
    scores = [season_score(F.col(c)) for c in marks]
    return out.withColumns({"season_score": (scores[0] + scores[1] + scores[2]) / 3, "flux_score": exp_score(F.col("uptake") - F.col("ref_uptake"), F.col("ref_uptake"))})


def diurnal_score(difference: Column, length: Column) -> Column:
    """exp(ln 0.1 / 0.5 |d| / L): a tenth at half the season's length."""
    return F.exp(math.log(0.1) / 0.5 * F.abs(F.try_divide(difference, length)))


def diurnal_season(df: DataFrame, keys: list[str], threshold: float = 0.2) -> DataFrame:
    """From daily amplitudes (keys, ``day``, ``value``): the season of the days with over ``threshold`` of the greatest one:
    its first and last day, length, centroid, day of the maximum, and mean amplitude in it."""
    most = df.groupBy(*keys).agg(F.max("value").alias("_most"), F.min_by("day", F.struct(-F.col("value"), "day")).alias("peak"))
    inside = df.join(most, keys).filter(F.col("value") > threshold * F.col("_most"))
    out = inside.groupBy(*keys).agg(
        F.min("day").alias("begin"), F.max("day").alias("end"), (F.sum(F.col("day") * F.col("value")) / F.sum("value")).alias("centroid"), F.avg("value").alias("uptake"), F.first("peak").alias("peak"),
    )
    return out.withColumn("length", F.col("end") - F.col("begin") + 1)


def diurnal_scores(ref: DataFrame, com: DataFrame, keys: list[str], threshold: float = 0.2) -> DataFrame:
    """The five scores of a season of daily amplitudes: begin and end, length, centroid, time of the maximum, uptake."""
    a, b = diurnal_season(ref, keys, threshold), diurnal_season(com, keys, threshold)
    both = a.select(*keys, *(F.col(c).alias(f"_{c}") for c in ("begin", "end", "length", "centroid", "peak", "uptake"))).join(b, keys)
    off = lambda c: diurnal_score(F.col(c) - F.col(f"_{c}"), F.col("_length"))
    return both.select(*keys, ((off("begin") + off("end")) / 2).alias("bounds_score"), off("length").alias("length_score"), off("centroid").alias("centroid_score"), off("peak").alias("timing_score"), exp_score(F.col("uptake") - F.col("_uptake"), F.col("_uptake")).alias("uptake_score"))


def uncertain_bias(ref: DataFrame, com: DataFrame, keys: list[str]) -> DataFrame:
    """The bias of the time means; and the time mean of exp(-u / s), where u is how far a value lies beyond the reference's
    own bounds (value_lo, value_hi) at its time and s the reference's deviation from its mean (the mean, with one time)."""
    w, x, y = F.col("t1") - F.col("t0"), F.col("x"), F.col("y")
    pairs = ref.select(*keys, "t0", "t1", F.col("value").alias("x"), "value_lo", "value_hi").join(com.select(*keys, "t0", "t1", F.col("value").alias("y")), [*keys, "t0", "t1"])
    mean = lambda v: F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))
    means = pairs.groupBy(*keys).agg(mean(x).alias("_x"), mean(y).alias("_y"), mean(x * x).alias("_xx"), F.count(F.lit(1)).alias("_n"))
    means = means.withColumn("_s", F.when(F.col("_n") > 1, F.sqrt(F.greatest(F.col("_xx") - F.col("_x") * F.col("_x"), F.lit(0.0)))).otherwise(F.col("_x")))
    beyond = F.greatest(y - F.col("value_hi"), F.lit(0.0)) + F.greatest(F.col("value_lo") - y, F.lit(0.0))
    scored = pairs.join(means, keys).withColumn("_score", F.when(x.isNotNull() & y.isNotNull(), F.exp(-F.try_divide(beyond, F.col("_s")))))
    return scored.groupBy(*keys).agg(F.first(F.col("_y") - F.col("_x")).alias("bias"), mean(F.col("_score")).alias("score"))


def depth_gradient(df: DataFrame, keys: list[str], top: float, bottom: float) -> DataFrame:
    """Least-squares slope of the profile with depth between two depths, positive where values fall with depth."""
    z = (F.col("z0") + F.col("z1")) / 2
    return df.filter((F.col("z1") > top) & (F.col("z0") < bottom)).groupBy(*keys).agg((-F.regr_slope("value", z)).alias("value"))


def content_change(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last less the first value in time, by ``keys``."""
    v = F.struct("t0", "value")
    return df.filter("value is not null").groupBy(*keys).agg((F.max(v)["value"] - F.min(v)["value"]).alias("value"))


def accumulated_total(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rates (per day) to totals of each interval."""
    return df.withColumn("value", F.col("value") * (F.col("t1") - F.col("t0"))).select(*keys, "t0", "t1", "value")


def deseasonalised(df: DataFrame, keys: list[str]) -> DataFrame:
    """value less the mean of its month of the year, by ``keys``; the root mean square of it is the year-to-year variability."""
    month = F.floor(F.pmod((F.col("t0") + F.col("t1")) / 2, F.lit(365.0)) / (365.0 / 12)).cast("int")
    rows = df.withColumn("_m", month)
    return rows.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*keys, "_m"))).drop("_m")


def interannual_variability(df: DataFrame, keys: list[str]) -> DataFrame:
    return root_mean_square(deseasonalised(df, keys), keys)


def band_summary(sites: DataFrame, bands: list[tuple[float, float]]) -> DataFrame:
    """Latitude bands (lo, hi] of sites (lat, amplitude, peak_day): mean amplitude, circular mean day, number of sites."""
    label = F.coalesce(*(F.when((F.col("lat") > lo) & (F.col("lat") <= hi), F.lit(k)) for k, (lo, hi) in enumerate(bands)))
    angle = F.col("peak_day") * (2 * math.pi / 365)
    out = sites.withColumn("band", label).filter("band is not null").groupBy("band").agg(F.avg("amplitude").alias("amplitude"), F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))).alias("_a"), F.count(F.lit(1)).alias("n"))
    return out.select("band", "amplitude", F.pmod(F.col("_a") * (365 / (2 * math.pi)), F.lit(365.0)).alias("peak_day"), "n")
