"""The default analysis of a field against a reference: period means, cycles, variability, errors and their scores by region.

All models are one table with a ``model`` column, so a dataset is one job whatever the number of models and their grids.
Each field is reduced by its own cells: once for its mean cycles, once with them for its other statistics. Only errors of
series need both fields at once. Everything after that is as small as a grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import cycle_score, exp_score, taylor_score, wrap_shift
from ..operators import CELL
from ..operators.compare import bias, correlation
from ..operators.lookup import regional_threshold
from ..operators.space import area_column, axis_meetings, compose, in_region, one_axis
from ..operators.time import annual_cycle, integrate, nearest_month
from ..sources.store import written

#: Days in the months of a year without leap days.
MONTH_DAYS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


def period_bias(ref: DataFrame, com: DataFrame) -> DataFrame:
    """Bias of the time means on the composed grid."""
    a, b = compose(integrate(ref, CELL, mean=True), integrate(com, CELL, mean=True), (ref, com))
    return bias(a, b, CELL)


def global_bias(ref: DataFrame, com: DataFrame) -> DataFrame:
    """Area-weighted mean bias over all cells of the composed grid: the flagship query."""
    area = area_column()
    v = F.col("value")
    cells = period_bias(ref, com).filter(v.isNotNull())
    return cells.agg(F.count(F.lit(1)).alias("n_cells"), F.try_divide(F.sum(v * area), F.sum(area)).alias("bias"), F.sum(area).alias("area"))


def series_statistics(ref: DataFrame, com: DataFrame, keys: list[str]) -> DataFrame:
    """By ``keys``, from one join and one aggregate over the times of both: the means of each over its own times, the
    reference's deviation from its mean, the root mean square error and the centred one.

    Fields on one grid meet by the lower bounds of cells and times alone, so the other field moves four columns.
    """
    upper = {"lat1": "lat0", "lon1": "lon0"}
    on = [*(k for k in keys if upper.get(k) not in keys), "t0"]
    pairs = ref.select(*keys, "t0", "t1", F.col("value").alias("x")).join(com.select(*on, F.col("value").alias("y")), on)
    return _statistics(pairs, keys)


def _statistics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    x, y, w = F.col("x"), F.col("y"), F.col("t1") - F.col("t0")
    d = y - x
    has = lambda *c: F.sum(F.when(F.greatest(*(v.isNull().cast("int") for v in c), F.lit(0)) == 0, w))
    sums = pairs.groupBy(*keys).agg(
        has(x).alias("_wx"), F.sum(x * w).alias("_x"), F.sum(x * x * w).alias("_xx"), has(y).alias("_wy"), F.sum(y * w).alias("_y"),
        has(x, y).alias("_w"), F.sum(d * w).alias("_d"), F.sum(d * d * w).alias("_dd"), F.count(F.lit(1)).alias("n_times"),
    )
    out = sums.withColumns({"ref_mean": F.try_divide("_x", "_wx"), "com_mean": F.try_divide("_y", "_wy")})
    shift = F.col("com_mean") - F.col("ref_mean")
    square = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))
    return out.select(
        *keys, "ref_mean", "com_mean", "n_times", shift.alias("bias"), square(F.try_divide("_xx", "_wx") - F.pow("ref_mean", F.lit(2))).alias("spread"),
        square(F.try_divide("_dd", "_w")).alias("rmse"), square(F.try_divide("_dd", "_w") - 2 * shift * F.try_divide("_d", "_w") + shift * shift).alias("crmse"),
    )


def _mean_of(column: str | Column, weight: Column, where: Column | None = None) -> Column:
    v = F.col(column) if isinstance(column, str) else column
    v = v if where is None else F.when(where, v)
    return F.try_divide(F.sum(v * weight), F.sum(F.when(v.isNotNull(), weight)))


def regional_scores(ref: DataFrame, com: DataFrame, regions: DataFrame) -> DataFrame:
    """By region, on the grid both share: bias, its score (normalised by the reference's own deviation, weighted by the
    reference mean), the root mean square error and its score."""
    cells = series_statistics(ref, com, CELL)
    cells = cells.withColumns({"bias_score": exp_score(F.col("bias"), F.col("spread")), "rmse_score": exp_score(F.col("crmse"), F.col("spread"))})
    area, mass = area_column(), F.abs("ref_mean")
    return in_region(cells, regions).groupBy("region").agg(
        _mean_of("bias", area).alias("bias"), _mean_of("bias_score", area * mass).alias("bias_score"),
        _mean_of("rmse", area).alias("rmse"), _mean_of("rmse_score", area * mass).alias("rmse_score"),
    )


def _own_statistics(df: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Of one field by ``keys``: its mean, deviation from it, number of times, first month of the greatest of the mean cycle
    and root mean square of the difference from the cycle; and the cycle (``month``, value)."""
    x, w = F.col("value"), F.col("t1") - F.col("t0")
    cycle = written(annual_cycle(df, keys).withColumnRenamed("value", name), "cycle")
    mean = lambda v: F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))
    rest = df.withColumn("month", nearest_month((F.col("t0") + F.col("t1")) / 2)).join(cycle, [*keys, "month"], "left")
    off = x - F.col(name)
    sums = rest.groupBy(*keys).agg(mean(x).alias(f"{name}_mean"), mean(x * x).alias("_xx"), F.count(F.lit(1)).alias(f"{name}_times"), F.sqrt(mean(off * off)).alias(f"{name}_iav"))
    sums = sums.withColumn(f"{name}_spread", F.sqrt(F.greatest(F.col("_xx") - F.pow(f"{name}_mean", F.lit(2)), F.lit(0.0)))).drop("_xx")
    top = F.min(F.when(F.col(name).isNotNull(), F.struct((-F.col(name)).alias("v"), F.col("month").alias("m"))))["m"]
    return sums.join(cycle.groupBy(*keys).agg(top.alias(f"{name}_top")), keys, "left"), cycle


def place_scores(ref: DataFrame, com: DataFrame, place: list[str], basis: str = "cycle", meetings: DataFrame | None = None) -> DataFrame:
    """By model and place (``place`` names what identifies a site, or a cell by its lower bounds): means, deviation, bias,
    errors (of the mean cycles or of the series), phase shift in months, year-to-year variability of both, and the scores of
    all these. ``both`` tells where both have data.

    With ``meetings`` (``axis_meetings``) each model has a grid of its own: the places are the cells of the composed grids,
    with all bounds. Each field is reduced by its own cells, and what needs both by the pairs of cells that meet, which the
    axes tell; the reference is never copied for the models.
    """
    (a, ca), (b, cb) = _own_statistics(ref, place, "r"), _own_statistics(com, ["model", *place], "c")
    rs, cs = [f"r_{c}" for c in place], [f"c_{c}" for c in place]
    named = lambda df, to: df.withColumnsRenamed(dict(zip(place, to, strict=True)))
    a, ca, b, cb, com_, ref_ = named(a, rs), named(ca, rs), named(b, cs), named(cb, cs), named(com, cs), named(ref, rs)
    if meetings is None:
        models = com.select("model").distinct().withColumn("_k", F.lit(0))
        mine = ref.select(*place).distinct().withColumn("_k", F.lit(0)).join(models, "_k").select("model", *place)
        cells = com.select("model", *place).union(mine).distinct().select("model", *place, *(F.col(c).alias(t) for to in (rs, cs) for c, t in zip(place, to, strict=True)))
        met = lambda df: df.withColumns({r: F.col(c) for r, c in zip(rs, cs, strict=True)})
    else:
        lats, lons = one_axis(meetings, "lat"), one_axis(meetings, "lon")
        cells = lats.join(lons, "model")
        met = lambda df: df.join(lats.select("model", "r_lat0", "c_lat0").distinct(), ["model", "c_lat0"]).join(lons.select("model", "r_lon0", "c_lon0").distinct(), ["model", "c_lon0"])
    keys = ["model", *rs, *cs]
    if basis == "cycle":
        days = F.element_at(F.lit(MONTH_DAYS), F.col("month") + 1)
        pairs = met(cb).join(ca, [*rs, "month"]).select(*keys, F.col("r").alias("x"), F.col("c").alias("y"), days.alias("w"))
    else:
        times = met(com_.select("model", *cs, "t0", F.col("value").alias("y")))
        pairs = times.join(ref_.select(*rs, "t0", (F.col("t1") - F.col("t0")).alias("w"), F.col("value").alias("x")), [*rs, "t0"]).select(*keys, "x", "y", "w")
    d, w = F.col("y") - F.col("x"), F.col("w")
    whole = F.sum(F.when(d.isNotNull(), w))
    errors = pairs.groupBy(*keys).agg(F.try_divide(F.sum(d * d * w), whole).alias("_dd"), F.try_divide(F.sum(d * w), whole).alias("_d"), (F.avg("y") - F.avg("x")).alias("_m"))
    both = cells.join(a, rs, "left").join(b, ["model", *cs], "left").join(errors, keys, "left").filter("r_mean is not null or c_mean is not null")
    bias_ = F.col("c_mean") - F.col("r_mean")
    # the means that errors are centred by: of the cycles, or those over each field's own times
    shift_ = F.col("_m") if basis == "cycle" else bias_
    bounds = CELL if meetings is not None else place
    norm = F.when(F.col("r_times") > 1, F.col("r_spread")).otherwise(F.col("r_mean"))
    out = both.select(
        "model", *bounds, F.col("r_mean").alias("ref_mean"), F.col("c_mean").alias("com_mean"), F.col("r_times").alias("n_times"), F.col("r_spread").alias("spread"), bias_.alias("bias"), norm.alias("_norm"),
        F.sqrt("_dd").alias("rmse"), F.sqrt(F.greatest(F.col("_dd") - 2 * shift_ * F.col("_d") + shift_ * shift_, F.lit(0.0))).alias("crmse"),
        wrap_shift((F.col("c_top") - F.col("r_top")).cast("double") * 365.0 / 12.0).alias("shift"), F.col("r_iav").alias("ref_iav"), F.col("c_iav").alias("com_iav"),
    )
    scored = {
        "both": F.col("ref_mean").isNotNull() & F.col("com_mean").isNotNull(),
        "bias_score": exp_score(F.col("bias"), F.col("_norm")),
        "rmse_score": exp_score(F.col("crmse"), F.col("spread")),
        "cycle_score": cycle_score(F.col("shift")),
        "shift": F.abs("shift") / 30.0,
        "iav_score": exp_score(F.col("com_iav") - F.col("ref_iav"), F.col("ref_iav")),
    }
    return out.withColumns(scored).drop("_norm")


#: The names of scalars.
_NAMES = {
    "bias": "Bias", "bias_score": "Bias Score", "rmse": "RMSE", "rmse_score": "RMSE Score", "shift": "Phase Shift", "cycle_score": "Seasonal Cycle Score",
    "iav_score": "Interannual Variability Score", "ref_mean": "Benchmark Period Mean (intersection)", "com_mean": "Model Period Mean (intersection)",
    "ref_only": "Benchmark Period Mean (complement)", "com_only": "Model Period Mean (complement)", "sd_score": "Spatial Distribution Score",
}
#: Scores that a flag of the configuration leaves out.
SKIPPED = {"skip_cycle": ("shift", "cycle_score", "iav_score"), "skip_rmse": ("rmse", "rmse_score", "iav_score"), "skip_iav": ("iav_score",)}


def _long(wide: DataFrame, keys: list[str], skip: tuple[str, ...]) -> DataFrame:
    left_out = {c for flag in skip for c in SKIPPED[flag]}
    columns = [c for c in _NAMES if c in wide.columns and c not in left_out]
    rows = wide.select(*keys, F.explode(F.array(*(F.struct(F.lit(_NAMES[c]).alias("scalar"), F.col(c).alias("value")) for c in columns))).alias("x"))
    return rows.select(*keys, "x.scalar", "x.value").filter("value is not null")


def skipped(ref: DataFrame, skip: tuple[str, ...] = ()) -> tuple[str, ...]:
    """``skip`` and what the reference's times do not allow: no cycle unless they are at least twelve months, no errors and
    no variability with a single time. One small job on the distinct times."""
    times = ref.select("t0", "t1").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("t1") - F.col("t0")).alias("dt")).first()
    monthly = times["n"] >= 12 and abs(times["dt"] - 30) < 3
    return (*skip, *(() if monthly else ("skip_cycle",)), *(("skip_rmse",) if times["n"] == 1 else ()))


def quantile_score(cells: DataFrame, column: str, thresholds: DataFrame, regions: DataFrame, kind: str) -> DataFrame:
    """``cells`` with ``column``_score made anew: 1 - |column| / threshold within [0, 1], the threshold being the sum over a
    cell's regions of the table's (``region``, ``type``, ``value``) values of the type ``kind``; null in no region."""
    by_cell = regional_threshold(in_region(cells.select(*CELL).distinct(), regions), thresholds.filter(F.col("type") == kind))
    share = 1 - F.try_divide(F.abs({"bias": "bias", "rmse": "crmse"}[column]), F.col("threshold"))
    score = F.when(share.isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
    return cells.join(by_cell, CELL, "left").withColumn(f"{column}_score", score).drop("threshold")


def mean_state(ref: DataFrame, com: DataFrame, regions: DataFrame, basis: str = "cycle", mass_weighting: bool = True, skip: tuple[str, ...] = (), thresholds: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``model``, ``region``, ``scalar``, ``value``: all scalars of gridded models, each on a grid of its own, by region.

    Each model meets the reference on the grid of both their cell edges. Means over the cells that both have, that only one
    has; spatial distribution of the time means; bias, errors, cycle and variability with their scores, which weigh cells by
    area and, for scores with ``mass_weighting``, the reference's mean. ``thresholds`` (a table of regional thresholds, and
    its regions) makes scores of bias and errors by ``quantile_score``, without mass weighting.
    """
    meetings = written(axis_meetings(ref, com), "axes")
    scores = place_scores(ref, com, ["lat0", "lon0"], basis, meetings)
    if thresholds is not None:
        mass_weighting = False
        for column in ("bias", "rmse"):
            scores = quantile_score(scores, column, *thresholds, column)
    cells = in_region(scores, regions)
    area, both = area_column(), F.col("both")
    mass = area * F.abs("ref_mean") if mass_weighting else area
    x, y = (F.when(both, F.col(c)) for c in ("ref_mean", "com_mean"))
    marked = cells.withColumns({"_x": x, "_y": y})
    wide = marked.groupBy("model", "region").agg(
        *(_mean_of(c, area, both).alias(c) for c in ("ref_mean", "com_mean", "bias", "rmse", "shift")),
        *(_mean_of(c, mass, both).alias(c) for c in ("bias_score", "rmse_score", "cycle_score", "iav_score")),
        _mean_of("ref_mean", area, F.col("com_mean").isNull()).alias("ref_only"), _mean_of("com_mean", area, F.col("ref_mean").isNull()).alias("com_only"),
        correlation("_x", "_y").alias("_r"), F.try_divide(F.stddev_pop("_y"), F.stddev_pop("_x")).alias("_s"),
    )
    return _long(wide.withColumn("sd_score", taylor_score(F.col("_s"), F.col("_r"))), ["model", "region"], skipped(ref, skip))


def site_state(ref: DataFrame, com: DataFrame, basis: str = "series", skip: tuple[str, ...] = ()) -> DataFrame:
    """``model``, ``scalar``, ``value``: the scalars of site data, as means over the sites that both have; there is no
    complement and no spatial distribution."""
    sites = place_scores(ref, com, ["site"], basis).filter("both")
    wide = sites.groupBy("model").agg(*(F.avg(c).alias(c) for c in ("ref_mean", "com_mean", "bias", "bias_score", "rmse", "rmse_score", "shift", "cycle_score", "iav_score")))
    return _long(wide, ["model"], skipped(ref, skip))
