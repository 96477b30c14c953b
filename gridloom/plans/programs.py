"""Programs of particular quantities by ``ctype``: from a dataset's reference and all its models to scalars, in one job.

Each takes (node, reference, models, regions) like the default program. Those in ``RAW`` get the fields as they are, in
the units of the configuration, because reference and models differ in kind (a series of the globe or of basins against
grids); the others get fields that ``alignment.comparable`` has made alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import exp_score
from ..operators.compare import efficiency
from ..operators.polygons import basin_means
from ..operators.space import area_column
from ..operators.time import annual_cycle, coarsen
from . import config, run
from .analyses import DIFFERENCE_SCALES, growing_season_scores, net_balance
from .mean_state import _mean_of


def _years(df: DataFrame) -> DataFrame:
    """The whole years, as intervals, that a field's times cover."""
    ends = df.agg(F.ceil(F.min("t0") / 365.0).alias("a"), F.floor(F.max("t1") / 365.0).alias("b")).filter("b > a")
    return ends.select(F.explode(F.sequence("a", F.col("b") - 1)).alias("y")).select((F.col("y") * 365.0).alias("b0"), ((F.col("y") + 1) * 365.0).alias("b1"))


def yearly(df: DataFrame, keys: list[str], like: DataFrame) -> DataFrame:
    """Means of the whole years that ``like`` covers."""
    return coarsen(df, _years(like), keys).withColumnsRenamed({"b0": "t0", "b1": "t1"})


def _scalars(wide: DataFrame, names: dict[str, str], region: str = "global") -> DataFrame:
    rows = wide.select("model", F.explode(F.array(*(F.struct(F.lit(n).alias("scalar"), F.col(c).cast("double").alias("value")) for c, n in names.items()))).alias("x"))
    return rows.select("model", F.lit(region).alias("region"), "x.scalar", "x.value").filter("value is not null")


def balance_program(node: config.Node, ref: DataFrame, com: DataFrame, regions: DataFrame) -> DataFrame:
    """The balance of the globe: models' fluxes summed over all cells, means of years, accumulated, against a series of the
    globe. The difference at the end is scored on the scale of the node's ``difference_scale`` (GCP unless it says else)."""
    flux = com.groupBy("model", "t0", "t1").agg(F.sum(F.col("value") * area_column()).alias("value")) if "lat0" in com.columns else com
    a = yearly(ref, [], ref) if "value_lo" not in ref.columns else ref
    out = net_balance(a, yearly(flux, ["model"], ref), DIFFERENCE_SCALES[node.values.get("difference_scale", "GCP")], keys=["model"])
    return _scalars(out, {"com_end": "nbp", "diff": "diff", "difference_score": "Difference Score", "trajectory_score": "Trajectory Score", "temporal_score": "Temporal Distribution Score"})


def efficiency_program(node: config.Node, ref: DataFrame, com: DataFrame, regions: DataFrame) -> DataFrame:
    """Series of sites, such as gauges: the mean over sites of the efficiencies of each and of the models' means."""
    pairs = com.select("model", "site", "t0", F.col("value").alias("com")).join(ref.select("site", "t0", F.col("value").alias("ref")), ["site", "t0"])
    means = pairs.filter("ref is not null and com is not null").groupBy("model", "site").agg(F.avg("com").alias("mean"))
    out = efficiency(pairs, ["model", "site"]).join(means, ["model", "site"]).groupBy("model").agg(*(F.avg(c).alias(c) for c in ("mean", "nse", "kge")))
    return _scalars(out, {"mean": "Mean Discharge", "nse": "NSE Score", "kge": "KGE Score"})


def basin_program(rings: DataFrame, tile: float = 1.0) -> run.Program:
    """Gridded models against yearly series of basins (``site`` is the basin), whose polygons are ``rings``: means of years over
    each basin; bias, scored by the reference's mean, and year-to-year variability, as means weighted by the reference."""

    def program(node: config.Node, ref: DataFrame, com: DataFrame, regions: DataFrame) -> DataFrame:
        own = yearly(basin_means(com, rings, ["model"], tile), ["model", "site"], ref)
        pairs = own.select("model", "site", "t0", F.col("value").alias("y")).join(ref.select("site", "t0", F.col("value").alias("x")), ["site", "t0"]).filter("x is not null and y is not null")
        basins = pairs.groupBy("model", "site").agg(*(f(c).alias(f"{n}{c}") for c in "xy" for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))))
        off = F.col("my") - F.col("mx")
        scored = basins.withColumns({"bias": off, "bias_score": exp_score(off, F.col("mx")), "iav_score": exp_score(F.col("sy") - F.col("sx"), F.col("sx"))})
        weight = F.abs("mx")
        out = scored.groupBy("model").agg(F.avg("mx").alias("ref_mean"), F.avg("my").alias("com_mean"), F.avg("bias").alias("bias"), *(_mean_of(c, weight).alias(c) for c in ("bias_score", "iav_score")))
        return _scalars(out, {"ref_mean": "Benchmark Period Mean (intersection)", "com_mean": "Model Period Mean (intersection)", "bias": "Bias", "bias_score": "Bias Score", "iav_score": "Interannual Variability Score"})

    return program


def season_program(node: config.Node, ref: DataFrame, com: DataFrame, regions: DataFrame) -> DataFrame:
    """The growing season of the land north of 20 degrees: the cycle of the flux summed over it, its season and net flux."""
    north = lambda df, *keys: df.filter(F.col("lat0") >= 20).groupBy(*keys, "t0", "t1").agg(F.sum(F.col("value") * area_column()).alias("value"))
    models = com.select("model").distinct().withColumn("_k", F.lit(0))
    a = annual_cycle(north(ref).withColumn("_k", F.lit(0)).join(models, "_k").drop("_k"), ["model"])
    out = growing_season_scores(a, annual_cycle(north(com, "model"), ["model"]), ["model"])
    marked = out.withColumn("season_score", F.when(F.col("begin").isNotNull() & F.col("end").isNotNull(), F.col("season_score")))
    return _scalars(marked, {"uptake": "Growing Season Net Flux", "season_score": "Growing Season Score", "flux_score": "Growing Season Net Flux Score"})


#: Programs that make their fields comparable themselves.
RAW = {"ConfNBP", "ConfBasin"}


def register_all(rings: DataFrame | None = None, tile: float = 1.0) -> None:
    """Make the programs known to runs by the names that configurations use; that of basins needs their polygons."""
    programs: dict[str, Callable] = {"ConfNBP": balance_program, "ConfUSGS": efficiency_program, "ConfGSNF": season_program}
    if rings is not None:
        programs["ConfBasin"] = basin_program(rings, tile)
    for name, program in programs.items():
        run.register(name, program, raw=name in RAW)
