"""Comparison of a field with a reference field: bias, errors, correlation, distributions and relationships."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import taylor_score
from . import CELL
from .space import on_one_grid
from .time import integrate


def paired(ref: DataFrame, com: DataFrame, on: list[str]) -> DataFrame:
    """``ref`` and ``com`` values that share ``on``, as columns of these names."""
    return ref.select(*on, F.col("value").alias("ref")).join(com.select(*on, F.col("value").alias("com")), on)


def bias(ref: DataFrame, com: DataFrame, on: list[str]) -> DataFrame:
    return paired(ref, com, on).withColumn("value", F.col("com") - F.col("ref"))


def rmse(ref: DataFrame, com: DataFrame, keys: list[str]) -> DataFrame:
    """Root of the time mean of the squared difference."""
    pairs = paired(ref, com, [*keys, "t0", "t1"])
    squared = pairs.withColumn("value", F.pow(F.col("com") - F.col("ref"), 2))
    return integrate(squared, keys, mean=True).withColumn("value", F.sqrt("value"))


def correlation(x: str = "ref", y: str = "com") -> Column:
    """Pearson's r of two columns where n counts all rows, masked ones too, and sums skip them."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    n = F.count(F.lit(1))
    sx, sy = F.sum(a), F.sum(b)
    top = n * F.sum(a * b) - sx * sy
    return F.try_divide(top, F.sqrt(n * F.sum(a * a) - sx * sx) * F.sqrt(n * F.sum(b * b) - sy * sy))


def taylor(ref: DataFrame, com: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Spatial distribution: standard deviation ratio (each on its own grid), correlation on the common one, score."""
    r = pairs.groupBy(*keys).agg(correlation().alias("r"))
    a = ref.groupBy(*keys).agg(F.stddev_pop("value").alias("_a"))
    b = com.groupBy(*keys).agg(F.stddev_pop("value").alias("_b"))
    out = r.join(a, keys).join(b, keys) if keys else _one_row(r, a, b)
    out = out.withColumn("sigma", F.try_divide(F.greatest("_b", F.lit(1e-12)), F.greatest("_a", F.lit(1e-12)))).drop("_a", "_b")
    return out.withColumn("score", taylor_score(F.col("sigma"), F.col("r")))


def _one_row(*frames: DataFrame) -> DataFrame:
    """Aggregates without keys side by side."""
    out = frames[0].withColumn("_k", F.lit(0))
    for f in frames[1:]:
        out = out.join(f.withColumn("_k", F.lit(0)), "_k")
    return out.drop("_k")


def presence(ref: DataFrame, com: DataFrame, on: list[str]) -> DataFrame:
    """Whether each place has data in both, the reference only or the other only."""
    a = ref.groupBy(*on).agg((F.count("value") > 0).alias("_a"))
    b = com.groupBy(*on).agg((F.count("value") > 0).alias("_b"))
    has = a.join(b, on, "full")
    in_a, in_b = F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))
    return has.select(*on, F.when(in_a & in_b, "both").when(in_a, "reference").when(in_b, "other").alias("where")).filter("where is not null")


def overlaid(first: DataFrame, second: DataFrame, on: list[str], tiny: float = 1e-12) -> DataFrame:
    """``first``, filled from ``second`` where it is masked or tiny beside its maximum."""
    most = first.agg(F.max("value").alias("m")).first()["m"] or 0.0
    rows = first.select(*on, F.col("value").alias("_a")).join(second.select(*on, F.col("value").alias("_b")), on, "full")
    return rows.select(*on, F.coalesce(F.when(F.col("_a") >= tiny * most, F.col("_a")), "_b").alias("value"))


def efficiency(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Nash-Sutcliffe and Kling-Gupta efficiencies within [0, 1], from one pass of sums."""
    both = pairs.filter("ref is not null and com is not null")
    sums = both.groupBy(*keys).agg(
        F.sum(F.pow(F.col("com") - F.col("ref"), 2)).alias("_e"), F.var_pop("ref").alias("_v"), F.count(F.lit(1)).alias("_n"), F.corr("ref", "com").alias("_r"),
        F.stddev_pop("com").alias("_sc"), F.stddev_pop("ref").alias("_sr"), F.avg("com").alias("_mc"), F.avg("ref").alias("_mr"),
    )
    nse = 1 - F.try_divide(F.col("_e"), F.col("_v") * F.col("_n"))
    kge = 1 - F.sqrt(F.pow(F.col("_r") - 1, 2) + F.pow(F.try_divide("_sc", "_sr") - 1, 2) + F.pow(F.try_divide("_mc", "_mr") - 1, 2))
    bounded = lambda x: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return sums.select(*keys, bounded(nse).alias("nse"), bounded(kge).alias("kge"))


def bins(column: str, low: float, high: float, n: int) -> Column:
    """Bin 1 to n of equal width; values outside go into the edge bins."""
    return F.least(F.greatest(F.floor((F.col(column) - low) / ((high - low) / n)) + 1, F.lit(1)), F.lit(n)).cast("int")


def limits(df: DataFrame, column: str, slack: float = 1e-8) -> tuple[float, float]:
    row = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    spread = slack * (row["b"] - row["a"])
    return row["a"] - spread, row["b"] + spread


def histogram2d(df: DataFrame, ind: str, dep: str, ind_limits: tuple[float, float], dep_limits: tuple[float, float], n: int = 25) -> DataFrame:
    """Share of the pairs in each two-dimensional bin; empty bins have no row."""
    rows = df.filter(F.col(ind).isNotNull() & F.col(dep).isNotNull())
    counts = rows.groupBy(bins(ind, *ind_limits, n).alias("bin_x"), bins(dep, *dep_limits, n).alias("bin_y")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    return counts.withColumn("share", F.col("n") / F.lit(float(total or 1)))


def response(df: DataFrame, ind: str, dep: str, ind_limits: tuple[float, float], n: int = 25, least_share: float = 3e-3) -> DataFrame:
    """Mean and standard deviation of ``dep`` by bins of ``ind`` that hold a share of at least ``least_share``."""
    rows = df.filter(F.col(ind).isNotNull() & F.col(dep).isNotNull())
    total = float(rows.count() or 1)
    out = rows.groupBy(bins(ind, *ind_limits, n).alias("bin_x")).agg(F.avg(dep).alias("mean"), F.stddev_pop(dep).alias("std"), F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") / F.lit(total) >= least_share)


def log_response(df: DataFrame, ind: str, dep: str, ind_limits: tuple[float, float], n: int = 25, least_share: float = 3e-3) -> DataFrame:
    """``response`` in log10 of a positive ``dep``: 10 to the mean of its logarithms, and their standard deviation."""
    own = df.filter(F.col(dep) > 0).withColumn("_log", F.log10(dep))
    return response(own, ind, "_log", ind_limits, n, least_share).withColumn("mean", F.pow(F.lit(10.0), F.col("mean")))


def response_line(df: DataFrame, ind: str, dep: str) -> DataFrame:
    """The least-squares line of ``dep`` and the half width of the band that holds half of normal residuals (0.674 standard
    deviations of them): ``slope``, ``intercept``, ``band``."""
    rows = df.filter(F.col(ind).isNotNull() & F.col(dep).isNotNull())
    spread = F.sqrt(F.greatest(F.regr_syy(dep, ind) - F.pow(F.regr_sxy(dep, ind), F.lit(2)) / F.regr_sxx(dep, ind), F.lit(0.0)) / F.regr_count(dep, ind))
    return rows.agg(F.regr_slope(dep, ind).alias("slope"), F.regr_intercept(dep, ind).alias("intercept"), (0.674 * spread).alias("band"))


def shared_limits(frames: list[DataFrame], column: str) -> tuple[float, float]:
    """Limits that hold the values of all the fields, on which their relationships are binned alike."""
    own = [limits(df, column) for df in frames]
    return min(a for a, _ in own), max(b for _, b in own)


def relationship_scores(ref: DataFrame, com: DataFrame, keys: list[str], n: int = 25, least_share: float = 3e-3) -> DataFrame:
    """By ``keys`` (such as the region) of rows (``ind``, ``dep``): how alike two relationships are, as 1 - the Hellinger
    distance of their histograms and as exp(-|a - b| / |a|) of their response curves, on bins that both share.

    Counts by bin are the only thing that is shuffled.
    """
    (a, b), (c, d) = (shared_limits([ref, com], x) for x in ("ind", "dep"))

    def binned(df: DataFrame) -> DataFrame:
        rows = df.filter("ind is not null and dep is not null")
        return rows.groupBy(*keys, bins("ind", a, b, n).alias("bin_x"), bins("dep", c, d, n).alias("bin_y")).agg(F.count(F.lit(1)).alias("n"), F.sum("dep").alias("s"))

    def curves(counts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        whole = F.sum("n").over(Window.partitionBy(*keys))
        shares = counts.withColumn(f"p_{name}", F.col("n") / whole).select(*keys, "bin_x", "bin_y", f"p_{name}")
        means = counts.groupBy(*keys, "bin_x").agg((F.sum("s") / F.sum("n")).alias(f"m_{name}"), F.sum("n").alias("n"))
        total = F.sum("n").over(Window.partitionBy(*keys))
        return shares, means.withColumn("_share", F.col("n") / total).filter(F.col("_share") >= least_share).select(*keys, "bin_x", f"m_{name}")

    (pa, ma), (pb, mb) = curves(binned(ref), "a"), curves(binned(com), "b")
    hellinger = pa.join(pb, [*keys, "bin_x", "bin_y"]).groupBy(*keys).agg((1 - F.sqrt(F.sum(F.pow(F.sqrt("p_a") - F.sqrt("p_b"), 2))) / math.sqrt(2)).alias("distance_score"))
    response_ = ma.join(mb, [*keys, "bin_x"]).groupBy(*keys).agg(F.exp(-F.sqrt(F.sum(F.pow(F.col("m_a") - F.col("m_b"), 2))) / F.sqrt(F.sum(F.col("m_a") * F.col("m_a")))).alias("response_score"))
    return hellinger.join(response_, keys, "full")


def hellinger_score(a: DataFrame, b: DataFrame) -> DataFrame:
    """1 - sqrt(sum (sqrt p - sqrt q)^2) / sqrt 2 over bins filled in both histograms."""
    pairs = a.select("bin_x", "bin_y", F.col("share").alias("p")).join(b.select("bin_x", "bin_y", F.col("share").alias("q")), ["bin_x", "bin_y"])
    return pairs.agg((1 - F.sqrt(F.coalesce(F.sum(F.pow(F.sqrt("p") - F.sqrt("q"), 2)), F.lit(0.0))) / F.sqrt(F.lit(2.0))).alias("score"))


def response_score(a: DataFrame, b: DataFrame) -> DataFrame:
    """exp(-|a - b| / |a|) of two response curves over their common bins."""
    pairs = a.select("bin_x", F.col("mean").alias("p")).join(b.select("bin_x", F.col("mean").alias("q")), "bin_x")
    return pairs.agg(F.exp(-F.sqrt(F.sum(F.pow(F.col("p") - F.col("q"), 2))) / F.sqrt(F.sum(F.col("p") * F.col("p")))).alias("score"))


#: Bins in which quantiles are looked for.
QUANTILE_BINS = 4096


def exact_quantiles(df: DataFrame, keys: list[str], value: Column, quantiles: list[float]) -> DataFrame:
    """Exact quantiles (linear between ranks) of ``value`` by ``keys``: one row each, ``quantile`` and ``value``.

    No task sees a whole group: counts in QUANTILE_BINS bins, summed map-side, tell which bins hold the wanted ranks, and
    only the distinct values of these bins are put in order. Null values are left out.
    """
    n_bins = QUANTILE_BINS
    rows = df.select(*keys, value.alias("_v")).filter("_v is not null").withColumn("_all", F.lit(0))
    own = ["_all", *keys]
    ranges = rows.groupBy(*own).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    binned = rows.join(ranges, own).withColumn("_bin", F.least(F.coalesce(F.floor(F.try_divide((F.col("_v") - F.col("_lo")) * n_bins, F.col("_hi") - F.col("_lo"))), F.lit(0)), F.lit(n_bins - 1)).cast("int"))
    counts = binned.groupBy(*own, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*own).orderBy("_bin")) - F.col("_c")
    placed = counts.withColumn("_before", before)
    wanted = ranges.select(*own, "_n", F.explode(F.array(*(F.struct(F.lit(float(q)).alias("q")) for q in quantiles))).alias("_q")).select(*own, F.col("_q.q").alias("_q"), ((F.col("_n") - 1) * F.col("_q.q")).alias("_at"))
    ranks = wanted.select(*own, "_q", "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank"))
    hit = placed.join(ranks, own).filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
    bins_hit = hit.select(*own, "_bin", "_before").distinct()
    values = binned.join(bins_hit, [*own, "_bin"]).groupBy(*own, "_bin", "_before", "_v").agg(F.count(F.lit(1)).alias("_k"))
    after = F.col("_before") + F.sum("_k").over(Window.partitionBy(*own, "_bin").orderBy("_v"))
    spans = values.withColumn("_to", after)
    found = spans.join(hit.select(*own, "_bin", "_q", "_at", "_rank"), [*own, "_bin"]).filter((F.col("_rank") < F.col("_to")) & (F.col("_rank") >= F.col("_to") - F.col("_k")))
    low, high = F.min("_v"), F.max("_v")
    share = F.max(F.col("_at")) - F.floor(F.max("_at"))
    return found.groupBy(*own, "_q").agg((low + (high - low) * share).alias("value")).select(*keys, F.col("_q").alias("quantile"), "value")


def quantile_errors(errors: DataFrame, keys: list[str], quantiles: list[int]) -> DataFrame:
    """Exact quantiles of absolute errors by ``keys``, one row each (a table for quantile scores)."""
    out = exact_quantiles(errors, keys, F.abs("value"), [q / 100 for q in quantiles])
    return out.withColumn("quantile", F.round(F.col("quantile") * 100).cast("int"))


def ensemble_mean(models: DataFrame, on: list[str], weights: dict[str, float] | DataFrame) -> DataFrame:
    """Weighted sum over models divided by the weight of all models; masked where none has a value.

    ``models`` has a column ``model``: any number of models is one aggregate. ``weights`` is a dictionary or a DataFrame
    (model, weight), of any size.
    """
    if isinstance(weights, DataFrame):
        whole = weights.agg(F.sum("weight").alias("w")).first()["w"]
        rows = models.join(weights, "model", "left")
        return rows.groupBy(*on).agg(F.when(F.count("value") > 0, F.sum(F.coalesce("value", F.lit(0.0)) * F.coalesce("weight", F.lit(0.0))) / F.lit(whole)).alias("value"))
    w = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("model")), F.lit(0.0))
    total = float(sum(weights.values()))
    return models.groupBy(*on).agg(F.when(F.count("value") > 0, F.sum(F.coalesce("value", F.lit(0.0)) * w) / total).alias("value"))


def ensemble_on_grid(models: DataFrame, cells: DataFrame, weights: dict[str, float] | DataFrame) -> DataFrame:
    """``ensemble_mean`` of models on grids of their own, on the ``cells`` of one grid."""
    times = [c for c in ("t0", "t1") if c in models.columns]
    return ensemble_mean(on_one_grid(models, cells), [*times, *CELL], weights)
