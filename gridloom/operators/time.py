"""Reductions, resampling and window operators along time or depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _clipped(lower: str, upper: str, start: float | None, end: float | None) -> Column:
    a = F.col(lower) if start is None else F.greatest(F.col(lower), F.lit(float(start)))
    b = F.col(upper) if end is None else F.least(F.col(upper), F.lit(float(end)))
    return b - a


def integrate(df: DataFrame, keys: list[str], start: float | None = None, end: float | None = None, mean: bool = False, value: str = "value", bounds: tuple[str, str] = ("t0", "t1")) -> DataFrame:
    """Sum of value x interval, intervals clipped to [start, end]; ``mean`` divides by the unmasked length.

    One partial aggregation and one shuffle of the groups; the range is a filter on the bounds, so it reaches the scan.
    Use bounds ("z0", "z1") for depth.
    """
    lower, upper = bounds
    if start is not None:
        df = df.filter(F.col(upper) > start)
    if end is not None:
        df = df.filter(F.col(lower) < end)
    w, v = _clipped(lower, upper, start, end), F.col(value)
    total, length = F.sum(v * w), F.sum(F.when(v.isNotNull(), w))
    return df.groupBy(*keys).agg((F.try_divide(total, length) if mean else total).alias(value))


def clip_to_cover(df: DataFrame, start: float, end: float, tolerance: float = 1e-6) -> DataFrame:
    """The intervals from the one whose start is nearest to ``start`` to the one whose end is nearest to ``end``, widened
    outwards so that they cover [start, end] where there are data. The two bounds are scalars of one aggregate."""
    at = df.agg(
        F.max(F.when(F.col("t0") <= start + tolerance, F.col("t0"))).alias("a"), F.min("t0").alias("first"),
        F.min(F.when(F.col("t1") >= end - tolerance, F.col("t1"))).alias("b"), F.max("t1").alias("last"),
    ).first()
    a = at["first"] if at["a"] is None else at["a"]
    b = at["last"] if at["b"] is None else at["b"]
    return df if a is None else df.filter((F.col("t0") >= a - tolerance) & (F.col("t1") <= b + tolerance))


#: Target intervals that may be broadcast.
MAX_TARGETS = 100_000


def interval_join(left: DataFrame, right: DataFrame, left_bounds: tuple[str, str], right_bounds: tuple[str, str]) -> DataFrame:
    """Pairs of rows whose intervals overlap, as an equi join on buckets of time.

    The bucket is the greater mean length of the two sides' intervals, so each side has at most two bucketed rows a row on
    average, however long single intervals are; a pair is kept in the first bucket that both have. Up to MAX_TARGETS right
    rows are broadcast, and then the left side is not shuffled. There is no nested-loop join, whatever the sizes.
    """
    (a0, a1), (b0, b1) = left_bounds, right_bounds
    sizes = [df.agg(F.avg(F.col(y) - F.col(x)).alias("w"), F.count(F.lit(1)).alias("n")).first() for df, (x, y) in ((left, left_bounds), (right, right_bounds))]
    width = max(*(s["w"] or 0.0 for s in sizes), 1e-9)

    def bucketed(df: DataFrame, lower: str, upper: str, name: str) -> DataFrame:
        first, last = F.floor(F.col(lower) / width), F.floor(F.col(upper) / width)
        return df.withColumn(name, F.explode(F.sequence(first, last)))

    other = bucketed(right, b0, b1, "_b")
    pairs = bucketed(left, a0, a1, "_a").join(F.broadcast(other) if sizes[1]["n"] <= MAX_TARGETS else other, F.col("_a") == F.col("_b"))
    overlap = (F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1))
    return pairs.filter(overlap & (F.col("_a") == F.floor(F.greatest(a0, b0) / width))).drop("_a", "_b")


def coarsen(df: DataFrame, intervals: DataFrame, keys: list[str], window: float = 0.0) -> DataFrame:
    """Overlap-weighted means over the target ``intervals`` (b0, b1), each widened by ``window`` on both sides."""
    targets = intervals.select("b0", "b1", (F.col("b0") - window).alias("_w0"), (F.col("b1") + window).alias("_w1"))
    pairs = interval_join(df, targets, ("t0", "t1"), ("_w0", "_w1"))
    w = F.least("t1", "_w1") - F.greatest("t0", "_w0")
    v = F.col("value")
    return pairs.groupBy(*keys, "b0", "b1").agg(F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w))).alias("value"))


def reduce_intervals(df: DataFrame, intervals: DataFrame, keys: list[str], reducer) -> DataFrame:
    """``reducer`` (a column of an aggregate) over all samples that touch each target interval, ends included."""
    edge = 1e-9
    targets = intervals.select("b0", "b1", (F.col("b0") - edge).alias("_w0"), (F.col("b1") + edge).alias("_w1"))
    return interval_join(df, targets, ("t0", "t1"), ("_w0", "_w1")).groupBy(*keys, "b0", "b1").agg(reducer.alias("value"))


def accumulate(df: DataFrame, keys: list[str]) -> DataFrame:
    """Running integral by ``keys`` with a zero at the first start; a masked step masks all that follow."""
    along = Window.partitionBy(*keys).orderBy("t0").rowsBetween(Window.unboundedPreceding, 0)
    step = F.col("value") * (F.col("t1") - F.col("t0"))
    running = F.when(F.count(F.when(F.col("value").isNull(), 1)).over(along) == 0, F.sum(step).over(along))
    points = df.select(*keys, F.col("t1").alias("t"), running.alias("value"))
    zero = df.groupBy(*keys).agg(F.min("t0").alias("t")).select(*keys, "t", F.lit(0.0).alias("value"))
    return points.unionByName(zero)


def _weighted_mean(value: str, keys: list[str]) -> Column:
    own, w = Window.partitionBy(*keys), F.col("t1") - F.col("t0")
    return F.sum(F.col(value) * w).over(own) / F.sum(F.when(F.col(value).isNotNull(), w)).over(own)


def anomaly(df: DataFrame, keys: list[str]) -> DataFrame:
    """value less its time mean by ``keys``."""
    return df.withColumn("value", F.col("value") - _weighted_mean("value", keys))


def root_mean_square(df: DataFrame, keys: list[str]) -> DataFrame:
    """Root of the time mean of value^2."""
    return integrate(df.withColumn("value", F.col("value") * F.col("value")), keys, mean=True).withColumn("value", F.sqrt("value"))


def interannual_deviation(df: DataFrame, keys: list[str]) -> DataFrame:
    """Population standard deviation over time, unweighted."""
    return df.groupBy(*keys).agg(F.stddev_pop("value").alias("value"))


def minimum_removed(df: DataFrame, keys: list[str]) -> DataFrame:
    """value less its least one by ``keys``."""
    return df.withColumn("value", F.col("value") - F.min("value").over(Window.partitionBy(*keys)))


def midpoint_bounds(df: DataFrame, keys: list[str], at: str = "t") -> DataFrame:
    """Bounds half-way between neighbours, the ends extrapolated; a single point has width zero."""
    along = Window.partitionBy(*keys).orderBy(at)
    before, after, x = F.lag(at).over(along), F.lead(at).over(along), F.col(at)
    low, high = (before + x) / 2, (x + after) / 2
    return df.withColumns({"t0": F.coalesce(low, x - (high - x), x), "t1": F.coalesce(high, x + (x - low), x)})


def annual_cycle(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean by month (0 to 11) over whole years, which begin at the first of the early months of the calendar year."""
    middle = (F.col("t0") + F.col("t1")) / 2
    along = Window.partitionBy(*keys).orderBy("t0")
    rows = df.withColumns({"_i": F.row_number().over(along) - 1, "_day": F.pmod(middle, F.lit(365.0))})
    own = Window.partitionBy(*keys)
    first = F.min_by(F.when(F.col("_i") < 11, F.col("_i")), F.when(F.col("_i") < 11, F.struct("_day", "_i"))).over(own)
    rows = rows.withColumns({"_first": first, "_n": F.count(F.lit(1)).over(own)})
    k = F.col("_i") - F.col("_first")
    whole = F.floor((F.col("_n") - F.col("_first")) / 12) * 12
    return rows.filter((k >= 0) & (k < whole)).groupBy(*keys, F.pmod(k, F.lit(12)).cast("int").alias("month")).agg(F.avg("value").alias("value"))


def time_of_extremum(df: DataFrame, keys: list[str], order: str = "month", maximum: bool = True) -> DataFrame:
    """``order`` at which the first greatest (or least) value is; null where all are masked."""
    v = F.col("value")
    ranked = F.when(v.isNotNull(), F.struct((-v if maximum else v).alias("v"), F.col(order).alias("o")))
    return df.groupBy(*keys).agg(F.min(ranked)["o"].alias(order))


def detrend(df: DataFrame, keys: list[str]) -> DataFrame:
    """value less its least-squares quadratic in time by ``keys`` (masked values are left out of the fit).

    Normal equations from power sums of the standardised time: one aggregate and a join of the coefficients.
    """
    own = Window.partitionBy(*keys)
    t = (F.col("t0") + F.col("t1")) / 2
    x = (t - F.avg(t).over(own)) / F.when(F.stddev_pop(t).over(own) > 0, F.stddev_pop(t).over(own))
    rows = df.withColumn("_x", x)
    v, X = F.col("value"), F.col("_x")
    has = v.isNotNull()
    sums = rows.groupBy(*keys).agg(*(F.sum(F.when(has, F.pow(X, F.lit(k)))).alias(f"s{k}") for k in range(5)), *(F.sum(v * F.pow(X, F.lit(k))).alias(f"p{k}") for k in range(3)))

    def det(m: list[list[Column]]) -> Column:
        (a, b, c), (d, e, f), (g, h, i) = m
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    s, p = [F.col(f"s{k}") for k in range(5)], [F.col(f"p{k}") for k in range(3)]
    matrix = [[s[i + j] for j in range(3)] for i in range(3)]
    whole = det(matrix)
    fit = [F.try_divide(det([[p[i] if j == k else matrix[i][j] for j in range(3)] for i in range(3)]), whole).alias(f"c{k}") for k in range(3)]
    coefficients = sums.select(*keys, *fit)
    out = rows.join(coefficients, keys)
    return out.withColumn("value", v - (F.col("c0") + F.col("c1") * X + F.col("c2") * X * X)).drop("_x", "c0", "c1", "c2")


def concatenate(pieces: list[DataFrame], keys: list[str]) -> DataFrame:
    """Fields one after another in time; raises if two intervals of one key overlap."""
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    along = Window.partitionBy(*keys).orderBy("t0")
    if out.withColumn("_over", F.lag("t1").over(along) > F.col("t0") + 1e-6).filter("_over").limit(1).count():
        raise ValueError("pieces overlap in time")
    return out


def daily_cycle(df: DataFrame, keys: list[str], slots: int) -> DataFrame:
    """Mean, 10th and 90th percentile by slot of the day, over days with all slots; needs a column ``t`` in days."""
    day, slot = F.floor("t"), F.floor((F.col("t") - F.floor("t")) * slots).cast("int")
    rows = df.withColumns({"day": day, "slot": slot})
    means = rows.groupBy(*keys, "day", "slot").agg(F.avg("value").alias("value"))
    whole = F.count("value").over(Window.partitionBy(*keys, "day")) == slots
    kept = means.withColumn("_whole", whole).filter("_whole")
    return kept.groupBy(*keys, "slot").agg(F.avg("value").alias("value"), F.percentile("value", F.lit(0.1)).alias("low"), F.percentile("value", F.lit(0.9)).alias("high"))


def longest_run(df: DataFrame, keys: list[str]) -> DataFrame:
    """The longest run of unmasked values in the order of ``t0``, by ``keys``."""
    along = Window.partitionBy(*keys).orderBy("t0")
    rows = df.withColumn("_i", F.row_number().over(along)).filter(F.col("value").isNotNull())
    island = rows.withColumn("_g", F.col("_i") - F.row_number().over(along))
    return island.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("n"))


def consecutive_years_below(yearly_max: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Whether a yearly maximum (``year``, ``value``) was under ``threshold`` in two years in a row, by ``keys``."""
    along = Window.partitionBy(*keys).orderBy("year")
    below = F.col("value") < threshold
    rows = yearly_max.withColumn("_both", below & F.lag(below).over(along) & (F.lag("year").over(along) == F.col("year") - 1))
    return rows.groupBy(*keys).agg(F.coalesce(F.bool_or("_both"), F.lit(False)).alias("frozen"))


def noleap_day(date: Column) -> Column:
    """Days since 1850-01-01 of a date or timestamp in a calendar without leap days; 29 February is 1 March, at its start."""
    year, month = F.year(date), F.month(date)
    # fixed values: days before each month of a year without leap days
    before = F.element_at(F.lit([0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]), month)
    day = F.when((month == 2) & (F.dayofmonth(date) == 29), 28).otherwise(F.dayofmonth(date) - 1)
    clock = date.cast("timestamp")
    share = (F.hour(clock) * 3600 + F.minute(clock) * 60 + F.second(clock)) / 86400.0
    return (year - 1850) * 365.0 + before + day + F.when((month == 2) & (F.dayofmonth(date) == 29), 0.0).otherwise(share)


def year_of(day: Column) -> Column:
    """The year (with a fraction) of a day since 1850 in a calendar without leap days."""
    return day / 365.0 + 1850.0


def read_times(df: DataFrame, keys: list[str], start: float, end: float, slack: float = 0.01) -> DataFrame:
    """The intervals within [start, end], each allowed ``slack`` of its length beyond; ``t`` is set to their middles.

    Raises if the intervals of a key do not follow each other without a gap.
    """
    length = F.col("t1") - F.col("t0")
    kept = df.filter((F.col("t0") >= F.lit(start) - slack * length) & (F.col("t1") <= F.lit(end) + slack * length))
    before = F.lag("t1").over(Window.partitionBy(*keys).orderBy("t0"))
    if kept.withColumn("_gap", F.abs(F.col("t0") - before) > slack * length).filter("_gap").limit(1).count():
        raise ValueError("intervals do not follow each other")
    return kept.withColumn("t", (F.col("t0") + F.col("t1")) / 2)


def reduced_units(df: DataFrame, unit: str, most: int = 2) -> tuple[DataFrame, str]:
    """Values of small orders of magnitude in a finer unit: per day for per second, then g for kg, while the mean log10 of
    their sizes is below -2, ``most`` times at most."""
    for _ in range(most):
        order = df.agg(F.avg(F.log10(F.greatest(F.abs("value"), F.lit(1e-16)))).alias("o")).first()["o"]
        if order is None or order >= -2:
            break
        if "s-1" in unit:
            df, unit = df.withColumn("value", F.col("value") * 86400.0), unit.replace("s-1", "d-1")
        elif "kg" in unit:
            df, unit = df.withColumn("value", F.col("value") * 1000.0), unit.replace("kg", "g")
    return df, unit


#: The middles of the months of a year without leap days.
MIDDLES = [15.5, 45.0, 74.5, 105.0, 135.5, 166.0, 196.5, 227.5, 258.0, 288.5, 319.0, 349.5]


def nearest_month(day: Column) -> Column:
    """The month (0 to 11) whose middle is nearest to the day of the year, the earlier one of equals."""
    rest = F.pmod(day, F.lit(365.0))
    ranked = F.array(*(F.struct(F.abs(rest - m).alias("d"), F.lit(k).alias("month")) for k, m in enumerate(MIDDLES)))
    return F.array_min(ranked)["month"]


def without_cycle(df: DataFrame, cycle: DataFrame, keys: list[str]) -> DataFrame:
    """value less a given cycle's (``keys``, ``month``, ``value``) at the nearest month."""
    rows = df.withColumn("month", nearest_month((F.col("t0") + F.col("t1")) / 2))
    joined = rows.join(cycle.select(*keys, "month", F.col("value").alias("_c")), [*keys, "month"], "left")
    return joined.withColumn("value", F.col("value") - F.col("_c")).drop("_c", "month")


def hour_of_maximum(df: DataFrame, keys: list[str], slots: int) -> DataFrame:
    """The hour at which the mean cycle of a day (``slot``, ``value``) is greatest, the first of equals.

    Masked slots take no part, and keys that have no others get no row; NaN is greater than all numbers, as in SQL. A slot
    that is null comes last of equals.
    """
    greatest = F.max(F.struct("value", (-F.col("slot")).alias("_s")))["_s"]
    return df.filter("value is not null").groupBy(*keys).agg((-greatest * (24.0 / slots)).alias("hour"))


def cycle_shape(df: DataFrame, keys: list[str], period: float = 365.0) -> DataFrame:
    """Rows by ``period_number`` (0, 1, ...) and ``sample`` within it, from the first sample of the first whole period on; the
    samples of an unfinished period at the end are left out. Samples have equal steps."""
    along = Window.partitionBy(*keys).orderBy("t0")
    own = Window.partitionBy(*keys)
    day = F.pmod(F.col("t0"), F.lit(period))
    rows = df.withColumns({"_i": F.row_number().over(along) - 1, "_day": day, "_n": F.count(F.lit(1)).over(own)})
    rows = rows.withColumn("_per", F.round(F.lit(period) / F.min(F.col("t1") - F.col("t0")).over(own)).cast("int"))
    first = F.min(F.when(F.abs("_day") < (F.col("t1") - F.col("t0")) / 2, F.col("_i"))).over(own)
    k = F.col("_i") - F.col("_first")
    rows = rows.withColumn("_first", first)
    whole = F.floor((F.col("_n") - F.col("_first")) / F.col("_per")) * F.col("_per")
    kept = rows.filter((k >= 0) & (k < whole)).withColumns({"period_number": F.floor(k / F.col("_per")).cast("int"), "sample": F.pmod(k, F.col("_per")).cast("int")})
    return kept.drop("_i", "_day", "_n", "_per", "_first")
