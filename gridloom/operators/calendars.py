"""Time stamps of any calendar and origin to days since 1850 in a calendar without leap days, and bounds around stamps.

A calendar is a column, so series of different calendars are converted together: ``standard`` (also ``gregorian`` and
``proleptic_gregorian``, by the Gregorian rule at all times), ``noleap`` (``365_day``), ``all_leap`` (``366_day``) and
``360_day``. A day that the calendar without leap days lacks, such as 29 or 30 February, is the start of the next month.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days before each month, and in each month, of years without and with a leap day.
BEFORE = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]
LENGTHS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
BEFORE_LEAP = [0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335]
KINDS = {"standard": "standard", "gregorian": "standard", "proleptic_gregorian": "standard", "noleap": "noleap", "365_day": "noleap", "all_leap": "all_leap", "366_day": "all_leap", "360_day": "360_day"}
#: Days in the units of time.
UNITS = {"day": 1.0, "hour": 1 / 24, "minute": 1 / 1440, "second": 1 / 86400}


def _with(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def kind_of(calendar: Column) -> Column:
    """One of the four calendars for each of its names; null for others."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.lower(calendar))


def parsed_units(units: Column) -> Column:
    """``size`` (days of a unit), ``year``, ``month``, ``day`` and ``share`` (of that day) of texts like ``days since 1850-01-01
    06:00:00``; null where it is none."""
    part = lambda k: F.regexp_extract(units, r"^\s*(\w+?)s?\s+since\s+(\d+)-(\d+)-(\d+)(?:[T ]+(\d+):(\d+)(?::(\d+))?)?", k)
    number = lambda k: F.coalesce(part(k).try_cast("int"), F.lit(0))
    size = F.element_at(F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv)), F.lower(part(1)))
    share = (number(5) * 3600 + number(6) * 60 + number(7)) / 86400.0
    return F.when(size.isNotNull(), F.struct(size.alias("size"), number(2).alias("year"), number(3).alias("month"), number(4).alias("day"), share.alias("share")))


def _at(values: list[int], i: Column) -> Column:
    return F.element_at(F.lit(values), i.cast("int"))


def date_of(number: Column, units: Column, calendar: Column) -> Column:
    """``year``, ``month``, ``day`` (from 1), ``share`` of the day (to the second) of a stamp, and ``into``: how many days of its own
    calendar it is from the start of its year."""
    kind = kind_of(calendar)
    return _with(parsed_units(units), lambda u: F.when(u.isNotNull() & kind.isNotNull(), _with(F.struct(kind.alias("kind"), F.round((number * u["size"] + u["share"]) * 86400).alias("seconds")), lambda n: _date(u, n["kind"], n["seconds"]))))


def _date(u: Column, kind: Column, seconds: Column) -> Column:
    days, share = F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400.0)) / 86400
    year, month, day = u["year"], u["month"], u["day"]
    date = F.date_add(F.make_date(F.when(kind == "standard", year), month, day), days.cast("int"))

    def of_years(length: int, before: list[int]) -> tuple[Column, ...]:
        total = year.cast("long") * length + _at(before, month) + day - 1 + days
        rest = F.pmod(total, F.lit(length))
        m = F.size(F.filter(F.lit(before), lambda b: b <= rest))
        return F.floor(total / length), m, rest - _at(before, m) + 1, rest

    out = (F.year(date), F.month(date), F.dayofmonth(date), F.dayofyear(date) - 1)
    for name, length, before in (("noleap", 365, BEFORE), ("all_leap", 366, BEFORE_LEAP), ("360_day", 360, [30 * k for k in range(12)])):
        out = tuple(F.when(kind == name, x).otherwise(y) for x, y in zip(of_years(length, before), out, strict=True))
    y, m, d, into = (x.cast("int") for x in out)
    return F.struct(y.alias("year"), m.alias("month"), d.alias("day"), share.alias("share"), (into + share).alias("into"))


def noleap_from(number: Column, units: Column, calendar: Column) -> Column:
    """Days since 1850-01-01 in a calendar without leap days; null for an unknown unit or calendar."""

    def days(at: Column) -> Column:
        beyond = at["day"] > _at(LENGTHS, at["month"])
        return (at["year"] - 1850) * 365.0 + _at(BEFORE, at["month"]) + F.when(beyond, _at(LENGTHS, at["month"]).cast("double")).otherwise(at["day"] - 1 + at["share"])

    return _with(date_of(number, units, calendar), days)


def stamp_places(df: DataFrame, keys: list[str]) -> DataFrame:
    """By ``keys``: ``alpha``, where in their intervals the stamps (``t``, ``units``, ``calendar``) of a series lie, from 0 (their
    begins) to 1, judged by the first two: yearly and monthly series are taken to begin with a year, ones of parts of a day
    with a day. A single stamp lies in the middle; null for other steps."""
    first = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("t"))).filter("_i <= 2").withColumn("_at", date_of(F.col("t"), F.col("units"), F.col("calendar")))
    own = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", F.col("_at.into").alias("into"), F.col("_at.share").alias("share"), parsed_units(F.col("units"))["size"].alias("size")))).alias("s"))
    a, b = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    step = (b["t"] - a["t"]) * a["size"]
    clipped = lambda x: F.least(F.greatest(F.bround(x, 1), F.lit(0.0)), F.lit(1.0))
    of_year = clipped(a["into"] / step)
    alpha = F.when(b.isNull(), F.lit(0.5)).when(F.abs(step - 365) <= 10.00365, of_year).when(F.abs(step - 30) <= 4.0003, of_year).when(step < 0.9, F.bround(a["share"] / step, 1))
    return own.select(*keys, alpha.alias("alpha"))


def bounds_of_stamps(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``t0``, ``t1`` (days since 1850 without leap days), and the other columns, of series of stamps without bounds: each
    interval reaches back by ``alpha`` of the step before, and on by the rest of the step after. Raises for steps that say
    nothing about where stamps lie, and for stamps outside of [0, 1] of an interval."""
    places = stamp_places(df, keys)
    if places.filter("alpha is null or alpha < 0 or alpha > 1").limit(1).count():
        raise ValueError("the place of stamps in their intervals cannot be told from their steps")
    along = Window.partitionBy(*keys).orderBy("t")
    before, after = F.col("t") - F.lag("t").over(along), F.lead("t").over(along) - F.col("t")
    steps = df.withColumns({"_before": F.coalesce(before, after, F.lit(0.0)), "_after": F.coalesce(after, before, F.lit(0.0))}).join(places, keys)
    day = lambda x: noleap_from(x, F.col("units"), F.col("calendar"))
    out = steps.withColumns({"t0": day(F.col("t") - F.col("alpha") * F.col("_before")), "t1": day(F.col("t") + (1 - F.col("alpha")) * F.col("_after"))})
    return out.drop("_before", "_after", "alpha", "t", "units", "calendar")
