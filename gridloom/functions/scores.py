"""Scores and geometry as column expressions: all null-safe, none needs Python on the executors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6.371e6
DAYS_PER_YEAR = 365.0


def exp_score(value: Column, normalizer: Column) -> Column:
    """exp(-|value / normalizer|), below 1e-16 zero; null where the ratio is."""
    s = F.exp(-F.abs(F.try_divide(value, normalizer)))
    return F.when(s < 1e-16, F.lit(0.0)).otherwise(s)


def cycle_score(shift_days: Column) -> Column:
    """(1 + cos(2 pi |shift| / 365)) / 2."""
    return (1 + F.cos(F.abs(shift_days) * (2 * math.pi / DAYS_PER_YEAR))) / 2


def quantile_score(value: Column, threshold: Column) -> Column:
    """1 - |value| / threshold within [0, 1]; null if either is null."""
    s = 1 - F.abs(F.try_divide(value, threshold))
    return F.when(s.isNotNull(), F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)))


def wrap_shift(days: Column) -> Column:
    """A difference of days of the year, wrapped once into half a year either way."""
    half = DAYS_PER_YEAR / 2
    return F.when(days > half, days - DAYS_PER_YEAR).when(days < -half, days + DAYS_PER_YEAR).otherwise(days)


def day_shift_score(days: Column) -> Column:
    """1 - min(d, 365 - d) / 182.5."""
    d = F.abs(days)
    return 1 - F.least(d, DAYS_PER_YEAR - d) / (DAYS_PER_YEAR / 2)


def taylor_score(sigma: Column, r: Column) -> Column:
    """4 (1 + R) / ((s + 1/s)^2 * 2), s at least 1e-12."""
    s = F.greatest(sigma, F.lit(1e-12))
    return F.when(sigma.isNotNull() & r.isNotNull(), 4 * (1 + r) / (F.pow(s + 1 / s, 2) * 2))


def cell_area(lat0: Column, lat1: Column, lon0: Column, lon1: Column) -> Column:
    """Area of a latitude-longitude cell on the sphere, in m2."""
    return EARTH_RADIUS_M**2 * (F.sin(F.radians(lat1)) - F.sin(F.radians(lat0))) * F.radians(lon1 - lon0)


def shifted_longitude(lon: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def pressure_to_height(pa: Column) -> Column:
    """Barometric height in m of a pressure in Pa (288.15 K at the ground)."""
    gas, temperature, molar_mass, gravity = 8.3144598, 288.15, 0.0289644, 9.80665
    return -F.ln(pa / 101325.0) * (gas * temperature / molar_mass / gravity)


def q10(slope: Column) -> Column:
    """10^(-10 p') of a log10 turnover time's slope."""
    return F.pow(F.lit(10.0), -10 * slope)


def gated_ratio(top: Column, bottom: Column, least: float) -> Column:
    """top / bottom where the bottom is at least ``least``, else null."""
    return F.when(bottom >= least, F.try_divide(top, bottom))
