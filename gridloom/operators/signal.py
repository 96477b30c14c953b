"""Curve kernels that SQL has no form for: one bounded site series at a time, grouped by Spark and handed over as Arrow.

Each group is the series of one site (or cell) and model, not a share of the corpus: a few thousand days.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

YEAR = 365.0


def harmonic_design(t: np.ndarray, degree: int = 3, harmonics: int = 4) -> np.ndarray:
    """Columns of a polynomial (t in years from the middle) and of yearly harmonics."""
    x = (t - t.mean()) / YEAR
    waves = [f(2 * np.pi * k * t / YEAR) for k in range(1, harmonics + 1) for f in (np.sin, np.cos)]
    return np.column_stack([x**k for k in range(degree)] + waves)


def low_pass(series: np.ndarray, step: float, cutoff_days: float) -> np.ndarray:
    """Frequencies damped by ``filter_response``; the series is taken off its ends' line and padded with zeros to a power of
    two, and the line is put back."""
    n = 1 << max(1, int(np.ceil(np.log2(2 * len(series)))))
    flat, line = end_adjusted(series)
    damp = filter_response(np.fft.rfftfreq(n, step), cutoff_days)
    return np.fft.irfft(np.fft.rfft(flat, n) * damp, n)[: len(series)] + line


def end_adjusted(series: np.ndarray, share: float = 1 / 6) -> tuple[np.ndarray, np.ndarray]:
    """A series less the line that joins the means of its first and last ``share``, and that line: what is left ends where it
    begins, so a transform sees no jump where it wraps around."""
    n = len(series)
    k = max(1, int(n * share))
    at = np.arange(n, dtype=float)
    x0, x1 = at[:k].mean(), at[n - k :].mean()
    y0, y1 = series[:k].mean(), series[n - k :].mean()
    line = y0 + (y1 - y0) / (x1 - x0) * (at - x0) if x1 > x0 else np.full(n, series.mean())
    return series - line, line


def filter_response(f: np.ndarray, cutoff_days: float) -> np.ndarray:
    """What the filter leaves of a wave of ``f`` cycles a day: 2^-(f / fc)^6, one half at the cutoff."""
    return 2.0 ** -np.minimum((np.asarray(f, dtype=float) * cutoff_days) ** 6, 1000)


def fit_statistics(design: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The parameters of a least-squares fit, their covariance (the inverse normal matrix times the residual variance), and
    that variance, with as many degrees of freedom as values beyond parameters."""
    fit = np.linalg.lstsq(design, v, rcond=None)[0]
    free = max(len(v) - design.shape[1], 1)
    variance = float(np.sum((v - design @ fit) ** 2) / free)
    return fit, np.linalg.pinv(design.T @ design) * variance, variance


def smooth_curve(t: np.ndarray, v: np.ndarray, short_days: float = 80.0, long_days: float = 667.0, degree: int = 3, harmonics: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fitted function, the smooth curve (function and residuals of over ``short_days``) and the trend."""
    degree = max(1, min(degree, len(t) // 3))
    harmonics = min(harmonics, max(0, (len(t) - degree) // 4))
    design = harmonic_design(t, degree, harmonics)
    fit = np.linalg.lstsq(design, v, rcond=None)[0]
    function = design @ fit
    step = float(np.median(np.diff(t))) if len(t) > 1 else 1.0
    regular = np.arange(t[0], t[-1] + step / 2, step)
    residual = np.interp(regular, t, v - function)
    smooth = function + np.interp(t, regular, low_pass(residual, step, short_days))
    trend = design[:, :degree] @ fit[:degree] + np.interp(t, regular, low_pass(residual, step, long_days))
    return function, smooth, trend


def season_bounds(t: np.ndarray, v: np.ndarray) -> tuple[float, float]:
    """Begin and end of the active season: the two breaks of the piecewise line that fits the cumulative sum best.

    All pairs of breaks are tried; the error of a piece comes from prefix sums.
    """
    total = np.cumsum(v)
    n = len(t)
    x, y = t - t.mean(), total
    sums = [np.concatenate([[0.0], np.cumsum(q)]) for q in (np.ones(n), x, y, x * x, x * y, y * y)]

    def error(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = [q[b] - q[a] for q in sums]
        k = np.maximum(s[0], 1)
        sxx, sxy, syy = s[3] - s[1] ** 2 / k, s[4] - s[1] * s[2] / k, s[5] - s[2] ** 2 / k
        return syy - np.where(sxx > 1e-12, sxy**2 / np.maximum(sxx, 1e-12), 0)

    i, j = np.triu_indices(n - 3, 2) if n > 5 else (np.array([0]), np.array([0]))
    if n <= 5:
        return float(t[0]), float(t[-1])
    i, j = i + 2, j + 2
    cost = error(np.zeros_like(i), i) + error(i, j) + error(j, np.full_like(j, n))
    best = int(np.argmin(cost))
    return float(t[i[best]]), float(t[j[best]])


def phase_defined(values: np.ndarray, step: float, least: int = 24) -> bool:
    """Whether the longest run of known values has ``least`` of them and its spectrum is greatest at one cycle a year."""
    known = np.concatenate([[False], ~np.isnan(values), [False]])
    edges = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
    if not len(edges):
        return False
    a, b = edges[np.argmax(edges[:, 1] - edges[:, 0])]
    if b - a < least:
        return False
    own = values[a:b]
    power, f = np.abs(np.fft.rfft(own - own.mean())), np.fft.rfftfreq(b - a, step)
    peak = int(np.argmax(power[1:])) + 1
    return bool(abs(f[peak] - 1 / YEAR) <= f[1] / 2)


def sites_with_phase(df: DataFrame, least: int = 24) -> DataFrame:
    """site and whether its yearly phase is well defined, from its rows (t0, t1, value) in the order of time."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t0")
        step = float((pdf["t1"] - pdf["t0"]).mean())
        return pd.DataFrame({"site": [pdf["site"].iloc[0]], "defined": [phase_defined(pdf["value"].to_numpy(dtype=float), step, least)]})

    return df.select("site", "t0", "t1", "value").groupBy("site").applyInPandas(one, "site long, defined boolean")


def spline_pieces(x: np.ndarray, y: np.ndarray, period: float) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of the pieces of the periodic cubic spline through (x, y), and their coefficients by falling power of the
    distance from the piece's begin."""
    n, h = len(x), np.diff(np.append(x, x[0] + period))
    slope, k = np.diff(np.append(y, y[0])) / h, np.arange(n)
    m = np.zeros((n, n))
    m[k, k] = 2 * (h + np.roll(h, 1))
    m[k, k - 1] += np.roll(h, 1)
    m[k, (k + 1) % n] += h
    second = np.linalg.solve(m, 6 * (slope - np.roll(slope, 1)))
    after = np.roll(second, -1)
    return h, np.column_stack([(after - second) / (6 * h), second / 2, slope - h * (2 * second + after) / 6, y])


def _roots_within(coefficients: np.ndarray, length: float) -> list[float]:
    """The real roots of a polynomial in [0, length)."""
    kept = np.trim_zeros(coefficients, "f")
    if len(kept) < 2:
        return []
    roots = np.roots(kept)
    real = roots[np.abs(roots.imag) < 1e-9 * np.maximum(1.0, np.abs(roots))].real
    return [float(r) for r in real if 0 <= r < length]


def spline_extremes(x: np.ndarray, y: np.ndarray, period: float) -> tuple[tuple[float, float], tuple[float, float]]:
    """Place and value of the greatest and of the least value of the spline, the first of equals: at the roots of each
    piece's slope and at the knots."""
    h, pieces = spline_pieces(x, y, period)
    found = [(float(x[i] + d), float(np.polyval(p, d))) for i, p in enumerate(pieces) for d in [0.0, *_roots_within(np.polyder(p), h[i])]]
    found = [(t % period, v) for t, v in found]
    return max(found, key=lambda f: (f[1], -f[0])), min(found, key=lambda f: (f[1], f[0]))


def spline_crossings(x: np.ndarray, y: np.ndarray, period: float, level: float = 0.0) -> list[tuple[float, bool]]:
    """The places in a period where the spline goes through ``level``, in order, and whether it rises there."""
    h, pieces = spline_pieces(x, y, period)
    out = []
    for i, p in enumerate(pieces):
        for d in _roots_within(p - np.array([0, 0, 0, level]), h[i]):
            rate = float(np.polyval(np.polyder(p), d))
            if rate:
                out.append((float((x[i] + d) % period), rate > 0))
    return sorted(out)


def periodic_spline(x: np.ndarray, y: np.ndarray, period: float, at: np.ndarray) -> np.ndarray:
    """The periodic cubic spline through (x, y), evaluated at ``at``."""
    _, pieces = spline_pieces(x, y, period)
    u = (np.asarray(at) - x[0]) % period + x[0]
    i = np.clip(np.searchsorted(x, u, side="right") - 1, 0, len(x) - 1)
    a, b, c, d = pieces[i].T
    t = u - x[i]
    return ((a * t + b) * t + c) * t + d


def smooth_sites(df: DataFrame) -> DataFrame:
    """site, t, function, smooth, trend and growth (the trend's slope a year) for each unmasked value of a site."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["value"]).sort_values("t")
        if len(pdf) < 4:
            return pd.DataFrame({"site": pdf["site"], "t": pdf["t"], "function": pdf["value"], "smooth": pdf["value"], "trend": pdf["value"], "growth": 0.0})
        function, smooth, trend = smooth_curve(pdf["t"].to_numpy(), pdf["value"].to_numpy())
        return pd.DataFrame({"site": pdf["site"], "t": pdf["t"], "function": function, "smooth": smooth, "trend": trend, "growth": np.gradient(trend, pdf["t"].to_numpy()) * YEAR})

    return df.select("site", "t", "value").groupBy("site").applyInPandas(one, "site long, t double, function double, smooth double, trend double, growth double")


def site_seasons(df: DataFrame) -> DataFrame:
    """site, begin, end of the active season."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["value"]).sort_values("t")
        if pdf.empty:
            return pd.DataFrame({"site": [], "begin": [], "end": []})
        begin, end = season_bounds(pdf["t"].to_numpy(), pdf["value"].to_numpy())
        return pd.DataFrame({"site": [pdf["site"].iloc[0]], "begin": [begin], "end": [end]})

    return df.select("site", "t", "value").groupBy("site").applyInPandas(one, "site long, begin double, end double")


def cycle_extremes(df: DataFrame, period: float = 365.0) -> DataFrame:
    """site, amplitude, t_max, t_min of the periodic cubic spline through a site's mean cycle (``t`` in the period, ``value``),
    from the roots of its slope; the first of equals. A site of under three values gives no row."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["value"]).groupby("t", as_index=False)["value"].mean().assign(site=pdf["site"].iloc[0])
        if len(pdf) < 3:
            return pd.DataFrame({"site": [], "amplitude": [], "t_max": [], "t_min": []})
        top, low = spline_extremes(pdf["t"].to_numpy(), pdf["value"].to_numpy(), period)
        return pd.DataFrame({"site": [pdf["site"].iloc[0]], "amplitude": [top[1] - low[1]], "t_max": [top[0]], "t_min": [low[0]]})

    return df.select("site", "t", "value").groupBy("site").applyInPandas(one, "site long, amplitude double, t_max double, t_min double")


def cycle_crossings(df: DataFrame, period: float = 365.0) -> DataFrame:
    """site, t, rising: where the spline of a site's mean cycle, less its mean over the given values, goes through zero."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.dropna(subset=["value"]).groupby("t", as_index=False)["value"].mean()
        found = spline_crossings(own["t"].to_numpy(), own["value"].to_numpy(), period, float(own["value"].mean())) if len(own) > 2 else []
        return pd.DataFrame({"site": [pdf["site"].iloc[0]] * len(found), "t": [t for t, _ in found], "rising": [up for _, up in found]})

    return df.select("site", "t", "value").groupBy("site").applyInPandas(one, "site long, t double, rising boolean")


def curve_fits(df: DataFrame, degree: int = 3, harmonics: int = 4) -> DataFrame:
    """site, parameter (its place among the powers of the years from the middle, then sine and cosine of each harmonic), value,
    error (its standard error) and variance (of the residuals) of the fitted function of each site (``t`` in days, ``value``).
    A site with no more values than parameters gives no row."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.dropna(subset=["value"]).sort_values("t")
        if len(own) <= degree + 2 * harmonics:
            return pd.DataFrame({"site": [], "parameter": [], "value": [], "error": [], "variance": []})
        fit, covariance, variance = fit_statistics(harmonic_design(own["t"].to_numpy(), degree, harmonics), own["value"].to_numpy())
        return pd.DataFrame({"site": [own["site"].iloc[0]] * len(fit), "parameter": range(len(fit)), "value": fit, "error": np.sqrt(np.maximum(np.diag(covariance), 0)), "variance": variance})

    return df.select("site", "t", "value").groupBy("site").applyInPandas(one, "site long, parameter int, value double, error double, variance double")


def response_table(steps: DataFrame, cutoff_days: float) -> DataFrame:
    """``days``, ``response``: what the filter leaves of waves of these periods, as columns."""
    power = F.pow(F.lit(cutoff_days) / F.col("days"), F.lit(6.0))
    return steps.select("days", F.pow(F.lit(2.0), -F.least(power, F.lit(1000.0))).alias("response"))
