"""Windowed means over streams of site values (``site``, ``ts``, ``value``): late rows up to the watermark count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_mean(stream: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling, or with ``slide`` hopping, means by site. The state is one sum and count a site and window."""
    window = F.window("ts", length, slide or length)
    rows = stream.withWatermark("ts", late).groupBy(window, "site").agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    return rows.select("site", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "value", "n")


def active_seasons(stream: DataFrame, gap: str = "2 days", late: str = "1 hour") -> DataFrame:
    """Sessions of a site's values with no gap longer than ``gap``: total and length."""
    rows = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "site").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    return rows.select("site", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total", "n")
