"""Two fields made comparable: the steps that come before every analysis."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import conversion
from ..operators import CELL
from ..operators.space import at_sites, uniform_clip
from ..operators.time import clip_to_cover, coarsen, integrate
from ..sources.store import written


class NotComparable(ValueError):
    """The two fields describe different things."""


class NotTemporal(NotComparable):
    """One field has times, the other has none."""


class NotLayered(NotComparable):
    """One field has several layers, the other has none."""


def _place(df: DataFrame) -> list[str]:
    return ["site"] if "site" in df.columns else [c for c in CELL if c in df.columns]


def _models(df: DataFrame) -> list[str]:
    return [c for c in ("model",) if c in df.columns]


def model_groups(com: DataFrame) -> list[list[str]]:
    """The models of ``com`` in groups of one clock, extent and layering: each group can be made comparable in one go,
    whatever the others are like. One job, which sends a row a model."""
    ends = [(f, c) for f, c in ((F.min, "lat0"), (F.max, "lat1"), (F.min, "lon0"), (F.max, "lon1"), (F.min, "z0"), (F.max, "z1")) if c in com.columns]
    if "t0" in com.columns:
        steps = com.groupBy("model", "t0", "t1").agg(F.count(F.lit(1)).alias("rows"), *(f(c).alias(c) for f, c in ends))
        own = [F.min("t0"), F.max("t1"), F.count(F.lit(1)), F.round(F.avg(F.col("t1") - F.col("t0")), 6)]
        rows = steps.groupBy("model").agg(*own, *(f(c) for f, c in ends)).collect()
    else:
        rows = com.groupBy("model").agg(*(f(c) for f, c in ends), F.count(F.lit(1)) > 0).collect()
    groups: dict[tuple, list[str]] = {}
    for row in rows:
        groups.setdefault(tuple(row)[1:], []).append(row["model"])
    return sorted(sorted(g) for g in groups.values())


def _on_times_of(ref: DataFrame, com: DataFrame) -> DataFrame:
    """``com`` with the reference's bounds of time, interval by interval in their order. The intervals are metadata."""
    own = com.select("t0", "t1").distinct().withColumn("_n", F.row_number().over(Window.orderBy("t0")))
    theirs = ref.select(F.col("t0").alias("_t0"), F.col("t1").alias("_t1")).distinct().withColumn("_n", F.row_number().over(Window.orderBy("_t0")))
    both = own.join(theirs, "_n").drop("_n")
    return com.join(both, ["t0", "t1"]).drop("t0", "t1").withColumnsRenamed({"_t0": "t0", "_t1": "t1"}).select(*com.columns)


def _times(df: DataFrame) -> dict:
    """First and last bound, mean length, number and a hash of the set of the distinct intervals."""
    distinct = df.select("t0", "t1").distinct()
    return distinct.agg(F.min("t0").alias("a"), F.max("t1").alias("b"), F.avg(F.col("t1") - F.col("t0")).alias("dt"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("t0", "t1")).alias("hash")).first().asDict()


def comparable(
    ref: DataFrame, com: DataFrame, ref_unit: str = "1", com_unit: str = "1", sites: DataFrame | None = None, clip_ref: bool = True, window: float = 0.0, any_times: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``ref`` and ``com`` (which may have a ``model`` column) at the same places, times and layers and in the reference's unit.

    A grid is read at the reference's ``sites`` (site, lat, lon). Grids are cut where one reaches 5 degrees beyond the other.
    The finer in time is averaged over the coarser's intervals if these are over half an order of magnitude longer, widened
    by ``window``. Then times are cut to what both cover, and the intervals of ``com``, which may be off by a part of their
    length, get the reference's bounds. Models of different clocks go one group (``model_groups``) at a time. Decisions rest on a few scalars that Spark aggregates; the fields
    themselves stay distributed. Raises where no common form exists.
    """
    if ("t0" in ref.columns) != ("t0" in com.columns):
        raise NotTemporal("one field has times, the other has none")
    if "site" in ref.columns and "site" not in com.columns:
        if sites is None:
            raise NotComparable("the reference has sites; say where they are")
        com = written(at_sites(com, sites).drop(*CELL, "lat", "lon"), "sites")
    if ("site" in ref.columns) != ("site" in com.columns):
        raise NotComparable("one field has sites, the other a grid")
    if "lat0" in ref.columns:
        ref, com = uniform_clip(ref, com)
    if "t0" in ref.columns:
        ref, com = _same_times(ref, com, clip_ref, window, any_times)
    ref, com = _same_layers(ref, com)
    factor, offset = conversion(com_unit, ref_unit)
    return ref, com.withColumn("value", F.col("value") * factor + offset)


def _same_times(ref: DataFrame, com: DataFrame, clip_ref: bool, window: float, any_times: bool) -> tuple[DataFrame, DataFrame]:
    a, b = _times(ref), _times(com)
    if not a["n"] or not b["n"]:
        raise NotComparable("a field has no times")
    if a == b:
        return ref, com
    intervals = lambda df: df.select(F.col("t0").alias("b0"), F.col("t1").alias("b1")).distinct()
    back = {"b0": "t0", "b1": "t1"}
    if math.log10(a["dt"] / b["dt"]) > 0.5:
        com = written(coarsen(com, intervals(ref), [*_models(com), *_place(com)], window).withColumnsRenamed(back), "coarse")
    elif math.log10(b["dt"] / a["dt"]) > 0.5:
        ref = written(coarsen(ref, intervals(com), _place(ref), window).withColumnsRenamed(back), "coarse")
        a = _times(ref)
    com = clip_to_cover(com, a["a"], a["b"])
    b = _times(com)
    if clip_ref:
        ref = clip_to_cover(ref, max(a["a"], b["a"]), min(a["b"], b["b"]))
        a = _times(ref)
    if any_times:
        return ref, com
    if a["n"] == b["n"] + 1:  # the reference may begin one interval earlier
        second = ref.filter(F.col("t0") > a["a"]).agg(F.min("t0").alias("t")).first()["t"]
        if abs(second - b["a"]) < 1e-2 * a["dt"]:
            ref = ref.filter(F.col("t0") > a["a"])
            a = _times(ref)
    if a["n"] != b["n"]:
        raise NotComparable(f"the reference has {a['n']} times, the other {b['n']}")
    if max(abs(a["a"] - b["a"]), abs(a["b"] - b["b"])) > 0.75 * a["dt"]:
        raise NotComparable("the fields are defined at different times")
    return ref, com if a["hash"] == b["hash"] else _on_times_of(ref, com)


def _same_layers(ref: DataFrame, com: DataFrame) -> tuple[DataFrame, DataFrame]:
    if "z0" not in ref.columns and "z0" not in com.columns:
        return ref, com
    layers = [df.select("z0", "z1").distinct().agg(F.count(F.lit(1)).alias("n"), F.min("z0").alias("a"), F.max("z1").alias("b")).first() if "z0" in df.columns else None for df in (ref, com)]
    if layers[0] is None or layers[1] is None:
        if (layers[0] or layers[1])["n"] == 1:
            return ref.drop("z0", "z1"), com.drop("z0", "z1")
        raise NotLayered("one field has layers, the other has none")
    times = [c for c in ("t0", "t1") if c in ref.columns]
    mean = lambda df, z: integrate(df, [*_models(df), *_place(df), *times], z["a"], z["b"], mean=True, bounds=("z0", "z1"))
    if layers[0]["n"] == 1:
        return mean(ref, layers[0]), mean(com, layers[0])
    if layers[0]["n"] != layers[1]["n"]:
        raise NotComparable("the fields have different layers")
    return ref, com
