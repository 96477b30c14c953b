"""Registered queries of whole programs, alignment, trims, calendars and regions, each with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import fixture
from .functions.scores import pressure_to_height, shifted_longitude
from .operators import CELL
from .operators import calendars as K
from .operators import compare as C
from .operators import lookup as L
from .operators import polygons as P
from .operators import regions as R
from .operators import signal as G
from .operators import space as S
from .operators import time as T
from .plans import alignment, analyses, config, mean_state, programs, run, scoreboard
from .sources import catalog as CAT
from .sources.store import Store, folder, written
from .queries import _POWERS, _R, _REGION_ROWS, AREA, PI, _cells, _cycle_sql, _fit_sql, _rounded, query

_MONTH = "CAST(floor((((t0+t1)/2) % 365)/(365.0::DOUBLE/12)) AS INT)"
_MODELS = "u AS (SELECT 'a' AS model, t0, t1, lat0, lat1, lon0, lon1, value FROM {1} UNION ALL SELECT 'b', t0, t1, lat0, lat1, lon0, lon1, CASE WHEN lat0 < 60 THEN value*1.25-3 END FROM {1}), r AS (SELECT * FROM {0})"


def _keyed_cycle(table: str, name: str, keys: str) -> str:
    """The SQL of the mean yearly cycle by ``keys``."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    own = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""{name}_i AS (SELECT {keys}, value, row_number() OVER (PARTITION BY {keys} ORDER BY t0) - 1 AS i, ((t0+t1)/2) % 365 AS d, count(*) OVER (PARTITION BY {keys}) AS n FROM {table}),
{name}_f AS (SELECT {keys}, i AS f FROM (SELECT {keys}, i, row_number() OVER (PARTITION BY {keys} ORDER BY d, i) AS k FROM {name}_i WHERE i < 11) q WHERE k = 1),
{name} AS (SELECT {own}, CAST((i - f) % 12 AS INT) AS month, avg(value) AS value FROM {name}_i a JOIN {name}_f b ON {on} WHERE i >= f AND i - f < floor((n - f) / 12) * 12 GROUP BY ALL)"""


def _meeting_sql(name: str, axis: str, limit: int, where: str) -> str:
    """CTEs: the cells of an axis composed of each model's and the reference's, with the nearest cells of both."""
    near = lambda t: f"SELECT c.model, c.lo, c.hi, first(o.lo ORDER BY abs((c.lo+c.hi)/2-(o.lo+o.hi)/2), o.lo) AS near FROM {name}_c c JOIN {name}_{t} o ON o.model = c.model GROUP BY ALL"
    return f"""{name}_u AS (SELECT DISTINCT model, {axis}0 AS lo, {axis}1 AS hi FROM u0), {name}_r AS (SELECT DISTINCT model, {axis}0 AS lo, {axis}1 AS hi FROM r0 CROSS JOIN mm WHERE {where}),
{name}_e AS (SELECT DISTINCT model, e FROM (SELECT model, unnest([lo, hi]) AS e FROM {name}_u UNION ALL SELECT model, unnest([lo, hi]) FROM {name}_r) q WHERE abs(e) <= {limit}),
{name}_c AS (SELECT * FROM (SELECT model, e AS lo, lead(e) OVER (PARTITION BY model ORDER BY e) AS hi FROM {name}_e) q WHERE hi IS NOT NULL),
{name} AS (SELECT a.model, a.lo, a.hi, a.near AS r, b.near AS c FROM ({near('r')}) a JOIN ({near('u')}) b ON b.model = a.model AND b.lo = a.lo)"""


def _composed_sql(ref: str, models: str, where: str = "true") -> str:
    """CTEs ``u`` and ``rr``: models of grids of their own, and the reference, on each model's composed grid. ``where``: which
    cells of the reference meet which model."""
    return f"""u0 AS (SELECT * FROM {models}), r0 AS (SELECT * FROM {ref}), mm AS (SELECT DISTINCT model FROM u0), {_meeting_sql('ml', 'lat', 90, where)}, {_meeting_sql('mo', 'lon', 180, where)},
u AS (SELECT u0.model, t0, t1, ml.lo AS lat0, ml.hi AS lat1, mo.lo AS lon0, mo.hi AS lon1, value FROM u0 JOIN ml ON ml.model = u0.model AND ml.c = u0.lat0 JOIN mo ON mo.model = u0.model AND mo.c = u0.lon0),
rr AS (SELECT ml.model, t0, t1, ml.lo AS lat0, ml.hi AS lat1, mo.lo AS lon0, mo.hi AS lon1, value FROM r0 JOIN ml ON ml.r = r0.lat0 JOIN mo ON mo.model = ml.model AND mo.r = r0.lon0)"""


def _place_sql(ref: str, com: str, place: str, basis: str, base: str = "") -> str:
    """CTEs up to ``z``: the statistics by model and place, from the formulas of masked means on whole fields. ``base``: CTEs
    of the models ``u`` and of the reference ``rr`` once for each model, in place of those of one grid."""
    base = base or f"{_MODELS.format(ref, com)}, mm AS (SELECT DISTINCT model FROM u), rr AS (SELECT mm.model, r.* FROM r CROSS JOIN mm)"
    keys = f"model, {place}"
    on = lambda a, b, names: " AND ".join(f"{a}.{k} = {b}.{k}" for k in names.split(", "))
    pick = lambda t, names: ", ".join(f"{t}.{k}" for k in names.split(", "))
    extra = ", lat1, lon1" if "lat0" in place else ""
    wrap = "CASE WHEN d > 182.5 THEN d - 365 WHEN d < -182.5 THEN d + 365 ELSE d END"
    first = lambda name, k: f"(SELECT {k}, month FROM (SELECT {k}, month, row_number() OVER (PARTITION BY {k} ORDER BY value DESC, month) AS i FROM {name} WHERE value IS NOT NULL) q WHERE i = 1)"
    days = "CASE WHEN month = 1 THEN 28 WHEN month IN (3, 5, 8, 10) THEN 30 ELSE 31 END"
    error = {
        "series": "sqrt(sum((y-x)*(y-x)*w)/sum(CASE WHEN y-x IS NOT NULL THEN w END)) AS rmse, sqrt(sum(((y-my)-(x-mx))*((y-my)-(x-mx))*w)/sum(CASE WHEN y-x IS NOT NULL THEN w END)) AS crmse FROM jm",
        "cycle": f"sqrt(sum((y-x)*(y-x)*{days})/sum(CASE WHEN y-x IS NOT NULL THEN {days} END)) AS rmse, sqrt(sum(((y-my)-(x-mx))*((y-my)-(x-mx))*{days})/sum(CASE WHEN y-x IS NOT NULL THEN {days} END)) AS crmse FROM (SELECT *, avg(x) OVER (PARTITION BY {keys}) AS mx, avg(y) OVER (PARTITION BY {keys}) AS my FROM cc) q",
    }[basis]
    return f"""{base},
j AS (SELECT coalesce(rr.model, u.model) AS model, {', '.join(f'coalesce(rr.{k}, u.{k}) AS {k}' for k in (place + extra).split(', '))}, coalesce(rr.t0, u.t0) AS t0, coalesce(rr.t1, u.t1) AS t1, coalesce(rr.t1, u.t1)-coalesce(rr.t0, u.t0) AS w, rr.value AS x, u.value AS y FROM rr FULL JOIN u ON u.model = rr.model AND u.t0 = rr.t0 AND {on('u', 'rr', place)}),
m AS (SELECT {keys}{extra}, sum(x*w)/sum(CASE WHEN x IS NOT NULL THEN w END) AS mx, sum(y*w)/sum(CASE WHEN y IS NOT NULL THEN w END) AS my FROM j GROUP BY ALL),
jm AS (SELECT j.*, mx, my FROM j JOIN m ON {on('j', 'm', keys)}), s AS (SELECT {keys}, sqrt(sum((x-mx)*(x-mx)*w)/sum(CASE WHEN x IS NOT NULL THEN w END)) AS s FROM jm GROUP BY ALL),
{_keyed_cycle('rr', 'cr', keys)}, {_keyed_cycle('u', 'cu', keys)}, cc AS (SELECT {pick('cu', keys)}, cu.month, cr.value AS x, cu.value AS y FROM cu JOIN cr ON {on('cu', 'cr', keys)} AND cr.month = cu.month),
e AS (SELECT {keys}, {error} GROUP BY ALL), sh AS (SELECT {pick('b', keys)}, CAST(b.month-a.month AS DOUBLE)*365/12 AS d FROM {first('cr', keys)} a JOIN {first('cu', keys)} b ON {on('a', 'b', keys)}),
iv AS (SELECT {pick('j', keys)}, sqrt(sum((j.x-cc.x)*(j.x-cc.x)*w)/sum(CASE WHEN j.x-cc.x IS NOT NULL THEN w END)) AS ix, sqrt(sum((j.y-cc.y)*(j.y-cc.y)*w)/sum(CASE WHEN j.y-cc.y IS NOT NULL THEN w END)) AS iy FROM j LEFT JOIN cc ON {on('cc', 'j', keys)} AND cc.month = {_MONTH.replace('t0', 'j.t0').replace('t1', 'j.t1')} GROUP BY ALL),
z AS (SELECT m.*, my-mx AS bias, exp(-abs((my-mx)/nullif(s, 0))) AS bias_score, rmse, exp(-abs(crmse/nullif(s, 0))) AS rmse_score, abs({wrap})/30 AS shift, (1+cos(abs({wrap})*2*{PI}/365))/2 AS cycle_score, exp(-abs((iy-ix)/nullif(ix, 0))) AS iav_score
 FROM m LEFT JOIN s ON {on('s', 'm', keys)} LEFT JOIN e ON {on('e', 'm', keys)} LEFT JOIN sh ON {on('sh', 'm', keys)} LEFT JOIN iv ON {on('iv', 'm', keys)})"""


def _models(df: DataFrame, columns: list[str]) -> DataFrame:
    other = df.withColumn("value", F.when(F.col("lat0") < 60, F.col("value") * 1.25 - 3) if "lat0" in df.columns else F.col("value") * 1.25 - 3)
    return df.select(F.lit("a").alias("model"), *columns).unionByName(other.select(F.lit("b").alias("model"), *columns))


_FIELD = ["t0", "t1", *CELL, "value"]
_IN_REGION = "r2.label = 'globe' OR ((lat0+lat1)/2 > lat_min AND (lat0+lat1)/2 <= lat_max AND (lon0+lon1)/2 > lon_min AND (lon0+lon1)/2 <= lon_max)"


def _state_sql(ref: str, com: str, basis: str, mass: bool, base: str = "") -> str:
    """CTEs up to ``w``: model, region, scalar, value."""
    weight = f"abs(mx)*{AREA}" if mass else AREA
    mean = lambda c, w, where="mx IS NOT NULL AND my IS NOT NULL": f"sum(CASE WHEN {where} THEN ({c})*({w}) END)/sum(CASE WHEN ({where}) AND ({c}) IS NOT NULL THEN {w} END)"
    x, y = "CASE WHEN my IS NOT NULL THEN mx END", "CASE WHEN mx IS NOT NULL THEN my END"
    scalars = {
        "Bias": mean("bias", AREA), "Bias Score": mean("bias_score", weight), "RMSE": mean("rmse", AREA), "RMSE Score": mean("rmse_score", weight), "Phase Shift": mean("shift", AREA),
        "Seasonal Cycle Score": mean("cycle_score", weight), "Interannual Variability Score": mean("iav_score", weight), "Benchmark Period Mean (intersection)": mean("mx", AREA),
        "Model Period Mean (intersection)": mean("my", AREA), "Benchmark Period Mean (complement)": mean("mx", AREA, "my IS NULL"), "Model Period Mean (complement)": mean("my", AREA, "mx IS NULL"),
        "Spatial Distribution Score": "max(4*(1+rr)/((ss+1/ss)*(ss+1/ss)*2))",
    }
    shape = _R.replace("x", "{x}").replace("y", "{y}").replace("ma{x}", "max")
    r = shape.format(x=f"({x})", y=f"({y})")
    parts = " UNION ALL ".join(f"SELECT model, region, '{name}' AS scalar, {sql} AS value FROM zr GROUP BY model, region" for name, sql in scalars.items())
    return f"""{_place_sql(ref, com, 'lat0, lon0', basis, base)}, zg AS (SELECT z.*, r2.label AS region FROM z JOIN fx_regions r2 ON {_IN_REGION}),
sd AS (SELECT model, region, {r} AS rr, stddev_pop({y})/stddev_pop({x}) AS ss FROM zg GROUP BY model, region), zr AS (SELECT zg.*, rr, ss FROM zg JOIN sd ON sd.model = zg.model AND sd.region = zg.region),
w AS (SELECT * FROM ({parts}) q WHERE value IS NOT NULL AND NOT isnan(value))"""


def _state(spark: SparkSession, sf_dir: str, basis: str, mass: bool) -> DataFrame:
    ref, com = written(fixture(spark, sf_dir, "fx_masked_ref").select(*_FIELD), "ref"), written(_models(fixture(spark, sf_dir, "fx_same_grid"), _FIELD), "com")
    return mean_state.mean_state(ref, com, fixture(spark, sf_dir, "fx_regions"), basis, mass)


@query(f"WITH {_state_sql('fx_masked_ref', 'fx_same_grid', 'cycle', True)} SELECT model, region, scalar, round(value, 6) AS value FROM w")
def mean_state_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_state(spark, sf_dir, "cycle", True), "value")


@query(f"WITH {_state_sql('fx_masked_ref', 'fx_same_grid', 'series', False)} SELECT model, region, scalar, round(value, 6) AS value FROM w")
def mean_state_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_state(spark, sf_dir, "series", False), "value")


_GRIDS = _composed_sql("fx_masked_ref", "fx_three_models")


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(fixture(spark, sf_dir, "fx_three_models"), "models")


@query(f"WITH {_state_sql('', '', 'cycle', True, _GRIDS)} SELECT model, region, scalar, round(value, 6) AS value FROM w")
def mean_state_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models, each on a grid of its own."""
    ref = written(fixture(spark, sf_dir, "fx_masked_ref").select(*_FIELD), "ref")
    return _rounded(mean_state.mean_state(ref, _three(spark, sf_dir), fixture(spark, sf_dir, "fx_regions")), "value")


@query(f"WITH {_state_sql('', '', 'series', True, _GRIDS)} SELECT model, region, scalar, round(value, 6) AS value FROM w WHERE scalar LIKE '%RMSE%' OR scalar LIKE 'Bias%'")
def mean_state_grids_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = written(fixture(spark, sf_dir, "fx_masked_ref").select(*_FIELD), "ref")
    out = mean_state.mean_state(ref, _three(spark, sf_dir), fixture(spark, sf_dir, "fx_regions"), "series", skip=("skip_cycle",))
    return _rounded(out.filter("scalar like '%RMSE%' or scalar like 'Bias%'"), "value")


@query(f"""WITH mm(model, weight) AS (VALUES ('a', 1.0), ('b', 2.0), ('c', 0.5)), u AS (SELECT * FROM fx_three_models), g AS (SELECT DISTINCT lat0, lat1, lon0, lon1 FROM fx_ref_grid),
la AS (SELECT model, g.lat0, first(o.lat0 ORDER BY abs((g.lat0+g.lat1)/2-(o.lat0+o.lat1)/2), o.lat0) AS near FROM (SELECT DISTINCT lat0, lat1 FROM g) g CROSS JOIN (SELECT DISTINCT model, lat0, lat1 FROM u) o GROUP BY ALL),
lo AS (SELECT model, g.lon0, first(o.lon0 ORDER BY abs((g.lon0+g.lon1)/2-(o.lon0+o.lon1)/2), o.lon0) AS near FROM (SELECT DISTINCT lon0, lon1 FROM g) g CROSS JOIN (SELECT DISTINCT model, lon0, lon1 FROM u) o GROUP BY ALL)
SELECT la.lat0, lo.lon0, u.t0, round(sum(value*weight)/3.5, 6) AS value FROM u JOIN mm ON mm.model = u.model JOIN la ON la.model = u.model AND la.near = u.lat0 JOIN lo ON lo.model = u.model AND lo.near = u.lon0 GROUP BY ALL""")
def ensemble_on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fixture(spark, sf_dir, "fx_ref_grid").select(*CELL).distinct()
    out = C.ensemble_on_grid(_three(spark, sf_dir), cells, {"a": 1.0, "b": 2.0, "c": 0.5})
    return _rounded(out, "value").select("lat0", "lon0", "t0", "value")


_THRESHOLDS = "(VALUES ('globe', 'bias', 4.0), ('euro', 'bias', 2.5), ('globe', 'rmse', 6.0), ('shsa', 'rmse', 3.0)) AS h(region, type, value)"
_LIMIT = f"(SELECT z.lat0, z.lat1, z.lon0, z.lon1, h.type, sum(h.value) AS q FROM (SELECT DISTINCT lat0, lat1, lon0, lon1 FROM z) z JOIN fx_regions r2 ON {_IN_REGION} JOIN {_THRESHOLDS} ON h.region = r2.label GROUP BY ALL)"


@query(f"""WITH {_place_sql('', '', 'lat0, lon0', 'cycle', _GRIDS).replace(', rmse, exp(', ', rmse, crmse, exp(')}, lt AS {_LIMIT}, sq AS (SELECT z.*, greatest(least(1-abs(bias)/b.q, 1), 0) AS bs, CASE WHEN crmse IS NOT NULL THEN greatest(least(1-crmse/e.q, 1), 0) END AS es FROM z JOIN lt b ON b.lat0 = z.lat0 AND b.lon0 = z.lon0 AND b.lat1 = z.lat1 AND b.lon1 = z.lon1 AND b.type = 'bias' JOIN lt e ON e.lat0 = z.lat0 AND e.lon0 = z.lon0 AND e.lat1 = z.lat1 AND e.lon1 = z.lon1 AND e.type = 'rmse' WHERE mx IS NOT NULL AND my IS NOT NULL),
gq AS (SELECT sq.*, r2.label AS region FROM sq JOIN fx_regions r2 ON {_IN_REGION}) SELECT model, region, 'Bias Score' AS scalar, round(sum(bs*{AREA})/sum({AREA}), 6) AS value FROM gq GROUP BY ALL UNION ALL SELECT model, region, 'RMSE Score', round(sum(es*{AREA})/sum(CASE WHEN es IS NOT NULL THEN {AREA} END), 6) FROM gq GROUP BY ALL""")
def mean_state_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bias and errors scored by regional thresholds."""
    regions = fixture(spark, sf_dir, "fx_regions")
    ref = written(fixture(spark, sf_dir, "fx_masked_ref").select(*_FIELD), "ref")
    table = spark.sql(f"SELECT region, type, CAST(value AS DOUBLE) AS value FROM {_THRESHOLDS}")
    out = mean_state.mean_state(ref, _three(spark, sf_dir), regions, thresholds=(table, regions))
    return _rounded(out.filter("scalar in ('Bias Score', 'RMSE Score')"), "value")


_SITE_MONTHS = "SELECT CAST(l_suppkey % 7 AS INT) AS site, (q.yr-1850)*365+m.b0 AS t0, (q.yr-1850)*365+m.b1 AS t1, avg(v) AS value FROM (SELECT l_suppkey, year(l_shipdate) AS yr, month(l_shipdate) AS mo, {} AS v FROM lineitem) q JOIN fx_months m ON q.mo = m.mo GROUP BY 1, 2, 3"


def _site_months(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    from .fixtures import with_fixtures

    return spark.sql(with_fixtures(_SITE_MONTHS.format(value)).replace("FROM lineitem", f"FROM parquet.`{sf_dir}/lineitem.parquet`"))


_SITE_SCALARS = {
    "Bias": "bias", "Bias Score": "bias_score", "RMSE": "rmse", "RMSE Score": "rmse_score", "Phase Shift": "shift", "Seasonal Cycle Score": "cycle_score", "Interannual Variability Score": "iav_score",
    "Benchmark Period Mean (intersection)": "mx", "Model Period Mean (intersection)": "my",
}
_SITE_MODELS = _MODELS.replace(", lat0, lat1, lon0, lon1", ", site").replace("CASE WHEN lat0 < 60 THEN value*1.25-3 END", "value*1.25-3")


@query(
    f"WITH sa AS ({_SITE_MONTHS.format('l_quantity')}), sb AS ({_SITE_MONTHS.format('l_quantity+l_tax*40')}), "
    + _place_sql("sa", "sb", "site", "series").replace(_MODELS.format("sa", "sb"), _SITE_MODELS.format("sa", "sb"))
    + ", w AS ("
    + " UNION ALL ".join(f"SELECT model, '{n}' AS scalar, avg({c}) AS value FROM z WHERE mx IS NOT NULL AND my IS NOT NULL GROUP BY model" for n, c in _SITE_SCALARS.items())
    + ") SELECT model, scalar, round(value, 6) AS value FROM w WHERE value IS NOT NULL"
)
def site_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, com = _site_months(spark, sf_dir, "l_quantity"), _site_months(spark, sf_dir, "l_quantity+l_tax*40")
    return _rounded(mean_state.site_state(ref, _models(com, ["t0", "t1", "site", "value"])), "value")


#: A run of two sections, of unequal weights on each level; the last dataset has no data and counts as zero.
CONFIG = """
[h1: Land]
[h2: First]
variable = "masked"
weight = 5
mass_weighting = "yes"
[Grid]
weight = 3
[Again]
skip_iav = "yes"
weight = 1
[h2: Second]
variable = "plain"
weight = 2
[Grid]
[h1: Sea]
weight = 0.5
[h2: Third]
variable = "none"
[Nothing]
"""
_SCORE_WEIGHT = "CASE scalar WHEN 'RMSE Score' THEN 2 ELSE 1 END"


def _overall_sql(name: str, where: str = "true") -> str:
    return f"SELECT model, sum(value*{_SCORE_WEIGHT})/sum({_SCORE_WEIGHT}) AS s FROM {name} WHERE region = 'globe' AND scalar LIKE '%Score' AND {where} GROUP BY model"


@query(
    f"""WITH m1 AS (WITH {_state_sql('fx_masked_ref', 'fx_same_grid', 'cycle', True)} SELECT * FROM w), m2 AS (WITH {_state_sql('fx_ref_grid', 'fx_same_grid', 'cycle', False)} SELECT * FROM w),
g AS ({_overall_sql('m1')}), h AS ({_overall_sql('m1', "scalar <> 'Interannual Variability Score'")}), k AS ({_overall_sql('m2')}),
v AS (SELECT g.model, (3*g.s+h.s)/4 AS first, k.s AS second FROM g JOIN h ON h.model = g.model JOIN k ON k.model = g.model), s AS (SELECT *, (5*first+2*second)/7 AS land FROM v)
SELECT model, level, section, variable, round(score, 6) AS score FROM (SELECT model, 'variable' AS level, 'Land' AS section, 'First' AS variable, first AS score FROM s UNION ALL SELECT model, 'variable', 'Land', 'Second', second FROM s UNION ALL SELECT model, 'variable', 'Sea', 'Third', 0 FROM s
 UNION ALL SELECT model, 'section', 'Land', NULL, land FROM s UNION ALL SELECT model, 'section', 'Sea', NULL, 0 FROM s UNION ALL SELECT model, 'whole', NULL, NULL, land/1.5 FROM s) q"""
)
def scoreboard_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, regions = config.parse(CONFIG), fixture(spark, sf_dir, "fx_regions")
    tables = {k: written(fixture(spark, sf_dir, f).select(*_FIELD), "ref") for k, f in (("masked", "fx_masked_ref"), ("plain", "fx_ref_grid"))}
    models = written(_models(fixture(spark, sf_dir, "fx_same_grid"), _FIELD), "models")
    scalars = run.run(root, run.Fields(lambda leaf: tables.get(leaf.values["variable"]), lambda leaf: models), regions)
    rolled = scoreboard.roll_up(run.weighted_leaves(spark, root, scalars, region="globe"), keys=("model",))
    return _rounded(rolled.filter("level <> 'source'"), "score").select("model", "level", "section", "variable", "score")


#: A run of models on grids of their own, with relationships; the last dataset's times do not fit the models'.
GRID_CONFIG = """
[h1: Land]
[h2: First]
variable = "masked"
mass_weighting = "yes"
[Grid]
[h2: Second]
variable = "plain"
[Again]
relationships = "First/Grid"
[h2: Third]
variable = "early"
[Off]
"""


def _grid_run(spark: SparkSession, sf_dir: str) -> tuple[config.Node, Store, DataFrame]:
    """The run, begun on one model and gone on with all, on one store."""
    root, regions, store = config.parse(GRID_CONFIG), fixture(spark, sf_dir, "fx_regions"), Store(spark)
    refs = {"masked": written(fixture(spark, sf_dir, "fx_masked_ref").select(*_FIELD), "ref"), "plain": written(fixture(spark, sf_dir, "fx_ref_grid").select(*_FIELD), "ref")}
    refs["early"] = refs["plain"].withColumns({"t0": F.col("t0") - 36500, "t1": F.col("t1") - 36500})
    models = _three(spark, sf_dir)
    changed = {"plain": models.withColumn("value", F.col("value") * (1 + F.col("lat0") / 900)), "masked": models}
    fields = lambda which: run.Fields(lambda leaf: refs[leaf.values["variable"]], lambda leaf: changed.get(leaf.values["variable"], models).filter(which))
    run.run(root, fields("model = 'b'"), regions, ["Land/First"], store)
    scalars = run.run(root, fields("true"), regions, None, store)
    return root, store, scalars


#: The reference is cut where it goes far beyond a model.
_CUT = "NOT (mm.model = 'b' AND r0.lat0 >= 60)"
_CHANGED = "(SELECT * REPLACE (value*(1+lat0/900) AS value) FROM fx_three_models)"


@query(
    f"""WITH m1 AS (WITH {_state_sql('', '', 'cycle', True, _composed_sql('fx_masked_ref', 'fx_three_models', _CUT))} SELECT * FROM w), m2 AS (WITH {_state_sql('', '', 'cycle', False, _composed_sql('fx_ref_grid', _CHANGED, _CUT))} SELECT * FROM w), g AS ({_overall_sql('m1')}), k AS ({_overall_sql('m2')})
SELECT 'First' AS variable, model, 'done' AS status, round(s, 6) AS score FROM g UNION ALL SELECT 'Second', model, 'done', round(s, 6) FROM k UNION ALL SELECT 'Third', model, 'failed', NULL FROM (SELECT DISTINCT model FROM fx_three_models) q"""
)
def run_on_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, store, scalars = _grid_run(spark, sf_dir)
    scores = scalars.filter("region = 'globe' and scalar = 'Overall Score'").select("variable", "model", F.lit("done").alias("status"), F.col("value").alias("score"))
    failed = store.failures().select(F.element_at(F.split("dataset", "/"), 2).alias("variable"), "model", F.lit("failed").alias("status"), F.lit(None).cast("double").alias("score"))
    return _rounded(scores.unionByName(failed), "score")


_RELATED_MAPS = f"""mp AS (SELECT 'y' AS k, 'Benchmark' AS model, lat0, lat1, lon0, lon1, sum(value*(t1-t0))/sum(CASE WHEN value IS NOT NULL THEN t1-t0 END) AS v FROM fx_ref_grid GROUP BY ALL UNION ALL SELECT 'x', 'Benchmark', lat0, lat1, lon0, lon1, sum(value*(t1-t0))/sum(CASE WHEN value IS NOT NULL THEN t1-t0 END) FROM fx_masked_ref GROUP BY ALL
 UNION ALL SELECT 'y', model, lat0, lat1, lon0, lon1, sum(value*(t1-t0))/sum(t1-t0) FROM {_CHANGED} q GROUP BY ALL UNION ALL SELECT 'x', model, lat0, lat1, lon0, lon1, sum(value*(t1-t0))/sum(t1-t0) FROM fx_three_models GROUP BY ALL)"""
_BIN = "CAST(least(greatest(floor(({0}-l{0}.a)*25/(l{0}.b-l{0}.a)), 0), 24) AS INT)"


@query(
    f"""WITH {_RELATED_MAPS}, lx AS (SELECT min(v) AS a, max(v) AS b FROM mp WHERE k = 'x'), ly AS (SELECT min(v) AS a, max(v) AS b FROM mp WHERE k = 'y'),
pt AS (SELECT a.model, a.lat0, a.lat1, a.lon0, a.lon1, a.v AS x, b.v AS y FROM mp a JOIN mp b ON a.k = 'x' AND b.k = 'y' AND b.model = a.model AND b.lat0 = a.lat0 AND b.lon0 = a.lon0 WHERE a.v IS NOT NULL AND b.v IS NOT NULL),
bn AS (SELECT model, r2.label AS region, {_BIN.format('x')} AS i, {_BIN.format('y')} AS j, y FROM pt JOIN fx_regions r2 ON {_IN_REGION} CROSS JOIN lx CROSS JOIN ly), n AS (SELECT model, region, count(*) AS n FROM bn GROUP BY ALL),
p AS (SELECT bn.model, bn.region, i, j, count(*)/max(n.n) AS p FROM bn JOIN n ON n.model = bn.model AND n.region = bn.region GROUP BY ALL), m AS (SELECT bn.model, bn.region, i, avg(y) AS m FROM bn JOIN n ON n.model = bn.model AND n.region = bn.region GROUP BY ALL HAVING count(*)/max(n.n) >= 3e-3),
d AS (SELECT b.model, b.region, sum((sqrt(a.p)-sqrt(b.p))**2) AS s FROM p a JOIN p b ON a.model = 'Benchmark' AND b.model <> 'Benchmark' AND b.region = a.region AND b.i = a.i AND b.j = a.j GROUP BY ALL)
SELECT n.model, n.region, 'First|Grid Hellinger Distance' AS scalar, round(1-sqrt(coalesce(d.s, 0))/sqrt(2), 6) AS value FROM n JOIN n o ON o.model = 'Benchmark' AND o.region = n.region LEFT JOIN d ON d.model = n.model AND d.region = n.region WHERE n.model <> 'Benchmark'
UNION ALL SELECT b.model, b.region, 'First|Grid Score', round(exp(-sqrt(sum((a.m-b.m)**2))/sqrt(sum(a.m**2))), 6) FROM m a JOIN m b ON a.model = 'Benchmark' AND b.model <> 'Benchmark' AND b.region = a.region AND b.i = a.i GROUP BY ALL"""
)
def run_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, store, _ = _grid_run(spark, sf_dir)
    out = run.relationships(root, store, fixture(spark, sf_dir, "fx_regions"))
    return _rounded(out, "value").select("model", "region", "scalar", "value")


# alignment


_YEARS = "(SELECT DISTINCT CAST((yr-1850)*365 AS DOUBLE) AS b0, CAST((yr-1849)*365 AS DOUBLE) AS b1 FROM fx_masked_ref WHERE yr BETWEEN 1996 AND 1999)"


@query(f"""WITH y AS {_YEARS}, a AS (SELECT lat0, lon0, b0, b0*1.0/365+1850 AS value FROM y CROSS JOIN (SELECT DISTINCT lat0, lon0 FROM fx_masked_ref WHERE lat0 >= -30) c),
b AS (SELECT lat0, lon0, b0, sum(value*(least(t1,b1)-greatest(t0,b0)))/sum(CASE WHEN value IS NOT NULL THEN least(t1,b1)-greatest(t0,b0) END)*86400000 AS value FROM fx_masked_ref JOIN y ON t0 < b1 AND t1 > b0 WHERE lat0 >= -60 GROUP BY 1, 2, 3)
SELECT b.lat0, b.lon0, b.b0 AS t0, round(a.value, 6) AS ref, round(b.value, 3) AS com FROM b LEFT JOIN a ON a.lat0 = b.lat0 AND a.lon0 = b.lon0 AND a.b0 = b.b0""")
def make_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    com = fixture(spark, sf_dir, "fx_masked_ref")
    years = com.filter("yr between 1996 and 1999").select(((F.col("yr") - 1850) * 365).cast("double").alias("t0"), ((F.col("yr") - 1849) * 365).cast("double").alias("t1"), *CELL).distinct()
    ref = years.filter("lat0 >= -30").withColumn("value", F.col("t0") / 365 + 1850)
    a, b = alignment.comparable(ref, com.select(*_FIELD), "g m-2 d-1", "kg m-2 s-1")
    on = ["lat0", "lon0", "t0"]
    both = b.select(*on, F.col("value").alias("com")).join(a.select(*on, F.col("value").alias("ref")), on, "left")
    return both.select(*on, F.round("ref", 6).alias("ref"), F.round("com", 3).alias("com"))


@query("SELECT lat0, lon0, t0, round(value, 6) AS value FROM fx_ref_grid WHERE lat0 >= -60 AND lat0 <= 0 AND lon0 >= -180 AND lon0 <= 60")
def trim_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    # -30 is the upper edge of one cell and the lower of the next: the first counts
    out = S.trimmed(fixture(spark, sf_dir, "fx_ref_grid"), lat=(-30.0, 12.0), lon=(-500.0, 75.0))
    return _rounded(out, "value").select("lat0", "lon0", "t0", "value")


@query("SELECT cell, z0, round(value, 6) AS value FROM fx_layers WHERE z1 >= 2 AND z0 <= 4")
def trim_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.trimmed(fixture(spark, sf_dir, "fx_layers"), depth=(2.0, 4.0)), "value").select("cell", "z0", "value")


@query("""WITH u AS (SELECT 'a' AS model, lat0, lat1, lon0, lon1 FROM fx_ref_grid WHERE lat0 >= -60 UNION ALL SELECT 'b', lat0+1.5, lat1+1.5, lon0, lon1-1 FROM fx_com_grid WHERE lat0 < 45), m AS (SELECT model, min(lat0) AS a, max(lat1) AS b, min(lon0) AS c, max(lon1) AS d FROM u GROUP BY model)
SELECT CASE WHEN abs(max(a)+90) <= 2 THEN -90 ELSE max(a) END AS lat_min, CASE WHEN abs(min(b)-90) <= 2 THEN 90 ELSE min(b) END AS lat_max, CASE WHEN abs(max(c)+180) <= 2 THEN -180 ELSE max(c) END AS lon_min, CASE WHEN abs(min(d)-180) <= 2 THEN 180 ELSE min(d) END AS lon_max FROM m""")
def restrictive_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fixture(spark, sf_dir, "fx_ref_grid").filter("lat0 >= -60").select(F.lit("a").alias("model"), *CELL)
    b = fixture(spark, sf_dir, "fx_com_grid").filter("lat0 < 45").select(F.lit("b").alias("model"), (F.col("lat0") + 1.5).alias("lat0"), (F.col("lat1") + 1.5).alias("lat1"), "lon0", (F.col("lon1") - 1).alias("lon1"))
    return S.shared_extents(a.unionByName(b))


@query("SELECT lat0, lon0, t0, round(CASE WHEN abs(lat0)+lon0/4 >= 20 AND NOT (lat0 = 60 AND lon0 > 0) THEN value END, 6) AS value FROM fx_ref_grid")
def land_and_glacier_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "fx_ref_grid")
    cells = df.select(*CELL).distinct()
    land = cells.withColumn("value", F.when(F.abs("lat0") + F.col("lon0") / 4 >= 20, 80.0).otherwise(10.0))
    ice = cells.withColumn("value", F.when((F.col("lat0") == 60) & (F.col("lon0") > 0), 1.0).otherwise(0.0))
    return _rounded(S.land_only(df, land, 0.3, ice), "value").select("lat0", "lon0", "t0", "value")


@query("""SELECT l_orderkey, l_linenumber, (year(l_shipdate)-1850)*365.0::DOUBLE + CASE month(l_shipdate) WHEN 1 THEN 0 WHEN 2 THEN 31 WHEN 3 THEN 59 WHEN 4 THEN 90 WHEN 5 THEN 120 WHEN 6 THEN 151 WHEN 7 THEN 181 WHEN 8 THEN 212 WHEN 9 THEN 243 WHEN 10 THEN 273 WHEN 11 THEN 304 ELSE 334 END
 + CASE WHEN month(l_shipdate) = 2 AND day(l_shipdate) = 29 THEN 28 ELSE day(l_shipdate)-1 END AS day FROM lineitem""")
def noleap_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.select("l_orderkey", "l_linenumber", T.noleap_day(F.to_date("l_shipdate")).alias("day"))


@query("SELECT lat0, lon0, (t0+t1)/2 AS t, round((t0+t1)/2/365+1850, 6) AS year, round(value, 6) AS value FROM fx_dense_ref WHERE t0 >= 53290-0.01*(t1-t0) AND t1 <= 54020+0.01*(t1-t0)")
def read_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.read_times(fixture(spark, sf_dir, "fx_dense_ref"), CELL, 53290.0, 54020.0)
    return _rounded(out.withColumn("year", T.year_of(F.col("t"))), "year", "value").select("lat0", "lon0", "t", "year", "value")


@query("WITH r AS (SELECT *, value*1e-9 AS v FROM fx_ref_grid) SELECT lat0, lon0, t0, round(v*86400*1000, 6) AS value, 'g m-2 d-1' AS unit FROM r")
def reduced_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, unit = T.reduced_units(fixture(spark, sf_dir, "fx_ref_grid").withColumn("value", F.col("value") * 1e-9), "kg m-2 s-1")
    return _rounded(out, "value").select("lat0", "lon0", "t0", "value", F.lit(unit).alias("unit"))


# regions


_BOXES = ", ".join(f"('{b[0]}', {b[2]}, {b[3]}, {b[4]}, {b[5]})" for b in R.BOXES)


@query(f"""WITH b(label, a, b, c, d) AS (VALUES {_BOXES}), g AS (SELECT lat0, lat1, lon0, lon1, value FROM fx_com_grid WHERE value IS NOT NULL)
SELECT label AS region, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS value FROM g JOIN b ON label IN ('global', 'globe') OR ((lat0+lat1)/2 > a AND (lat0+lat1)/2 <= b.b AND (lon0+lon1)/2 > c AND (lon0+lon1)/2 <= d) GROUP BY label""")
def fixed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.in_region(fixture(spark, sf_dir, "fx_com_grid").filter("value is not null"), R.fixed_regions(spark))
    return _rounded(rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")), "value")


@query("""WITH g AS (SELECT *, CAST(floor(((lat0+lat1)/2+90)/45) AS INT) AS i FROM fx_ref_grid) SELECT 'zone' || i AS region, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM (SELECT value, CASE WHEN (lat0+lat1)/2 IN (-45, 0, 45) THEN i-1 ELSE i END AS i FROM g) q GROUP BY i""")
def raster_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 30-degree rows to the raster's 45-degree ones by nearest centres, the lower one of equals
    raster = fixture(spark, sf_dir, "fx_com_grid").select(*CELL).distinct().withColumn("label", F.concat(F.lit("zone"), ((F.col("lat0") + 90) / 45).cast("int")))
    rows = R.in_raster(fixture(spark, sf_dir, "fx_ref_grid"), raster)
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# cycles, seasons, relationships


@query(f"""WITH {_cycle_sql('fx_ref_grid', 'cyc')} SELECT g.lat0, g.lon0, t0, round(g.value-c.value, 6) AS value FROM fx_ref_grid g LEFT JOIN cyc c ON c.lat0 = g.lat0 AND c.lon0 = g.lon0 AND c.month = {_MONTH}""")
def without_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "fx_ref_grid")
    return _rounded(T.without_cycle(df, T.annual_cycle(df, CELL), CELL), "value").select("lat0", "lon0", "t0", "value")


@query("""WITH i AS (SELECT lat0, lon0, t0, value, row_number() OVER (PARTITION BY lat0, lon0 ORDER BY t0) - 1 AS i, count(*) OVER (PARTITION BY lat0, lon0) AS n, t0 % 365 AS d, t1-t0 AS w, min(t1-t0) OVER (PARTITION BY lat0, lon0) AS least FROM fx_dense_ref),
f AS (SELECT *, min(CASE WHEN abs(d) < w/2 THEN i END) OVER (PARTITION BY lat0, lon0) AS f, CAST(round(365/least) AS INT) AS p FROM i)
SELECT lat0, lon0, t0, CAST(floor((i-f)/p) AS INT) AS period_number, CAST((i-f) % p AS INT) AS sample FROM f WHERE i >= f AND i-f < floor((n-f)/p)*p""")
def cycle_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cycle_shape(fixture(spark, sf_dir, "fx_dense_ref"), CELL).select("lat0", "lon0", "t0", "period_number", "sample")


@query(f"""WITH {_cycle_sql('fx_ref_grid', 'a')}, {_cycle_sql('fx_same_grid', 'b')}, f AS (SELECT 'x' AS k, lat0, lon0, month, value-26 AS v FROM a UNION ALL SELECT 'y', lat0, lon0, month, value-30 FROM b),
o AS (SELECT k, lat0, lon0, coalesce(sum(CASE WHEN v < 0 THEN v*365/12 END), 0) AS u, min(CASE WHEN v < 0 THEN month END) AS b, max(CASE WHEN v < 0 THEN month END) AS e FROM f GROUP BY ALL),
s AS (SELECT k, lat0, lon0, month AS s FROM (SELECT *, row_number() OVER (PARTITION BY k, lat0, lon0 ORDER BY v, month) AS i FROM f) q WHERE i = 1), t AS (SELECT o.*, s.s FROM o JOIN s ON s.k = o.k AND s.lat0 = o.lat0 AND s.lon0 = o.lon0),
d AS (SELECT x.lat0, x.lon0, x.u AS ru, y.u, (y.b-x.b)*365.0::DOUBLE/12 AS b, (y.e-x.e)*365.0::DOUBLE/12 AS e, (y.s-x.s)*365.0::DOUBLE/12 AS s FROM t x JOIN t y ON x.k = 'x' AND y.k = 'y' AND y.lat0 = x.lat0 AND y.lon0 = x.lon0)
SELECT lat0, lon0, round(ru, 6) AS ref_uptake, round(u, 6) AS uptake, round(CASE WHEN b IS NOT NULL AND e IS NOT NULL THEN (greatest(1-abs(b)/60, 0)+greatest(1-abs(e)/60, 0)+greatest(1-abs(s)/60, 0))/3 END, 6) AS season_score, round(exp(-abs((u-ru)/nullif(ru, 0))), 6) AS flux_score FROM d""")
def growing_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (T.annual_cycle(fixture(spark, sf_dir, f), CELL).withColumn("value", F.col("value") - x) for f, x in (("fx_ref_grid", 26.0), ("fx_same_grid", 30.0)))
    out = analyses.growing_season_scores(a, b, CELL)
    # a score needs all three marks, as greatest() alone would pass over a missing one
    marked = out.withColumn("season_score", F.when(F.col("begin").isNotNull() & F.col("end").isNotNull(), F.col("season_score")))
    return _cells(marked, "ref_uptake", "uptake", "season_score", "flux_score")


_AMPLITUDES = "SELECT user_id % 20 AS site, CAST(day(ts) AS INT) AS day, max(value)-min(value) AS value FROM events WHERE {} GROUP BY 1, 2"


def _season_sql(name: str) -> str:
    return f"""(WITH m AS (SELECT *, max(value) OVER (PARTITION BY site) AS m FROM {name}), p AS (SELECT site, min(day) AS p FROM m WHERE value = m GROUP BY site)
SELECT m.site, min(day) AS b, max(day) AS e, max(day)-min(day)+1 AS l, sum(day*value)/sum(value) AS c, avg(value) AS u, any_value(p) AS p FROM m JOIN p ON p.site = m.site WHERE value > 0.2*m GROUP BY m.site)"""


@query(f"""WITH a AS ({_AMPLITUDES.format("event_id % 2 = 0")}), b AS ({_AMPLITUDES.format("event_id % 2 = 1")}), x AS {_season_sql('a')}, y AS {_season_sql('b')}
SELECT x.site, round((exp(2*ln(0.1)*abs(y.b-x.b)/x.l)+exp(2*ln(0.1)*abs(y.e-x.e)/x.l))/2, 6) AS bounds_score, round(exp(2*ln(0.1)*abs(y.l-x.l)/x.l), 6) AS length_score, round(exp(2*ln(0.1)*abs(y.c-x.c)/x.l), 6) AS centroid_score,
 round(exp(2*ln(0.1)*abs(y.p-x.p)/x.l), 6) AS timing_score, round(exp(-abs((y.u-x.u)/x.u)), 6) AS uptake_score FROM x JOIN y ON y.site = x.site""")
def diurnal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    daily = lambda k: df.filter(f"event_id % 2 = {k}").groupBy((F.col("user_id") % 20).alias("site"), F.dayofmonth("ts").alias("day")).agg((F.max("value") - F.min("value")).alias("value"))
    out = analyses.diurnal_scores(daily(0), daily(1), ["site"])
    return _rounded(out, *out.columns[1:])


@query("""WITH b AS (SELECT event_type, CAST(floor(hour(ts)/6) AS INT) AS slot, avg(value) AS v FROM events GROUP BY 1, 2) SELECT event_type, CAST(min(slot)*6 AS DOUBLE) AS hour FROM (SELECT *, max(v) OVER (PARTITION BY event_type) AS m FROM b) q WHERE v = m GROUP BY event_type""")
def hour_of_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    cycle = df.groupBy("event_type", F.floor(F.hour("ts") / 6).cast("int").alias("slot")).agg(F.avg("value").alias("value"))
    return T.hour_of_maximum(cycle, ["event_type"], 4)


@query("SELECT round(regr_slope(dep, ind), 6) AS slope, round(regr_intercept(dep, ind), 6) AS intercept, round(0.674*sqrt(greatest(regr_syy(dep, ind)-regr_sxy(dep, ind)**2/regr_sxx(dep, ind), 0)/count(*)), 6) AS band FROM fx_relationship")
def response_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.response_line(fixture(spark, sf_dir, "fx_relationship"), "ind", "dep")
    return _rounded(out, *out.columns)


@query("""WITH l AS (SELECT min(ind)-1e-8*(max(ind)-min(ind)) AS a, max(ind)+1e-8*(max(ind)-min(ind)) AS b FROM fx_relationship), h AS (SELECT CAST(least(greatest(floor((ind-a)/((b-a)/25))+1, 1), 25) AS INT) AS bin_x, log10(dep) AS y FROM fx_relationship CROSS JOIN l)
SELECT bin_x, round(10**avg(y), 4) AS mean, round(stddev_pop(y), 6) AS std, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY bin_x HAVING count(*) >= 3e-3*(SELECT count(*) FROM h)""")
def log_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "fx_relationship")
    out = C.log_response(df, "ind", "dep", C.shared_limits([df], "ind"))
    return out.select("bin_x", F.round("mean", 4).alias("mean"), F.round("std", 6).alias("std"), "n")


@query(f"""WITH r AS ({_REGION_ROWS}) SELECT region, unnest([0, 5, 50, 100]) AS quantile, round(unnest(quantile_cont(abs(value), [0.0, 0.05, 0.5, 1.0])), 6) AS value FROM r WHERE value IS NOT NULL GROUP BY region""")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.in_region(fixture(spark, sf_dir, "fx_masked_ref"), fixture(spark, sf_dir, "fx_regions"))
    return _rounded(C.quantile_errors(rows, ["region"], [0, 5, 50, 100]), "value")


@query("SELECT label, CAST(row_number() OVER (ORDER BY CASE label WHEN 'global' THEN 0 WHEN 'globe' THEN 1 ELSE 2 END, label) AS INT) AS place FROM fx_regions")
def sorted_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoreboard.sorted_regions(fixture(spark, sf_dir, "fx_regions"))


@query("SELECT n_name AS model, CAST(row_number() OVER (ORDER BY n_name <> 'JAPAN', upper(n_name), n_name) AS INT) AS place FROM nation")
def sorted_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoreboard.sorted_models(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("model")), "JAPAN")


@query("""SELECT n_name AS scalar, CAST(row_number() OVER (ORDER BY CASE WHEN contains(n_name, 'I') THEN 1 ELSE 0 END + CASE WHEN contains(n_name, 'UN') THEN 2 ELSE 0 END, n_name) AS INT) AS place FROM nation""")
def metric_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoreboard.metric_order(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("scalar")), ["I", "UN"])


_ROLLED3 = """t AS (SELECT *, unnest(['a', 'b']) AS model, score*unnest([1.0, 0.5]) AS s FROM fx_tree), v AS (SELECT model, section, variable, sum(weight*s)/sum(weight) AS s FROM t GROUP BY ALL), c AS (SELECT model, section, avg(s) AS s FROM v GROUP BY ALL)"""


@query(f"""WITH {_ROLLED3}, x AS (SELECT model, section, list(struct_pack(variable := variable, score := round(s, 6)) ORDER BY variable) AS l FROM v GROUP BY ALL), y AS (SELECT x.model, list(struct_pack(section := x.section, score := round(c.s, 6), variables := l) ORDER BY x.section) AS l, round(avg(c.s), 6) AS o FROM x JOIN c ON c.model = x.model AND c.section = x.section GROUP BY x.model)
SELECT model, CAST(to_json(struct_pack(schema := 'v1', model := model, overall := o, sections := l)) AS VARCHAR) AS json FROM y""")
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(x).alias("x")) for m, x in (("a", 1.0), ("b", 0.5)))))
    rows = fixture(spark, sf_dir, "fx_tree").withColumn("_m", models).select("section", "variable", "source", "weight", "_m.model", (F.col("score") * F.col("_m.x")).alias("score"))
    return scoreboard.result_json(scoreboard.roll_up(rows, keys=("model",)))


@query("""WITH w(dataset, variable) AS (VALUES ('Land/First/Grid', 'masked'), ('Land/First/Again', 'masked'), ('Land/Second/Grid', 'plain'), ('Sea/Third/Nothing', 'none')), c AS (SELECT DISTINCT r_name AS model, CASE WHEN r_regionkey % 2 = 0 THEN 'masked' ELSE 'plain' END AS variable FROM region)
SELECT model, dataset FROM (SELECT DISTINCT model FROM c) m CROSS JOIN w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.model = m.model AND c.variable = w.variable)""")
def missing_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("model"), F.when(F.col("r_regionkey") % 2 == 0, "masked").otherwise("plain").alias("variable"))
    return run.missing(spark, config.parse(CONFIG), catalog)


# points, times and curves


@query("""WITH c AS (SELECT -90+10.0*i AS lat0, -180+10.0*j AS lon0 FROM range(18) a(i) CROSS JOIN range(36) b(j)), p AS (SELECT lat0, lon0, site, sqrt((lat0+5-lat)**2+(lon0+5-lon)**2) AS d, lat, lon FROM c CROSS JOIN fx_sites),
k AS (SELECT *, row_number() OVER (PARTITION BY lat0, lon0 ORDER BY d, lat, lon, site) AS k FROM p WHERE d < 8) SELECT CAST(c.lat0 AS DOUBLE) AS lat0, CAST(c.lon0 AS DOUBLE) AS lon0, CAST(k.site AS DOUBLE) AS value FROM c LEFT JOIN k ON k.lat0 = c.lat0 AND k.lon0 = c.lon0 AND k = 1""")
def regridded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fixture(spark, sf_dir, "fx_sites").select("lat", "lon", F.col("site").cast("double").alias("value"))
    return L.regridded_points(points, S.regular_grid(spark, 10.0), 8.0).select("lat0", "lon0", "value")


@query("""WITH m AS (SELECT lat0, lon0, CASE WHEN avg(value) < 25.6 THEN avg(value) END AS v FROM fx_ref_grid GROUP BY 1, 2), n AS (SELECT a.lat0, a.lon0, avg(b.v) AS v FROM m a JOIN m b ON abs(a.lat0-b.lat0) <= 30 AND (abs(a.lon0-b.lon0) <= 30 OR abs(a.lon0-b.lon0) = 330) AND NOT (a.lat0 = b.lat0 AND a.lon0 = b.lon0) GROUP BY 1, 2)
SELECT m.lat0, m.lon0, round(coalesce(m.v, n.v), 6) AS value FROM m LEFT JOIN n ON n.lat0 = m.lat0 AND n.lon0 = m.lon0""")
def filled_from_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = fixture(spark, sf_dir, "fx_ref_grid").groupBy(*CELL).agg(F.avg("value").alias("value")).withColumn("value", F.when(F.col("value") < 25.6, F.col("value")))
    return _cells(L.filled_from_neighbours(grid, 30.0), "value")


@query("""WITH e AS (SELECT user_id AS site, event_type AS variable, value, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS o FROM events), f AS (SELECT *, CASE WHEN site % 3 = 0 AND o = 0 THEN NULL ELSE value END AS v FROM e WHERE o IS NOT NULL), b AS (SELECT site, min(o) AS o FROM f WHERE v IS NOT NULL GROUP BY site)
SELECT f.site, f.variable, CAST(count(*) AS BIGINT) AS n, round(sum(v), 4) AS total FROM f JOIN b ON b.site = f.site AND b.o = f.o GROUP BY 1, 2""")
def first_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("site"), F.col("event_type").alias("variable"), "value")
    rows = df.withColumn("value", F.when(~((F.col("site") % 3 == 0) & (F.col("variable") == "view")), F.col("value")))
    out = L.first_available(rows, ["view", "click", "purchase"], ["site"])
    return out.groupBy("site", "variable").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH s AS (SELECT CAST(l_suppkey % 7 AS INT) AS site, (year(l_shipdate)-1850)*365.0::DOUBLE + CAST(month(l_shipdate)-1 AS DOUBLE)*365/12 + 15 AS t, l_quantity AS value FROM lineitem)
SELECT site, CAST(floor(t/365+1850) AS INT) AS year, CAST(floor((t % 365)/(365.0::DOUBLE/12)) AS INT) AS month, round(avg(value), 6) AS value, round(stddev_samp(value), 6) AS std, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1, 2, 3""")
def monthly_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(L.monthly_means(_dated(spark, sf_dir), ["site"]), "value", "std")


@query(f"""WITH s AS (SELECT CAST(l_suppkey % 7 AS INT) AS site, CAST(year(l_shipdate) AS INT) AS year, l_quantity AS value FROM lineitem) SELECT site, year, round(avg(value), 6) AS value, round(stddev_samp(value), 6) AS std, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1, 2""")
def annual_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(L.annual_means(_dated(spark, sf_dir), ["site"]), "value", "std")


@query("""WITH s AS (SELECT CAST(l_suppkey % 7 AS INT) AS site, CAST(year(l_shipdate) AS INT) AS year, (year(l_shipdate)-1850)*365.0::DOUBLE + CAST(month(l_shipdate)-1 AS DOUBLE)*365/12 + 15 AS t, l_extendedprice AS value FROM lineitem), m AS (SELECT *, max(value) OVER w AS hi, min(value) OVER w AS lo, max(year) OVER (PARTITION BY site) AS last FROM s WINDOW w AS (PARTITION BY site, year))
SELECT site, year, round(max(hi-lo), 6) AS amplitude, round(min(t) FILTER (WHERE value = hi), 6) AS t_max, round(min(t) FILTER (WHERE value = lo), 6) AS t_min FROM m WHERE year < last GROUP BY site, year""")
def annual_amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(L.annual_amplitudes(_dated(spark, sf_dir, "l_extendedprice"), ["site"]), "amplitude", "t_max", "t_min")


def _dated(spark: SparkSession, sf_dir: str, value: str = "l_quantity") -> DataFrame:
    day = (F.year("l_shipdate") - 1850) * 365.0 + (F.month("l_shipdate") - 1).cast("double") * 365 / 12 + 15
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_suppkey") % 7).cast("int").alias("site"), day.alias("t"), F.col(value).alias("value"))


@query("SELECT p_partkey, round(-ln(p_retailprice*60/101325)*(8.3144598*288.15/0.0289644/9.80665), 4) AS height, (p_partkey*7+180) % 360 - 180 AS lon FROM part")
def heights_and_longitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    return df.select("p_partkey", F.round(pressure_to_height(F.col("p_retailprice") * 60), 4).alias("height"), shifted_longitude((F.col("p_partkey") * 7).cast("double")).cast("long").alias("lon"))


@query("SELECT lat0, lon0, t0, t1, round(value*(t1-t0), 6) AS value FROM fx_ref_grid")
def accumulated_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analyses.accumulated_total(fixture(spark, sf_dir, "fx_ref_grid"), ["lat0", "lon0"]), "value")


@query("""WITH u AS (SELECT n_name AS model, unnest([53000.0, 53100.0]) + n_nationkey AS t0 FROM nation) SELECT model FROM u GROUP BY model HAVING min(t0) > 53000+10""")
def late_starters(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.explode(F.array(F.lit(53000.0), F.lit(53100.0)))
    runs = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("model"), "n_nationkey", starts.alias("t")).withColumn("t0", F.col("t") + F.col("n_nationkey"))
    return analyses.late_starters(runs, 53000.0)


@query("""WITH s AS (SELECT n_name AS model, CAST(n_nationkey AS DOUBLE) AS weight FROM nation), v AS (SELECT n_name AS model, CAST(r.r_regionkey AS BIGINT) AS cell, CASE WHEN (n_nationkey+r.r_regionkey) % 4 > 0 THEN n_nationkey*2.0+r.r_regionkey END AS value FROM nation CROSS JOIN region r)
SELECT cell, round(sum(coalesce(value, 0)*weight)/(SELECT sum(weight) FROM s), 6) AS value FROM v JOIN s ON s.model = v.model GROUP BY cell""")
def ensemble_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    cells = nation.select(F.col("n_name").alias("model"), "n_nationkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("cell"))
    values = cells.withColumn("value", F.when((F.col("n_nationkey") + F.col("cell")) % 4 > 0, F.col("n_nationkey") * 2.0 + F.col("cell")))
    return _rounded(C.ensemble_mean(values, ["cell"], nation.select(F.col("n_name").alias("model"), F.col("n_nationkey").cast("double").alias("weight"))), "value")


@query()
def site_cycle_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic spline of each site's days of a month; no SQL: a linear system by site (tested against numpy)."""
    return G.cycle_extremes(fixture(spark, sf_dir, "fx_site_daily").select("site", F.col("d").cast("double").alias("t"), "value"), period=31.0)


_BY_TYPE = "SELECT CAST(ts AS DATE) AS day, avg(value) AS v FROM events WHERE event_type = '{}' GROUP BY 1"


@query(f"WITH a AS ({_BY_TYPE.format('view')}), b AS ({_BY_TYPE.format('click')}), p AS (SELECT a.v AS x, b.v AS y FROM a JOIN b ON b.day = a.day) SELECT round(least(greatest(1-sum((y-x)**2)/(var_pop(x)*count(*)), 0), 1), 6) AS nse FROM p")
def paired_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    daily = [df.filter(F.col("event_type") == k).groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("value")) for k in ("view", "click")]
    return _rounded(C.efficiency(C.paired(*daily, ["day"]).withColumn("k", F.lit(0)), ["k"]), "nse").select("nse")


_PAIRED = "p AS (SELECT r2.label AS region, g.t0, g.value AS x, c.value AS y FROM fx_masked_ref g JOIN fx_same_grid c ON c.t0 = g.t0 AND c.lat0 = g.lat0 AND c.lon0 = g.lon0 JOIN fx_regions r2 ON r2.label = 'globe' OR ((g.lat0+g.lat1)/2 > lat_min AND (g.lat0+g.lat1)/2 <= lat_max AND (g.lon0+g.lon1)/2 > lon_min AND (g.lon0+g.lon1)/2 <= lon_max))"
_WITH_N = _R.replace("sum(x)", "sum(CASE WHEN y IS NOT NULL THEN x END)").replace("sum(y)", "sum(CASE WHEN x IS NOT NULL THEN y END)").replace("sum(x*x)", "sum(CASE WHEN y IS NOT NULL THEN x*x END)").replace("sum(y*y)", "sum(CASE WHEN x IS NOT NULL THEN y*y END)")


def _pairs_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = C.paired(fixture(spark, sf_dir, "fx_masked_ref"), fixture(spark, sf_dir, "fx_same_grid"), ["t0", *CELL])
    return S.in_region(pairs, fixture(spark, sf_dir, "fx_regions"))


@query(f"WITH {_PAIRED}, o AS (SELECT region, t0, {_WITH_N} AS r FROM p GROUP BY region, t0 HAVING count(x) > 5) SELECT region, CAST(count(r) AS BIGINT) AS n, round(avg(r), 6) AS r FROM o WHERE NOT isnan(r) GROUP BY region")
def spatial_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_time = _pairs_in_regions(spark, sf_dir).groupBy("region", "t0").agg(C.correlation().alias("r"), F.count("ref").alias("n")).filter("n > 5")
    return _rounded(by_time.filter("not isnan(r)").groupBy("region").agg(F.count("r").alias("n"), F.avg("r").alias("r")), "r")


@query(f"WITH {_PAIRED} SELECT region, round({_WITH_N}, 6) AS r FROM p GROUP BY region")
def spatiotemporal_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_pairs_in_regions(spark, sf_dir).groupBy("region").agg(C.correlation().alias("r")), "r")


_RELATED = "SELECT p_partkey % 3 AS k, p_partkey % 2 AS h, CAST(p_size AS DOUBLE) AS ind, p_retailprice AS dep FROM part"


def _shared(column: str) -> str:
    return f"SELECT min({column})-1e-8*(max({column})-min({column})) AS a, max({column})+1e-8*(max({column})-min({column})) AS b FROM x WHERE h = 0 UNION ALL SELECT min({column})-1e-8*(max({column})-min({column})), max({column})+1e-8*(max({column})-min({column})) FROM x WHERE h = 1"


@query(f"""WITH x AS ({_RELATED}), li AS (SELECT min(a) AS a, max(b) AS b FROM ({_shared('ind')}) q), ld AS (SELECT min(a) AS c, max(b) AS d FROM ({_shared('dep')}) q),
y AS (SELECT k, h, CAST(least(greatest(floor((ind-a)/((b-a)/25))+1, 1), 25) AS INT) AS i, CAST(least(greatest(floor((dep-c)/((d-c)/25))+1, 1), 25) AS INT) AS j, dep FROM x CROSS JOIN li CROSS JOIN ld), n AS (SELECT k, h, count(*) AS n FROM y GROUP BY 1, 2),
p AS (SELECT y.k, y.h, i, j, count(*)/max(n.n) AS p FROM y JOIN n ON n.k = y.k AND n.h = y.h GROUP BY 1, 2, 3, 4), m AS (SELECT y.k, y.h, i, avg(dep) AS m FROM y JOIN n ON n.k = y.k AND n.h = y.h GROUP BY 1, 2, 3 HAVING count(*)/max(n.n) >= 3e-3),
d AS (SELECT a.k, 1-sqrt(sum((sqrt(a.p)-sqrt(b.p))**2))/sqrt(2) AS s FROM p a JOIN p b ON a.h = 0 AND b.h = 1 AND b.k = a.k AND b.i = a.i AND b.j = a.j GROUP BY 1), r AS (SELECT a.k, exp(-sqrt(sum((a.m-b.m)**2))/sqrt(sum(a.m**2))) AS s FROM m a JOIN m b ON a.h = 0 AND b.h = 1 AND b.k = a.k AND b.i = a.i GROUP BY 1)
SELECT coalesce(d.k, r.k) AS k, round(d.s, 6) AS distance_score, round(r.s, 6) AS response_score FROM d FULL JOIN r ON r.k = d.k""")
def relationship_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % 3).alias("k"), (F.col("p_partkey") % 2).alias("h"), F.col("p_size").cast("double").alias("ind"), F.col("p_retailprice").alias("dep"))
    out = C.relationship_scores(df.filter("h = 0"), df.filter("h = 1"), ["k"])
    return _rounded(out, "distance_score", "response_score")


def _station_sql(table: str) -> str:
    return f"""(WITH m AS (SELECT site, avg((t0+t1)/2) AS m, stddev_pop((t0+t1)/2) AS d FROM {table} GROUP BY site), x AS (SELECT s.site, t0, t1, value AS y, ((t0+t1)/2-m)/d AS x FROM {table} s JOIN m ON m.site = s.site), s AS (SELECT site, {_POWERS} FROM x GROUP BY site),
c AS (SELECT site, {', '.join(map(_fit_sql, range(3)))} FROM s), d AS (SELECT x.site, {_MONTH} AS month, y-(c0+c1*x+c2*x*x) AS v FROM x JOIN c ON c.site = x.site), r AS (SELECT *, v-avg(v) OVER (PARTITION BY site, month) AS r FROM d), b AS (SELECT site, month, avg(v) AS v, sum(r*r) AS rr, count(*) AS n FROM r GROUP BY 1, 2),
e AS (SELECT *, max(v) OVER (PARTITION BY site) AS hi, min(v) OVER (PARTITION BY site) AS lo FROM b) SELECT site, max(hi-lo) AS a, min(month) FILTER (WHERE v = hi) AS p, min(month) FILTER (WHERE v = lo) AS t, sqrt(sum(rr)/sum(n)) AS i FROM e GROUP BY site)"""


_SHIFTED = "1-least(abs({0}),365-abs({0}))/182.5"


@query(f"""WITH sa AS ({_SITE_MONTHS.format('l_quantity')}), sb AS ({_SITE_MONTHS.format('l_quantity+l_tax*40')}), a AS {_station_sql('sa')}, b AS {_station_sql('sb')}
SELECT a.site, round(exp(-abs((b.a-a.a)/a.a)), 6) AS amplitude_score, round(exp(-abs((b.i-a.i)/a.i)), 6) AS iav_score, round({_SHIFTED.format('((b.p-a.p)*365.0::DOUBLE/12)')}, 6) AS max_phase_score, round({_SHIFTED.format('((b.t-a.t)*365.0::DOUBLE/12)')}, 6) AS min_phase_score FROM a JOIN b ON b.site = a.site""")
def station_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analyses.station_scores(_site_months(spark, sf_dir, "l_quantity"), _site_months(spark, sf_dir, "l_quantity+l_tax*40"), ["site"])
    return _rounded(out, *out.columns[1:])


@query()
def sites_with_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each site's yearly phase is well defined; no SQL: a spectrum by site (tested against known waves)."""
    return G.sites_with_phase(_site_months(spark, sf_dir, "l_quantity").withColumn("site", F.col("site").cast("long")))


# polygons


#: Nine-sided basins with a hole of four sides, around places that follow from the nations' keys.
_RINGS = """SELECT n_nationkey AS basin, ring, k, CAST((n_nationkey*23) % 110 - 55 AS DOUBLE) + (1+(n_nationkey % 3)*CAST(0.5 AS DOUBLE))*CAST(dy AS DOUBLE) AS lat, CAST((n_nationkey*37) % 320 - 160 AS DOUBLE) + (1+(n_nationkey % 3)*CAST(0.5 AS DOUBLE))*CAST(dx AS DOUBLE) AS lon
FROM nation CROSS JOIN (VALUES (0,0,0.0,10.3),(0,1,7.1,7.2),(0,2,10.1,0.3),(0,3,3.2,-2.1),(0,4,7.3,-7.4),(0,5,-0.3,-10.2),(0,6,-7.2,-7.1),(0,7,-10.4,0.1),(0,8,-7.3,7.2),(1,0,-1.1,-1.2),(1,1,-1.3,3.1),(1,2,2.2,2.9),(1,3,2.1,-1.4)) AS v(ring,k,dy,dx)"""
_SIDES = f"rg AS ({_RINGS}), sd AS (SELECT basin, lat AS y1, lon AS x1, coalesce(lead(lat) OVER w, first(lat) OVER (PARTITION BY basin, ring ORDER BY k)) AS y2, coalesce(lead(lon) OVER w, first(lon) OVER (PARTITION BY basin, ring ORDER BY k)) AS x2 FROM rg WINDOW w AS (PARTITION BY basin, ring ORDER BY k))"
_CROSSED = "((y1 > {0}.lat) <> (y2 > {0}.lat)) AND {0}.lon < (x2-x1)*({0}.lat-y1)/(y2-y1)+x1"


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_RINGS.replace("FROM nation", f"FROM parquet.`{sf_dir}/nation.parquet`")).withColumnRenamed("k", "at")


@query(f"""WITH {_SIDES}, c AS (SELECT c_custkey, c_acctbal, CAST(c_custkey*7 % 1400 AS DOUBLE)/10-70 AS lat, CAST(c_custkey*13 % 3600 AS DOUBLE)/10-180 AS lon FROM customer),
i AS (SELECT c_custkey, c_acctbal, basin FROM c JOIN sd ON {_CROSSED.format('c')} GROUP BY ALL HAVING count(*) % 2 = 1) SELECT basin, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 4) AS total FROM i GROUP BY basin""")
def points_in_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = {"lat": (F.col("c_custkey") * 7 % 1400).cast("double") / 10 - 70, "lon": (F.col("c_custkey") * 13 % 3600).cast("double") / 10 - 180}
    points = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal").withColumns(place)
    found = points.join(P.inside(points, _rings(spark, sf_dir), 5.0), ["lat", "lon"])
    return found.groupBy("basin").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 4).alias("total"))


@query(f"""WITH {_SIDES}, g AS (SELECT -90.0::DOUBLE+2*i AS lat0, -88.0::DOUBLE+2*i AS lat1, -180.0::DOUBLE+2*j AS lon0, -178.0::DOUBLE+2*j AS lon1, -89.0::DOUBLE+2*i AS lat, -179.0::DOUBLE+2*j AS lon FROM range(90) a(i) CROSS JOIN range(180) b(j)),
i AS (SELECT lat0, lat1, lon0, lon1, basin FROM g JOIN sd ON {_CROSSED.format('g')} GROUP BY ALL HAVING count(*) % 2 = 1) SELECT basin, CAST(count(*) AS BIGINT) AS n, round(sum({AREA})/1e9, 4) AS area FROM i GROUP BY basin""")
def basin_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of basins with holes, in the cells of two degrees."""
    out = P.basin_areas(S.regular_grid(spark, 2.0), _rings(spark, sf_dir), 5.0)
    return out.select("basin", "n", F.round(F.col("area") / 1e9, 4).alias("area"))


_FINE = """SELECT CAST((yr-1850)*365 AS DOUBLE) AS t0, CAST((yr-1849)*365 AS DOUBLE) AS t1, CAST(-90+5*i AS DOUBLE) AS lat0, CAST(-85+5*i AS DOUBLE) AS lat1, CAST(-180+5*j AS DOUBLE) AS lon0, CAST(-175+5*j AS DOUBLE) AS lon1, v AS value
FROM (SELECT year(l_shipdate) AS yr, CAST(l_suppkey % 36 AS INT) AS i, CAST(l_partkey % 72 AS INT) AS j, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3) q"""


@query(f"""WITH {_SIDES}, g AS (SELECT *, (lat0+lat1)/2 AS lat, (lon0+lon1)/2 AS lon FROM ({_FINE}) q), c AS (SELECT DISTINCT lat0, lat1, lon0, lon1, lat, lon FROM g), i AS (SELECT lat0, lat1, lon0, lon1, basin FROM c JOIN sd ON {_CROSSED.format('c')} GROUP BY ALL HAVING count(*) % 2 = 1),
a AS (SELECT basin, sum({AREA}) AS a FROM i GROUP BY basin) SELECT i.basin AS site, t0, round(sum(value*{AREA.replace('lat', 'i.lat').replace('lon', 'i.lon')})/max(a.a), 6) AS value FROM g JOIN i ON i.lat0 = g.lat0 AND i.lon0 = g.lon0 JOIN a ON a.basin = i.basin GROUP BY 1, 2""")
def basin_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = written(spark.sql(_FINE.replace("FROM lineitem", f"FROM parquet.`{sf_dir}/lineitem.parquet`")), "fine")
    return _rounded(P.basin_means(df, _rings(spark, sf_dir), [], 5.0), "value").select("site", "t0", "value")


# calendars


_NOLEAP = "(year({0})-1850)*365.0::DOUBLE + CASE month({0}) WHEN 1 THEN 0 WHEN 2 THEN 31 WHEN 3 THEN 59 WHEN 4 THEN 90 WHEN 5 THEN 120 WHEN 6 THEN 151 WHEN 7 THEN 181 WHEN 8 THEN 212 WHEN 9 THEN 243 WHEN 10 THEN 273 WHEN 11 THEN 304 ELSE 334 END + CASE WHEN month({0}) = 2 AND day({0}) = 29 THEN 28 ELSE day({0})-1 END"
_LONG_MONTH = "CASE month(d) WHEN 2 THEN 28 WHEN 4 THEN 30 WHEN 6 THEN 30 WHEN 9 THEN 30 WHEN 11 THEN 30 ELSE 31 END"


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d, l_suppkey % 4 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN month(d) = 2 AND day(d) = 29 AND k < 3 THEN {_NOLEAP.format('d')} WHEN k = 3 THEN (year(d)-1850)*365.0::DOUBLE + {_NOLEAP.format('d').split('+', 1)[1].split('+ CASE WHEN', 1)[0]} + least(day(d)-1, {_LONG_MONTH}) + CASE WHEN day(d)-1 < {_LONG_MONTH} THEN 0.25 ELSE 0 END ELSE {_NOLEAP.format('d')} + 0.25 END AS day FROM l WHERE NOT (k = 1 AND month(d) = 2 AND day(d) = 29) AND NOT (k = 3 AND day(d) = 31)""")
def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship dates at six o'clock as stamps of four calendars, units and origins, to days without leap days."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("d"), (F.col("l_suppkey") % 4).cast("int").alias("k"))
    df = df.filter(~((F.col("k") == 1) & (F.month("d") == 2) & (F.dayofmonth("d") == 29)) & ~((F.col("k") == 3) & (F.dayofmonth("d") == 31)))
    year, month, day = F.year("d"), F.month("d"), F.dayofmonth("d")
    leap = (year * 366 + F.element_at(F.lit(K.BEFORE_LEAP), month) + day - 1 - (1990 * 366)) * 1.0
    stamps = [
        ((F.datediff("d", F.lit("1970-03-01")) * 24 - 6).cast("double"), "hours since 1970-03-01 12:00:00", "gregorian"),
        (((year - 1900) * 365 + F.element_at(F.lit(K.BEFORE), month) + day - 1 - 59 + 0.25).cast("double"), "days since 1900-03-01", "noleap"),
        (leap * 86400 + 21600, "seconds since 1990-01-01 00:00", "366_day"),
        ((year * 360 + (month - 1) * 30 + day - 1 - (2000 * 360 + 30 + 29) + 0.25).cast("double"), "days since 2000-02-30", "360_day"),
    ]
    pick = lambda i: F.element_at(F.array(*(s[i] if i == 0 else F.lit(s[i]) for s in stamps)), F.col("k") + 1)
    return df.select("l_orderkey", "l_linenumber", K.noleap_from(pick(0), pick(1), pick(2)).alias("day"))


_STAMPS = """SELECT k, (yr-1995)*365.0 + b0 + (b1-b0)*a AS t FROM (SELECT DISTINCT CAST(l_suppkey % 3 AS INT) AS k, year(l_shipdate) AS yr, month(l_shipdate) AS mo FROM lineitem WHERE year(l_shipdate) BETWEEN 1995 AND 1997) l JOIN fx_months m ON m.mo = l.mo JOIN (VALUES (0, 0.0), (1, 0.5), (2, 1.0)) AS v(kk, a) ON kk = k"""


@query(f"""WITH s AS ({_STAMPS}), n AS (SELECT *, lag(t) OVER w AS p, lead(t) OVER w AS q, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY k ORDER BY t)),
a AS (SELECT k, CASE WHEN abs(q-t-30) <= 4.0003 THEN least(greatest(round_even((t % 365)/(q-t), 1), 0), 1) END AS a FROM n WHERE i = 1)
SELECT n.k, round(145*365+t-a*coalesce(t-p, q-t), 6) AS t0, round(145*365+t+(1-a)*coalesce(q-t, t-p), 6) AS t1 FROM n JOIN a ON a.k = n.k""")
def stamp_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of monthly stamps that stand at the begins, middles and ends of months."""
    from .fixtures import with_fixtures

    df = spark.sql(with_fixtures(_STAMPS).replace("FROM lineitem", f"FROM parquet.`{sf_dir}/lineitem.parquet`")).select("k", F.col("t").cast("double").alias("t"))
    out = K.bounds_of_stamps(df.withColumns({"units": F.lit("days since 1995-01-01"), "calendar": F.lit("noleap")}), ["k"])
    return _rounded(out, "t0", "t1")


# documents and files


_SCORES = """SELECT r_name AS section, n_name AS variable, s_name AS source, m AS model, g AS region, sc AS scalar, CAST(1+s_suppkey % 3 AS DOUBLE) AS weight, CASE WHEN (s_suppkey+length(sc)) % 7 > 0 THEN 1/(1+abs(s_acctbal)/5000)*x END AS value
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey CROSS JOIN (VALUES ('a', CAST(1.0 AS DOUBLE)), ('b', CAST(0.5 AS DOUBLE))) AS v(m, x) CROSS JOIN (VALUES ('global'), ('euro'), ('nowhere')) AS w(g) CROSS JOIN (VALUES ('Bias Score'), ('RMSE Score'), ('OverallScore')) AS y(sc)"""


@query(f"""WITH s AS ({_SCORES}), t AS (SELECT *, regexp_replace(scalar, '([a-z])([A-Z])', '\\1 \\2', 'g') AS statistic FROM s WHERE value IS NOT NULL AND region <> 'nowhere')
SELECT region, model, section || coalesce('::' || variable, '') || coalesce('!!' || source, '') AS metric, statistic, round(sum(value*weight)/sum(weight), 6) AS value FROM t GROUP BY GROUPING SETS ((region, model, statistic, section), (region, model, statistic, section, variable), (region, model, statistic, section, variable, source))""")
def cmec_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document's results, read back from its JSON."""
    sql = _SCORES
    for t in ("supplier", "nation", "region"):
        sql = sql.replace(f"FROM {t} ", f"FROM parquet.`{sf_dir}/{t}.parquet` ").replace(f"JOIN {t} ", f"JOIN parquet.`{sf_dir}/{t}.parquet` ")
    scores = written(spark.sql(sql), "scores")
    regions = spark.sql("SELECT * FROM VALUES ('global', 'Globe', 'own'), ('euro', 'Europe', 'own') AS t(label, name, generator)")
    models = spark.sql("SELECT * FROM VALUES ('a', 'model a', 'x') AS t(model, description, source)")
    nested = F.from_json("json", "RESULTS map<string, map<string, map<string, map<string, double>>>>")["RESULTS"]
    out = scoreboard.cmec_document(scores, regions, models).select(F.explode(nested).alias("region", "r"))
    out = out.select("region", F.explode("r").alias("model", "m")).select("region", "model", F.explode("m").alias("metric", "s"))
    return _rounded(out.select("region", "model", "metric", F.explode("s").alias("statistic", "value")), "value")


@query("""SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'a' WHEN l_suppkey % 3 = 1 THEN 'b' ELSE 'c' END AS model, CASE WHEN l_suppkey % 3 = 2 THEN 'gppv' ELSE 'gpp' END AS variable, CAST(year(l_shipdate) AS INT) AS year, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 4) AS total FROM lineitem WHERE year(l_shipdate) BETWEEN 1994 AND 1995 GROUP BY ALL""")
def catalogued_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of three models, one with a variable of another name, found by their names; only those of two years are read."""
    path = folder(spark) + f"/files-{uuid.uuid4().hex}"
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumns({"k": (F.col("l_suppkey") % 3).cast("int"), "y": F.year("l_shipdate")})
    df.select("k", "y", F.col("l_quantity").alias("value")).repartition("k", "y").write.partitionBy("k", "y").parquet(path)
    # one folder a model and year; their names stand in for those of files
    pattern = r"k=(?P<model>\d)/y=(?P<first>\d+)/.*(?P<variable>)\.parquet$"
    files = CAT.file_catalog(spark, path, pattern, "*.parquet").withColumns({"model": F.element_at(F.array(*map(F.lit, "abc")), F.col("model").cast("int") + 1), "variable": F.when(F.col("model") == "2", "gppv").otherwise("gpp"), "last": F.col("first")})
    synonyms = spark.sql("SELECT 'gpp' AS variable, 'gppv' AS synonym, 1 AS place")
    rows = CAT.read_files(CAT.select_files(files, "gpp", synonyms, (1994, 1995)).withColumn("model", F.concat_ws("|", "model", "first")))
    model, year = F.split("model", r"\|")[0], F.split("model", r"\|")[1].cast("int")
    return rows.groupBy(model.alias("model"), "variable", year.alias("year")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# curves


@query("""WITH x AS (SELECT site, d, value, (d-avg(d) OVER (PARTITION BY site))/365.0::DOUBLE AS x FROM fx_site_daily), s AS (SELECT site, count(*) AS n, avg(value) AS m, regr_sxx(value, x) AS sxx, regr_slope(value, x) AS b, (regr_syy(value, x)-regr_sxy(value, x)**2/regr_sxx(value, x))/(count(*)-2) AS v FROM x GROUP BY site HAVING count(*) > 2)
SELECT site, 0 AS parameter, round(m, 6) AS value, round(sqrt(v/n), 6) AS error, round(v, 6) AS variance FROM s UNION ALL SELECT site, 1, round(b, 4), round(sqrt(v/sxx), 4), round(v, 6) FROM s""")
def site_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters, their errors and the residual variance of each site's fitted line."""
    out = G.curve_fits(fixture(spark, sf_dir, "fx_site_daily").select("site", F.col("d").cast("double").alias("t"), "value"), degree=2, harmonics=0)
    places = F.when(F.col("parameter") == 0, F.round("value", 6)).otherwise(F.round("value", 4)).alias("value")
    errors = F.when(F.col("parameter") == 0, F.round("error", 6)).otherwise(F.round("error", 4)).alias("error")
    return out.select("site", "parameter", places, errors, F.round("variance", 6).alias("variance"))


@query("SELECT DISTINCT CAST(p_size*20 AS DOUBLE) AS days, round(2.0**(-least((80.0/(p_size*20))**6, 1000)), 9) AS response FROM part")
def filter_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_size") * 20).cast("double").alias("days")).distinct()
    return G.response_table(steps, 80.0).select("days", F.round("response", 9).alias("response"))


@query()
def site_cycle_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each site's periodic spline goes through its mean; no SQL: a linear system by site (tested against dense search)."""
    return G.cycle_crossings(fixture(spark, sf_dir, "fx_site_daily").select("site", F.col("d").cast("double").alias("t"), "value"), period=31.0)


# programs by ctype


PROGRAM_CONFIG = """
[h1: Land]
[h2: Gauges]
variable = "gauges"
ctype = "ConfUSGS"
[Sites]
[h2: Basins]
variable = "basins"
ctype = "ConfBasin"
[Rivers]
[h2: Balance]
variable = "balance"
ctype = "ConfNBP"
[Globe]
"""
_GLOBE = f"SELECT t0, t1, sum(value*{AREA})/1e14 AS value, sum(value*{AREA})/1e14-40 AS value_lo FROM ({_FINE}) q GROUP BY 1, 2"
_BASIN_YEARS = "SELECT CAST(o_custkey % 25 AS INT) AS site, (year(o_orderdate)-1850)*365.0 AS t0, (year(o_orderdate)-1849)*365.0 AS t1, avg(o_totalprice)/5000 AS value FROM orders GROUP BY 1, 2, 3"
_EFFICIENCY = "greatest(least(1-sum((y-x)**2)/(var_pop(x)*count(*)), 1), 0) AS nse, greatest(least(1-sqrt((corr(y, x)-1)**2+(stddev_pop(y)/stddev_pop(x)-1)**2+(avg(y)/avg(x)-1)**2), 1), 0) AS kge"


def _program_fields(spark: SparkSession, sf_dir: str) -> run.Fields:
    from .fixtures import with_fixtures

    def sql(text: str) -> DataFrame:
        text = with_fixtures(text)
        for t in ("lineitem", "orders", "nation"):
            text = text.replace(f"FROM {t} ", f"FROM parquet.`{sf_dir}/{t}.parquet` ").replace(f"FROM {t})", f"FROM parquet.`{sf_dir}/{t}.parquet`)")
        return spark.sql(text)

    fine = written(sql(_FINE), "fine")
    two = lambda df: df.withColumn("model", F.lit("a")).unionByName(df.withColumns({"model": F.lit("b"), "value": F.col("value") * 1.25 - 3}))
    globe = written(sql(_GLOBE), "globe")
    refs = {"gauges": lambda: _site_months(spark, sf_dir, "l_quantity"), "basins": lambda: sql(_BASIN_YEARS).select("site", F.col("t0").cast("double").alias("t0"), F.col("t1").cast("double").alias("t1"), "value"), "balance": lambda: globe}
    coms = {"gauges": lambda: two(_site_months(spark, sf_dir, "l_quantity+l_tax*40")), "basins": lambda: two(fine), "balance": lambda: two(fine).withColumn("value", F.col("value") / 1e14 * 0.98)}
    return run.Fields(lambda leaf: refs[leaf.values["variable"]](), lambda leaf: coms[leaf.values["variable"]]())


@query(
    f"""WITH sa AS ({_SITE_MONTHS.format('l_quantity')}), sb AS ({_SITE_MONTHS.format('l_quantity+l_tax*40')}), md AS (SELECT 'a' AS model, 1.0::DOUBLE AS f, 0.0::DOUBLE AS o UNION ALL SELECT 'b', 1.25, -3),
e AS (SELECT model, site, avg(y) AS m, {_EFFICIENCY} FROM (SELECT md.model, sa.site, sa.value AS x, sb.value*f+o AS y FROM sa JOIN sb ON sb.site = sa.site AND sb.t0 = sa.t0 CROSS JOIN md) q GROUP BY ALL),
{_SIDES}, g AS (SELECT *, (lat0+lat1)/2 AS lat, (lon0+lon1)/2 AS lon FROM ({_FINE}) q), c AS (SELECT DISTINCT lat0, lat1, lon0, lon1, lat, lon FROM g), i AS (SELECT lat0, lat1, lon0, lon1, basin FROM c JOIN sd ON {_CROSSED.format('c')} GROUP BY ALL HAVING count(*) % 2 = 1),
ar AS (SELECT basin, sum({AREA}) AS a FROM i GROUP BY basin), bm AS (SELECT model, i.basin AS site, t0, sum((value*f+o)*{AREA.replace('lat', 'i.lat').replace('lon', 'i.lon')})/max(ar.a) AS y FROM g JOIN i ON i.lat0 = g.lat0 AND i.lon0 = g.lon0 JOIN ar ON ar.basin = i.basin CROSS JOIN md GROUP BY ALL),
bs AS (SELECT model, bm.site, avg(b.value) AS mx, avg(y) AS my, stddev_pop(b.value) AS sx, stddev_pop(y) AS sy FROM bm JOIN ({_BASIN_YEARS}) b ON b.site = bm.site AND b.t0 = bm.t0 GROUP BY ALL),
gl AS ({_GLOBE}), fl AS (SELECT model, t0, t1, sum((value*f+o)/1e14*0.98*{AREA}) AS y FROM ({_FINE}) q CROSS JOIN md GROUP BY ALL), pr AS (SELECT model, gl.t0, value AS x, value-value_lo AS u, y, gl.t1-gl.t0 AS w FROM gl JOIN fl ON fl.t0 = gl.t0),
ac AS (SELECT model, t0, sum(x*w) OVER w AS x, sum(y*w) OVER w AS y, sum(u*w) OVER w AS u FROM pr WINDOW w AS (PARTITION BY model ORDER BY t0)), en AS (SELECT model, last(x ORDER BY t0) AS x, last(y ORDER BY t0) AS y, avg(exp(-greatest(abs(y-x)-u, 0)/u)) AS tr FROM ac GROUP BY model),
st AS (SELECT model, corr(y, x) AS r, stddev_pop(y)/stddev_pop(x) AS s FROM pr GROUP BY model),
w AS (SELECT 'Gauges' AS variable, model, 'Mean Discharge' AS scalar, avg(m) AS value FROM e GROUP BY model UNION ALL SELECT 'Gauges', model, 'NSE Score', avg(nse) FROM e GROUP BY model UNION ALL SELECT 'Gauges', model, 'KGE Score', avg(kge) FROM e GROUP BY model
 UNION ALL SELECT 'Basins', model, 'Benchmark Period Mean (intersection)', avg(mx) FROM bs GROUP BY model UNION ALL SELECT 'Basins', model, 'Model Period Mean (intersection)', avg(my) FROM bs GROUP BY model UNION ALL SELECT 'Basins', model, 'Bias', avg(my-mx) FROM bs GROUP BY model
 UNION ALL SELECT 'Basins', model, 'Bias Score', sum(exp(-abs((my-mx)/mx))*abs(mx))/sum(abs(mx)) FROM bs GROUP BY model UNION ALL SELECT 'Basins', model, 'Interannual Variability Score', sum(CASE WHEN sx > 0 THEN exp(-abs((sy-sx)/sx))*abs(mx) END)/sum(CASE WHEN sx > 0 THEN abs(mx) END) FROM bs GROUP BY model
 UNION ALL SELECT 'Balance', model, 'nbp', y FROM en UNION ALL SELECT 'Balance', model, 'diff', y-x FROM en UNION ALL SELECT 'Balance', model, 'Difference Score', exp(-0.287*abs((y-x)/10.8)) FROM en UNION ALL SELECT 'Balance', model, 'Trajectory Score', tr FROM en UNION ALL SELECT 'Balance', model, 'Temporal Distribution Score', 4*(1+r)/((s+1/s)*(s+1/s)*2) FROM st JOIN en USING (model))
SELECT variable, model, scalar, round(value, 5) AS value FROM w"""
)
def run_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three programs of their own kinds in one run."""
    programs.register_all(_rings(spark, sf_dir), 5.0)
    out = run.run(config.parse(PROGRAM_CONFIG), _program_fields(spark, sf_dir), fixture(spark, sf_dir, "fx_regions"))
    return out.filter("scalar <> 'Overall Score'").select("variable", "model", "scalar", F.round("value", 5).alias("value"))
