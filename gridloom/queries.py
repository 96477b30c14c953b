"""Registered queries of the field operators, each with DuckDB SQL where SQL can express it.

Every query reads the given tables through the fixtures; floats are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fixtures import fixture, with_fixtures
from .functions.expressions import compile_expression
from .functions.scores import cycle_score, day_shift_score, exp_score, gated_ratio, quantile_score, wrap_shift
from .functions.units import conversion
from .operators import CELL
from .operators import compare as C
from .operators import lookup as L
from .operators import signal as G
from .operators import space as S
from .operators import time as T
from .plans import analyses, mean_state, scoreboard

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: SQL of a cell's area and of a month's weight.
AREA = "(6.371e6*6.371e6*(sin(radians(lat1))-sin(radians(lat0)))*radians(lon1-lon0))"
PI = "3.141592653589793"
T_START, T_END = (1996 - 1850) * 365 + 10, (1999 - 1850) * 365 + 200


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_fixtures(sql)
        return f

    return register


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 0.0, 6) for c in columns})


def _cells(df: DataFrame, *columns: str) -> DataFrame:
    return _rounded(df, *columns).select("lat0", "lon0", *columns)


@query("SELECT lat0, lon0, round(sum(value*(t1-t0))/sum(t1-t0), 6) AS value FROM fx_ref_grid GROUP BY lat0, lon0")
def time_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(T.integrate(fixture(spark, sf_dir, "fx_ref_grid"), CELL, mean=True), "value")


@query(f"SELECT lat0, lon0, round(sum(value*(least(t1,{T_END})-greatest(t0,{T_START}))), 6) AS value FROM fx_ref_grid WHERE t1 > {T_START} AND t0 < {T_END} GROUP BY lat0, lon0")
def time_integral_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(T.integrate(fixture(spark, sf_dir, "fx_ref_grid"), CELL, T_START, T_END), "value")


@query(f"SELECT CAST(count(*) AS BIGINT) AS n, round(min(t0), 6) AS a, round(max(t1), 6) AS b FROM fx_ref_grid WHERE t0 >= (SELECT max(t0) FROM fx_ref_grid WHERE t0 <= {T_START}) AND t1 <= (SELECT min(t1) FROM fx_ref_grid WHERE t1 >= {T_END})")
def clip_to_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.clip_to_cover(fixture(spark, sf_dir, "fx_ref_grid"), T_START, T_END).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("t0"), 6).alias("a"), F.round(F.max("t1"), 6).alias("b"))


@query("SELECT cell, round(sum(value*(least(z1,5.0)-greatest(z0,1.5)))/sum(least(z1,5.0)-greatest(z0,1.5)), 6) AS value FROM fx_layers WHERE z1 > 1.5 AND z0 < 5.0 GROUP BY cell")
def depth_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(T.integrate(fixture(spark, sf_dir, "fx_layers"), ["cell"], 1.5, 5.0, mean=True, bounds=("z0", "z1")), "value")


_REGION_ROWS = "SELECT r.label AS region, g.* FROM fx_masked_ref g JOIN fx_regions r ON r.label = 'globe' OR ((lat0+lat1)/2 > lat_min AND (lat0+lat1)/2 <= lat_max AND (lon0+lon1)/2 > lon_min AND (lon0+lon1)/2 <= lon_max)"


@query(f"""WITH g AS ({_REGION_ROWS}), c AS (SELECT region, sum({AREA}) AS a FROM (SELECT region, lat0, lat1, lon0, lon1 FROM g GROUP BY ALL HAVING count(value) > 0) q GROUP BY region)
SELECT g.region, t0, round(sum(value*{AREA})/any_value(c.a), 6) AS value FROM g JOIN c ON c.region = g.region GROUP BY g.region, t0""")
def space_mean_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.in_region(fixture(spark, sf_dir, "fx_masked_ref"), fixture(spark, sf_dir, "fx_regions"))
    return _rounded(S.space_mean(rows, ["region"]), "value").select("region", "t0", "value")


@query(f"""WITH c AS (SELECT sum({AREA}) AS a FROM (SELECT lat0, lat1, lon0, lon1 FROM fx_masked_ref GROUP BY ALL HAVING count(value) > 0) q)
SELECT t0, round(sum(value*{AREA})/(SELECT a FROM c), 6) AS value FROM fx_masked_ref GROUP BY t0""")
def space_mean_dense_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.space_mean(fixture(spark, sf_dir, "fx_masked_ref"), []), "value").select("t0", "value")


@query(f"SELECT t0, round(sum(abs(value)*{AREA})/1e12, 6) AS value FROM fx_masked_ref GROUP BY t0")
def space_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.space_mean(fixture(spark, sf_dir, "fx_masked_ref"), [], mean=False, absolute=True)
    return _rounded(out.withColumn("value", F.col("value") / 1e12), "value").select("t0", "value")


@query("SELECT t0, round(avg(value), 6) AS value FROM fx_site_daily GROUP BY t0")
def site_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.site_mean(fixture(spark, sf_dir, "fx_site_daily"), ["t0"]), "value")


@query("SELECT t0, round(sum(abs(value)*n)/sum(n), 6) AS value FROM fx_site_daily GROUP BY t0")
def site_mean_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.site_mean(fixture(spark, sf_dir, "fx_site_daily"), ["t0"], weight="n", absolute=True), "value")


def _cycle_sql(table: str, name: str) -> str:
    return f"""{name}_i AS (SELECT lat0, lon0, value, row_number() OVER (PARTITION BY lat0, lon0 ORDER BY t0) - 1 AS i, ((t0+t1)/2) % 365 AS d, count(*) OVER (PARTITION BY lat0, lon0) AS n FROM {table}),
{name}_f AS (SELECT lat0, lon0, i AS f FROM (SELECT lat0, lon0, i, row_number() OVER (PARTITION BY lat0, lon0 ORDER BY d, i) AS k FROM {name}_i WHERE i < 11) q WHERE k = 1),
{name} AS (SELECT a.lat0, a.lon0, CAST((i - f) % 12 AS INT) AS month, avg(value) AS value FROM {name}_i a JOIN {name}_f b ON b.lat0 = a.lat0 AND b.lon0 = a.lon0 WHERE i >= f AND i - f < floor((n - f) / 12) * 12 GROUP BY 1, 2, 3)"""


def _phase_sql(name: str) -> str:
    return f"{name}_p AS (SELECT lat0, lon0, month FROM (SELECT lat0, lon0, month, row_number() OVER (PARTITION BY lat0, lon0 ORDER BY value DESC, month) AS k FROM {name} WHERE value IS NOT NULL) q WHERE k = 1)"


@query(f"WITH {_cycle_sql('fx_masked_ref', 'cyc')} SELECT lat0, lon0, month, round(value, 6) AS value FROM cyc")
def annual_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(T.annual_cycle(fixture(spark, sf_dir, "fx_masked_ref"), CELL), "value").select("lat0", "lon0", "month", "value")


@query(f"WITH {_cycle_sql('fx_ref_grid', 'cyc')}, {_phase_sql('cyc')} SELECT lat0, lon0, month FROM cyc_p")
def phase_of_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.time_of_extremum(T.annual_cycle(fixture(spark, sf_dir, "fx_ref_grid"), CELL), CELL).select("lat0", "lon0", "month")


_SHIFT = "CASE WHEN d > 182.5 THEN d - 365 WHEN d < -182.5 THEN d + 365 ELSE d END"


@query(f"""WITH {_cycle_sql('fx_ref_grid', 'a')}, {_phase_sql('a')}, {_cycle_sql('fx_same_grid', 'b')}, {_phase_sql('b')}, s AS (SELECT a_p.lat0, a_p.lon0, CAST(b_p.month - a_p.month AS DOUBLE)*365/12 AS d FROM a_p JOIN b_p ON a_p.lat0 = b_p.lat0 AND a_p.lon0 = b_p.lon0)
SELECT lat0, lon0, round({_SHIFT}, 6) AS days, round((1+cos(abs({_SHIFT})*2*{PI}/365))/2, 6) AS score, round(1-least(abs({_SHIFT}),365-abs({_SHIFT}))/182.5, 6) AS day_score FROM s""")
def phase_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (T.time_of_extremum(T.annual_cycle(fixture(spark, sf_dir, f), CELL), CELL) for f in ("fx_ref_grid", "fx_same_grid"))
    both = a.withColumnRenamed("month", "m").join(b, CELL)
    out = both.withColumn("days", wrap_shift((F.col("month") - F.col("m")).cast("double") * 365.0 / 12.0))
    return _cells(out.withColumns({"score": cycle_score(F.col("days")), "day_score": day_shift_score(F.col("days"))}), "days", "score", "day_score")


@query("""WITH m AS (SELECT lat0, lon0, sum(value*(t1-t0))/sum(CASE WHEN value IS NOT NULL THEN t1-t0 END) AS m FROM fx_masked_ref GROUP BY lat0, lon0)
SELECT g.lat0, g.lon0, round(sqrt(sum((value-m)*(value-m)*(t1-t0))/sum(CASE WHEN value IS NOT NULL THEN t1-t0 END)), 6) AS value FROM fx_masked_ref g JOIN m ON m.lat0 = g.lat0 AND m.lon0 = g.lon0 GROUP BY g.lat0, g.lon0""")
def rms_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(T.root_mean_square(T.anomaly(fixture(spark, sf_dir, "fx_masked_ref"), CELL), CELL), "value")


@query("SELECT lat0, lon0, round(stddev_pop(value), 6) AS value FROM fx_masked_ref GROUP BY lat0, lon0")
def interannual_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(T.interannual_deviation(fixture(spark, sf_dir, "fx_masked_ref"), CELL), "value")


_MEANS = "SELECT lat0, lat1, lon0, lon1, sum(value*(t1-t0))/sum(t1-t0) AS value FROM {} GROUP BY ALL"
_COMPOSED = f"""a AS ({_MEANS.format('fx_ref_grid')}), b AS ({_MEANS.format('fx_com_grid')}),
o AS (SELECT greatest(a.lat0,b.lat0) AS lat0, least(a.lat1,b.lat1) AS lat1, greatest(a.lon0,b.lon0) AS lon0, least(a.lon1,b.lon1) AS lon1, a.value AS ref, b.value AS com FROM a JOIN b ON a.lat0<b.lat1 AND b.lat0<a.lat1 AND a.lon0<b.lon1 AND b.lon0<a.lon1)"""


@query(f"WITH {_COMPOSED} SELECT CAST(count(*) AS BIGINT) AS n_cells, round(sum((com-ref)*{AREA})/sum({AREA}), 6) AS bias, round(sum({AREA})/1e12, 3) AS area FROM o")
def global_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mean_state.global_bias(fixture(spark, sf_dir, "fx_ref_grid"), fixture(spark, sf_dir, "fx_com_grid"))
    return out.select("n_cells", F.round("bias", 6).alias("bias"), F.round(F.col("area") / 1e12, 3).alias("area"))


@query(f"WITH {_COMPOSED} SELECT lat0, lon0, round(com-ref, 6) AS value FROM o")
def bias_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(mean_state.period_bias(fixture(spark, sf_dir, "fx_ref_grid"), fixture(spark, sf_dir, "fx_com_grid")), "value")


_BY_CELL = f"""a AS ({_MEANS.format('fx_ref_grid')}), b AS ({_MEANS.format('fx_same_grid')}),
s AS (SELECT g.lat0, g.lon0, sqrt(sum((g.value-a.value)*(g.value-a.value)*(t1-t0))/sum(t1-t0)) AS s FROM fx_ref_grid g JOIN a ON a.lat0 = g.lat0 AND a.lon0 = g.lon0 GROUP BY g.lat0, g.lon0),
e AS (SELECT r.lat0, r.lon0, sqrt(sum((c.value-r.value)*(c.value-r.value)*(r.t1-r.t0))/sum(r.t1-r.t0)) AS rmse, sqrt(sum(((c.value-b.value)-(r.value-a.value))*((c.value-b.value)-(r.value-a.value))*(r.t1-r.t0))/sum(r.t1-r.t0)) AS crmse
 FROM fx_ref_grid r JOIN fx_same_grid c ON c.t0 = r.t0 AND c.lat0 = r.lat0 AND c.lon0 = r.lon0 JOIN a ON a.lat0 = r.lat0 AND a.lon0 = r.lon0 JOIN b ON b.lat0 = r.lat0 AND b.lon0 = r.lon0 GROUP BY r.lat0, r.lon0)"""


@query(f"WITH {_BY_CELL} SELECT a.lat0, a.lon0, round(exp(-abs((b.value-a.value)/s)), 6) AS score FROM a JOIN b ON a.lat0 = b.lat0 AND a.lon0 = b.lon0 JOIN s ON s.lat0 = a.lat0 AND s.lon0 = a.lon0")
def bias_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, com = fixture(spark, sf_dir, "fx_ref_grid"), fixture(spark, sf_dir, "fx_same_grid")
    spread = T.root_mean_square(T.anomaly(ref, CELL), CELL).withColumnRenamed("value", "s")
    out = C.bias(T.integrate(ref, CELL, mean=True), T.integrate(com, CELL, mean=True), CELL).join(spread, CELL)
    return _cells(out.withColumn("score", exp_score(F.col("value"), F.col("s"))), "score")


@query(f"WITH {_BY_CELL} SELECT lat0, lon0, round(rmse, 6) AS value FROM e")
def rmse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(C.rmse(fixture(spark, sf_dir, "fx_ref_grid"), fixture(spark, sf_dir, "fx_same_grid"), CELL), "value")


@query(f"""WITH {_BY_CELL}, c AS (SELECT a.lat0, a.lat1, a.lon0, a.lon1, abs(a.value) AS m, b.value-a.value AS bias, exp(-abs((b.value-a.value)/s)) AS bs, rmse, exp(-abs(crmse/s)) AS rs FROM a JOIN b ON a.lat0 = b.lat0 AND a.lon0 = b.lon0 JOIN s ON s.lat0 = a.lat0 AND s.lon0 = a.lon0 JOIN e ON e.lat0 = a.lat0 AND e.lon0 = a.lon0)
SELECT r.label AS region, round(sum(bias*{AREA})/sum({AREA}), 6) AS bias, round(sum(bs*m*{AREA})/sum(m*{AREA}), 6) AS bias_score, round(sum(rmse*{AREA})/sum({AREA}), 6) AS rmse, round(sum(rs*m*{AREA})/sum(m*{AREA}), 6) AS rmse_score
FROM c JOIN fx_regions r ON r.label = 'globe' OR ((lat0+lat1)/2 > lat_min AND (lat0+lat1)/2 <= lat_max AND (lon0+lon1)/2 > lon_min AND (lon0+lon1)/2 <= lon_max) GROUP BY r.label""")
def regional_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mean_state.regional_scores(fixture(spark, sf_dir, "fx_ref_grid"), fixture(spark, sf_dir, "fx_same_grid"), fixture(spark, sf_dir, "fx_regions"))
    return _rounded(out, "bias", "bias_score", "rmse", "rmse_score")


_R = "(count(*)*sum(x*y)-sum(x)*sum(y))/(sqrt(count(*)*sum(x*x)-sum(x)*sum(x))*sqrt(count(*)*sum(y*y)-sum(y)*sum(y)))"
_BOTH = "CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN {0} END"


@query(f"WITH p AS (SELECT r.lat0, r.lon0, {_BOTH.format('r.value', 'c.value')} AS x, {_BOTH.format('c.value', 'r.value')} AS y FROM fx_masked_ref r JOIN fx_same_grid c ON c.t0 = r.t0 AND c.lat0 = r.lat0 AND c.lon0 = r.lon0) SELECT lat0, lon0, round({_R}, 6) AS r FROM p GROUP BY lat0, lon0 HAVING count(x) > 0")
def masked_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = C.paired(fixture(spark, sf_dir, "fx_masked_ref"), fixture(spark, sf_dir, "fx_same_grid"), ["t0", *CELL])
    return _cells(pairs.groupBy(*CELL).agg(C.correlation().alias("r")).filter("r is not null"), "r")


@query(f"""WITH {_COMPOSED}, q AS (SELECT ref AS x, com AS y FROM o), r AS (SELECT {_R} AS r FROM q), s AS (SELECT (SELECT stddev_pop(value) FROM b)/(SELECT stddev_pop(value) FROM a) AS s)
SELECT round(r, 6) AS r, round(s, 6) AS sigma, round(4*(1+r)/((s+1/s)*(s+1/s)*2), 6) AS score FROM r CROSS JOIN s""")
def spatial_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, com = (T.integrate(fixture(spark, sf_dir, f), CELL, mean=True) for f in ("fx_ref_grid", "fx_com_grid"))
    a, b = S.compose(ref, com)
    return _rounded(C.taylor(ref, com, C.paired(a, b, CELL), []), "r", "sigma", "score").select("r", "sigma", "score")


@query("""WITH c AS (SELECT lat0, lon0, t1 AS t, CASE WHEN sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER w = 0 THEN sum(value*(t1-t0)) OVER w END AS value FROM fx_masked_ref WINDOW w AS (PARTITION BY lat0, lon0 ORDER BY t0 ROWS UNBOUNDED PRECEDING))
SELECT lat0, lon0, t, round(value, 6) AS value FROM c UNION ALL SELECT lat0, lon0, min(t0), 0.0 FROM fx_masked_ref GROUP BY lat0, lon0""")
def cumulative_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(T.accumulate(fixture(spark, sf_dir, "fx_masked_ref"), CELL), "value").select("lat0", "lon0", "t", "value")


def _coarse_sql(window: int) -> str:
    return f"""WITH y AS (SELECT DISTINCT CAST((yr-1850)*365 AS DOUBLE) AS b0, CAST((yr-1849)*365 AS DOUBLE) AS b1 FROM fx_masked_ref),
p AS (SELECT lat0, lon0, b0, value, least(t1,b1+{window})-greatest(t0,b0-{window}) AS w FROM fx_masked_ref g JOIN y ON t0 < b1+{window} AND t1 > b0-{window})
SELECT lat0, lon0, b0, round(sum(value*w)/sum(CASE WHEN value IS NOT NULL THEN w END), 6) AS value FROM p GROUP BY lat0, lon0, b0"""


def _coarse(spark: SparkSession, sf_dir: str, window: float) -> DataFrame:
    df = fixture(spark, sf_dir, "fx_masked_ref")
    years = df.select(((F.col("yr") - 1850) * 365).cast("double").alias("b0"), ((F.col("yr") - 1849) * 365).cast("double").alias("b1")).distinct()
    return _rounded(T.coarsen(df, years, CELL, window), "value").select("lat0", "lon0", "b0", "value")


@query(_coarse_sql(0))
def coarsen_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coarse(spark, sf_dir, 0.0)


@query(_coarse_sql(45))
def coarsen_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coarse(spark, sf_dir, 45.0)


@query("""WITH y AS (SELECT DISTINCT CAST((yr-1850)*365 AS DOUBLE) AS b0, CAST((yr-1849)*365 AS DOUBLE) AS b1 FROM fx_masked_ref)
SELECT lat0, lon0, b0, round(max(value), 6) AS value FROM fx_masked_ref g JOIN y ON t0 <= b1 AND t1 >= b0 GROUP BY lat0, lon0, b0""")
def reduce_over_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "fx_masked_ref")
    years = df.select(((F.col("yr") - 1850) * 365).cast("double").alias("b0"), ((F.col("yr") - 1849) * 365).cast("double").alias("b1")).distinct()
    return _rounded(T.reduce_intervals(df, years, CELL, F.max("value")), "value").select("lat0", "lon0", "b0", "value")


@query(f"""WITH m AS ({_MEANS.format('fx_ref_grid')}), la AS (SELECT site, lat0 FROM (SELECT site, lat0, row_number() OVER (PARTITION BY site ORDER BY abs((lat0+lat1)/2-lat), lat0) AS k FROM fx_sites CROSS JOIN (SELECT DISTINCT lat0, lat1 FROM m) x) q WHERE k = 1),
lo AS (SELECT site, lon0 FROM (SELECT site, lon0, row_number() OVER (PARTITION BY site ORDER BY abs((lon0+lon1)/2-lon), lon0) AS k FROM fx_sites CROSS JOIN (SELECT DISTINCT lon0, lon1 FROM m) x) q WHERE k = 1)
SELECT la.site, round(m.value, 6) AS value FROM la JOIN lo ON lo.site = la.site JOIN m ON m.lat0 = la.lat0 AND m.lon0 = lo.lon0""")
def nearest_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = T.integrate(fixture(spark, sf_dir, "fx_ref_grid"), CELL, mean=True)
    return _rounded(S.at_sites(grid, fixture(spark, sf_dir, "fx_sites")), "value").select("site", "value")


_HALVES = "a AS (SELECT * FROM fx_masked_ref WHERE lat0 < 30), b AS (SELECT * FROM fx_masked_ref WHERE lat0 > -60)"


@query(f"""WITH {_HALVES}, x AS (SELECT lat0, lon0 FROM a GROUP BY ALL HAVING count(value) > 0), y AS (SELECT lat0, lon0 FROM b GROUP BY ALL HAVING count(value) > 0)
SELECT coalesce(x.lat0, y.lat0) AS lat0, coalesce(x.lon0, y.lon0) AS lon0, CASE WHEN x.lat0 IS NULL THEN 'other' WHEN y.lat0 IS NULL THEN 'reference' ELSE 'both' END AS "where" FROM x FULL JOIN y ON x.lat0 = y.lat0 AND x.lon0 = y.lon0""")
def land_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "fx_masked_ref")
    return C.presence(df.filter("lat0 < 30"), df.filter("lat0 > -60"), ["lat0", "lon0"])


@query(f"WITH {_HALVES}, m AS (SELECT max(value) AS m FROM a) SELECT coalesce(a.lat0, b.lat0) AS lat0, coalesce(a.lon0, b.lon0) AS lon0, coalesce(a.t0, b.t0) AS t0, round(coalesce(CASE WHEN a.value >= 1e-12*(SELECT m FROM m) THEN a.value END, b.value), 6) AS value FROM a FULL JOIN b ON a.lat0 = b.lat0 AND a.lon0 = b.lon0 AND a.t0 = b.t0")
def overlay_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "fx_masked_ref")
    return _rounded(C.overlaid(df.filter("lat0 < 30"), df.filter("lat0 > -60"), ["lat0", "lon0", "t0"]), "value")


@query("SELECT yr, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total FROM fx_ref_grid GROUP BY yr")
def combine_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "fx_ref_grid")
    whole = T.concatenate([df.filter("yr < 1998"), df.filter("yr >= 1998")], CELL)
    return _rounded(whole.groupBy("yr").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total")


@query("WITH e AS (SELECT lat0 AS e FROM fx_ref_grid UNION SELECT lat1 FROM fx_ref_grid UNION SELECT lat0 FROM fx_com_grid UNION SELECT lat1 FROM fx_com_grid) SELECT lo, hi FROM (SELECT e AS lo, lead(e) OVER (ORDER BY e) AS hi FROM e) q WHERE hi IS NOT NULL")
def union_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cell_edges([fixture(spark, sf_dir, f) for f in ("fx_ref_grid", "fx_com_grid")], "lat0", "lat1")


@query("SELECT l_orderkey, l_linenumber, (l_extendedprice*(1.0::DOUBLE-l_discount)-l_tax*100.0::DOUBLE)/l_quantity AS value FROM lineitem WHERE l_quantity <> 0")
def derived_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    columns = {"price": F.col("l_extendedprice"), "discount": F.col("l_discount"), "tax": F.col("l_tax"), "quantity": F.col("l_quantity")}
    value, _ = compile_expression("(price*(1-discount)-tax*100)/quantity", columns)
    return df.filter("l_quantity <> 0").select("l_orderkey", "l_linenumber", value.alias("value"))


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN l_quantity >= 10 THEN 1 END) AS BIGINT) AS kept, round(sum(CASE WHEN l_quantity >= 10 THEN l_tax/l_quantity END), 6) AS ratio FROM lineitem GROUP BY l_returnflag")
def threshold_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("v", gated_ratio(F.col("l_tax"), F.col("l_quantity"), 10.0))
    return _rounded(df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("kept"), F.sum("v").alias("ratio")), "ratio")


_ERRORS = "x AS (SELECT r.label AS region, c.value-g.value AS value FROM fx_ref_grid g JOIN fx_same_grid c ON c.t0 = g.t0 AND c.lat0 = g.lat0 AND c.lon0 = g.lon0 JOIN fx_regions r ON r.label = 'globe' OR ((g.lat0+g.lat1)/2 > lat_min AND (g.lat0+g.lat1)/2 <= lat_max AND (g.lon0+g.lon1)/2 > lon_min AND (g.lon0+g.lon1)/2 <= lon_max))"


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = C.bias(fixture(spark, sf_dir, "fx_ref_grid"), fixture(spark, sf_dir, "fx_same_grid"), ["t0", *CELL])
    return S.in_region(errors, fixture(spark, sf_dir, "fx_regions"))


@query(f"WITH {_ERRORS}, q AS (SELECT unnest([50,60,70,80,90,95,98]) AS quantile) SELECT region, quantile, round(quantile_cont(abs(value), quantile/100), 6) AS value FROM x CROSS JOIN q GROUP BY region, quantile".replace("quantile_cont(abs(value), quantile/100)", "CASE quantile WHEN 50 THEN quantile_cont(abs(value), 0.5) WHEN 60 THEN quantile_cont(abs(value), 0.6) WHEN 70 THEN quantile_cont(abs(value), 0.7) WHEN 80 THEN quantile_cont(abs(value), 0.8) WHEN 90 THEN quantile_cont(abs(value), 0.9) WHEN 95 THEN quantile_cont(abs(value), 0.95) ELSE quantile_cont(abs(value), 0.98) END"))
def error_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.quantile_errors(_errors(spark, sf_dir), ["region"], [50, 60, 70, 80, 90, 95, 98]), "value")


@query(f"WITH {_ERRORS}, q AS (SELECT region, quantile_cont(abs(value), 0.7) AS q FROM x GROUP BY region) SELECT x.region, round(avg(least(greatest(1-abs(value)/q, 0), 1)), 6) AS score FROM x JOIN q ON q.region = x.region GROUP BY x.region")
def quantile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = _errors(spark, sf_dir)
    table = C.quantile_errors(errors, ["region"], [70]).select("region", F.col("value").alias("q"))
    out = errors.join(table, "region").groupBy("region").agg(F.avg(quantile_score(F.col("value"), F.col("q"))).alias("score"))
    return _rounded(out, "score")


_LIM = "l AS (SELECT min(ind) - 1e-8*(max(ind)-min(ind)) AS a, max(ind) + 1e-8*(max(ind)-min(ind)) AS b, min(dep) - 1e-8*(max(dep)-min(dep)) AS c, max(dep) + 1e-8*(max(dep)-min(dep)) AS d FROM fx_relationship)"


def _bin(column: str, a: str, b: str, n: int = 25) -> str:
    return f"CAST(least(greatest(floor(({column}-{a})/(({b}-{a})/{n}))+1, 1), {n}) AS INT)"


@query(f"WITH {_LIM} SELECT {_bin('ind', 'a', 'b')} AS bin_x, {_bin('dep', 'c', 'd')} AS bin_y, CAST(count(*) AS BIGINT) AS n, round(count(*)/(SELECT CAST(count(*) AS DOUBLE) FROM fx_relationship), 6) AS share FROM fx_relationship CROSS JOIN l GROUP BY 1, 2")
def relationship_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "fx_relationship")
    return _rounded(C.histogram2d(df, "ind", "dep", C.limits(df, "ind"), C.limits(df, "dep")), "share")


@query(f"WITH {_LIM} SELECT {_bin('ind', 'a', 'b')} AS bin_x, round(avg(dep), 6) AS mean, round(stddev_pop(dep), 6) AS std, CAST(count(*) AS BIGINT) AS n FROM fx_relationship CROSS JOIN l GROUP BY 1 HAVING count(*)/(SELECT CAST(count(*) AS DOUBLE) FROM fx_relationship) >= 3e-3")
def relationship_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "fx_relationship")
    return _rounded(C.response(df, "ind", "dep", C.limits(df, "ind")), "mean", "std")


@query(f"""WITH {_LIM}, h AS (SELECT cell % 2 AS k, {_bin('ind', 'a', 'b')} AS bin_x, {_bin('dep', 'c', 'd')} AS bin_y, count(*) AS n FROM fx_relationship CROSS JOIN l GROUP BY 1, 2, 3), s AS (SELECT k, sum(n) AS s FROM h GROUP BY k), p AS (SELECT h.k, bin_x, bin_y, n/CAST(s AS DOUBLE) AS p FROM h JOIN s ON s.k = h.k)
SELECT round(1-sqrt(sum((sqrt(x.p)-sqrt(y.p))*(sqrt(x.p)-sqrt(y.p))))/sqrt(2), 6) AS score FROM p x JOIN p y ON x.bin_x = y.bin_x AND x.bin_y = y.bin_y WHERE x.k = 0 AND y.k = 1""")
def relationship_hellinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "fx_relationship")
    at = (C.limits(df, "ind"), C.limits(df, "dep"))
    a, b = (C.histogram2d(df.filter(F.col("cell") % 2 == k), "ind", "dep", *at) for k in (0, 1))
    return _rounded(C.hellinger_score(a, b), "score")


@query(f"""WITH {_LIM}, h AS (SELECT cell % 2 AS k, {_bin('ind', 'a', 'b')} AS bin_x, avg(dep) AS m FROM fx_relationship CROSS JOIN l GROUP BY 1, 2)
SELECT round(exp(-sqrt(sum((x.m-y.m)*(x.m-y.m)))/sqrt(sum(x.m*x.m))), 6) AS score FROM h x JOIN h y ON x.bin_x = y.bin_x WHERE x.k = 0 AND y.k = 1""")
def relationship_rmse_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "fx_relationship")
    a, b = (C.response(df.filter(F.col("cell") % 2 == k), "ind", "dep", C.limits(df, "ind"), least_share=0.0) for k in (0, 1))
    return _rounded(C.response_score(a, b), "score")


_POWERS = ", ".join([f"sum(x**{k}) AS s{k}" for k in range(5)] + [f"sum(y*x**{k}) AS p{k}" for k in range(3)])
_DET = "({0}*({4}*{8}-{5}*{7})-{1}*({3}*{8}-{5}*{6})+{2}*({3}*{7}-{4}*{6}))"
_MOMENTS = [["s0", "s1", "s2"], ["s1", "s2", "s3"], ["s2", "s3", "s4"]]


def _fit_sql(k: int) -> str:
    swapped = [[f"p{i}" if j == k else _MOMENTS[i][j] for j in range(3)] for i in range(3)]
    flat = lambda m: [x for row in m for x in row]
    return f"{_DET.format(*flat(swapped))}/{_DET.format(*flat(_MOMENTS))} AS c{k}"


@query("""WITH a AS (SELECT lat0, lon0, t0, value, (t0+t1)/2 AS t FROM fx_masked_ref), m AS (SELECT lat0, lon0, avg(t) AS m, stddev_pop(t) AS d FROM a GROUP BY lat0, lon0), x AS (SELECT a.lat0, a.lon0, t0, value AS y, (t-m)/d AS x FROM a JOIN m ON m.lat0 = a.lat0 AND m.lon0 = a.lon0),
s AS (SELECT lat0, lon0, """ + _POWERS + """ FROM x WHERE y IS NOT NULL GROUP BY lat0, lon0), c AS (SELECT lat0, lon0, """ + ", ".join(map(_fit_sql, range(3))) + """ FROM s)
SELECT x.lat0, x.lon0, t0, round(y-(c0+c1*x+c2*x*x), 6) AS value FROM x LEFT JOIN c ON c.lat0 = x.lat0 AND c.lon0 = x.lon0""")
def quadratic_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(T.detrend(fixture(spark, sf_dir, "fx_masked_ref"), CELL), "value").select("lat0", "lon0", "t0", "value")


@query("""WITH u AS (SELECT 'a' AS model, t0, lat0, lon0, value FROM fx_masked_ref UNION ALL SELECT 'b', t0, lat0, lon0, value FROM fx_same_grid)
SELECT t0, lat0, lon0, round(CASE WHEN count(value) > 0 THEN sum(coalesce(value, 0)*CASE model WHEN 'a' THEN 2.0 ELSE 1.0 END)/3.0 END, 6) AS value FROM u GROUP BY t0, lat0, lon0""")
def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [fixture(spark, sf_dir, f).select(F.lit(m).alias("model"), "t0", "lat0", "lon0", "value") for m, f in (("a", "fx_masked_ref"), ("b", "fx_same_grid"))]
    return _rounded(C.ensemble_mean(both[0].unionByName(both[1]), ["t0", "lat0", "lon0"], {"a": 2.0, "b": 1.0}), "value")


_TREE = "SELECT *, CAST(1+length(variable) % 4 AS DOUBLE) AS variable_weight, CAST(1+length(section) % 3 AS DOUBLE) AS section_weight FROM fx_tree"
_ROLLED = f"""t AS ({_TREE}), v AS (SELECT section, section_weight, variable, variable_weight, sum(weight*score)/sum(weight) AS score FROM t GROUP BY ALL),
s AS (SELECT section, section_weight, sum(variable_weight*score)/sum(variable_weight) AS score FROM v GROUP BY ALL)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = lambda c, n: (1 + F.length(c) % n).cast("double")
    return fixture(spark, sf_dir, "fx_tree").withColumns({"variable_weight": weight("variable", 4), "section_weight": weight("section", 3)})


@query(f"""WITH {_ROLLED} SELECT 'source' AS level, section, variable, source, round(score, 6) AS score FROM t UNION ALL SELECT 'variable', section, variable, NULL, round(score, 6) FROM v
UNION ALL SELECT 'section', section, NULL, NULL, round(score, 6) FROM s UNION ALL SELECT 'whole', NULL, NULL, NULL, round(sum(section_weight*score)/sum(section_weight), 6) FROM s""")
def score_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoreboard.roll_up(_tree(spark, sf_dir)), "score")


@query(f"""WITH {_ROLLED}, x AS (SELECT section, to_json(list(struct_pack(variable := variable, score := round(score, 6)) ORDER BY variable)) AS j FROM v GROUP BY section)
SELECT s.section, '{{"section":"' || s.section || '","score":' || CAST(round(s.score, 6) AS VARCHAR) || ',"variables":' || CAST(x.j AS VARCHAR) || '}}' AS json FROM s JOIN x ON x.section = s.section""")
def score_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoreboard.as_json(scoreboard.roll_up(_tree(spark, sf_dir)))


_MODELS = "SELECT section, variable, source, unnest(['a', 'b', 'c']) AS model, score*(1+unnest([0, 0.01, -0.2])) AS score FROM fx_tree"


@query(f"WITH m AS ({_MODELS}) SELECT section, variable, source, model, round((score - avg(score) OVER w)/CASE WHEN stddev_pop(score) OVER w <= 1e-12 THEN 1 ELSE greatest(stddev_pop(score) OVER w, 0.02) END, 6) AS z FROM m WINDOW w AS (PARTITION BY section, variable, source)")
def score_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(x).alias("x")) for m, x in (("a", 0.0), ("b", 0.01), ("c", -0.2)))))
    rows = fixture(spark, sf_dir, "fx_tree").withColumn("_m", models).select("section", "variable", "source", "_m.model", (F.col("score") * (1 + F.col("_m.x"))).alias("score"))
    out = rows.withColumn("z", scoreboard.z_score(F.col("score"), ["section", "variable", "source"]))
    return _rounded(out, "z").select("section", "variable", "source", "model", "z")


_METRICS = "CASE CAST(substr(source, length(source)) AS INT) % 3 WHEN 0 THEN 'Bias Score' WHEN 1 THEN 'RMSE Score' ELSE 'Own Score' END"


@query(f"SELECT section, variable, round(sum(score*CASE {_METRICS} WHEN 'RMSE Score' THEN 2 ELSE 1 END)/sum(CASE {_METRICS} WHEN 'RMSE Score' THEN 2 ELSE 1 END), 6) AS score FROM fx_tree GROUP BY section, variable")
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "fx_tree").withColumns({"metric": F.expr(_METRICS), "data": F.col("score")})
    return _rounded(scoreboard.overall_score(rows, ["section", "variable"]), "score")


@query("""WITH p AS (SELECT site, value AS ref, lag(value) OVER (PARTITION BY site ORDER BY d) AS com FROM fx_site_daily), q AS (SELECT * FROM p WHERE com IS NOT NULL), s AS (SELECT site, sum((com-ref)*(com-ref)) AS e, var_pop(ref)*count(*) AS v, corr(ref, com) AS r, stddev_pop(com)/nullif(stddev_pop(ref), 0) AS s, avg(com)/avg(ref) AS m FROM q GROUP BY site HAVING count(*) > 3)
SELECT site, round(least(greatest(1-e/v, 0), 1), 6) AS nse, round(least(greatest(1-sqrt((r-1)*(r-1)+(s-1)*(s-1)+(m-1)*(m-1)), 0), 1), 6) AS kge FROM s""")
def nash_kling(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = fixture(spark, sf_dir, "fx_site_daily")
    pairs = daily.select("site", F.col("value").alias("ref"), F.lag("value").over(Window.partitionBy("site").orderBy("d")).alias("com")).filter("com is not null")
    enough = pairs.groupBy("site").count().filter("count > 3").select("site")
    return _rounded(C.efficiency(pairs.join(enough, "site", "left_semi"), ["site"]), "nse", "kge")


@query("SELECT user_id AS site, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(max(value)-min(value), 6) AS amplitude FROM events GROUP BY 1, 2")
def daily_amplitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _rounded(df.groupBy(F.col("user_id").alias("site"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg((F.max("value") - F.min("value")).alias("amplitude")), "amplitude")


@query("""WITH s AS (SELECT CAST(event_type AS VARCHAR) AS kind, CAST(floor(hour(ts)/6) AS INT) AS slot, CAST(ts AS DATE) AS day, avg(value) AS value FROM events GROUP BY 1, 2, 3), w AS (SELECT *, count(value) OVER (PARTITION BY kind, day) AS n FROM s)
SELECT kind, slot, round(avg(value), 6) AS value, round(quantile_cont(value, 0.1), 6) AS low, round(quantile_cont(value, 0.9), 6) AS high FROM w WHERE n = 4 GROUP BY kind, slot""")
def diurnal_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + F.hour("ts") / 24.0 + 1e-6
    return _rounded(T.daily_cycle(df.select(F.col("event_type").alias("kind"), t.alias("t"), "value"), ["kind"], 4), "value", "low", "high")


@query("""WITH y AS (SELECT lat0, lon0, yr, max(value) AS m FROM fx_ref_grid GROUP BY 1, 2, 3), p AS (SELECT lat0, lon0, m < 40 AND lag(m) OVER w < 40 AND lag(yr) OVER w = yr-1 AS f FROM y WINDOW w AS (PARTITION BY lat0, lon0 ORDER BY yr)) SELECT lat0, lon0, coalesce(bool_or(f), false) AS frozen FROM p GROUP BY lat0, lon0""")
def consecutive_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = fixture(spark, sf_dir, "fx_ref_grid").groupBy("lat0", "lon0", F.col("yr").alias("year")).agg(F.max("value").alias("value"))
    return T.consecutive_years_below(yearly, ["lat0", "lon0"], 40.0)


@query("""WITH i AS (SELECT lat0, lon0, t0, value, row_number() OVER (PARTITION BY lat0, lon0 ORDER BY t0) AS i FROM fx_masked_ref), g AS (SELECT lat0, lon0, i - row_number() OVER (PARTITION BY lat0, lon0 ORDER BY t0) AS g FROM i WHERE value IS NOT NULL), n AS (SELECT lat0, lon0, g, count(*) AS n FROM g GROUP BY 1, 2, 3)
SELECT lat0, lon0, CAST(max(n) AS BIGINT) AS n FROM n GROUP BY lat0, lon0""")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.longest_run(fixture(spark, sf_dir, "fx_masked_ref"), ["lat0", "lon0"])


@query("""WITH p AS (SELECT site, d AS t, lag(d) OVER w AS a, lead(d) OVER w AS b FROM fx_site_daily WINDOW w AS (PARTITION BY site ORDER BY d)), q AS (SELECT site, t, (a+t)/2.0 AS lo, (t+b)/2.0 AS hi FROM p)
SELECT site, CAST(t AS INT) AS t, CAST(coalesce(lo, t-(hi-t), t) AS DOUBLE) AS t0, CAST(coalesce(hi, t+(t-lo), t) AS DOUBLE) AS t1 FROM q""")
def midpoint_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.midpoint_bounds(fixture(spark, sf_dir, "fx_site_daily").select("site", F.col("d").cast("int").alias("t")), ["site"]).select("site", "t", F.col("t0").cast("double").alias("t0"), F.col("t1").cast("double").alias("t1"))


@query("SELECT lat0, lon0, t0, round(value - min(value) OVER (PARTITION BY lat0, lon0), 6) AS value FROM fx_ref_grid")
def minimum_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(T.minimum_removed(fixture(spark, sf_dir, "fx_ref_grid"), CELL), "value").select("lat0", "lon0", "t0", "value")


@query(f"SELECT site, round(atan2(avg(sin(2*{PI}*d/365)), avg(cos(2*{PI}*d/365)))*365/(2*{PI}), 4) AS day FROM fx_site_daily GROUP BY site")
def circular_mean_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = F.col("d") * (2 * 3.141592653589793) / 365
    out = fixture(spark, sf_dir, "fx_site_daily").groupBy("site").agg((F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))) * 365 / (2 * 3.141592653589793)).alias("day"))
    return out.withColumn("day", F.round("day", 4))


@query()
def smooth_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.smooth_sites(fixture(spark, sf_dir, "fx_site_daily").select(F.col("site").cast("long").alias("site"), F.col("d").cast("double").alias("t"), "value"))


@query()
def site_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.site_seasons(fixture(spark, sf_dir, "fx_site_daily").select(F.col("site").cast("long").alias("site"), F.col("d").cast("double").alias("t"), "value"))


@query("""WITH m AS (SELECT r.lat0, r.lon0, sum(c.value*(r.t1-r.t0)) AS a, sum(r.value*(r.t1-r.t0)) AS b FROM fx_masked_ref r JOIN fx_same_grid c ON c.t0 = r.t0 AND c.lat0 = r.lat0 AND c.lon0 = r.lon0 WHERE r.value >= 20 AND c.value IS NOT NULL GROUP BY r.lat0, r.lon0)
SELECT g.lat0, g.lon0, round(m.a/m.b, 6) AS value FROM (SELECT DISTINCT r.lat0, r.lon0 FROM fx_masked_ref r JOIN fx_same_grid c ON c.t0 = r.t0 AND c.lat0 = r.lat0 AND c.lon0 = r.lon0) g LEFT JOIN m ON m.lat0 = g.lat0 AND m.lon0 = g.lon0""")
def ratio_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(analyses.ratio_of_means(fixture(spark, sf_dir, "fx_same_grid"), fixture(spark, sf_dir, "fx_masked_ref"), CELL, 20.0), "value")


@query("SELECT r.lat0, r.lon0, r.t0, round(CASE WHEN r.value >= 25 THEN c.value/r.value END, 6) AS value FROM fx_masked_ref r JOIN fx_same_grid c ON c.t0 = r.t0 AND c.lat0 = r.lat0 AND c.lon0 = r.lon0")
def gated_ratio_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analyses.albedo(fixture(spark, sf_dir, "fx_same_grid"), fixture(spark, sf_dir, "fx_masked_ref"), ["t0", "lat0", "lon0"], 25.0)
    return _rounded(out, "value")


@query("SELECT r.lat0, r.lon0, r.t0, round(CASE WHEN r.value >= 0 AND c.value >= 0 AND r.value + c.value >= 20 THEN r.value/(r.value+c.value) END, 6) AS value FROM fx_masked_ref r JOIN fx_same_grid c ON c.t0 = r.t0 AND c.lat0 = r.lat0 AND c.lon0 = r.lon0")
def evaporative_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analyses.evaporative_fraction(fixture(spark, sf_dir, "fx_masked_ref"), fixture(spark, sf_dir, "fx_same_grid"), ["t0", "lat0", "lon0"]), "value")


_BASINS = "SELECT DISTINCT lat0, lon0, CAST((lat0+90)/60 AS INT)*10 + CAST(floor((lon0+180)/120) AS INT) AS basin FROM fx_ref_grid"


def _basins(df: DataFrame) -> DataFrame:
    return df.select("lat0", "lon0", (((F.col("lat0") + 90) / 60).cast("int") * 10 + F.floor((F.col("lon0") + 180) / 120).cast("int")).alias("basin")).distinct()


def _basin_sql(table: str, name: str) -> str:
    return f"{name} AS (SELECT basin, t0, t1, sum(value*{AREA})/sum(CASE WHEN value IS NOT NULL THEN {AREA} END) AS value FROM {table} g JOIN b ON b.lat0 = g.lat0 AND b.lon0 = g.lon0 GROUP BY 1, 2, 3)".replace("lat1", "g.lat1").replace("lon1", "g.lon1").replace("radians(lat0)", "radians(g.lat0)").replace("-lon0)", "-g.lon0)")


_BASIN_SQL = f"b AS ({_BASINS.replace('CAST((lat0+90)/60 AS INT)', 'CAST(floor((lat0+90)/60) AS INT)')}), x AS (SELECT * FROM fx_masked_ref), {_basin_sql('fx_masked_ref', 'p')}, {_basin_sql('fx_same_grid', 'q')}"


@query(f"""WITH {_BASIN_SQL}, pm AS (SELECT basin, sum(value*(t1-t0))/sum(CASE WHEN value IS NOT NULL THEN t1-t0 END) AS m FROM p GROUP BY basin), qm AS (SELECT basin, sum(value*(t1-t0))/sum(CASE WHEN value IS NOT NULL THEN t1-t0 END) AS m FROM q GROUP BY basin),
j AS (SELECT p.basin, p.t1-p.t0 AS w, p.value-pm.m AS a, q.value-qm.m AS c FROM p JOIN q ON q.basin = p.basin AND q.t0 = p.t0 JOIN pm ON pm.basin = p.basin JOIN qm ON qm.basin = p.basin),
s AS (SELECT basin, sqrt(sum(a*a*w)/sum(CASE WHEN a IS NOT NULL THEN w END)) AS magnitude, sqrt(sum((c-a)*(c-a)*w)/sum(CASE WHEN c-a IS NOT NULL THEN w END)) AS rmse FROM j GROUP BY basin)
SELECT basin, round(magnitude, 6) AS magnitude, round(rmse, 6) AS rmse, round(exp(-rmse/magnitude), 6) AS score FROM s""")
def water_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, com = fixture(spark, sf_dir, "fx_masked_ref"), fixture(spark, sf_dir, "fx_same_grid")
    basins = _basins(fixture(spark, sf_dir, "fx_ref_grid"))
    return _rounded(analyses.water_storage(analyses.basin_means(ref, basins), analyses.basin_means(com, basins)), "magnitude", "rmse", "score")


@query(f"""WITH {_BASIN_SQL}, sp AS (SELECT basin, avg(value) AS m, stddev_pop(value) AS s FROM p GROUP BY basin), sq AS (SELECT basin, avg(value) AS m, stddev_pop(value) AS s FROM q GROUP BY basin)
SELECT sp.basin, round(sp.m, 6) AS ref_mean, round(sq.m, 6) AS com_mean, round(sq.m-sp.m, 6) AS bias, round(exp(-abs((sq.m-sp.m)/sp.m)), 6) AS bias_score, round(exp(-abs((sq.s-sp.s)/sp.s)), 6) AS iav_score FROM sp JOIN sq ON sq.basin = sp.basin""")
def runoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    basins = _basins(fixture(spark, sf_dir, "fx_ref_grid"))
    a, b = (analyses.basin_means(fixture(spark, sf_dir, f), basins) for f in ("fx_masked_ref", "fx_same_grid"))
    return _rounded(analyses.runoff(a, b), "ref_mean", "com_mean", "bias", "bias_score", "iav_score")


@query(f"""WITH a AS (SELECT t0, t1, avg(value)/1000 AS v FROM fx_ref_grid GROUP BY t0, t1), b AS (SELECT t0, t1, avg(value)/1000 AS v FROM fx_same_grid GROUP BY t0, t1), j AS (SELECT a.t0, a.t1, a.v AS x, b.v AS y FROM a JOIN b ON b.t0 = a.t0),
c AS (SELECT t1 AS t, sum(x*(t1-t0)) OVER (ORDER BY t0) AS x, sum(y*(t1-t0)) OVER (ORDER BY t0) AS y, sum(0.001*(t1-t0)) OVER (ORDER BY t0) AS u FROM j),
e AS (SELECT arg_max(x, t) AS x, arg_max(y, t) AS y, avg(exp(-greatest(abs(y-x)-u, 0)/u)) AS traj FROM c), r AS (SELECT {_R} AS r, stddev_pop(y)/stddev_pop(x) AS s FROM j)
SELECT round(x, 6) AS ref_end, round(y, 6) AS com_end, round(y-x, 6) AS diff, round(exp(-0.287*abs(y-x)/10.8), 6) AS difference_score, round(traj, 6) AS trajectory_score, round(4*(1+r)/((s+1/s)*(s+1/s)*2), 6) AS temporal_score FROM e CROSS JOIN r""")
def net_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (fixture(spark, sf_dir, f).groupBy("t0", "t1").agg((F.avg("value") / 1000).alias("value")) for f in ("fx_ref_grid", "fx_same_grid"))
    out = analyses.net_balance(a.withColumn("value_lo", F.col("value") - 0.001), b)
    return _rounded(out, *out.columns)


@query(f"""WITH y AS (SELECT lat0, lat1, lon0, lon1, yr, max(value) AS m FROM fx_ref_grid GROUP BY ALL), f AS (SELECT lat0, lat1, lon0, lon1, m < 42 AND lag(m) OVER w < 42 AND lag(yr) OVER w = yr-1 AS f FROM y WINDOW w AS (PARTITION BY lat0, lon0 ORDER BY yr)), m AS (SELECT DISTINCT lat0, lat1, lon0, lon1 FROM f WHERE f),
o AS (SELECT DISTINCT lat0, lat1, lon0, lon1 FROM fx_ref_grid WHERE lat0 >= 0), j AS (SELECT coalesce(m.lat0, o.lat0) AS lat0, coalesce(m.lat1, o.lat1) AS lat1, coalesce(m.lon0, o.lon0) AS lon0, coalesce(m.lon1, o.lon1) AS lon1, m.lat0 IS NOT NULL AS im, o.lat0 IS NOT NULL AS io FROM m FULL JOIN o ON o.lat0 = m.lat0 AND o.lon0 = m.lon0),
s AS (SELECT coalesce(sum(CASE WHEN im AND io THEN {AREA}/1e12 END), 0) AS overlap, coalesce(sum(CASE WHEN NOT im THEN {AREA}/1e12 END), 0) AS missed, coalesce(sum(CASE WHEN NOT io THEN {AREA}/1e12 END), 0) AS excess FROM j)
SELECT round(overlap, 6) AS overlap, round(missed, 6) AS missed, round(excess, 6) AS excess, round(overlap/nullif(overlap+missed, 0), 6) AS missed_score, round(overlap/nullif(overlap+excess, 0), 6) AS excess_score FROM s""")
def frozen_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "fx_ref_grid")
    yearly = df.groupBy(*CELL, F.col("yr").alias("year")).agg(F.max("value").alias("value")).withColumn("z0", F.lit(0.0))
    out = analyses.permafrost(yearly, df.filter("lat0 >= 0").select(*CELL).distinct(), 42.0)
    return _rounded(out, *out.columns)


@query(f"WITH {_cycle_sql('fx_ref_grid', 'cyc')} SELECT lat0, lon0, round(max(value)-min(value), 6) AS amplitude FROM cyc GROUP BY lat0, lon0")
def cycle_amplitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(analyses.detrended_cycle(fixture(spark, sf_dir, "fx_ref_grid"), CELL), "amplitude")


@query(f"WITH {_cycle_sql('fx_ref_grid', 'cyc')}, o AS (SELECT lat0, lon0, month, row_number() OVER (PARTITION BY lat0, lon0 ORDER BY value DESC, month) AS hi, row_number() OVER (PARTITION BY lat0, lon0 ORDER BY value, month) AS lo FROM cyc WHERE value IS NOT NULL) SELECT lat0, lon0, max(CASE WHEN hi = 1 THEN month END) AS peak, max(CASE WHEN lo = 1 THEN month END) AS trough FROM o GROUP BY lat0, lon0")
def cycle_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.detrended_cycle(fixture(spark, sf_dir, "fx_ref_grid"), CELL).select("lat0", "lon0", "peak", "trough")


@query("SELECT lat0, lon0, t0, round(value - avg(value) OVER (PARTITION BY lat0, lon0, CAST(floor((((t0+t1)/2) % 365)/(365.0::DOUBLE/12)) AS INT)), 6) AS value FROM fx_masked_ref")
def deseasonalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analyses.deseasonalised(fixture(spark, sf_dir, "fx_masked_ref"), CELL), "value").select("lat0", "lon0", "t0", "value")


@query("SELECT cell, round(-regr_slope(value, (z0+z1)/2), 6) AS value FROM fx_layers WHERE z1 > 1 AND z0 < 6 GROUP BY cell")
def depth_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analyses.depth_gradient(fixture(spark, sf_dir, "fx_layers"), ["cell"], 1.0, 6.0), "value")


@query("SELECT lat0, lon0, round(arg_max(value, t0)-arg_min(value, t0), 6) AS value FROM fx_masked_ref WHERE value IS NOT NULL GROUP BY lat0, lon0")
def content_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(analyses.content_change(fixture(spark, sf_dir, "fx_masked_ref"), CELL), "value")


@query(f"""WITH x AS (SELECT l_discount*500-10 AS x, log10(l_extendedprice/l_quantity) AS y FROM lineitem), s AS (SELECT {_POWERS} FROM x), c AS (SELECT {', '.join(map(_fit_sql, range(3)))} FROM s)
SELECT round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2, round(10**(-10*(c1-20*c2)), 6) AS q10_cold, round(10**(-10*(c1+20*c2)), 6) AS q10_mild, round(10**(-10*(c1+50*c2)), 6) AS q10_warm FROM c""")
def turnover_q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = df.select(F.col("l_extendedprice").alias("soilc"), F.col("l_quantity").alias("npp"), (F.col("l_discount") * 500 - 10).alias("tas"), F.lit(0.0).alias("pr"), F.lit(0.0).alias("pet"), F.lit(0.0).alias("fracpeat"))
    out = analyses.turnover(rows)
    return _rounded(out, *out.columns)


@query("""WITH s AS (SELECT site, -60 + (site*7) % 120 AS lat, max(value)-min(value) AS amplitude, CAST(min(d) FILTER (WHERE value = m) AS DOUBLE) AS p FROM (SELECT *, max(value) OVER (PARTITION BY site) AS m FROM fx_site_daily) q GROUP BY site), b AS (SELECT *, CASE WHEN lat > -90 AND lat <= -23 THEN 0 WHEN lat > -23 AND lat <= 23 THEN 1 WHEN lat > 23 AND lat <= 90 THEN 2 END AS band FROM s)
SELECT CAST(band AS INT) AS band, round(avg(amplitude), 6) AS amplitude, round((atan2(avg(sin(p*2*""" + PI + """/365)), avg(cos(p*2*""" + PI + """/365)))*365/(2*""" + PI + """) + 365) % 365, 4) AS peak_day, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY band""")
def latitude_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = fixture(spark, sf_dir, "fx_site_daily")
    sites = daily.groupBy("site").agg((F.max("value") - F.min("value")).alias("amplitude"), F.min_by(F.col("d").cast("double"), F.struct(-F.col("value"), "d")).alias("peak_day"))
    sites = sites.withColumn("lat", (F.lit(-60) + (F.col("site") * 7) % 120).cast("double"))
    return _rounded(analyses.band_summary(sites, [(-90.0, -23.0), (-23.0, 23.0), (23.0, 90.0)]), "amplitude").withColumn("peak_day", F.round("peak_day", 4)).select("band", "amplitude", "peak_day", "n")


@query("""WITH p AS (SELECT r.lat0, r.lon0, r.t1-r.t0 AS w, r.value AS x, c.value AS y FROM fx_ref_grid r JOIN fx_same_grid c ON c.t0 = r.t0 AND c.lat0 = r.lat0 AND c.lon0 = r.lon0),
m AS (SELECT lat0, lon0, sum(x*w)/sum(w) AS x, sum(y*w)/sum(w) AS y FROM p GROUP BY 1, 2), s AS (SELECT p.lat0, p.lon0, sqrt(sum((p.x-m.x)*(p.x-m.x)*w)/sum(w)) AS s FROM p JOIN m ON m.lat0 = p.lat0 AND m.lon0 = p.lon0 GROUP BY 1, 2)
SELECT p.lat0, p.lon0, round(any_value(m.y-m.x), 6) AS bias, round(sum(w*exp(-(greatest(p.y-p.x-1, 0)+greatest(p.x-1-p.y, 0))/s))/sum(w), 6) AS score FROM p JOIN m ON m.lat0 = p.lat0 AND m.lon0 = p.lon0 JOIN s ON s.lat0 = p.lat0 AND s.lon0 = p.lon0 GROUP BY 1, 2""")
def uncertain_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = fixture(spark, sf_dir, "fx_ref_grid").withColumns({"value_lo": F.col("value") - 1, "value_hi": F.col("value") + 1})
    return _rounded(analyses.uncertain_bias(ref, fixture(spark, sf_dir, "fx_same_grid"), ["lat0", "lon0"]), "bias", "score")


@query("""WITH p AS (SELECT a.site, b.site AS other, sqrt((a.lat-b.lat)*(a.lat-b.lat)+(a.lon-b.lon)*(a.lon-b.lon)) AS d FROM fx_sites a JOIN fx_sites b ON a.site % 2 = 1 AND b.site % 2 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY d, other) AS k FROM p WHERE d < 60)
SELECT site, other, round(d, 6) AS distance FROM k WHERE k = 1""")
def sites_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = fixture(spark, sf_dir, "fx_sites")
    odd, even = sites.filter("site % 2 = 1"), sites.filter("site % 2 = 0")
    return _rounded(L.sites_within(odd, even.select(F.col("site").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), 60.0), "distance")


@query("""WITH r AS (SELECT r.label AS region, g.lat0, g.lat1, g.lon0, g.lon1 FROM (SELECT DISTINCT lat0, lat1, lon0, lon1 FROM fx_ref_grid) g JOIN fx_regions r ON r.label = 'globe' OR ((lat0+lat1)/2 > lat_min AND (lat0+lat1)/2 <= lat_max AND (lon0+lon1)/2 > lon_min AND (lon0+lon1)/2 <= lon_max)),
t AS (SELECT region, CAST(length(region) AS DOUBLE) AS value FROM r GROUP BY region) SELECT lat0, lon0, round(sum(value), 6) AS threshold FROM r JOIN t ON t.region = r.region GROUP BY lat0, lon0""")
def regional_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.in_region(fixture(spark, sf_dir, "fx_ref_grid").select(*CELL).distinct(), fixture(spark, sf_dir, "fx_regions"))
    table = rows.groupBy("region").agg(F.max(F.length("region")).cast("double").alias("value"))
    return _cells(L.regional_threshold(rows, table), "threshold")


@query("SELECT c.c_name AS name, CAST(coalesce(n.n_nationkey, -1) AS INT) AS id FROM (SELECT DISTINCT lower(n_name) AS c_name FROM nation UNION SELECT r_name FROM region) c LEFT JOIN nation n ON lower(n.n_name) = lower(c.c_name)")
def match_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    wanted = nation.select(F.lower("n_name").alias("name")).union(region.select("r_name")).distinct()
    found = L.match_names(wanted, nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id")))
    return found.withColumn("id", F.coalesce("id", F.lit(-1)).cast("int"))


@query("""WITH k AS (SELECT * FROM (VALUES (0, 0.5), (1, 0.3), (2, 0.1)) v(lag, weight)), f AS (SELECT site, CAST(d AS INT) AS step, value FROM fx_site_daily), n AS (SELECT f.site, f.step + k.lag AS step, sum(value*weight) AS v FROM f CROSS JOIN k GROUP BY 1, 2),
g AS (SELECT a.site, a.step, sum(b.value) AS v FROM f a JOIN f b ON b.site = a.site AND b.step < a.step - 2 GROUP BY 1, 2)
SELECT f.site, f.step, round(n.v + coalesce(g.v, 0)*0.1, 6) AS value FROM f JOIN n ON n.site = f.site AND n.step = f.step LEFT JOIN g ON g.site = f.site AND g.step = f.step""")
def lagged_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    flux = fixture(spark, sf_dir, "fx_site_daily").select("site", F.col("d").cast("int").alias("step"), "value")
    kernel = spark.createDataFrame([(0, 0.5), (1, 0.3), (2, 0.1)], "lag int, weight double")
    return _rounded(L.lagged_response(flux, kernel, ["site"]), "value")


@query(f"WITH b AS ({_BASINS.replace('CAST((lat0+90)/60 AS INT)', 'CAST(floor((lat0+90)/60) AS INT)')}), v AS (SELECT basin, avg(value) AS value FROM fx_ref_grid g JOIN b ON b.lat0 = g.lat0 AND b.lon0 = g.lon0 GROUP BY basin) SELECT lat0, lon0, round(sum(value), 6) AS value FROM b JOIN v ON v.basin = b.basin GROUP BY lat0, lon0")
def paint_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "fx_ref_grid")
    basins = _basins(df)
    return _rounded(L.paint(df.join(basins, ["lat0", "lon0"]).groupBy("basin").agg(F.avg("value").alias("value")), basins), "value")


@query("""WITH m AS (SELECT lat0, lon0, avg(value) AS v FROM fx_ref_grid GROUP BY 1, 2), c AS (SELECT CAST(floor((lat0+15)/30) AS INT) AS i, (CAST(floor((lon0+15)/30) AS INT)+120) % 12 AS j, v FROM m),
p AS (SELECT site, (lat-15)/30 AS y, (lon-15)/30 AS x FROM fx_sites), q AS (SELECT site, CAST(floor(y) AS INT) + a AS i, (CAST(floor(x) AS INT) + b + 120) % 12 AS j, CASE a WHEN 1 THEN y-floor(y) ELSE 1-(y-floor(y)) END * CASE b WHEN 1 THEN x-floor(x) ELSE 1-(x-floor(x)) END AS w FROM p, (VALUES (0), (1)) s(a), (VALUES (0), (1)) t(b))
SELECT site, round(sum(v*w)/nullif(sum(w), 0), 6) AS value FROM q JOIN c ON c.i = q.i AND c.j = q.j GROUP BY site""")
def bilinear_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = fixture(spark, sf_dir, "fx_ref_grid").groupBy(*CELL).agg(F.avg("value").alias("value"))
    return _rounded(L.bilinear(grid, fixture(spark, sf_dir, "fx_sites"), 30.0), "value")


@query("""WITH m AS (SELECT site, avg(value) AS m FROM fx_site_daily GROUP BY site), a AS (SELECT s.site, CAST(d AS DOUBLE) AS t, value-m AS v FROM fx_site_daily s JOIN m ON m.site = s.site), b AS (SELECT *, lag(v) OVER (PARTITION BY site ORDER BY t) AS u, lag(t) OVER (PARTITION BY site ORDER BY t) AS s FROM a)
SELECT site, CAST(count(*) AS BIGINT) AS n, round(sum(s+(t-s)*u/(u-v)), 4) AS total FROM b WHERE u*v < 0 OR (v = 0 AND u <> 0) GROUP BY site""")
def sign_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = fixture(spark, sf_dir, "fx_site_daily")
    means = daily.groupBy("site").agg(F.avg("value").alias("m"))
    rows = daily.join(means, "site").select("site", F.col("d").cast("double").alias("t"), (F.col("value") - F.col("m")).alias("value"))
    return L.sign_changes(rows, ["site"]).groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("t"), 4).alias("total"))


@query("SELECT event_type, round(avg(value*86400*1000), 4) AS g_per_day, round(avg(value+273.15), 4) AS kelvin FROM events GROUP BY event_type")
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    (a, b), (c, d) = conversion("kg m-2 s-1", "g m-2 d-1"), conversion("degC", "K")
    return df.groupBy("event_type").agg(F.round(F.avg(F.col("value") * a + b), 4).alias("g_per_day"), F.round(F.avg(F.col("value") * c + d), 4).alias("kelvin"))


@query(f"""WITH r AS ({_REGION_ROWS}) SELECT region, round(min(value), 6) AS low, round(max(value), 6) AS high, round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.99), 6) AS p99 FROM r WHERE value IS NOT NULL GROUP BY region""")
def value_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.in_region(fixture(spark, sf_dir, "fx_masked_ref"), fixture(spark, sf_dir, "fx_regions")).filter("value is not null")
    ends = C.exact_quantiles(rows, ["region"], F.col("value"), [0.0, 0.01, 0.99, 1.0])
    out = ends.groupBy("region").agg(*(F.max(F.when(F.col("quantile") == q, F.col("value"))).alias(c) for c, q in (("low", 0.0), ("p01", 0.01), ("p99", 0.99), ("high", 1.0))))
    return _rounded(out, "low", "high", "p01", "p99")


@query(f"SELECT site, round(avg(value*cos(2*{PI}*d/365)), 6) AS x, round(avg(value*sin(2*{PI}*d/365)), 6) AS y FROM fx_site_daily GROUP BY site")
def season_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = F.col("d") * (2 * 3.141592653589793) / 365
    out = fixture(spark, sf_dir, "fx_site_daily").groupBy("site").agg(F.avg(F.col("value") * F.cos(angle)).alias("x"), F.avg(F.col("value") * F.sin(angle)).alias("y"))
    return _rounded(out, "x", "y")


@query("""SELECT section AS "Section", variable AS "Variable", source AS "Source", 'one' AS "Model", 'Bias Score' AS "ScalarName", 'MeanState' AS "AnalysisType", 'globe' AS "Region", 'score' AS "ScalarType", '1' AS "Units", printf('%g', score) AS "Data", weight AS "Weight" FROM fx_tree""")
def scalar_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "fx_tree").select(
        "section", "variable", "source", F.lit("one").alias("model"), F.lit("Bias Score").alias("scalarname"), F.lit("MeanState").alias("analysistype"),
        F.lit("globe").alias("region"), F.lit("score").alias("scalartype"), F.lit("1").alias("units"), F.col("score").alias("data"), "weight")
    return scoreboard.scalar_table(rows)


from . import program_queries  # noqa: E402, F401  (registers the programs)
