"""Fields made from the given tables, as SQL that Spark and DuckDB both run: inputs of the registered queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SQL: dict[str, str] = {
    # fixed values: first and last day of each month of a year without leap days
    "fx_months": "SELECT m AS mo, CAST(b0 AS DOUBLE) AS b0, CAST(b1 AS DOUBLE) AS b1 FROM (VALUES (1,0,31),(2,31,59),(3,59,90),(4,90,120),(5,120,151),(6,151,181),(7,181,212),(8,212,243),(9,243,273),(10,273,304),(11,304,334),(12,334,365)) AS v(m,b0,b1)",
    "fx_ref_grid": """SELECT q.yr, q.mo, (q.yr-1850)*365+m.b0 AS t0, (q.yr-1850)*365+m.b1 AS t1,
 CAST(-90+30*i AS DOUBLE) AS lat0, CAST(-60+30*i AS DOUBLE) AS lat1, CAST(-180+30*j AS DOUBLE) AS lon0, CAST(-150+30*j AS DOUBLE) AS lon1, v AS value
FROM (SELECT year(l_shipdate) AS yr, month(l_shipdate) AS mo, CAST(l_suppkey % 6 AS INT) AS i, CAST(l_partkey % 12 AS INT) AS j, avg(l_quantity) AS v FROM lineitem GROUP BY 1,2,3,4) q JOIN fx_months m ON q.mo=m.mo""",
    "fx_com_grid": """SELECT q.yr, q.mo, (q.yr-1850)*365+m.b0 AS t0, (q.yr-1850)*365+m.b1 AS t1,
 CAST(-90+45*i AS DOUBLE) AS lat0, CAST(-45+45*i AS DOUBLE) AS lat1, CAST(-180+45*j AS DOUBLE) AS lon0, CAST(-135+45*j AS DOUBLE) AS lon1, v AS value
FROM (SELECT year(l_shipdate) AS yr, month(l_shipdate) AS mo, CAST(l_suppkey % 4 AS INT) AS i, CAST(l_partkey % 8 AS INT) AS j, avg(l_quantity*(1-l_discount)) AS v FROM lineitem GROUP BY 1,2,3,4) q JOIN fx_months m ON q.mo=m.mo""",
    "fx_same_grid": """SELECT q.yr, q.mo, (q.yr-1850)*365+m.b0 AS t0, (q.yr-1850)*365+m.b1 AS t1,
 CAST(-90+30*i AS DOUBLE) AS lat0, CAST(-60+30*i AS DOUBLE) AS lat1, CAST(-180+30*j AS DOUBLE) AS lon0, CAST(-150+30*j AS DOUBLE) AS lon1, v AS value
FROM (SELECT year(l_shipdate) AS yr, month(l_shipdate) AS mo, CAST(l_suppkey % 6 AS INT) AS i, CAST(l_partkey % 12 AS INT) AS j, avg(l_quantity*(1-l_tax)+l_linenumber) AS v FROM lineitem GROUP BY 1,2,3,4) q JOIN fx_months m ON q.mo=m.mo""",
    "fx_wide_grid": """SELECT q.yr, q.mo, (q.yr-1850)*365+m.b0 AS t0, (q.yr-1850)*365+m.b1 AS t1,
 CAST(-90+60*i AS DOUBLE) AS lat0, CAST(-30+60*i AS DOUBLE) AS lat1, CAST(-180+60*j AS DOUBLE) AS lon0, CAST(-120+60*j AS DOUBLE) AS lon1, v AS value
FROM (SELECT year(l_shipdate) AS yr, month(l_shipdate) AS mo, CAST(l_suppkey % 3 AS INT) AS i, CAST(l_partkey % 6 AS INT) AS j, avg(l_quantity*(1+l_tax)-l_linenumber) AS v FROM lineitem GROUP BY 1,2,3,4) q JOIN fx_months m ON q.mo=m.mo""",
    "fx_three_models": """SELECT 'a' AS model, t0, t1, lat0, lat1, lon0, lon1, value FROM fx_same_grid UNION ALL SELECT 'b', t0, t1, lat0, lat1, lon0, lon1, value FROM fx_com_grid WHERE lat0 < 45 UNION ALL SELECT 'c', t0, t1, lat0, lat1, lon0, lon1, value FROM fx_wide_grid""",
    "fx_dense_ref": """SELECT t.yr, t.mo, t.t0, t.t1, c.lat0, c.lat1, c.lon0, c.lon1, r.value
FROM (SELECT DISTINCT yr, mo, t0, t1 FROM fx_ref_grid) t CROSS JOIN (SELECT DISTINCT lat0, lat1, lon0, lon1 FROM fx_ref_grid) c
LEFT JOIN fx_ref_grid r ON r.t0=t.t0 AND r.lat0=c.lat0 AND r.lon0=c.lon0""",
    "fx_masked_ref": """SELECT yr, mo, t0, t1, lat0, lat1, lon0, lon1,
 CASE WHEN (yr+mo+CAST((lat0+90)/30 AS INT)*5+CAST((lon0+180)/30 AS INT)*3) % 11 = 0 OR (lat0=0 AND lon0=0) THEN NULL ELSE value END AS value FROM fx_dense_ref""",
    "fx_sites": "SELECT user_id AS site, CAST(-60 + (user_id*7) % 120 AS DOUBLE) AS lat, CAST(-180 + (user_id*13) % 360 AS DOUBLE) AS lon FROM (SELECT DISTINCT user_id FROM events) u",
    "fx_site_daily": """SELECT user_id AS site, day(ts)-1 AS d, CAST((2024-1850)*365+day(ts)-1 AS DOUBLE) AS t0, CAST((2024-1850)*365+day(ts) AS DOUBLE) AS t1, avg(value) AS value, count(*) AS n FROM events GROUP BY 1,2,3,4""",
    "fx_regions": """SELECT * FROM (VALUES ('globe',CAST(-90 AS DOUBLE),CAST(90 AS DOUBLE),CAST(-180 AS DOUBLE),CAST(180 AS DOUBLE)),
 ('shsa',-59.75,0.25,-80.25,-33.25),('euro',35.25,70.25,-10.25,30.25),('aust',-41.25,-10.5,112.0,154.0),('boas',54.75,70.25,30.25,179.75)) AS r(label,lat_min,lat_max,lon_min,lon_max)""",
    "fx_layers": "SELECT CAST(l_linenumber-1 AS DOUBLE) AS z0, CAST(l_linenumber AS DOUBLE) AS z1, CAST(l_suppkey % 6 AS INT) AS cell, avg(l_extendedprice)/1000 AS value FROM lineitem GROUP BY 1,2,3",
    "fx_tree": """SELECT r.r_name AS section, n.n_name AS variable, s.s_name AS source, CAST(1+s.s_suppkey % 5 AS DOUBLE) AS weight, 1/(1+abs(s.s_acctbal)/5000) AS score
FROM supplier s JOIN nation n ON s.s_nationkey=n.n_nationkey JOIN region r ON n.n_regionkey=r.r_regionkey""",
    "fx_relationship": "SELECT p_partkey AS cell, CAST(p_size AS DOUBLE) AS ind, p_retailprice AS dep FROM part",
}


def needed(sql: str) -> list[str]:
    """The fixtures that a statement builds on, in the order of SQL."""
    found: set[str] = set()

    def add(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name not in found:
                found.add(name)
                add(SQL[name])

    add(sql)
    return [name for name in SQL if name in found]


def with_fixtures(sql: str) -> str:
    """``sql`` (a select, or one that begins with WITH) with the fixtures it names in front."""
    own = ", ".join(f"{name} AS ({SQL[name]})" for name in needed(sql))
    if not own:
        return sql
    rest = sql.strip()
    return f"WITH {own}, {rest[5:]}" if rest.upper().startswith("WITH ") else f"WITH {own} {rest}"


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = with_fixtures(f"SELECT * FROM {name}")
    for table in TABLES:
        sql = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 parquet.`{sf_dir}/{table}.parquet`", sql)
    return spark.sql(sql)
