"""Runs that go on, models of clocks and grids of their own, polygons, calendars, catalogs and exact splines on small fields."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import CELL, calendars, compare, polygons, signal, space
from gridloom.plans import alignment, config, mean_state, run, scoreboard
from gridloom.sources import catalog
from gridloom.sources.store import Store, written

REGIONS = "label string, lat_min double, lat_max double, lon_min double, lon_max double"
CONFIG = '[h1: A]\n[h2: B]\nvariable = "v"\nmass_weighting = "yes"\n[C]\n[h2: D]\nvariable = "w"\n[E]\nrelationships = "B/C"\n'


def grid_months(spark, n, step=90.0, shift=0.0, start=0.0, wave=1.0, south=-90.0, north=90.0):
    """A gridded field of ``n`` months on cells of ``step`` degrees."""
    cells = space.regular_grid(spark, step).filter((F.col("lat0") >= south) & (F.col("lat1") <= north))
    rows = cells.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    value = 10 + F.col("lat0") / 30 + wave * F.sin((F.col("m") + F.col("lon0") / 90) * (2 * math.pi / 12)) + F.col("m") * 0.01
    return rows.select((F.col("m") * 30.0 + start + shift).alias("t0"), (F.col("m") * 30.0 + 30 + start + shift).alias("t1"), *CELL, value.alias("value"))


def regions_of(spark):
    return spark.createDataFrame([("global", None, None, None, None)], REGIONS)


def test_models_of_own_grids_and_clocks(spark):
    ref = grid_months(spark, 24)
    a = ref.withColumn("model", F.lit("a"))
    b = grid_months(spark, 24, step=60.0).withColumn("model", F.lit("b"))
    late = grid_months(spark, 12, start=360.0).withColumn("model", F.lit("late"))
    assert alignment.model_groups(a.unionByName(b).unionByName(late)) == [["a", "b"], ["late"]]
    models = a.unionByName(b).unionByName(late)
    store = Store(spark)
    out = run.run(config.parse(CONFIG), run.Fields(lambda n: ref, lambda n: models), regions_of(spark), store=store)
    got = {(r["variable"], r["model"]): r["value"] for r in out.filter("scalar = 'Overall Score'").collect()}
    assert set(got) == {(v, m) for v in "BD" for m in ("a", "b", "late")} and got["B", "a"] == pytest.approx(1.0)
    assert got["B", "b"] < 1.0 and store.failures().count() == 0
    related = run.relationships(config.parse(CONFIG), store, regions_of(spark)).collect()
    assert {(r["model"], r["scalar"]) for r in related if r["model"] == "a"} == {("a", "B|C Hellinger Distance"), ("a", "B|C Score")}
    assert all(r["value"] == pytest.approx(1.0) for r in related if r["model"] == "a")


def test_model_without_a_shared_record_leaves_others_whole(spark):
    ref, store = grid_months(spark, 24), Store(spark)
    models = ref.withColumn("model", F.lit("good")).unionByName(grid_months(spark, 24, start=36500.0).withColumn("model", F.lit("off")))
    out = run.run(config.parse(CONFIG), run.Fields(lambda n: ref, lambda n: models), regions_of(spark), store=store)
    assert {r["model"] for r in out.collect()} == {"good"}
    assert {(r["dataset"], r["model"]) for r in store.failures().collect()} == {("A/B/C", "off"), ("A/D/E", "off")}


def test_run_stopped_midway_goes_on(spark, monkeypatch):
    ref = grid_months(spark, 24)
    models = ref.withColumn("model", F.lit("m")).unionByName(ref.withColumn("model", F.lit("n")))
    fields, store, done = run.Fields(lambda n: ref, lambda n: models), Store(spark), []
    whole = Store.put

    def stopped(self, dataset, names, tables):
        """Writes the second dataset's part and is stopped before it is noted."""
        if dataset == "A/D/E" and "scalars" in tables:
            tables["scalars"].withColumn("dataset", F.lit(dataset)).write.parquet(f"{self.path}/scalars/part=orphan")
            raise KeyboardInterrupt
        whole(self, dataset, names, tables)

    monkeypatch.setattr(Store, "put", stopped)
    with pytest.raises(KeyboardInterrupt):
        run.run(config.parse(CONFIG), fields, regions_of(spark), store=store)
    monkeypatch.setattr(Store, "put", lambda self, dataset, *rest: (done.append(dataset), whole(self, dataset, *rest))[1])
    again = run.run(config.parse(CONFIG), fields, regions_of(spark), store=store)
    assert done == ["A/D/E"]
    one = run.run(config.parse(CONFIG), fields, regions_of(spark))
    rows = lambda df: sorted((r["variable"], r["model"], r["region"], r["scalar"], round(r["value"], 9)) for r in df.collect())
    assert rows(again) == rows(one)


def test_times_that_are_off_by_a_part_meet_by_number(spark):
    ref, com = grid_months(spark, 24), grid_months(spark, 24, shift=0.5)
    a, b = alignment.comparable(ref, com.withColumn("model", F.lit("m")))
    assert b.select("t0").distinct().count() == 24 and a.join(b, ["t0", "t1", *CELL]).count() == ref.count()
    out = mean_state.mean_state(a, b, regions_of(spark), "series")
    assert {r["scalar"]: r["value"] for r in out.collect()}["RMSE"] == pytest.approx(0.0, abs=1e-9)


def test_short_and_single_times_leave_scores_out(spark):
    names = lambda n: {r["scalar"] for r in mean_state.mean_state(grid_months(spark, n), grid_months(spark, n, wave=2.0).withColumn("model", F.lit("m")), regions_of(spark)).collect()}
    assert "Seasonal Cycle Score" not in names(6) and not {"RMSE", "RMSE Score", "Phase Shift"} & names(1) and "Bias Score" in names(1)


def test_nearest_on_axes_takes_the_lower_of_equals(spark):
    asked = spark.createDataFrame([("m", "lat", 0.0, 30.0), ("m", "lat", 60.0, 90.0), ("m", "lat", -90.0, -89.0)], "model string, axis string, lo double, hi double")
    own = spark.createDataFrame([("m", "lat", 0.0, 10.0), ("m", "lat", 20.0, 30.0), ("m", "lat", 30.0, 40.0)], "model string, axis string, lo double, hi double")
    assert {r["lo"]: r["own"] for r in space.nearest_on_axes(asked, own=own).collect()} == {0.0: 0.0, 60.0: 30.0, -90.0: 0.0}


def test_ensemble_of_grids(spark):
    a = grid_months(spark, 1, step=90.0).withColumns({"model": F.lit("a"), "value": F.lit(2.0)})
    b = grid_months(spark, 1, step=45.0).withColumns({"model": F.lit("b"), "value": F.lit(5.0)})
    out = compare.ensemble_on_grid(a.unionByName(b), space.regular_grid(spark, 30.0), {"a": 2.0, "b": 1.0}).collect()
    assert len(out) == 72 and all(r["value"] == pytest.approx(3.0) for r in out)


def test_cells_in_polygons_with_holes(spark):
    square = lambda basin, ring, r: [(basin, ring, k, y * r, x * r) for k, (y, x) in enumerate([(-1, -1), (-1, 1), (1, 1), (1, -1)])]
    rings = spark.createDataFrame([*square(1, 0, 10.3), *square(1, 1, 4.3), *square(2, 0, 2.3)], "basin int, ring int, at int, lat double, lon double")
    out = {r["basin"]: r["n"] for r in polygons.basin_areas(space.regular_grid(spark, 1.0), rings).collect()}
    brute = lambda r: sum(abs(i + 0.5) < r and abs(j + 0.5) < r for i in range(-90, 90) for j in range(-180, 180))
    assert out == {1: brute(10.3) - brute(4.3), 2: brute(2.3)}
    assert polygons.inside(spark.createDataFrame([(0.0, 0.0), (7.0, 0.0), (None, 1.0)], "lat double, lon double"), rings).orderBy("basin").collect() == [(7.0, 0.0, 1), (0.0, 0.0, 2)]


@pytest.mark.parametrize(
    ("number", "units", "calendar", "expected"),
    [
        (0.0, "days since 1850-01-01", "noleap", 0.0), (60.0, "days since 2000-01-01", "standard", 150 * 365 + 59.0), (59.5, "days since 2000-01-01", "gregorian", 150 * 365 + 59.0),
        (366.0, "days since 2000-01-01", "proleptic_gregorian", 151 * 365.0), (365.0, "days since 2000-01-01", "366_day", 150 * 365 + 364.0), (24.0, "hours since 1999-12-31 12:00:00", "365_day", 150 * 365 + 0.5),
        (360.0, "days since 1999-01-01", "360_day", 150 * 365.0), (59.0, "days since 2000-01-01", "360_day", 150 * 365 + 59.0), (86400.0, "seconds since 1850-12-31", "noleap", 365.0), (1.0, "months since 1850-01-01", "noleap", None), (1.0, "days since 1850-01-01", "lunar", None),
    ],
)
def test_calendars(spark, number, units, calendar, expected):
    got = spark.createDataFrame([(number, units, calendar)], "t double, units string, calendar string").select(calendars.noleap_from(F.col("t"), F.col("units"), F.col("calendar")).alias("d")).first()["d"]
    assert got == (None if expected is None else pytest.approx(expected))


def test_stamps(spark):
    rows = [("begin", 31.0 * k, "days since 2001-01-01", "noleap") for k in range(3)] + [("hours", 0.125 + 0.25 * k, "days since 2001-01-01", "standard") for k in range(4)] + [("one", 5.0, "days since 2001-01-01", "noleap")]
    df = spark.createDataFrame(rows, "k string, t double, units string, calendar string")
    got = {r["k"]: r["alpha"] for r in calendars.stamp_places(df, ["k"]).collect()}
    assert got == {"begin": 0.0, "hours": 0.5, "one": 0.5}
    bounds = [(r["t0"] - 151 * 365, r["t1"] - 151 * 365) for r in calendars.bounds_of_stamps(df, ["k"]).filter("k = 'begin'").orderBy("t0").collect()]
    assert bounds == [(0.0, 31.0), (31.0, 62.0), (62.0, 93.0)]
    daily = spark.createDataFrame([("d", float(k), "days since 2001-01-01", "noleap") for k in range(3)], "k string, t double, units string, calendar string")
    with pytest.raises(ValueError):
        calendars.bounds_of_stamps(daily, ["k"])


def test_catalog_opens_only_the_files_it_needs(spark, tmp_path):
    for name in ("gpp_Lmon_A_historical_r1_gn_199001-199912", "gpp_Lmon_A_historical_r1_gn_200001-200912", "tas_Amon_A_historical_r1_gn_199001-200912", "gppv_Lmon_B_historical_r1_199501-200412", "notes"):
        spark.createDataFrame([(1.0,)], "value double").coalesce(1).write.parquet(str(tmp_path / "w"), mode="overwrite")
        next((tmp_path / "w").glob("part-*.parquet")).rename(tmp_path / f"{name}.parquet")
    files = catalog.file_catalog(spark, str(tmp_path), glob="*_*.parquet")
    assert {(r["model"], r["variable"], r["first"], r["last"]) for r in files.collect()} == {("A", "gpp", 1990, 1999), ("A", "gpp", 2000, 2009), ("A", "tas", 1990, 2009), ("B", "gppv", 1995, 2004)}
    synonyms = spark.createDataFrame([("gpp", "gppv", 1)], "variable string, synonym string, place int")
    df = catalog.read_files(catalog.select_files(files, "gpp", synonyms, (1990, 1999)))
    assert sorted(f.rsplit("/", 1)[1] for f in df.inputFiles()) == ["gpp_Lmon_A_historical_r1_gn_199001-199912.parquet", "gppv_Lmon_B_historical_r1_199501-200412.parquet"]
    assert {(r["model"], r["variable"]) for r in df.collect()} == {("A", "gpp"), ("B", "gppv")}
    assert catalog.read_files(catalog.select_files(files, "pr")) is None


def test_areas_of_files_come_first(spark):
    cells = space.regular_grid(spark, 90.0).withColumn("value", F.lit(1.0))
    own = cells.limit(1).withColumn("value", F.lit(7.0))
    areas = [r["area"] for r in catalog.with_areas(cells, own).collect()]
    assert areas.count(7.0) == 1 and len(areas) == 8


def test_splines_are_exact():
    rng = np.random.default_rng(0)
    for n in (3, 12, 31):
        x, y = np.sort(rng.uniform(0, 365, n)), rng.normal(size=n)
        top, low = signal.spline_extremes(x, y, 365.0)
        at = np.linspace(0, 365, 1_000_001)
        v = signal.periodic_spline(x, y, 365.0, at)
        assert top[1] == pytest.approx(v.max(), abs=1e-6) and low[1] == pytest.approx(v.min(), abs=1e-6)
        crossings = signal.spline_crossings(x, y, 365.0, 0.1)
        changes = np.flatnonzero((v[1:] > 0.1) != (v[:-1] > 0.1))
        assert [t for t, _ in crossings] == pytest.approx(at[changes].tolist(), abs=1e-3) and [up for _, up in crossings] == (v[changes + 1] > 0.1).tolist()
    year = np.arange(12) * 365 / 12
    assert signal.spline_extremes(year, np.full(12, 2.0), 365.0) == ((0.0, 2.0), (0.0, 2.0))


def test_filter_keeps_lines_and_halves_at_its_cutoff():
    at = np.arange(400.0)
    assert np.abs(signal.low_pass(3 + 0.5 * at, 1.0, 80.0) - (3 + 0.5 * at)).max() < 1e-9
    assert signal.filter_response(np.array([0.0, 1 / 80, 1.0]), 80.0).tolist() == pytest.approx([1.0, 0.5, 0.0])
    fit, covariance, variance = signal.fit_statistics(np.column_stack([np.ones(5), np.arange(5.0)]), np.array([0.0, 1.0, 2.0, 3.0, 5.0]))
    assert fit[1] == pytest.approx(1.2) and variance == pytest.approx(0.4 / 3) and covariance[1, 1] == pytest.approx(variance / 10)


def test_statistics_of_the_document_are_in_order(spark):
    rows = [("s", "v", "d", "m", "global", n, 0.5, 1.0) for n in ("Bias Score", "OverallScore", "Other Score")]
    scores = spark.createDataFrame(rows, "section string, variable string, source string, model string, region string, scalar string, value double, weight double")
    regions = spark.createDataFrame([("global", "Globe", "own")], "label string, name string, generator string")
    models = spark.createDataFrame([], "model string, description string, source string")
    import json

    doc = json.loads(scoreboard.cmec_document(written(scores, "scores"), regions, models).first()["json"])
    assert doc["DIMENSIONS"]["dimensions"]["statistic"] == {"indices": ["Overall Score", "Bias Score", "Other Score"], "short_names": ["OverallScore", "Bias Score", "Other Score"]}
    assert doc["RESULTS"]["global"]["m"]["s::v!!d"] == {"Bias Score": 0.5, "Other Score": 0.5, "Overall Score": 0.5}
    assert doc["DIMENSIONS"]["dimensions"]["model"] == {"m": {"Description": "", "Source": ""}}
