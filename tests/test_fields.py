"""Operators on small fields with results worked out by hand or by plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import expressions, scores, units
from gridloom.operators import CELL, compare, lookup, signal, space, time
from gridloom.plans import alignment, analyses, config, run, scoreboard
from gridloom.sources import fields
from gridloom.streaming import windows


def series(spark, values, start=0.0, step=30.0):
    return spark.createDataFrame([(1, start + i * step, start + (i + 1) * step, v) for i, v in enumerate(values)], "cell int, t0 double, t1 double, value double")


def values(df, *order):
    return [r["value"] for r in (df.orderBy(*order) if order else df).collect()]


@pytest.mark.parametrize(
    ("source", "target", "x", "expected"),
    [("kg m-2 s-1", "g m-2 d-1", 1.0, 86400e3), ("degC", "K", 10.0, 283.15), ("K", "degC", 273.15, 0.0), ("mm d-1", "kg m-2 s-1", 1.0, 998.2e-3 / 86400), ("1e-6 kg m-3", "kg m-3", 2.0, 2e-6), ("W m-2", "J m-2 s-1", 3.0, 3.0), ("mol m-2 s-1", "g m-2 s-1", 1.0, 12.0107), ("psu", "1", 35.0, 0.035), ("Pg yr-1", "Tg yr-1", 1.0, 1e3), ("km", "cm", 1.0, 1e5), ("m3/s", "m3 s-1", 5.0, 5.0)],
)
def test_units(source, target, x, expected):
    scale, offset = units.conversion(source, target)
    assert x * scale + offset == pytest.approx(expected, rel=1e-9, abs=1e-9)


def test_units_that_fail():
    with pytest.raises(units.UnknownUnit):
        units.parse("furlong")
    with pytest.raises(units.UnitConversionError):
        units.conversion("K", "m")
    assert units.tidy("gC m-2") == "g m-2" and units.tidy("unitless") == "1"


def test_expression(spark):
    df = spark.createDataFrame([(8.0, 2.0, 1.0), (1.0, 0.0, None)], "a double, b double, c double")
    columns = {c: F.col(c) for c in df.columns}
    assert [r[0] for r in df.select(expressions.compile_expression("a/b - c", columns)[0]).collect()] == [3.0, None]
    assert [r[0] for r in df.select(expressions.compile_expression("(a+b)*2^2", columns)[0]).collect()] == [40.0, 4.0]
    assert expressions.names("rsus/rsds + 1") == ["rsus", "rsds"]
    assert expressions.compile_expression("a/b", columns, {"a": "W m-2", "b": "W m-2"})[1] == "1"
    assert [r[0] for r in df.select(expressions.compile_expression("a+b", columns, {"a": "kg", "b": "g"})[0]).collect()] == [8.002, 1.0]
    with pytest.raises(ValueError):
        expressions.compile_expression("a $ b", columns)


def test_integral_mean_and_masks(spark):
    df = series(spark, [1.0, None, 3.0, 5.0])
    assert values(time.integrate(df, ["cell"], mean=True)) == [3.0]
    assert values(time.integrate(df, ["cell"], 75.0, 105.0)) == [3.0 * 15 + 5.0 * 15]
    assert values(time.integrate(series(spark, [None, None]), ["cell"], mean=True)) == [None]
    assert time.integrate(df.filter("false"), ["cell"]).count() == 0


def test_running_integral_is_masked_after_a_gap(spark):
    assert values(time.accumulate(series(spark, [1.0, 2.0, None, 4.0]), ["cell"]), "t") == [0.0, 30.0, 90.0, None, None]


def test_detrend(spark):
    t = np.arange(20) * 30.0 + 15
    v = 2 + 0.3 * t - 0.001 * t**2 + np.where(np.arange(20) % 2, 1, -1)
    fit = np.polyval(np.polyfit(t, v, 2), t)
    assert np.allclose(values(time.detrend(series(spark, v.tolist()), ["cell"]), "t0"), v - fit, atol=1e-6)


def test_dense_mask_denominator(spark):
    rows = [(0.0, 1.0, -30.0, 0.0, 0.0, 90.0, 2.0), (0.0, 1.0, 0.0, 30.0, 0.0, 90.0, None), (1.0, 2.0, -30.0, 0.0, 0.0, 90.0, 2.0), (1.0, 2.0, 0.0, 30.0, 0.0, 90.0, 4.0)]
    df = spark.createDataFrame(rows, "t0 double, t1 double, lat0 double, lat1 double, lon0 double, lon1 double, value double")
    assert values(space.space_mean(df, []), "t0") == pytest.approx([1.0, 3.0])


def test_globe_has_its_area_and_constant_mean(spark):
    grid = space.regular_grid(spark, 30.0).withColumns({"t0": F.lit(0.0), "t1": F.lit(1.0), "value": F.lit(7.0)})
    assert grid.agg(F.sum(space.area_column())).first()[0] == pytest.approx(4 * math.pi * scores.EARTH_RADIUS_M**2)
    assert values(space.space_mean(grid, [])) == pytest.approx([7.0])
    boxes = spark.createDataFrame([("one", 15.0, 45.0, 0.0, 45.0), ("none", 0.0, 1.0, 0.0, 1.0)], "label string, lat_min double, lat_max double, lon_min double, lon_max double")
    assert {(r["lat0"], r["lon0"]) for r in space.in_region(grid, boxes).collect()} == {(30.0, 0.0), (30.0, 30.0)}
    assert [r[0] for r in space.regions_with_data(grid, boxes).collect()] == ["one"]


def test_self_comparison(spark):
    grid = space.regular_grid(spark, 45.0).withColumn("value", F.col("lat0") + F.col("lon0") / 7)
    a, b = space.compose(grid, grid)
    assert a.count() == grid.count()
    assert compare.bias(a, b, CELL).filter("abs(value) > 1e-12").count() == 0
    row = compare.taylor(grid, grid, compare.paired(a, b, CELL), []).first()
    assert (row["sigma"], row["r"], row["score"]) == pytest.approx((1, 1, 1))


def test_nearest_prefers_the_lower_of_equals():
    assert [space.nearest([0.0, 10.0, 20.0], x) for x in (-5, 5, 5.1, 99)] == [0, 0, 1, 2]


def test_annual_cycle_and_phase(spark):
    months = [(1, y * 365 + m * 365 / 12, y * 365 + (m + 1) * 365 / 12, float(m if y else m + 1)) for y in range(2) for m in range(12)]
    cycle = time.annual_cycle(spark.createDataFrame(months, "cell int, t0 double, t1 double, value double"), ["cell"])
    assert values(cycle, "month") == [m + 0.5 for m in range(12)]
    assert time.time_of_extremum(cycle, ["cell"]).first()["month"] == 11
    assert time.time_of_extremum(series(spark, [None]).withColumn("month", F.lit(3)), ["cell"]).first()["month"] is None


def test_overlapping_pieces_are_refused(spark):
    with pytest.raises(ValueError):
        time.concatenate([series(spark, [1.0, 2.0]), series(spark, [1.0], start=45.0)], ["cell"])


def test_scores(spark):
    row = spark.range(1).select(
        scores.exp_score(F.lit(0.0), F.lit(2.0)).alias("a"), scores.exp_score(F.lit(1.0), F.lit(0.0)).alias("b"), scores.exp_score(F.lit(100.0), F.lit(1.0)).alias("c"),
        scores.cycle_score(F.lit(182.5)).alias("d"), scores.quantile_score(F.lit(3.0), F.lit(2.0)).alias("e"), scores.wrap_shift(F.lit(300.0)).alias("f"), scores.quantile_score(F.lit(None).cast("double"), F.lit(2.0)).alias("g"),
    ).first()
    assert row["a"] == 1 and row["b"] is None and row["c"] == 0 and row["d"] == pytest.approx(0) and row["e"] == 0 and row["f"] == -65 and row["g"] is None


CONFIG = """
#! title = a title
[h1: Carbon]
[h2: Production]
variable = "gpp"
skip_rmse = True
[One]
source = "a"
weight = 3
[Two]   # a comment
variable = "gpp2"
[h2: Other]
depths = 0, 100
[Three]
[h1: Water]
[h2: Runoff]
[Four]
"""


def test_configuration(spark):
    root = config.parse(CONFIG)
    assert config.parse_options(CONFIG) == {"title": "a title"}
    assert [n.name for n in root.walk()][1:] == ["Carbon", "Production", "One", "Two", "Other 0m", "Three", "Other 100m", "Three", "Water", "Runoff", "Four"]
    one, two = root.children[0].children[0].children
    assert (one.normal, one.values["variable"], two.values["variable"], config.flag(one, "skip_rmse")) == (0.75, "gpp", "gpp2", True)
    assert sum(n.overall for n in root.walk() if n.values.get("_leaf")) == pytest.approx(1.0)
    assert config.leaves(spark, root).count() == 5
    with pytest.raises(ValueError):
        config.parse("[h2: too deep]")


def test_roll_up_of_missing_scores(spark):
    rows = spark.createDataFrame([("s", "v", "a", 1.0, 0.5), ("s", "v", "b", 3.0, None)], "section string, variable string, source string, weight double, score double")
    score = lambda df: df.filter("level = 'variable'").first()["score"]
    assert score(scoreboard.roll_up(rows)) == 0.125 and score(scoreboard.roll_up(rows, skip_missing=True)) == 0.5
    assert '"variable":"v","score":0.125' in scoreboard.as_json(scoreboard.roll_up(rows)).first()["json"]


def test_signal_kernels():
    t = np.arange(0, 1460, 7.0)
    v = 3 + 0.001 * t + 2 * np.sin(2 * np.pi * t / 365)
    function, smooth, trend = signal.smooth_curve(t, v)
    assert np.abs(function - v).max() < 1e-6 and np.abs(smooth - v).max() < 1e-6 and np.abs(trend - 3 - 0.001 * t).max() < 1e-6
    active = np.where((np.arange(365) >= 100) & (np.arange(365) < 250), 1.0, 0.0)
    begin, end = signal.season_bounds(np.arange(365.0), active)
    assert abs(begin - 100) <= 2 and abs(end - 250) <= 2
    x = np.arange(12) * 365 / 12
    y = np.cos(2 * np.pi * x / 365)
    assert np.abs(signal.periodic_spline(x, y, 365.0, np.linspace(0, 730, 50)) - np.cos(2 * np.pi * np.linspace(0, 730, 50) / 365)).max() < 2e-3


def test_sources(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "siteA.csv").write_text("# made here\ndate,flow [m3 s-1],temp [degC]\n2020-01-01,1,5\n2020-01-01,3,\n2020-01-02,x,7\n")
    got = {(r["site"], r["variable"], str(r["day"])): (r["unit"], r["value"]) for r in fields.read_point_csv(spark, str(tmp_path / "p")).collect()}
    assert got[("siteA", "flow", "2020-01-01")] == ("m3 s-1", 2.0) and got[("siteA", "temp", "2020-01-02")] == ("degC", 7.0) and got[("siteA", "flow", "2020-01-02")][1] is None
    (tmp_path / "r.txt").write_text("# label,name\neuro,Europe,35,70,-10,30\n")
    assert fields.read_regions(spark, str(tmp_path / "r.txt")).first()["lat_max"] == 70
    rows = [("m", v, 0.0 + i, 1.0 + i, 190.0, 220.0, float("nan") if i else 2.0) for v in ("gpp", "old") for i in range(3)]
    df = spark.createDataFrame(rows, "model string, variable string, t0 double, t1 double, lon0 double, lon1 double, value double").withColumns({"lat0": F.lit(0.0), "lat1": F.lit(10.0)})
    fields.write_field(fields.normalised(df), str(tmp_path / "f"))
    back = fields.read_field(spark, str(tmp_path / "f"), "new", ["gpp", "old"], t0=1.0)
    assert {(r["variable"], r["t0"], r["value"], r["lon0"]) for r in back.collect()} == {("gpp", 1.0, None, -170.0), ("gpp", 2.0, None, -170.0)}
    assert fields.catalog(spark, str(tmp_path / "f")).count() == 2
    manifest = spark.createDataFrame([("00", "siteA.csv"), ("00", "gone.csv")], "sha1 string, file string")
    assert {(r["file"], r["state"]) for r in fields.check_manifest(spark, str(tmp_path / "p"), manifest).collect()} == {("siteA.csv", "differs"), ("gone.csv", "missing")}


def test_streaming_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("site"), F.col("ts").cast("timestamp").alias("ts"), "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = windows.windowed_mean(stream).writeStream.format("memory").queryName("means").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    batch = events.groupBy("site", F.window("ts", "1 day").alias("w")).agg(F.avg("value").alias("v"))
    assert spark.table("means").count() == batch.count()
    assert spark.table("means").agg(F.sum("value")).first()[0] == pytest.approx(batch.agg(F.sum("v")).first()[0])
    assert windows.active_seasons(events).agg(F.sum("n")).first()[0] == events.count()


def grid(spark, rows):
    """Rows of t0, t1, lat0, lat1, lon0, lon1, value."""
    return spark.createDataFrame(rows, "t0 double, t1 double, lat0 double, lat1 double, lon0 double, lon1 double, value double")


def months(spark, n, start=0.0, value=1.0, lat0=0.0):
    return grid(spark, [(start + 30.0 * i, start + 30.0 * (i + 1), lat0, lat0 + 10.0, 0.0, 10.0, value * i) for i in range(n)])


def test_fields_that_are_not_comparable(spark):
    ref = months(spark, 6)
    with pytest.raises(alignment.NotTemporal):
        alignment.comparable(ref, ref.drop("t0", "t1"))
    with pytest.raises(alignment.NotComparable):
        alignment.comparable(ref, months(spark, 3), clip_ref=False)
    with pytest.raises(alignment.NotComparable):
        alignment.comparable(ref.withColumn("site", F.lit(1)).drop(*CELL), ref)
    with pytest.raises(alignment.NotLayered):
        layers = ref.withColumns({"z0": F.lit(0.0), "z1": F.lit(1.0)})
        alignment.comparable(layers.unionByName(layers.withColumns({"z0": F.lit(1.0), "z1": F.lit(2.0)})), ref)
    with pytest.raises(units.UnitConversionError):
        alignment.comparable(ref, ref, "K", "m")


def test_comparable_drops_a_first_interval_and_reads_grids_at_sites(spark):
    a, b = alignment.comparable(months(spark, 6), months(spark, 5, start=30.0), clip_ref=False)
    assert (a.count(), b.count()) == (5, 5) and a.agg(F.min("t0")).first()[0] == 30.0
    sites = spark.createDataFrame([(7, 4.0, 3.0)], "site long, lat double, lon double")
    ref = months(spark, 4).select(F.lit(7).cast("long").alias("site"), "t0", "t1", "value")
    a, b = alignment.comparable(ref, months(spark, 4, value=2.0), "km", "m", sites)
    assert values(b, "t0") == [0.0, 0.002, 0.004, 0.006] and "lat0" not in b.columns


def test_comparable_layers(spark):
    ref = months(spark, 2).withColumns({"z0": F.lit(0.0), "z1": F.lit(2.0)})
    deep = months(spark, 2)
    com = deep.withColumns({"z0": F.lit(0.0), "z1": F.lit(1.0)}).unionByName(deep.withColumns({"z0": F.lit(1.0), "z1": F.lit(3.0), "value": F.lit(5.0)}))
    a, b = alignment.comparable(ref, com)
    assert values(b, "t0") == [2.5, 3.0] and "z0" not in a.columns


def test_trim_of_limits_on_edges(spark):
    df = grid(spark, [(0.0, 1.0, a, a + 10.0, 0.0, 10.0, a) for a in (-20.0, -10.0, 0.0, 10.0)])
    assert sorted(values(space.trimmed(df, lat=(-10.0, 10.0)))) == [-20.0, -10.0, 0.0]
    assert sorted(values(space.trimmed(df, lat=(-500.0, 500.0)))) == [-20.0, -10.0, 0.0, 10.0]
    assert space.trimmed(df.filter("false"), lat=(0.0, 1.0)).count() == 0


def test_interval_join_with_one_very_long_interval(spark):
    left = spark.createDataFrame([(float(i), float(i + 1)) for i in range(1000)], "t0 double, t1 double")
    right = spark.createDataFrame([(0.0, 1000.0), (3.0, 4.0), (3.5, 5.5)], "b0 double, b1 double")
    got = time.interval_join(left, right, ("t0", "t1"), ("b0", "b1"))
    assert got.count() == 1000 + 1 + 3 and got.distinct().count() == got.count()


def test_quantiles_of_equal_values_and_groups(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.integers(0, 4, 500).astype(float), "b": rng.normal(0, 1, 777), "c": np.array([2.5]), "d": np.full(50, 7.0)}
    df = spark.createDataFrame([(k, float(v)) for k, own in groups.items() for v in own] + [("b", None)], "k string, v double")
    got = {(r["k"], r["quantile"]): r["value"] for r in compare.exact_quantiles(df, ["k"], F.col("v"), [0.0, 0.25, 0.9, 1.0]).collect()}
    assert got == {(k, q): pytest.approx(np.quantile(v, q)) for k, v in groups.items() for q in (0.0, 0.25, 0.9, 1.0)}
    assert compare.exact_quantiles(df.filter("false"), ["k"], F.col("v"), [0.5]).count() == 0


def test_noleap_days_and_year(spark):
    days = spark.sql("SELECT timestamp'2024-02-28 12:00:00' AS a, timestamp'2024-02-29 12:00:00' AS b, timestamp'2024-03-01 00:00:00' AS c, timestamp'1850-01-01 06:00:00' AS d")
    a, b, c, d = days.select(*(time.noleap_day(F.col(x)) for x in "abcd")).first()
    assert (a, b, c, d) == (174 * 365 + 58.5, 174 * 365 + 59.0, 174 * 365 + 59.0, 0.25)


def test_read_times_finds_gaps(spark):
    df = series(spark, [1.0, 2.0, 3.0, 4.0])
    assert values(time.read_times(df, ["cell"], 30.2, 120.0), "t0") == [2.0, 3.0, 4.0]
    with pytest.raises(ValueError):
        time.read_times(df.filter("value <> 2"), ["cell"], 0.0, 200.0)


def test_six_digits(spark):
    numbers = [0.5, 0.0, 123456.7, 1234567.0, 0.00001234567, -2.25, 1e-4, 100.0, None, 2 / 3, 99999.96]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    assert [r[1] for r in sorted(df.select("i", scoreboard.six_digits(F.col("x"))).collect())] == ["nan" if x is None else f"{x:g}" for x in numbers]


def test_configuration_round_trip_and_models():
    text = '[h1: A]\n[h2: B]\nweight = 5\n[C]\nsource = "x"\n[D]\nweight = 2\n'
    root = config.parse(text)
    again = config.from_json(config.to_json(root))
    assert [(n.name, n.overall) for n in again.walk()] == [(n.name, n.overall) for n in root.walk()]
    assert config.parse_models("# models\nA, /data/a\nB, /data/b, 150 # later\n") == [("A", "/data/a", 0.0), ("B", "/data/b", 150.0)]
    with pytest.raises(ValueError):
        config.parse_models("only a name")
    assert [leaf.name for _, _, leaf in run.selected(root, ["B/C", "C"])] == ["C"] and run.selected(root, ["Z"]) == []


def test_programs_of_ones_own(spark):
    root = config.parse('[h1: A]\n[h2: B]\nvariable = "v"\n[C]\nctype = "count"\n')
    run.register("count", lambda node, ref, com, regions: com.groupBy("model").agg(F.count("value").cast("double").alias("value")).select("model", F.lit("global").alias("region"), F.lit("Own Score").alias("scalar"), "value"))
    ref = months(spark, 3)
    out = run.run(root, run.Fields(lambda n: ref, lambda n: ref.withColumn("model", F.lit("m"))), spark.createDataFrame([], "label string, lat_min double, lat_max double, lon_min double, lon_max double"))
    assert sorted((r["scalar"], r["value"]) for r in out.collect()) == [("Overall Score", 3.0), ("Own Score", 3.0)]
    with pytest.raises(ValueError):
        run.run(root, run.Fields(lambda n: None, lambda n: None), ref)


def test_missing_sections_weigh_in(spark):
    rows = [("s", "v", "x", 1.0, 3.0, 2.0, 0.8), ("s", "w", "x", 1.0, 1.0, 2.0, None), ("t", "u", "x", 1.0, 1.0, 1.0, 0.4)]
    leaves = spark.createDataFrame(rows, "section string, variable string, source string, weight double, variable_weight double, section_weight double, score double")
    at = lambda skip: {(r["level"], r["section"]): r["score"] for r in scoreboard.roll_up(leaves, skip).filter("level in ('section', 'whole')").collect()}
    assert at(False) == {("section", "s"): pytest.approx(0.6), ("section", "t"): pytest.approx(0.4), ("whole", None): pytest.approx(1.6 / 3)}
    assert at(True)[("section", "s")] == pytest.approx(0.8)


def test_spline_by_site(spark):
    days = np.arange(0, 365, 15.0)
    df = spark.createDataFrame([(s, float(d), math.sin(2 * math.pi * (d - 30 * s) / 365)) for s in (1, 2) for d in days] + [(3, 0.0, 1.0)], "site long, t double, value double")
    got = {r["site"]: r for r in signal.cycle_extremes(df).collect()}
    assert set(got) == {1, 2}
    for s in (1, 2):
        assert got[s]["amplitude"] == pytest.approx(2.0, abs=1e-3) and got[s]["t_max"] == pytest.approx(365 / 4 + 30 * s, abs=1.0)


def test_bilinear_goes_round(spark):
    cells = [(0.0, 1.0, 0.0, 90.0, a, a + 90.0, a) for a in (-180.0, -90.0, 0.0, 90.0)]
    points = spark.createDataFrame([(1, 45.0, 180.0), (2, 45.0, -45.0)], "site long, lat double, lon double")
    got = {r["site"]: r["value"] for r in lookup.bilinear(grid(spark, cells), points, 90.0).collect()}
    assert got == {1: pytest.approx(-45.0), 2: pytest.approx(-90.0)}


def test_net_balance_without_bounds_has_no_path_score(spark):
    df = series(spark, [1.0, 2.0, 3.0]).drop("cell")
    row = analyses.net_balance(df, df.withColumn("value", F.col("value") + 0.1)).first()
    assert row["trajectory_score"] is None and row["diff"] == pytest.approx(9.0) and row["difference_score"] == pytest.approx(math.exp(-0.287 * 9 / 10.8))


def test_statistics_of_a_field(spark):
    from gridloom.sources import fields as sources

    row = sources.with_statistics(series(spark, [float(i) for i in range(101)] + [None]), ["cell"]).first()
    assert (row["min"], row["dn99"], row["up99"], row["max"], row["n"]) == (0.0, 1.0, 99.0, 100.0, 101)


def test_manifest_by_path(spark, tmp_path):
    import hashlib

    for d, text in (("a", b"one"), ("b", b"two")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.nc").write_bytes(text)
    rows = [(hashlib.sha1(b"one").hexdigest(), "a/x.nc"), (hashlib.sha1(b"one").hexdigest(), "b/x.nc"), ("0", "c/x.nc")]
    bad = fields.check_manifest(spark, str(tmp_path), spark.createDataFrame(rows, "sha1 string, file string"))
    assert sorted(tuple(r) for r in bad.collect()) == [("b/x.nc", "differs"), ("c/x.nc", "missing")]


def test_variables_of_a_table(spark):
    df = spark.createDataFrame([], "t0 double, t1 double, lat0 double, gpp double, gpp_lo double, gpp_hi double, le double, model string")
    assert fields.variables(df) == ["gpp", "le"]


def test_phase_is_defined_by_a_yearly_peak():
    t = np.arange(60) * (365 / 12)
    yearly, half = np.sin(2 * np.pi * t / 365), np.sin(4 * np.pi * t / 365)
    gap = yearly.copy()
    gap[[20, 41]] = np.nan
    assert signal.phase_defined(yearly, 365 / 12) and not signal.phase_defined(half + 0.2 * yearly, 365 / 12)
    assert not signal.phase_defined(gap, 365 / 12) and not signal.phase_defined(np.full(40, np.nan), 365 / 12)


def test_growth_is_the_slope_of_the_trend(spark):
    rows = [(1, 30.0 * i, 2.0 * i + math.sin(2 * math.pi * 30 * i / 365)) for i in range(80)]
    got = [r["growth"] for r in signal.smooth_sites(spark.createDataFrame(rows, "site long, t double, value double")).collect()]
    assert np.median(got) == pytest.approx(2 * 365 / 30, rel=0.02)


def near_sites(spark, a, b, radius):
    """Frames of both, and by site the nearest place's distance and least name by all pairs in numpy."""
    frames = [spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(p)], ddl) for p, ddl in ((a, "site long, lat double, lon double"), (b, "other long, lat2 double, lon2 double"))]
    expected = {}
    for i, place in enumerate(a):
        y, x = (place - b).T
        d = np.sqrt(y * y + x * x)
        if np.nanmin(d) < radius:
            expected[i] = (np.nanmin(d), np.nanargmin(d))
    return frames, expected


def rows_joined(df):
    """The most rows that a join of the run plan gave."""

    def visit(node):
        name = node.getClass().getSimpleName()
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        found = node.metrics().get("numOutputRows") if "Join" in name else None
        return max([found.get().value() if found is not None and found.isDefined() else 0, *map(visit, inner)])

    return visit(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("layout", ["spread", "ties", "clusters"])
def test_nearest_sites_are_exact_at_all_levels(spark, layout):
    rng = np.random.default_rng(4)
    if layout == "spread":
        a, b = (rng.uniform((-60, -180), (60, 180), (400, 2)) for _ in range(2))
        a[0], b[0], b[1] = (np.inf, 0), (1e30, 0), (0, np.nan)
    elif layout == "ties":
        a, b = rng.integers(-12, 12, (400, 2)).astype(float), rng.integers(-12, 12, (400, 2)) + 0.5
    else:
        a, b = np.concatenate([rng.uniform(0, 1, (200, 2)), rng.uniform(40, 40.001, (200, 2))]), rng.uniform(40, 40.01, (400, 2))
    (sites, others), expected = near_sites(spark, a, b, 20.0)
    got = {r["site"]: (r["distance"], r["other"]) for r in lookup.sites_within(sites, others, 20.0).collect()}
    assert len(expected) >= 200 and got == expected


@pytest.mark.parametrize("layout", ["one place", "dense"])
def test_nearest_sites_do_not_meet_all_in_the_radius(spark, layout):
    rng = np.random.default_rng(4)
    a, b = (np.full((2000, 2), k) if layout == "one place" else rng.uniform(0, 10, (2000, 2)) for k in (1.0, 2.0))
    (sites, others), expected = near_sites(spark, a, b, 60.0)
    df = lookup.sites_within(sites, others, 60.0)
    assert {r["site"]: (r["distance"], r["other"]) for r in df.collect()} == expected
    assert 2000 <= rows_joined(df) < 2000 * 200
