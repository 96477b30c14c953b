"""A run: from a configuration and the fields of models to the weighted scoreboard."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import CELL
from ..operators.space import in_region
from ..operators.time import integrate
from ..sources.store import Store, written
from . import config, mean_state, scoreboard
from .alignment import comparable, model_groups

#: A program takes (node, reference, models, regions) and returns ``model``, ``region``, ``scalar``, ``value``.
Program = Callable[[config.Node, DataFrame, DataFrame, DataFrame], DataFrame]


def default_program(node: config.Node, ref: DataFrame, com: DataFrame, regions: DataFrame) -> DataFrame:
    """The mean state of grids or sites, with the node's flags."""
    skip = tuple(f for f in mean_state.SKIPPED if config.flag(node, f))
    basis = node.values.get("rmse_score_basis", "cycle")
    if "site" in ref.columns:
        return mean_state.site_state(ref, com, basis, skip).withColumn("region", F.lit("global"))
    return mean_state.mean_state(ref, com, regions, basis, config.flag(node, "mass_weighting"), skip)


PROGRAMS: dict[str, Program] = {"default": default_program}
#: Programs that take the fields as they are.
RAW: set[str] = set()


def register(name: str, program: Program, raw: bool = False) -> None:
    """Programs of one's own, by the ``ctype`` of a dataset; ``raw`` ones make the fields comparable themselves."""
    PROGRAMS[name] = program
    (RAW.add if raw else RAW.discard)(name)


@dataclass
class Fields:
    """Where the fields of a run come from: ``reference(node)`` and ``models(node)``, and the sites of site references."""

    reference: Callable[[config.Node], DataFrame | None]
    models: Callable[[config.Node], DataFrame | None]
    sites: Callable[[config.Node], DataFrame] | None = None


def selected(root: config.Node, names: list[str]) -> list[tuple[config.Node, config.Node, config.Node]]:
    """Section, variable and dataset of each leaf whose long name holds one of ``names`` (all without any), once each."""
    found = [(h1, h2, leaf) for h1 in root.children for h2 in h1.children for leaf in h2.children]
    return [x for x in found if not names or any(n in "/".join(part.name for part in x) for n in names)]


def required(root: config.Node) -> dict[str, list[str]]:
    """Which variables each dataset needs, the names that may stand for one together."""
    out = {}
    for h1, h2, leaf in selected(root, []):
        names = leaf.values.get("derived") or leaf.values.get("variable", "")
        others = [n.strip() for n in leaf.values.get("alternate_vars", "").split(",") if n.strip()]
        out[f"{h1.name}/{h2.name}/{leaf.name}"] = [names, *others]
    return out


def missing(spark: SparkSession, root: config.Node, catalog: DataFrame) -> DataFrame:
    """``model``, ``dataset``: what each model of the ``catalog`` (model, variable) lacks a variable for."""
    rows = [(name, v) for name, names in required(root).items() for v in names if v]
    wanted = spark.createDataFrame(rows, "dataset string, variable string")
    models = catalog.select("model").distinct()
    have = catalog.join(wanted, "variable").select("model", "dataset").distinct()
    datasets = wanted.select(F.lit(0).alias("_k"), "dataset").distinct()
    return models.withColumn("_k", F.lit(0)).join(datasets, "_k").drop("_k").join(have, ["model", "dataset"], "left_anti")


SCALARS = "section string, variable string, source string, model string, region string, scalar string, value double"
MAPS = "model string, lat0 double, lat1 double, lon0 double, lon1 double, value double"
#: The name that the reference's own maps go by.
BENCHMARK = "Benchmark"


def _time_means(df: DataFrame, model: Column) -> DataFrame:
    keys = ["model", *CELL] if "model" in df.columns else CELL
    mean = integrate(df, keys, mean=True) if "t0" in df.columns else df
    return mean.select(model.alias("model"), *CELL, F.col("value").cast("double").alias("value"))


#: Datasets worked on at the same time; each is a chain of jobs, which leave executors idle in between.
AT_ONCE = 4


def run(root: config.Node, fields: Fields, regions: DataFrame, names: list[str] | None = None, store: Store | None = None) -> DataFrame:
    """``section``, ``variable``, ``source``, ``model``, ``region``, ``scalar``, ``value`` of all datasets, with the overall
    score of each; datasets without data give no rows.

    What each dataset gives for a group of models of one clock is written to the ``store`` (scalars, and maps of time means
    of grids for ``relationships``), so all that follows reads a small table. A run on a store goes on where an earlier one
    ended. What fails is noted there and leaves the others whole.
    """
    store = store or Store(regions.sparkSession)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        work = [pool.submit(inheritable_thread_target(regions.sparkSession)(_dataset), *own, fields, regions, store) for own in selected(root, names or [])]
        if not any([w.result() for w in work]):
            raise ValueError("no dataset of the configuration has data")
    out = store.read("scalars", SCALARS).drop("dataset")
    keys = ["section", "variable", "source", "model", "region"]
    overall = scoreboard.overall_score(out.withColumnsRenamed({"scalar": "metric", "value": "data"}), keys)
    return out.unionByName(overall.select(*keys, F.lit("Overall Score").alias("scalar"), F.col("score").alias("value")))


def _dataset(h1: config.Node, h2: config.Node, leaf: config.Node, fields: Fields, regions: DataFrame, store: Store) -> bool:
    """Put what the store lacks of a dataset there, model group by model group; whether it has data."""
    key, models = f"{h1.name}/{h2.name}/{leaf.name}", ["*"]
    try:
        ref, com = fields.reference(leaf), fields.models(leaf)
        if ref is None or com is None:
            return False
        models = sorted(r["model"] for r in store.missing(key, com).collect())  # a row a model
        if set(CELL) <= set(ref.columns) and store.missing(key, regions.sparkSession.createDataFrame([(BENCHMARK,)], "model string")).count():
            store.put(key, [BENCHMARK], {"maps": _time_means(ref, F.lit(BENCHMARK))})
        com = com.filter(F.col("model").isin(models)).withColumn("value", F.col("value") * float(leaf.values.get("scale_factor", 1)))
        groups = model_groups(com) if models else []
    except Exception as error:  # whatever a dataset's fields raise, the others go on
        store.fail(key, models, error)
        return True
    for group in groups:
        try:
            store.put(key, group, _results(h1, h2, leaf, fields, ref, com.filter(F.col("model").isin(group)), regions))
        except Exception as error:
            store.fail(key, group, error)
    return True


def _results(h1: config.Node, h2: config.Node, leaf: config.Node, fields: Fields, ref: DataFrame, com: DataFrame, regions: DataFrame) -> dict[str, DataFrame]:
    """The tables of one dataset for models of one clock."""
    unit = leaf.values.get("unit", "1")
    if leaf.values.get("ctype", "default") not in RAW:
        ref, com = comparable(ref, com, unit, leaf.values.get("model_unit", unit), fields.sites(leaf) if fields.sites else None)
    scalars = PROGRAMS[leaf.values.get("ctype", "default")](leaf, ref, com, regions)
    named = scalars.select(F.lit(h1.name).alias("section"), F.lit(h2.name).alias("variable"), F.lit(leaf.name).alias("source"), "model", "region", "scalar", F.col("value").cast("double").alias("value"))
    return {"scalars": named, "maps": _time_means(com, F.col("model"))} if set(CELL) <= set(com.columns) else {"scalars": named}


def related(root: config.Node) -> list[tuple[str, str, str]]:
    """Dependent dataset, independent dataset and the latter's short name, from the ``relationships`` keys, which list
    ``variable/source`` of other datasets."""
    keys = {f"{h2.name}/{leaf.name}": f"{h1.name}/{h2.name}/{leaf.name}" for h1, h2, leaf in selected(root, [])}
    out = []
    for h1, h2, leaf in selected(root, []):
        for name in (n.strip().strip("\"'") for n in leaf.values.get("relationships", "").split(",")):
            if name in keys:
                out.append((f"{h1.name}/{h2.name}/{leaf.name}", keys[name], name))
    return out


def relationships(root: config.Node, store: Store, regions: DataFrame, n: int = 25, least_share: float = 3e-3) -> DataFrame:
    """``section``, ``variable``, ``source``, ``model``, ``region``, ``scalar``, ``value``: for each pair of datasets that the
    configuration relates and each model, how alike the model's relationship of their time means is to the reference's, by
    region: the Hellinger score of their histograms and the score of their mean responses.

    One job for all pairs, models and regions over the written maps; bins span all models' values of a dataset. Maps of a
    pair meet where their cells are the same. Histograms without a common bin score 1, responses without one have no row.
    """
    spark = regions.sparkSession
    maps = store.read("maps", MAPS).filter("value is not null")
    pairs = spark.createDataFrame(related(root), "dep string, ind string, name string")
    spans = maps.groupBy("dataset").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    side = lambda which, v: maps.join(spans, "dataset").select(F.col("dataset").alias(which), "model", *CELL, F.col("value").alias(v), F.col("lo").alias(f"{v}_lo"), F.col("hi").alias(f"{v}_hi"))
    points = pairs.join(side("dep", "y"), "dep").join(side("ind", "x"), ["ind", "model", *CELL])
    bin_of = lambda v: F.least(F.greatest(F.coalesce(F.floor(F.try_divide((F.col(v) - F.col(f"{v}_lo")) * n, F.col(f"{v}_hi") - F.col(f"{v}_lo"))), F.lit(0)), F.lit(0)), F.lit(n - 1)).cast("int")
    keys = ["dep", "name", "region"]
    counts = in_region(points, regions).groupBy(*keys, "model", bin_of("x").alias("bin_x"), bin_of("y").alias("bin_y")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    counts = written(counts, "relations")
    whole = counts.groupBy(*keys, "model").agg(F.sum("n").alias("whole"))
    shares = counts.join(whole, [*keys, "model"]).select(*keys, "model", "bin_x", "bin_y", (F.col("n") / F.col("whole")).alias("p"))
    means = counts.groupBy(*keys, "model", "bin_x").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).join(whole, [*keys, "model"])
    means = means.filter(F.col("n") / F.col("whole") >= least_share).select(*keys, "model", "bin_x", (F.col("s") / F.col("n")).alias("m"))

    def against(df: DataFrame, on: list[str], value: str) -> DataFrame:
        own = df.filter(F.col("model") == BENCHMARK).drop("model").withColumnRenamed(value, "a")
        return df.filter(F.col("model") != BENCHMARK).withColumnRenamed(value, "b").join(own, [*keys, *on])

    off = against(shares, ["bin_x", "bin_y"], "p").groupBy(*keys, "model").agg(F.sum(F.pow(F.sqrt("a") - F.sqrt("b"), F.lit(2))).alias("off"))
    distance = against(whole, [], "whole").join(off, [*keys, "model"], "left").select(*keys, "model", F.lit("Hellinger Distance").alias("kind"), (1 - F.sqrt(F.coalesce("off", F.lit(0.0))) / F.sqrt(F.lit(2.0))).alias("value"))
    responses = against(means, ["bin_x"], "m").groupBy(*keys, "model").agg(F.exp(-F.try_divide(F.sqrt(F.sum(F.pow(F.col("a") - F.col("b"), F.lit(2)))), F.sqrt(F.sum(F.col("a") * F.col("a"))))).alias("value"))
    both = distance.unionByName(responses.filter("value is not null").select(*keys, "model", F.lit("Score").alias("kind"), "value"))
    section, variable, source = (F.element_at(F.split("dep", "/"), i).alias(c) for i, c in ((1, "section"), (2, "variable"), (3, "source")))
    return both.select(section, variable, source, "model", "region", F.concat(F.replace("name", F.lit("/"), F.lit("|")), F.lit(" "), F.col("kind")).alias("scalar"), "value")


def weighted_leaves(spark: SparkSession, root: config.Node, scalars: DataFrame, region: str = "global", scalar: str = "Overall Score") -> DataFrame:
    """The configuration's leaves with their weights, for each model, and the score of each (null without one)."""
    tree = config.leaves(spark, root)
    models = scalars.select("model").distinct().withColumn("_k", F.lit(0))
    own = scalars.filter((F.col("region") == region) & (F.col("scalar") == scalar)).select("section", "variable", "source", "model", F.col("value").alias("score"))
    return tree.withColumn("_k", F.lit(0)).join(models, "_k").drop("_k").join(own, ["section", "variable", "source", "model"], "left")
