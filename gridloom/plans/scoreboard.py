"""Roll-ups of scores through the weighted tree, and their tables and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of each score in the overall one; what is not named counts 1.
METRIC_WEIGHTS = {"Bias Score": 1.0, "RMSE Score": 2.0, "Seasonal Cycle Score": 1.0, "Interannual Variability Score": 1.0, "Spatial Distribution Score": 1.0}
MISSING = -999.0


def overall_score(scalars: DataFrame, keys: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean of all score rows (``metric``, ``data``) by ``keys``; null if the scores sum to nothing."""
    weights = METRIC_WEIGHTS if weights is None else weights
    w = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("metric")), F.lit(1.0))
    rows = scalars.filter(F.col("metric").endswith("Score") & F.col("data").isNotNull())
    out = rows.groupBy(*keys).agg(F.sum(F.col("data") * w).alias("_s"), F.sum(w).alias("_w"))
    return out.select(*keys, F.when(F.abs("_s") >= 1e-12, F.col("_s") / F.col("_w")).alias("score"))


def weighted_mean(rows: DataFrame, keys: list[str], value: str = "score", weight: str = "weight") -> DataFrame:
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(value))


def roll_up(leaves: DataFrame, skip_missing: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Scores of datasets (section, variable, source, weight, score) to variables, sections and the whole, weighted at each
    level: by ``weight`` within a variable, ``variable_weight`` within a section, ``section_weight`` in the whole (each 1
    where there is no such column).

    A child without a score counts as zero with its full weight, unless ``skip_missing``. ``keys``, such as the model, are
    kept apart. One row per node: keys, level, section, variable, source, score.
    """
    for c in ("variable_weight", "section_weight"):
        if c not in leaves.columns:
            leaves = leaves.withColumn(c, F.lit(1.0))
    keep = lambda df: df.filter("score is not null") if skip_missing else df.withColumn("score", F.coalesce("score", F.lit(0.0)))
    none = F.lit(None).cast("string")
    rows = keep(leaves)
    above = [*keys, "section", "section_weight"]
    variables = keep(weighted_mean(rows, [*above, "variable", "variable_weight"]))
    sections = keep(weighted_mean(variables, above, weight="variable_weight"))
    whole = weighted_mean(sections.withColumn("_k", F.lit(0)), [*keys, "_k"], weight="section_weight")

    def level(df: DataFrame, name: str, *names: str) -> DataFrame:
        own = [F.col(c) if c in names else none.alias(c) for c in ("section", "variable", "source")]
        return df.select(*keys, F.lit(name).alias("level"), *own, "score")

    out = level(rows, "source", "section", "variable", "source").unionByName(level(variables, "variable", "section", "variable"))
    return out.unionByName(level(sections, "section", "section")).unionByName(level(whole, "whole"))


def z_score(value: Column, keys: list[str]) -> Column:
    """(x - mean) / max(std, 0.02) across models, the divisor 1 where std is nil; -999 where missing."""
    own = Window.partitionBy(*keys)
    std = F.stddev_pop(value).over(own)
    return F.coalesce((value - F.avg(value).over(own)) / F.when(std <= 1e-12, F.lit(1.0)).otherwise(F.greatest(std, F.lit(0.02))), F.lit(MISSING))


def six_digits(value: Column) -> Column:
    """A number in six significant digits without trailing zeros, in text; an exponent below 1e-4 and from 1e6 on; nan for
    null."""
    text = F.format_string("%.5e", value)
    digits = F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)e", 1), r"\.?0+$", "")
    power = F.regexp_extract(text, r"e([+-][0-9]+)$", 1)
    exponent = power.cast("int")
    plain = F.format_string("%.10f", text.cast("double"))
    trimmed = F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.$", "")
    return F.when(value.isNull() | F.isnan(value), "nan").when(value == 0, "0").when((exponent < -4) | (exponent >= 6), F.concat(digits, F.lit("e"), power)).otherwise(trimmed)


def scalar_table(scalars: DataFrame) -> DataFrame:
    """The eleven columns of the scalar table, numbers in six significant digits, in text."""
    names = ("Section", "Variable", "Source", "Model", "ScalarName", "AnalysisType", "Region", "ScalarType", "Units")
    return scalars.select(*(F.col(n.lower()).alias(n) for n in names), six_digits(F.col("data")).alias("Data"), F.col("weight").alias("Weight"))


def sorted_regions(regions: DataFrame) -> DataFrame:
    """``label`` and ``place``: the whole globe first, then by label."""
    first = F.when(F.col("label") == "global", 0).when(F.col("label") == "globe", 1).otherwise(2)
    return regions.select("label", F.row_number().over(Window.orderBy(first, "label")).alias("place"))


def sorted_models(models: DataFrame, benchmark: str = "Benchmark") -> DataFrame:
    """``model`` and ``place``: the benchmark first, then by upper-case name."""
    return models.select("model").distinct().withColumn("place", F.row_number().over(Window.orderBy(F.col("model") != benchmark, F.upper("model"), "model")))


def metric_order(names: DataFrame, priority: list[str]) -> DataFrame:
    """``scalar`` and ``place``: by the sum of 2^i over the i-th words of ``priority`` that a name holds, then by name."""
    value = sum((F.when(F.col("scalar").contains(word), 1 << i).otherwise(0) for i, word in enumerate(priority)), F.lit(0))
    return names.select("scalar").distinct().withColumn("place", F.row_number().over(Window.orderBy(value, "scalar")))


def result_json(rolled: DataFrame, keys: str = "model") -> DataFrame:
    """One JSON text per model: its sections' scores, each with its variables', in order of their names."""
    named = lambda level, *names: rolled.filter(F.col("level") == level).select(keys, *names, F.round("score", 6).alias("score"))
    variables = named("variable", "section", "variable").groupBy(keys, "section").agg(F.sort_array(F.collect_list(F.struct("variable", "score"))).alias("variables"))
    sections = named("section", "section").join(variables, [keys, "section"]).groupBy(keys).agg(F.sort_array(F.collect_list(F.struct("section", "score", "variables"))).alias("sections"))
    whole = named("whole").withColumnRenamed("score", "overall").join(sections, keys)
    return whole.select(keys, F.to_json(F.struct(F.lit("v1").alias("schema"), F.col(keys), "overall", "sections")).alias("json"))


def as_json(rolled: DataFrame) -> DataFrame:
    """One JSON text per section with its variables' scores in order of their names; built by aggregates."""
    variables = rolled.filter("level = 'variable'").groupBy("section").agg(F.sort_array(F.collect_list(F.struct("variable", F.round("score", 6).alias("score")))).alias("variables"))
    sections = rolled.filter("level = 'section'").select("section", F.round("score", 6).alias("score"))
    return sections.join(variables, "section").select("section", F.to_json(F.struct("section", "score", "variables")).alias("json"))


#: Words that put a statistic's name in its place among others.
STATISTIC_WORDS = ("overall", "bias", "rmse", "cycle", "interannual", "spatial")


def spaced(name: Column) -> Column:
    """A name with a space before each capital that follows a small letter."""
    return F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")


def metric_means(scores: DataFrame) -> DataFrame:
    """``region``, ``model``, ``metric``, ``statistic``, ``value``: means of scores (section, variable, source, model, region, scalar,
    value, weight), weighted, of sections, of variables in them (``section::variable``) and of datasets in these (and
    ``!!source``): one pass of grouping sets."""
    rows = scores.filter("value is not null").select("region", "model", spaced(F.col("scalar")).alias("statistic"), "section", "variable", "source", "value", "weight")
    sets = F.explode(F.array(*(F.struct(*(F.col(c).alias(c) if k > i else F.lit(None).cast("string").alias(c) for i, c in enumerate(("section", "variable", "source")))) for k in (1, 2, 3))))
    levels = rows.withColumn("_l", sets).groupBy("region", "model", "statistic", "_l").agg(F.try_divide(F.sum(F.col("value") * F.col("weight")), F.sum("weight")).alias("value"))
    metric = F.concat("_l.section", F.coalesce(F.concat(F.lit("::"), F.col("_l.variable")), F.lit("")), F.coalesce(F.concat(F.lit("!!"), F.col("_l.source")), F.lit("")))
    return levels.select("region", "model", metric.alias("metric"), "statistic", "value")


def _as_map(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """By ``keys`` the map of ``name`` to ``value``, in the order of names."""
    entries = F.collect_list(F.struct(F.col(name).alias("key"), F.col(value).alias("value")))
    made = F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return df.groupBy(*keys).agg(made.alias(value)) if keys else df.agg(made.alias(value))


def cmec_document(scores: DataFrame, regions: DataFrame, models: DataFrame) -> DataFrame:
    """One JSON text in the CMEC v1 structure: dimensions (regions with ``label``, ``name``, ``generator``; models with ``model``,
    ``description``, ``source``; metrics; statistics in the order of STATISTIC_WORDS) and results by region, model, metric and
    statistic. Everything is joined and put into maps by aggregates; the document is as large as the table of means."""
    means = metric_means(scores)
    place = F.lit(1)
    for i, word in enumerate(STATISTIC_WORDS):
        place = place * F.when(F.lower("scalar").contains(word), 2**i).otherwise(1)
    found = F.greatest(*(F.lower("scalar").contains(w) for w in STATISTIC_WORDS))
    names = scores.select("scalar").distinct().select(F.when(found, place).otherwise(2**6).alias("place"), "scalar")
    ordered = names.agg(F.sort_array(F.collect_list(F.struct("place", "scalar"))).alias("s"))
    statistic = ordered.select(F.struct(F.transform("s", lambda x: spaced(x["scalar"])).alias("indices"), F.transform("s", lambda x: x["scalar"]).alias("short_names")).alias("statistic"))
    known = scores.select(F.col("region").alias("label")).distinct().join(regions, "label")
    region = _as_map(known.select("label", F.struct(F.col("name").alias("LongName"), F.col("name").alias("Description"), F.col("generator").alias("Generator")).alias("region")), [], "label", "region")
    about = scores.select("model").distinct().join(models, "model", "left")
    model = _as_map(about.select("model", F.struct(F.coalesce("description", F.lit("")).alias("Description"), F.coalesce("source", F.lit("")).alias("Source")).alias("of")).withColumnRenamed("of", "models"), [], "model", "models")
    abstract = F.when(F.col("metric").contains("!!"), "benchmark score").otherwise("composite score")
    metric = _as_map(means.select("metric").distinct().select("metric", F.struct(F.col("metric").alias("Name"), abstract.alias("Abstract")).alias("metrics")), [], "metric", "metrics")
    results = means.join(known.select(F.col("label").alias("region")), "region", "left_semi")
    for keys, name in ((["region", "model", "metric"], "statistic"), (["region", "model"], "metric"), (["region"], "model"), ([], "region")):
        results = _as_map(results, keys, name, "value")
    one = statistic
    for part in (region, model, metric, results.withColumnRenamed("value", "results")):
        one = one.withColumn("_k", F.lit(0)).join(part.withColumn("_k", F.lit(0)), "_k").drop("_k")
    schema = F.struct(F.lit("CMEC").alias("name"), F.lit("v1").alias("version"), F.lit("gridloom").alias("package"))
    dimensions = F.struct(F.array(*map(F.lit, ("region", "model", "metric", "statistic"))).alias("json_structure"), F.struct("region", F.col("models").alias("model"), F.col("metrics").alias("metric"), "statistic").alias("dimensions"))
    return one.select(F.to_json(F.struct(schema.alias("SCHEMA"), dimensions.alias("DIMENSIONS"), F.col("results").alias("RESULTS"))).alias("json"))
