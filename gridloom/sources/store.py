"""Tables between the stages of a run, and the store of a run's results, which a later run takes up again."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or on a local master without it one below the
    warehouse."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return own or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_gridloom"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own, which goes when the driver's JVM ends: later stages scan it, and plans stay small."""
    spark = df.sparkSession
    path = f"{folder(spark)}/fields-{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Store:
    """Results by dataset and model below ``path``: parts of scalars and of maps, and a manifest of what is complete.

    A part is written whole before its row of the manifest; what has no row there (a run that was stopped in between) is
    as if it were not. So a run that begins again does only what is missing, and pairs that failed are tried again.
    """

    MANIFEST = "dataset string, model string, part string, status string, message string"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self._lock = spark, Lock()
        self.path = path or f"{folder(spark)}/run-{uuid.uuid4().hex}"

    def _exists(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def manifest(self) -> DataFrame:
        """``dataset``, ``model``, ``part``, ``status`` (``done`` or ``failed``), ``message``."""
        path = f"{self.path}/manifest"
        return self.spark.read.schema(self.MANIFEST).parquet(path) if self._exists(path) else self.spark.createDataFrame([], self.MANIFEST)

    def missing(self, dataset: str, models: DataFrame) -> DataFrame:
        """The ``models`` (model) without a complete result for the dataset."""
        done = self.manifest().filter((F.col("dataset") == dataset) & (F.col("status") == "done"))
        return models.select("model").distinct().join(done.select("model"), "model", "left_anti")

    def put(self, dataset: str, models: Iterable[str], tables: dict[str, DataFrame]) -> None:
        """Write the ``tables`` (such as scalars and maps) of some models of a dataset, then say that they are complete."""
        part = uuid.uuid4().hex
        for kind, df in tables.items():
            df.withColumn("dataset", F.lit(dataset)).write.parquet(f"{self.path}/{kind}/part={part}")
        self._note([(dataset, m, part, "done", None) for m in models])

    def fail(self, dataset: str, models: Iterable[str], error: Exception) -> None:
        self._note([(dataset, m, None, "failed", f"{type(error).__name__}: {error}"[:2000]) for m in models])

    def _note(self, rows: list[tuple]) -> None:
        with self._lock:  # datasets may end at the same time, and a folder takes one writer at a time
            self.spark.createDataFrame(rows, self.MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def read(self, kind: str, schema: str) -> DataFrame:
        """All complete parts of a kind of table."""
        path = f"{self.path}/{kind}"
        if not self._exists(path):
            return self.spark.createDataFrame([], f"{schema}, dataset string")
        rows = self.spark.read.schema(f"{schema}, dataset string, part string").option("basePath", path).parquet(path)
        done = self.manifest().filter("status = 'done'").select("part").distinct()
        return rows.join(F.broadcast(done), "part", "left_semi").drop("part")

    def failures(self) -> DataFrame:
        """``dataset``, ``model``, ``message`` of pairs that failed and were not done since."""
        rows = self.manifest()
        done = rows.filter("status = 'done'").select("dataset", "model")
        return rows.filter("status = 'failed'").join(done, ["dataset", "model"], "left_anti").groupBy("dataset", "model").agg(F.max("message").alias("message"))
