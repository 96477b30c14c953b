"""What the operators of this subpackage share: the cluster's shared folder and typed views of ``documents``."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch sent to Python at most. Its bytes are bounded by Spark's ``maxBytesPerBatch`` too; a text that
#: is longer than that is a batch of its own.
ARROW_ROWS = 512
#: Columns of the ``documents`` table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``, read by Spark alone (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: ``ARROW_ROWS`` whole texts at a time. A smaller setting of the session stays; the setting
    cannot be put back here, as plans read it when they run."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session; only where that is unset on a local master (tests) a folder below the warehouse.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return own or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_gridloom"


class _Made(threading.local):
    """Paths of this thread's scratch tables that are still there, in the order of their making.

    Queries that run at once in threads of one driver each see their own tables.
    """

    def __init__(self):
        self.paths: list[str] = []


_made = _Made()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by ``free`` or when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/gridloom-{name}-{uuid.uuid4().hex}"
    _made.paths.append(path)
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs its running tasks, never earlier steps. As the table's size is then
    known to the planner, Spark broadcasts a join side only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """Names the scratch tables that this thread makes from here on, for ``free``."""
    return len(_made.paths)


def free(spark: SparkSession, since: int) -> None:
    """Remove all scratch tables made since a ``mark``, but for the last one, which holds the result."""
    for path in _made.paths[since:-1]:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    del _made.paths[since:-1]


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) and the columns ``more``; extra columns of the input are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def shards(total_bytes: int, least: int = 16 << 20, most: int = 512 << 20, fan: int = 4096) -> int:
    """Into how many parts to cut a corpus: of ``least`` bytes up to ``fan`` of them, then of more bytes, ``most`` in the end."""
    return max(1, -(-total_bytes // max(least, min(most, total_bytes // fan))))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, summed by Spark over the whole table (one number reaches the driver)."""
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_rows(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``row`` (unique, ascending with doc_id), ``doc_id``, ``text``; whole: also what ``whole_columns`` needs.

    Where doc_ids are unique and known, ``row`` is the doc_id and nothing is moved. Otherwise the table is put in the
    order of doc_id (nulls first) and text, numbered, and written. So a result by ``row`` is joined to these rows only.
    """
    # the text is left out of the struct, so it is written once
    more = {"_doc": F.struct(*(c for c in docs.columns if c != "text")), "_no_text": F.col("text").isNull()} if whole else {}
    rows = texts(docs, *(x.alias(name) for name, x in more.items()))
    odd = rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return rows.select(F.col("doc_id").alias("row"), "doc_id", "text", *more)
    ordered = rows.repartitionByRange(default_partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return materialise(ordered.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", *more), "rows")


def copies_of(few: DataFrame, copies: str) -> tuple[int, int]:
    """The sum and the greatest of ``copies``, 0 for an empty table."""
    row = few.agg(F.sum(copies).alias("n"), F.max(copies).alias("most")).first()
    return row["n"] or 0, row["most"] or 0


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], copies: str, known: tuple[int, int] | None = None, deal: list[str] | None = None) -> DataFrame:
    """``many`` joined to ``few``, which has one row a key and counts the key's rows of ``many`` in ``copies``.

    A key with more than a quarter of an even partition's rows is hot: its rows are dealt over parts by a hash of the
    columns ``deal`` (all, if not given), and its row of ``few`` is repeated for each part. At most four times as many keys as there are
    partitions can be hot, whatever the data, so their list is broadcast. ``few`` has to be a written table; ``known`` is
    its ``copies_of``.
    """
    total, most = known or copies_of(few, copies)
    limit = max(64, -(-total // (4 * default_partitions(many.sparkSession))))
    if most <= limit:
        return many.join(few, keys)
    n_parts = F.ceil(F.col(copies) / limit).cast("int")
    hot = few.filter(F.col(copies) > limit).select(*keys, n_parts.alias("_parts"))
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*(deal or many.columns)), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    repeated = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(F.col(copies) > limit, n_parts).otherwise(1) - 1)))
    return dealt.join(repeated, [*keys, "_part"]).drop("_part")


def whole_columns(names: list[str], fresh: dict[str, Column]) -> list[Column]:
    """The columns ``names`` of documents whose others than ``text`` are in ``_doc``; ``fresh`` ones take their place."""
    return [fresh[c].alias(c) if c in fresh else F.col(f"_doc.{c}").alias(c) for c in names]
