"""Length-delimited binary records of token ids, with a separate offset index.

Each document is one record, in ascending ``doc_id`` order over the part files:

    length      8 bytes, little-endian: bytes of the payload
    checksum    4 bytes: masked CRC-32 of the length field
    payload     width of an id (1 byte), 1 if there is a doc_id (1 byte), doc_id (8 bytes, signed), ids (2 or 4 bytes each)
    checksum    4 bytes: masked CRC-32 of the payload
    end         1 byte, a line feed

A checksum is masked by rotating it 15 bits to the right and adding 0xA282EAD8, so that a checksum stored in checked
bytes stays a good one. The records go through Spark's text writer with the line feed as its separator: any Hadoop
store works, part files appear only when a job commits, and a lost executor's tasks are simply run again.

``index`` is a Parquet table next to the data: file, offset, length, doc_id, n_tokens and the place of the first id in
its file. ``read_at`` fetches any subset of it, in any order.

Contract: null text counts as empty (a record with only the end id); null doc_ids come first; equal doc_ids follow
each other in the order of their texts' hashes; texts of any length are one record each; an empty table gives an empty data folder and index; other columns are
ignored. A damaged record raises ``ValueError``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shards, small_batches, text_bytes, texts
from .tokenizer import read_tokenizer, worker_encoder

#: Bytes of text per part file, which a reading task holds: the first in corpora of up to 64 GB, at most the second.
SHARD_TEXT_BYTES, MOST_SHARD_TEXT_BYTES = 16 << 20, 128 << 20
#: Part files whose starts are summed together.
FILES_TOGETHER = 1024
_HEAD, _PAYLOAD, _SUM = struct.Struct("<Q"), struct.Struct("<BBq"), struct.Struct("<I")
#: Bytes of a record besides its payload.
_FRAME = _HEAD.size + 2 * _SUM.size + 1


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = _PAYLOAD.pack(width, doc_id is not None, doc_id or 0) + ids
    head = _HEAD.pack(len(payload))
    return b"".join((head, _SUM.pack(masked(head)), payload, _SUM.pack(masked(payload)), b"\n"))


def parse(content: memoryview, offset: int) -> tuple[int | None, np.ndarray, int]:
    """doc_id, ids and the offset after the record at ``offset``."""
    head = bytes(content[offset : offset + 8])
    if len(head) < 8 or _SUM.unpack_from(content, offset + 8)[0] != masked(head):
        raise ValueError(f"damaged length at byte {offset}")
    size = _HEAD.unpack(head)[0]
    payload = bytes(content[offset + 12 : offset + 12 + size])
    if len(payload) < size or _SUM.unpack_from(content, offset + 12 + size)[0] != masked(payload):
        raise ValueError(f"damaged record at byte {offset}")
    width, known, doc_id = _PAYLOAD.unpack_from(payload)
    return doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=_PAYLOAD.size), offset + _FRAME + size


def in_order(docs: DataFrame, least: int, most: int) -> DataFrame:
    """``doc_id`` and ``text`` range-partitioned and sorted by doc_id, about ``least`` bytes a partition, in large corpora
    up to ``most``."""
    rows = texts(docs)
    n = shards(text_bytes(rows), least, most)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")


def write_records(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, shard_text_bytes: int = SHARD_TEXT_BYTES) -> None:
    """Write ``folder/data`` and ``folder/index``."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shipped.value)
        end, width = np.array([end_id], encoder.dtype).tobytes(), encoder.dtype.itemsize
        for batch in batches:
            frames = [frame(i, encoder.encode(t.as_py()) + end, width)[:-1] for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["record"])
        encoder.chunks.settle()

    records = in_order(docs, shard_text_bytes, max(shard_text_bytes, MOST_SHARD_TEXT_BYTES)).mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{folder}/data")
    _scan(spark, folder, ids=None).write.parquet(f"{folder}/index")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/data").select(F.regexp_extract("path", r"[^/]+$", 0).alias("file"), "content")


def _scan(spark: SparkSession, folder: str, ids: str | None) -> DataFrame:
    """All records by file, checked. ids: "ids" for the ids, "digest" for their CRC, None for the place only."""
    more = {"ids": ("ids", pa.list_(pa.int64()), "array<long>"), "digest": ("ids_crc32", pa.int64(), "long")}.get(ids or "")
    fields = [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("start_in_file", pa.int64()), ("n_tokens", pa.int64())] + ([more[:2]] if more else [])
    ddl = "file string, offset long, length long, doc_id long, start_in_file long, n_tokens long" + (f", {more[0]} {more[2]}" if more else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view, at, start = memoryview(content.as_buffer()), 0, 0
                while at < len(view) or not at:
                    out: list[list] = [[] for _ in fields]
                    while at < len(view) and len(out[0]) < 4096:
                        doc_id, got, after = parse(view, at)
                        row = [file, at, after - at, doc_id, start, len(got)]
                        if ids == "digest":
                            row.append(zlib.crc32(got.astype("<u4").tobytes()))
                        elif ids:
                            row.append(got.tolist())
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
                        at, start = after, start + len(got)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True)], names=[n for n, _ in fields])
                    if not len(view):
                        break

    return _files(spark, folder).mapInArrow(run, ddl)


def file_starts(spark: SparkSession, folder: str) -> DataFrame:
    """``file``, ``file_start``: ids in all files before it. Sums run within FILES_TOGETHER files, then over such groups."""
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    sums = spark.read.parquet(f"{folder}/index").groupBy("file").agg(F.sum("n_tokens").alias("n"))
    sums = materialise(sums.withColumns({"number": number, "some": F.floor(number / FILES_TOGETHER)}), "file-sums")
    before = Window.partitionBy("some").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    before_some = Window.orderBy("some").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("some").agg(F.sum("n").alias("n")).select("some", F.coalesce(F.sum("n").over(before_some), F.lit(0)).alias("some_start"))
    inside = sums.select("file", "some", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return materialise(inside.join(groups, "some").select("file", (F.col("start") + F.col("some_start")).alias("file_start")), "file-starts")


def read_records(spark: SparkSession, folder: str, ids: str = "ids") -> DataFrame:
    """All records: doc_id, ``start`` (ids of all documents before it), n_tokens and ``ids`` (or their ``digest``)."""
    rows = _scan(spark, folder, ids).join(file_starts(spark, folder), "file")
    return rows.select("doc_id", (F.col("file_start") + F.col("start_in_file")).alias("start"), "n_tokens", "ids" if ids == "ids" else "ids_crc32")


def read_at(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The records of some index rows, for shuffled reads: each file is opened once and cut at the wanted offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [parse(memoryview(x.as_buffer()), 0)[:2] for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1].tolist() for g in got], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    cut: Column = F.expr("substring(content, cast(offset + 1 as int), cast(length as int))")
    return wanted.select("file", "offset", "length").join(_files(spark, folder), "file").select(cut.alias("record")).mapInArrow(run, "doc_id long, ids array<long>")
