"""Removal of long repeated strings, found by sorting suffixes.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts earlier (in a smaller row, or before in
the same one). Sorting a suffix for each byte would move hundreds of times the corpus, so suffixes start at anchors
only: every window of LENGTH bytes picks its ``GRAM``-byte string of least hash, so equal windows pick equal anchors, and
windows that follow each other mostly share one. A run is the windows of one anchor.

1. A map finds all runs: the anchor's hash, a hash of the run's whole content, and its place.
2. One shuffle by anchor puts them in order. Of runs of the same content all but the first are repeats. A first run
   whose anchor is in no other content, and but once in its own, cannot repeat anything. Only the other firsts go on.
   An anchor that is in many runs (by a sample, which decides on the dealing alone) is dealt over several parts; the
   first runs of its parts meet again by anchor and content.
3. Their suffixes, from the anchor on, are dealt into buckets by sampled splitters over their leading bytes (a range
   partitioning), and each bucket is sorted by multikey quicksort on 8-byte words. Suffixes that share the anchor are
   neighbours; their windows are compared and all but the first of equal ones are repeats.
4. An anchor with over ``HOT`` contents is dealt by whole suffixes, so it goes over many buckets. Equal windows have
   their anchor at the same place, so all suffixes between theirs share the windows' bytes from the anchor on. Only
   windows whose bytes from there on are those of the bucket's first or last suffix too can have an equal one in another
   bucket; of each equal ones the bucket's first is compared across the boundaries, by a shuffle on the windows' hashes.

So repeats of whole runs are found by their hashes before suffixes are sorted, as a pre-aggregation. To sort the suffixes
of all runs would move their contents, about 125 bytes a run and a run every 24 bytes of text: over 5 times the corpus.

Contract: null text counts as empty; texts shorter than LENGTH lose nothing; equal doc_ids (or null ones, first) are
ordered by their texts' hashes; exact copies lose everything but the first; an empty table gives an empty result;
texts of any length are whole (they are hashed in overlapping parts); extra columns are ignored by ``repeats`` and kept by
``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import default_partitions, materialise, shards, small_batches, whole_columns, with_rows

LENGTH, GRAM = 100, 24
#: Windows that can share one anchor.
SHARED = LENGTH - GRAM + 1
#: Contents of one anchor that a bucket takes whole, and bytes of contents in a bucket.
HOT, BUCKET_BYTES = 1024, 4 << 20
#: One in so many rows is looked at to find hot anchors.
SAMPLED = 16
#: Bytes that are hashed at once, longer texts in overlapping parts; a place in a block fits into PLACE_BITS.
BLOCK_BYTES, PLACE_BITS = 1 << 20, 22
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, np.uint64))


class Rolling:
    """64-bit hashes of any part of a byte string, from its prefix sums."""

    def __init__(self, data: np.ndarray, table: int = 0):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[table][data] * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def all(self, size: int) -> np.ndarray:
        return (self.sums[size:] - self.sums[:-size]) * self.back[: len(self.sums) - size]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by doubling."""
    out, size = values, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _places(grams: np.ndarray, last: bool) -> np.ndarray:
    """For each window, where its gram of least hash is: the first such one, or the last."""
    place = np.arange(len(grams), dtype=np.uint64)
    kept = np.uint64((1 << PLACE_BITS) - 1)
    least = _least(grams & ~kept | (kept - place if last else place), SHARED) & kept
    return (kept - least if last else least).astype(np.int64)


def runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of the texts that lie in ``data``: text, first window, windows, anchor's place from it, whether the anchor
    is there more than once (then windows of the run may be equal), anchor, content."""
    n_windows = np.maximum(sizes - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(starts)), n_windows)
    if not len(text):
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    rolling = Rolling(data)
    grams = _mixed(rolling.all(GRAM))
    first_at, last_at = _places(grams, False), _places(grams, True)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + starts[text]
    anchor = grams[first_at[place]]
    new = np.ones(len(place), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(place)))
    if length.max() > SHARED:  # the same bytes over and over
        pieces = -(-length // SHARED)
        of = np.repeat(np.arange(len(first)), pieces)
        step = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, length = first[of] + step * SHARED, np.minimum(length[of] - step * SHARED, SHARED)
    at = place[first]
    several = last_at[at + length - 1] != first_at[at]
    content = _mixed(rolling.of(at, at + length + LENGTH - 1) + length.astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    return text[first], at - starts[text[first]], length, first_at[at] - at, several, anchor[first].view(np.int64), content.view(np.int64)


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows of 8-byte words by multikey quicksort: split three ways on one word, go on in the equal part."""
    done: list[np.ndarray] = []
    todo = [(np.arange(len(words)), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) <= 1 or depth == words.shape[1]:
            done.append(rows)
        elif len(rows) <= 256:
            done.append(rows[np.lexsort(words[rows, depth:].T[::-1])])
        else:
            column = words[rows, depth]
            pivot = np.partition(column[:: max(1, len(rows) // 64)], len(column[:: max(1, len(rows) // 64)]) // 2)[len(column[:: max(1, len(rows) // 64)]) // 2]
            todo += [(rows[column > pivot], depth), (rows[column == pivot], depth + 1), (rows[column < pivot], depth)]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


def _as_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_bytes: int) -> np.ndarray:
    """Rows of big-endian 8-byte words, zero after the end."""
    take = starts[:, None] + np.arange(-(-n_bytes // 8) * 8)
    inside = take < ends[:, None]
    return np.where(inside, data[np.minimum(take, len(data) - 1)], 0).astype(np.uint8).view(">u8").astype(np.uint64)


def _spans(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted single windows as spans of consecutive ones."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    return row[first], place[first], np.diff(np.append(first, len(row)))


def _shared(words: np.ndarray) -> np.ndarray:
    """Of rows of big-endian words, the leading bytes that each has in common with the first or the last row, the longer."""
    data = words.astype(">u8").view(np.uint8)
    return np.maximum(*(np.where((other := data != data[k]).any(axis=1), other.argmax(axis=1), data.shape[1]) for k in (0, -1)))


def one_place(at: int, n_windows: int, anchor_at: int, content: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """A run whose anchor is there more than once, in pieces (first window, windows, anchor's place, content): the windows
    that have their anchor at the same place."""
    gram, step = content[anchor_at : anchor_at + GRAM], 0
    while step < n_windows:
        end = min(n_windows, anchor_at + 1)
        yield at + step, end - step, anchor_at - step, content[step : end + LENGTH - 1]
        step = end
        anchor_at = max(content.find(gram, step), step)


def compare_bucket(row: np.ndarray, at: np.ndarray, n_windows: np.ndarray, anchor_at: np.ndarray, contents: list[bytes], edges: bool = True) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Repeated spans (row, first window, windows) of one bucket, and the open windows (two hashes, row, place).

    edges: the bucket's first and last block may go on in another bucket, and each run has its anchor at one place. Windows
    that another bucket can hold too stay open, the first of equal ones.
    """
    sizes = np.array([len(c) for c in contents])
    data = np.frombuffer(b"".join(contents), np.uint8)
    starts = np.cumsum(sizes) - sizes
    words = _as_words(data, starts + anchor_at, starts + sizes, LENGTH)
    order = multikey_order(words)
    row, at, n_windows, anchor_at, starts = row[order], at[order], n_windows[order], anchor_at[order], starts[order]
    lead = _as_words(data, starts + anchor_at, starts + anchor_at + GRAM, GRAM)
    new = np.ones(len(row), bool)
    new[1:] = (lead[1:] != lead[:-1]).any(axis=1)
    block = np.cumsum(new) - 1
    one, two = Rolling(data), Rolling(data, 1)
    record = np.repeat(np.arange(len(row)), n_windows)
    step = np.arange(len(record)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    begin = starts[record] + step
    h1, h2 = _mixed(one.of(begin, begin + LENGTH)), _mixed(two.of(begin, begin + LENGTH))
    of, place, in_block = row[record], at[record] + step, block[record]
    by = np.lexsort((place, of, h2, h1, in_block))
    again = np.zeros(len(by), bool)
    again[1:] = (in_block[by][1:] == in_block[by][:-1]) & (h1[by][1:] == h1[by][:-1]) & (h2[by][1:] == h2[by][:-1])
    repeated = by[again]
    repeated = repeated[np.lexsort((place[repeated], of[repeated]))]
    outer = by[~again]
    outer = outer[LENGTH - anchor_at[record[outer]] + step[outer] <= _shared(words[order])[record[outer]]] if edges else outer[:0]
    return _spans(of[repeated], place[repeated]), (h1[outer].view(np.int64), h2[outer].view(np.int64), of[outer], place[outer])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Rows, offsets and bytes of parts of texts, about BLOCK_BYTES at a time; every window lies in one part."""
    rows, offsets, held, size = [], [], [], 0
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            data = text.as_py()
            for offset in range(0, max(1, len(data) - LENGTH + 1), BLOCK_BYTES):
                rows.append(row)
                offsets.append(offset)
                held.append(data[offset : offset + BLOCK_BYTES + LENGTH - 1])
                size += len(held[-1])
                if size >= BLOCK_BYTES:
                    yield rows, offsets, held
                    rows, offsets, held, size = [], [], [], 0
    if rows:
        yield rows, offsets, held


#: One long column holds a run's first window, its windows (8 bits), whether its anchor is there more than once (1 bit)
#: and the anchor's place (7 bits).
SEVERAL, ANCHOR_BITS = 128, 127


def find_runs(rows: DataFrame, hot: dict[int, int] | None = None) -> DataFrame:
    """``anchor``, ``content``, ``row``, ``shape`` of all runs, and ``part``: over which of its parts a run of a hot anchor
    is dealt, null for others. hot: anchors and their parts, a bounded list."""
    anchors = np.array(sorted(hot or {}), np.int64)
    n_parts = np.array([(hot or {})[x] for x in anchors.tolist()], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, offsets, held in _blocks(batches):
            sizes = np.array([len(x) for x in held])
            text, at, n, anchor_at, several, anchor, content = runs(np.frombuffer(b"".join(held), np.uint8), np.cumsum(sizes) - sizes, sizes)
            own = np.array(ids, np.int64)[text]
            shape = (at + np.array(offsets, np.int64)[text]) << 16 | n << 8 | several * SEVERAL | anchor_at
            part = pa.nulls(len(own), pa.int32())
            if len(anchors) and len(own):
                near = np.minimum(np.searchsorted(anchors, anchor), len(anchors) - 1)
                dealt = _mixed(own.view(np.uint64) * np.uint64(_BASE) + shape.view(np.uint64)) % n_parts[near]
                part = pa.array(dealt.astype(np.int32), mask=anchors[near] != anchor)
            table = pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (anchor, content, own, shape)), part], names=["anchor", "content", "row", "shape", "part"])
            for k in range(0, len(own), 1 << 16):
                yield table.slice(k, 1 << 16)

    return rows.select("row", "text").mapInArrow(run, "anchor long, content long, row long, shape long, part int")


def _cut(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The content of each chosen run (row, shape, hot), and its suffix from the anchor on."""
    wanted = chosen.groupBy("row").agg(F.collect_list(F.struct("shape", "hot")).alias("shapes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row, text, shapes in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                data = text.as_py()
                for one in shapes:
                    shape = one["shape"]
                    at, n, anchor_at = shape >> 16, shape >> 8 & 255, shape & ANCHOR_BITS
                    content = data[at : at + n + LENGTH - 1]
                    # windows of hot anchors are told apart by what follows their own anchor
                    pieces = one_place(at, n, anchor_at, content) if one["hot"] and shape & SEVERAL else [(at, n, anchor_at, content)]
                    for at_, n_, anchor_at_, content_ in pieces:
                        for column, x in zip(out, (row, at_ << 16 | n_ << 8 | anchor_at_, content_, content_[anchor_at_ : anchor_at_ + LENGTH], one["hot"]), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.bool_())], names=["row", "shape", "content", "suffix", "hot"])

    return rows.select("row", "text").join(wanted, "row").select("row", "text", "shapes").mapInArrow(run, "row long, shape long, content binary, suffix binary, hot boolean")


def hot_anchors(rows: DataFrame) -> DataFrame:
    """``anchor``, ``parts``: anchors with over a quarter of an even partition's runs, and over how many parts to deal them.

    At most four times as many as there are partitions, so the list may go to all tasks. It comes from a sample of the rows
    and decides on the dealing, never on the result.
    """
    n = default_partitions(rows.sparkSession)
    counts = materialise(find_runs(rows.filter(F.pmod(F.xxhash64("row"), F.lit(SAMPLED)) == 0)).groupBy("anchor").count().filter("count > 1"), "anchor-counts")
    limit = max(16, (counts.agg(F.sum("count").alias("n")).first()["n"] or 0) // (4 * n))
    return counts.filter(F.col("count") > limit).select("anchor", F.ceil(F.col("count") / limit).cast("int").alias("parts"))


def _first_runs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``row``, ``shape`` of the runs that repeat an earlier run; ``row``, ``shape``, ``anchor`` of the first runs that another
    content of their anchor may repeat in part."""
    dealt = find_runs(rows, {r["anchor"]: r["parts"] for r in hot_anchors(rows).collect()})
    same = Window.partitionBy("anchor", "part").orderBy("content", "row", "shape")
    ordered = dealt.withColumn("before", F.lag("content").over(same))
    kinds = ordered.withColumn("first", F.coalesce(F.col("before") != F.col("content"), F.lit(True)))
    # a first is contested if its anchor has another content: one before it, or one after its own copies
    firsts = kinds.withColumn("after", F.expr("lead(CASE WHEN first THEN content END) IGNORE NULLS OVER (PARTITION BY anchor, part ORDER BY content, row, shape)"))
    several = F.col("shape").bitwiseAND(SEVERAL) != 0
    kept = firsts.filter(~F.col("first") | F.col("part").isNotNull() | F.col("before").isNotNull() | F.col("after").isNotNull() | several)
    kept = materialise(kept.select("row", "shape", "first", "anchor", F.when(F.col("first") & F.col("part").isNotNull(), F.col("content")).alias("content")), "runs")
    # firsts of the parts of hot anchors: one a part and content
    again = kept.filter("content is not null").withColumn("later", F.row_number().over(Window.partitionBy("anchor", "content").orderBy("row", "shape")) > 1)
    of_parts = materialise(again, "part-firsts")
    ranges = of_parts.groupBy("anchor").agg((F.min("content") != F.max("content")).alias("contested"))
    own = of_parts.filter("not later").join(F.broadcast(ranges), "anchor").filter(F.col("contested") | several)
    copies = kept.filter("not first").select("row", "shape").union(of_parts.filter("later").select("row", "shape"))
    return copies, kept.filter("first and content is null").select("row", "shape", "anchor").union(own.select("row", "shape", "anchor"))


def repeated_windows(rows: DataFrame) -> DataFrame:
    """``row``, ``at``, ``n``: spans of windows (by first byte) that repeat an earlier window."""
    spark = rows.sparkSession
    copied, contested = _first_runs(rows)
    copies = copied.select("row", F.shiftright("shape", 16).alias("at"), F.shiftright("shape", 8).bitwiseAND(255).alias("n"))
    hot = materialise(contested.groupBy("anchor").count().filter(F.col("count") > HOT).select("anchor"), "hot-anchors")
    some_hot = hot.limit(1).count() > 0
    flagged = contested.join(hot.withColumn("hot", F.lit(True)), "anchor", "left").select("row", "shape", F.coalesce("hot", F.lit(False)).alias("hot"))
    contents = materialise(_cut(rows, flagged), "suffixes")
    size = F.sum(F.octet_length("content"))
    totals = {r["hot"]: r["n"] for r in contents.groupBy("hot").agg(size.alias("n")).collect()}
    buckets = {k: max(default_partitions(spark), shards(totals.get(k, 0), BUCKET_BYTES, 16 * BUCKET_BYTES)) for k in (False, True)}

    def bucket(edges: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            if not sum(b.num_rows for b in held):
                return
            table = pa.Table.from_batches(held)
            row, shape = (table[c].to_numpy() for c in ("row", "shape"))
            spans, (h1, h2, open_row, open_at) = compare_bucket(row, shape >> 16, shape >> 8 & 255, shape & ANCHOR_BITS, table["content"].to_pylist(), edges)
            none = pa.nulls(len(spans[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in spans), none, none], names=["row", "at", "n", "h1", "h2"])
            for k in range(0, len(open_row), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(open_row[part], pa.int64()), pa.array(open_at[part], pa.int64()), pa.array(np.ones(len(h1[part]), np.int64)), pa.array(h1[part]), pa.array(h2[part])], names=["row", "at", "n", "h1", "h2"])

        return run

    ddl = "row long, at long, n long, h1 long, h2 long"
    # buckets between anchors: all suffixes of an anchor are in one
    inside = contents.filter("not hot").drop("hot").repartitionByRange(buckets[False], F.substring("suffix", 1, GRAM)).mapInArrow(bucket(False), ddl).select("row", "at", "n")
    if not some_hot:
        return copies.union(inside)
    # hot anchors: buckets within an anchor, by the whole suffix
    compared = materialise(contents.filter("hot").drop("hot").repartitionByRange(buckets[True], "suffix", "row", "shape").mapInArrow(bucket(True), ddl), "compared")
    equal = Window.partitionBy("h1", "h2").orderBy("row", "at")
    across = compared.filter("h1 is not null").withColumn("again", F.lag("row").over(equal).isNotNull()).filter("again")
    return copies.union(inside).union(compared.filter("h1 is null").select("row", "at", "n")).union(across.select("row", "at", "n"))


def merge(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Which bytes of a text of ``size`` bytes the windows cover."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + n + LENGTH - 1, -1)
    return np.cumsum(edges[:-1]) > 0


def _with_spans(rows: DataFrame, *more: str) -> DataFrame:
    small_batches(rows.sparkSession)
    spans = repeated_windows(rows).groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    return rows.join(spans, "row", "left").select(*more, F.col("text").cast("binary").alias("data"), F.col("spans.at").alias("at"), F.col("spans.n").alias("n"))


def repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for data, at, n in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                raw = data.as_py()
                removed, spans, kept = 0, 0, raw
                if at.is_valid:
                    gone = merge(at.values.to_numpy(), n.values.to_numpy(), len(raw))
                    removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                for column, x in zip(out, (len(raw), removed, spans, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(with_rows(docs), "doc_id").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated bytes; a character that is cut in two goes. ``n_chars`` is counted anew.

    All columns stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, at, n in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                raw = data.as_py()
                if at.is_valid:
                    raw = np.frombuffer(raw, np.uint8)[~merge(at.values.to_numpy(), n.values.to_numpy(), len(raw))].tobytes()
                out.append(raw.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["_doc", "text"])

    joined = _with_spans(with_rows(docs, whole=True), "_doc")
    inner = joined.schema["_doc"].dataType.simpleString()
    out = joined.mapInArrow(run, f"_doc {inner}, text string")
    return out.select(*whole_columns(docs.columns, {"text": F.col("text"), "n_chars": F.length("text").cast("long")}))
