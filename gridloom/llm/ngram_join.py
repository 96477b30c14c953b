"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles; two are linked if the Jaccard similarity of their sets is ``THRESHOLD`` or more.

1. A map makes each document's set, its hash and ``HASHES`` MinHash values (16 bits each). Documents with the same set
   form one class, which one of them stands for; classes are counted map-side first.
2. Four values make a band. Classes that share a band meet in a bucket; a pair with similarity 0.8 misses all
   ``BANDS`` bands with probability 4e-8, and a bucket of one class is dropped at once.
3. In a bucket each pair is looked at in its first common band only. Its values are compared ``STEP`` at a time, and
   the pair is dropped when the posterior probability that it reaches the threshold (a uniform prior, m of n values
   equal) falls below ``TOLERANCE``. What leaves a task are the classes that are still in a pair, not the pairs.
4. These classes come together again with their sets, by bucket; the pairs that the pruning left, and only they, are
   verified: one by one, or in dense groups by products of the 0/1 matrix of the shingles that two or more of the
   classes have. Links are counted there; only counts and trees of links come out.

Large buckets are dealt out by pairs of blocks of ``BLOCK`` classes, so no task holds a whole group, and nothing is
capped. What leaves a task grows with documents, not with pairs; sets are moved for classes in surviving pairs only.

Words are runs of characters other than ASCII white space. Contract: a text of under five words is one shingle, a null
or empty text the shingle of no words, so empty texts are linked; equal doc_ids (or null ones) are documents of their
own; texts of any length are whole; of documents with equal sets the first stands for all; an empty table gives an empty
result; other columns are ignored (``one_of_each`` keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import copies_of, default_partitions, materialise, small_batches, spread_join, whole_columns, with_rows
from .suffix_dedup import Rolling, _mixed

SHINGLE_WORDS, THRESHOLD = 5, (4, 5)
BANDS, BAND_VALUES = 32, 4
HASHES = BANDS * BAND_VALUES
STEP, TOLERANCE = 16, 1e-7
BLOCK = 256
#: Distinct shared shingles that one matrix product takes at once.
COLUMNS = 4096
_MULTIPLY = np.random.default_rng(5).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = np.cumprod(np.full(SHINGLE_WORDS, 0xD6E8FEB86659FD93, np.uint64))
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


def shingle_sets(texts_: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = np.frombuffer(b" ".join([*texts_, b""]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts_])
    inside = ~_WHITE[data]
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    word = _mixed(Rolling(data).of(begin, end) + (end - begin).astype(np.uint64))
    bounds = np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)]))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = word[a:b]
        n = max(1, len(own) - SHINGLE_WORDS + 1)
        total = np.zeros(n, np.uint64)
        for k in range(min(SHINGLE_WORDS, len(own))):
            total += own[k : k + n] * _ORDER[k]
        out.append(np.unique(_mixed(total)))
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 1024):
        part = ((shingles[at : at + 1024, None] * _MULTIPLY) >> np.uint64(32)).astype(np.uint32)
        least = np.minimum(least, part.min(axis=0))
    return least.astype("<u2")


def posterior_limits() -> np.ndarray:
    """The fewest equal values after each STEP with which a pair stays.

    With a uniform prior, P(similarity >= t | m of n equal) = P(Binomial(n + 1, t) <= m).
    """
    t = THRESHOLD[0] / THRESHOLD[1]
    limits = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < TOLERANCE:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        limits.append(m)
    return np.array(limits)


def sketches(rows: DataFrame) -> DataFrame:
    """row, n (distinct shingles), two hashes of the set, the MinHash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_ = [t.as_py() for t in batch.column(1).cast(pa.binary())]
            out: list[list] = [[], [], [], []]
            for at in range(0, len(texts_), 64):
                for own in shingle_sets(texts_[at : at + 64]):
                    with np.errstate(over="ignore"):
                        row = (len(own), int(_mixed(own * _MULTIPLY[0]).sum().view(np.int64)), int(_mixed(own ^ _MULTIPLY[1]).sum().view(np.int64)), minhash(own).tobytes())
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], names=["row", "n", "s1", "s2", "values"])

    return rows.select("row", "text").mapInArrow(run, "row long, n long, s1 long, s2 long, values binary")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal first ``keys`` columns."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_numpy() for k in range(keys)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = [0, *new.tolist(), table.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            part = table.slice(a, b - a)
            if held and any(held[0].column(k)[0] != part.column(k)[0] for k in range(keys)):
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def _dealt(members: DataFrame) -> DataFrame:
    """``members`` (with the ``size`` of their bucket) by pairs of blocks: ``bucket``, ``i``, ``j`` (i <= j) name a task's
    two blocks, ``block`` the row's own."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = members.withColumn("block", F.pmod(F.xxhash64("row"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    return own.select("*", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "size")


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition(default_partitions(rows.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "row")


def _pairs(block: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    if i == j:
        return np.triu_indices(len(block), 1)
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def surviving(group: pa.Table, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a bucket's two blocks that the pruning leaves, of those whose first common band is the bucket's."""
    values = np.frombuffer(b"".join(group["values"].to_pylist()), "<u2").reshape(group.num_rows, HASHES)
    bands = np.ascontiguousarray(values).view("<u8")
    a, b = _pairs(group["block"].to_numpy(), group["i"][0].as_py(), group["j"][0].as_py())
    for earlier in range(group["band"][0].as_py()):
        apart = bands[a, earlier] != bands[b, earlier]
        a, b = a[apart], b[apart]
    equal = np.zeros(len(a), np.int32)
    for k, limit in enumerate(limits):
        equal += (values[a, k * STEP : (k + 1) * STEP] == values[b, k * STEP : (k + 1) * STEP]).sum(axis=1, dtype=np.int32)
        stays = equal >= limit
        a, b, equal = a[stays], b[stays], equal[stays]
    return a, b


_PLACE = ["bucket", "i", "j", "row", "band", "block"]


def candidates(members: DataFrame) -> DataFrame:
    """The rows of each bucket's pairs of blocks that are in a surviving pair."""
    limits = posterior_limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            a, b = surviving(group, limits)
            if len(a):
                yield from group.select(_PLACE).take(np.union1d(a, b)).combine_chunks().to_batches()

    return _together(members).select(*_PLACE, "values").mapInArrow(run, "bucket long, i int, j int, row long, band int, block int")


def components(edges: DataFrame) -> DataFrame:
    """``row``, ``label``: the least row of each component, by passing on least labels until none changes.

    A row that many others are linked to, and a label that many rows bear, are hot keys, dealt over parts.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    degrees = materialise(both.groupBy("b").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    known = copies_of(degrees, "degree")
    labels = materialise(both.groupBy(F.col("a").alias("row")).agg(F.min("b").alias("least")).select("row", F.least("row", "least").alias("label")), "labels")
    while True:
        # the least label of the neighbours, and the label of one's own label
        of = labels.select(F.col("row").alias("b"), "label").join(degrees, "b")
        near = spread_join(both, of, ["b"], "degree", known).groupBy(F.col("a").alias("row")).agg(F.min("label").alias("near"))
        bearers = labels.groupBy("label").agg(F.count(F.lit(1)).alias("bearers"))
        jump = materialise(labels.select(F.col("row").alias("label"), F.col("label").alias("far")).join(bearers, "label"), "jumps")
        fresh = spread_join(labels.join(near, "row"), jump, ["label"], "bearers").select("row", F.least("label", "near", "far").alias("fresh"), "label")
        fresh = materialise(fresh, "labels")
        labels = fresh.select("row", F.col("fresh").alias("label"))
        if not fresh.filter("fresh <> label").limit(1).count():
            return labels


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shingles that the sets of each pair share."""
    if len(a) <= 2 * len(sets):
        return np.array([np.intersect1d(sets[x], sets[y], assume_unique=True).size for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shingle, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    shared = np.cumsum(count > 1) - 1
    take = count[shingle] > 1
    of, column = of[take], shared[shingle[take]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [at, at + COLUMNS]))
        ones = np.zeros((len(sets), COLUMNS), np.float32)
        ones[of[part], column[part] - at] = 1
        both += ones @ ones.T
    return both[a, b].astype(np.int64)


def exact_links(members: DataFrame) -> DataFrame:
    """``a``, ``b``, ``links``: for each class its linked documents within a pair of blocks, and a tree edge (or itself)."""
    num, den = THRESHOLD
    limits = posterior_limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            row, copies, n = (group[c].to_numpy() for c in ("row", "copies", "n"))
            a, b = surviving(group, limits)
            inter = intersections([np.frombuffer(x.as_buffer(), "<u8") for x in group["shingles"].combine_chunks()], a, b)
            linked = den * inter >= num * (n[a] + n[b] - inter)
            a, b = a[linked], b[linked]
            if len(a):
                links = np.bincount(a, weights=copies[b], minlength=len(row)) + np.bincount(b, weights=copies[a], minlength=len(row))
                label = roots(len(row), a, b)
                found = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays([pa.array(row[found]), pa.array(row[label[found]]), pa.array(links[found].astype(np.int64))], names=["a", "b", "links"])

    return _together(members).select(*_PLACE, "n", "copies", "values", "shingles").mapInArrow(run, "a long, b long, links long")


def _shingled(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen`` with the shingle sets of their rows' texts.

    The texts meet the chosen rows in a shuffle at every size: how many are chosen grows with the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_ = [t.as_py() for t in batch.column(1).cast(pa.binary())]
            sets = [s.astype("<u8").tobytes() for at in range(0, len(texts_), 64) for s in shingle_sets(texts_[at : at + 64])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(sets, pa.binary())], names=["row", "copies", "n", "values", "shingles"])

    return rows.select("row", "text").join(chosen.hint("merge"), "row").select("row", "text", "copies", "n", "values").mapInArrow(run, "row long, copies long, n long, values binary, shingles binary")


def classes(rows: DataFrame) -> DataFrame:
    """``row``, ``label`` (the least row of its group), ``links`` (other documents linked to it)."""
    spark = rows.sparkSession
    small_batches(spark)
    sketch = materialise(sketches(rows), "sketches")
    same = materialise(sketch.groupBy("s1", "s2", "n").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    belongs = materialise(sketch.select("row", "s1", "s2", "n").join(same, ["s1", "s2", "n"]).select("row", "rep", "copies", "n"), "membership")
    own = same.select(F.col("rep").alias("row"), "copies")
    values = sketch.select("row", "values").join(own.select("row"), "row", "left_semi")
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("values"), b * (2 * BAND_VALUES) + 1, F.lit(2 * BAND_VALUES))))).alias("band", "bucket")
    banded = materialise(values.select("row", band), "bands")
    sizes = materialise(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    met = materialise(spread_join(banded, sizes, ["bucket"], "size"), "met")
    members = met.join(values.join(met.select("row").distinct(), "row", "left_semi"), "row")
    left = materialise(candidates(_dealt(members)), "candidates")
    chosen = left.select("row").distinct().join(belongs.filter("row = rep").select("row", "copies", "n"), "row").join(values, "row")
    shingled = materialise(_shingled(rows, chosen), "shingled")
    exact = materialise(exact_links(left.join(shingled, "row")), "links")
    links = exact.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("more"))
    labels = components(exact.filter("a <> b")).select(F.col("row").alias("rep"), "label")
    out = belongs.join(links, "rep", "left").join(labels, "rep", "left")
    return out.select("row", F.coalesce("label", "rep").alias("label"), (F.coalesce("more", F.lit(0)) + F.col("copies") - 1).alias("links"))


def ngram_join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the first doc_id of its group of links), n_links."""
    rows = with_rows(docs)
    found = classes(rows)
    ids = rows.select("row", "doc_id")
    named = found.join(ids, "row").join(ids.select(F.col("row").alias("label"), F.col("doc_id").alias("class_id")), "label")
    return named.select("doc_id", "class_id", F.col("links").alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The first document of each group, with all columns."""
    rows = with_rows(docs, whole=True)
    kept = classes(rows).filter("row = label").select("row")
    return rows.join(kept, "row", "left_semi").select(*whole_columns(docs.columns, {"text": F.when(~F.col("_no_text"), F.col("text"))}))


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w) q
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 5 * p.k >= 4 * (x.n + y.n - p.k)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
)
SELECT d.doc_id, (SELECT min(r.b) FROM r WHERE r.a = d.doc_id) AS class_id, CAST((SELECT count(*) FROM e WHERE e.a = d.doc_id) AS BIGINT) AS n_links FROM documents d
"""
