"""Hard-negative mining: for anchors, the closest rows of their label, and rows of other labels that are close, but not too close.

Components become integers, and scores are exact integer inner products. Several candidates are packed into one wide
integer by component (Kronecker substitution): their components are biased to be non-negative and put into fields of so
many bits that the sum of all products with the anchor's biased components cannot run over. One multiplication by an
anchor's component then serves all of them, and the fields of the sum are the biased scores; sums of components, which
are known, take the bias off. Packs of up to 53 bits are multiplied as doubles, which hold them exactly, as one matrix
product; where components are so large that not even one field fits, packs are Python's integers, of any width.

Anchors are taken in blocks of at most ``BLOCK``, one after another; a block is broadcast, so its size is bounded
whatever the number of anchors, and meets all rows in two narrow passes. The first finds each anchor's positives: each
task keeps the best few, and these few are all that is shuffled. Their scores bound the negatives of the second pass.

Contract: rows without vec_id, label or vector, or with a null or non-finite component, take no part; a shorter vector
counts as followed by zeros; rows of one vec_id are rows of their own, each an anchor if the id is one, and equal results
are repeated; scores beyond a long are written as its ends, after exact comparison; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch

ANCHOR_STEP, RELABEL_STEP, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: 100 x a negative's score lies between so many times the positive's.
LOW, HIGH = 30, 90
SCALE = 256
#: Anchors in one block, and rows that are multiplied at once.
BLOCK, ROWS = 2048, 2048
#: Bits of an integer that a double holds exactly.
EXACT = 53
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def components(column: pa.Array) -> np.ndarray:
    """The vectors' components as integers in doubles, zeros after the shorter ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _widened(a: np.ndarray, size: int) -> np.ndarray:
    return a if a.shape[1] == size else np.pad(a, ((0, 0), (0, size - a.shape[1])))


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of all anchors and rows, as longs, or as Python's integers where these do not hold them."""
    size = max(anchors.shape[1], rows.shape[1])
    a, c = _widened(anchors, size), _widened(rows, size)
    if not a.size or not c.size:
        return np.zeros((len(a), len(c)), np.int64)
    least_a, least_c = (min(0, int(x.min())) for x in (a, c))
    top = size * (int(a.max()) - least_a) * (int(c.max()) - least_c)
    width = max(top.bit_length(), 1)
    wide = width > EXACT or max(-least_a, -least_c, int(a.max()), int(c.max())) >> 50 > 0
    if wide:
        whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)
        a, c, fields = whole(a), whole(c), 16
    else:
        fields = EXACT // width
    a, biased = a - least_a, c - least_c
    full = -(-len(c) // fields) * fields
    biased = np.concatenate([biased, np.zeros((full - len(c), size), biased.dtype)]).reshape(-1, fields, size)
    powers = [1 << width * k for k in range(fields)] if wide else [float(1 << width * k) for k in range(fields)]
    packs = sum(biased[:, k] * powers[k] for k in range(fields))
    sums = a @ packs.T
    if not wide:
        sums, a = sums.astype(np.int64), a.astype(np.int64)
    mask = (1 << width) - 1
    biased_scores = np.stack([sums >> width * k & mask for k in range(fields)], axis=2).reshape(len(a), full)[:, : len(c)]
    # (a - la)(c - lc) summed is the score less lc * sum(a - la), less la * sum(c)
    c = c if wide else c.astype(np.int64)
    return biased_scores + least_c * a.sum(axis=1)[:, None] + least_a * c.sum(axis=1)[None, :]


class Best:
    """The best ``k`` (score, vec_id, row) of each of ``n`` groups so far: higher scores first, ties by smaller vec_id, then row."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.group = self.ids = self.rows = np.zeros(0, np.int64)
        self.scores = np.zeros(0, object)
        self.least: np.ndarray | None = None
        self.n = n

    def add(self, scores: np.ndarray, allowed: np.ndarray, groups: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Scores of the ``groups`` (rows of ``scores``) and of all rows; only ``allowed`` ones count."""
        if self.least is not None:
            least = self.least[groups]
            allowed = allowed & (scores >= (least if scores.dtype == object else np.clip(least, -(1 << 62), 1 << 62).astype(np.int64))[:, None])
        g, r = np.nonzero(allowed)
        group, own = np.concatenate([self.group, groups[g]]), np.concatenate([self.scores, scores[g, r]])
        ids, rows = np.concatenate([self.ids, ids[r]]), np.concatenate([self.rows, rows[r]])
        exact = own.astype(np.int64) if scores.dtype != object and all(abs(x) < 1 << 62 for x in self.scores) else None
        order = np.lexsort((rows, ids, -exact, group)) if exact is not None else np.array(sorted(range(len(own)), key=lambda i: (group[i], -own[i], ids[i], rows[i])), np.int64)
        group = group[order]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        place = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
        kept = order[place < self.k]
        self.group, self.scores, self.ids, self.rows = group[place < self.k], np.array(own[kept].tolist(), dtype=object), ids[kept], rows[kept]
        least = np.full(self.n, -(1 << 300), object)
        last = place[place < self.k] == self.k - 1
        least[self.group[last]] = self.scores[last]
        self.least = least


_LONG = ((-1 << 63), (1 << 63) - 1)
_TURNED = str.maketrans("0123456789abcdef", "fedcba9876543210")


def descending(score: int) -> str:
    """A text that sorts by the integer, the greatest first, whatever its size."""
    digits = f"{abs(score):x}"
    key = f"{len(digits):08d}{digits}"
    return "0" + f"{99999999 - len(digits):08d}" + digits.translate(_TURNED) if score > 0 else "1" + key


def _as_long(score: int) -> int:
    return max(_LONG[0], min(_LONG[1], int(score)))


def _found(name: str, groups: np.ndarray, best: Best) -> pa.RecordBatch:
    scores = [int(x) for x in best.scores]
    columns = {name: groups, "below": [descending(x) for x in scores], "score": [str(x) for x in scores], "vec_id": best.ids, "row": best.rows}
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k in ("below", "score") else pa.int64()) for k, x in columns.items()], names=list(columns))


def _merged(found: DataFrame, name: str, k: int) -> DataFrame:
    """The best ``k`` of all tasks by ``name``: each task sends at most so many rows a group."""
    best = F.slice(F.sort_array(F.collect_list(F.struct("below", "vec_id", "row", "score"))), 1, k)
    return found.groupBy(name).agg(best.alias("best")).select(name, F.posexplode("best").alias("place", "own"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to about ROWS rows."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            held.append(batch.slice(at, ROWS))
            n += held[-1].num_rows
            if n >= ROWS:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def positives_of(vectors: DataFrame, block: list, k: int) -> list:
    """Row, vec_id, row of the positive, its vec_id and score (in text) of the best ``k`` rows of each anchor's label."""
    shipped = vectors.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, _, labels, vectors_ = shipped.value
        best, groups = Best(len(rows), k), np.arange(len(rows))
        for table in _blocks(batches):
            own = _column(table, "row")
            allowed = (labels[:, None] == _column(table, "label")[None, :]) & (rows[:, None] != own[None, :])
            best.add(packed_scores(vectors_, components(table["embedding"])), allowed, groups, _column(table, "vec_id"), own)
        yield _found("anchor", rows[best.group], best)

    found = _merged(vectors.mapInArrow(run, "anchor long, below string, score string, vec_id long, row long"), "anchor", k)
    return found.select("anchor", "place", "own.vec_id", "own.score").collect()  # of one block


def negatives_of(vectors: DataFrame, block: list, positives: list, k: int) -> DataFrame:
    """The result's rows for one block of anchors."""
    rows, ids, labels, comps = block
    place = {int(r): i for i, r in enumerate(rows)}
    pairs = sorted((place[p["anchor"]], p["place"], p["vec_id"], int(p["score"])) for p in positives)
    shipped = vectors.sparkSession.sparkContext.broadcast((labels, comps, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, comps, pairs = shipped.value
        best, groups = Best(len(pairs), k), np.arange(len(pairs))
        anchor = np.array([p[0] for p in pairs], np.int64)
        # 30 p <= 100 s <= 90 p in whole numbers
        low, high = (np.array([f(p[3]) for p in pairs], object) for f in (lambda p: -(-LOW * p // 100), lambda p: HIGH * p // 100))
        for table in _blocks(batches):
            scores = packed_scores(comps, components(table["embedding"]))
            other = labels[:, None] != _column(table, "label")[None, :]
            bounds = [x if scores.dtype == object else np.clip(x, -(1 << 62), 1 << 62).astype(np.int64) for x in (low, high)]
            for at in range(0, len(pairs), BLOCK):
                own = groups[at : at + BLOCK]
                s = scores[anchor[own]]
                best.add(s, other[anchor[own]] & (s >= bounds[0][own, None]) & (s <= bounds[1][own, None]), own, _column(table, "vec_id"), _column(table, "row"))
        yield _found("pair", best.group, best)

    found = _merged(vectors.mapInArrow(run, "pair long, below string, score string, vec_id long, row long"), "pair", k)
    named = vectors.sparkSession.createDataFrame([(i, int(ids[a]), p, _as_long(s)) for i, (a, _, p, s) in enumerate(pairs)], "pair long, anchor_id long, positive_id long, positive_score long")
    long_ = F.coalesce(F.expr("try_cast(own.score AS long)"), F.when(F.startswith("own.score", F.lit("-")), _LONG[0]).otherwise(_LONG[1]))
    return found.join(named, "pair").select("anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("own.vec_id").alias("negative_id"), "positive_score", long_.alias("negative_score"))


def vectors_of(embeddings: DataFrame) -> DataFrame:
    """``row``, ``vec_id``, ``label`` (changed where the id is divisible by RELABEL_STEP), ``embedding`` of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    label = F.when(F.col("vec_id") % RELABEL_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return materialise(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", label.alias("label"), "embedding"), "vectors")


def hard_negatives(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score`` for all anchors."""
    spark, vectors = embeddings.sparkSession, vectors_of(embeddings)
    anchors = vectors.filter(F.col("vec_id") % ANCHOR_STEP == 0)
    n = anchors.count()
    # dealt evenly over parts of about BLOCK rows, which are cut where they have more
    parts = materialise(anchors.repartition(max(1, -(-n // BLOCK))).withColumn("part", F.spark_partition_id()), "anchors")
    sizes = sorted((r["part"], r["count"]) for r in parts.groupBy("part").count().collect())
    path = scratch(spark, "negatives")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    for part, size in sizes:
        own = parts.filter(F.col("part") == part).orderBy("row").toArrow()
        for at in range(0, size, BLOCK):
            piece = own.slice(at, BLOCK)
            block = [_column(piece, "row"), _column(piece, "vec_id"), _column(piece, "label"), components(piece["embedding"])]
            found = positives_of(vectors, block, positives)
            if found:
                negatives_of(vectors, block, found, negatives).write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (
  SELECT vec_id, label, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM v
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM c a JOIN c b ON a.d = b.d AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY 1, 2, 3
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10
"""
