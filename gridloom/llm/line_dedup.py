"""Line dedup: repeated runs of lines, found by a suffix array over line ids, lose their later copies.

A document is the sequence of the ids of its lines with a word. Suffixes (document, line) are ranked by prefix
doubling: from the order of their first h lines follows that of their first 2h, as the order of the pairs (rank, rank
h lines on). Each step is a shuffle that counts pairs, and one that puts the repeated pairs, not their copies, in order
by a range partitioning. A suffix whose pair is found once is in no repeated run that long and drops out; doubling goes
on until no pair is repeated. Suffixes of one rank are an interval of the suffix array with a longest common prefix of h
lines or more; its first suffix (by document, then line) keeps its lines, and the h lines of each other suffix are the
copy of an earlier run. Two overlapping ranks give the intervals of the lengths up to ``MIN_LINES`` that are no power of two.

A copy goes if it has ``MIN_LINES`` lines, or ``MIN_WORDS`` words in fewer lines. Longer copies overlap, so their union
are the maximal repeated runs. Ranks meet their suffixes in joins that split hot keys, such as a line found everywhere.

Contract: null text counts as empty; lines are cut at line feeds, those without a word always stay and are not
counted; texts of any length are whole; equal doc_ids (or null ones, first) are ordered by their texts' hashes; of exact
copies with enough lines or words only the first keeps any; an empty table gives an empty result; ``remove_runs`` keeps
extra columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import copies_of, default_partitions, materialise, small_batches, spread_join, whole_columns, with_rows

MIN_LINES, MIN_WORDS = 3, 50
SPACES = " \t\n\x0b\x0c\r"


def suffixes(rows: DataFrame, min_lines: int) -> DataFrame:
    """``row``, ``at``, ``line`` and ``line2`` (128 bits of hash), ``need``: one row for each line with a word. need: how many lines from here a run must
    have to go, which is ``min_lines`` or as many as hold MIN_WORDS words."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    words = F.transform(F.col("lines"), lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")))

    def need(i: Column) -> Column:
        total = lambda n: F.aggregate(F.slice(F.col("words"), i + 1, n), F.lit(0), lambda a, x: a + x)
        enough = [F.when(total(n) >= MIN_WORDS, F.lit(n)) for n in range(1, min_lines)]
        return F.coalesce(*enough, F.lit(min_lines)).cast("short")

    # two hashes of differing seeds: 128 bits
    each = F.transform("lines", lambda x, i: F.struct(F.xxhash64(x).alias("line"), F.xxhash64(F.lit(1), x).alias("line2"), need(i).alias("need")))
    out = rows.select("row", lines.alias("lines")).withColumn("words", words)
    return out.select("row", F.posexplode(each).alias("at", "own")).select("row", "at", "own.line", "own.line2", "own.need")


def _ranked(keyed: DataFrame, names: list[str]) -> DataFrame | None:
    """``keyed`` (row, at, need and ``names``) where the key is repeated, with ``rank``, the key's place in the order of
    all repeated ones, and ``again``, whether it is found earlier too; None if no key is repeated."""
    intervals = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at")).alias("first")).filter("n > 1")
    ordered = intervals.repartitionByRange(default_partitions(keyed.sparkSession), *names).sortWithinPartitions(*names)
    ranks = materialise(ordered.withColumn("rank", F.monotonically_increasing_id()), "ranks")
    known = copies_of(ranks, "n")
    if not known[0]:
        return None
    found = spread_join(keyed, ranks, names, "n", known)
    return materialise(found.select("row", "at", "need", "rank", (F.struct("row", "at") != F.col("first")).alias("again")), "ranked")


def _pairs(ranked: DataFrame, step: int) -> DataFrame:
    """The rank of each suffix and that of the suffix ``step`` lines on, if it is still there."""
    after = F.first("rank").over(Window.partitionBy("row").orderBy("at").rangeBetween(step, step))
    return materialise(ranked.select("row", "at", "need", F.col("rank").alias("head"), after.alias("next")).filter("next is not null"), "pairs")


def repeated_runs(rows: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``row``, ``at``, ``n``: runs of n lines that are repeated from earlier and have to go; the longest from each line."""
    lines = materialise(suffixes(rows, min_lines), "lines")
    found = lines.select("row", "at", F.lit(0).alias("n")).limit(0)
    ranked, h = _ranked(lines, ["line", "line2"]), 1
    while ranked is not None:
        tested = [(ranked, h)] + [(_ranked(_pairs(ranked, n - h), ["head", "next"]), n) for n in range(h + 1, min(2 * h, min_lines + 1))]
        for intervals, n in tested:
            if intervals is not None:
                found = found.union(intervals.filter(F.col("again") & (F.col("need") <= n)).select("row", "at", F.lit(n).alias("n")))
        ranked, h = _ranked(_pairs(ranked, h), ["head", "next"]), 2 * h
    return found.repartition("row").groupBy("row", "at").agg(F.max("n").alias("n"))


def split_lines(text: str, runs: list | None) -> tuple[list[str], int, int, int]:
    """The lines that stay, and how many lines with a word there were, how many went, and in how many runs."""
    lines = text.split("\n")
    worded = [k for k, line in enumerate(lines) if line.strip(SPACES)]
    over = [0] * (len(worded) + 1)  # how many more runs cover a line than the one before it
    for at, n in runs or ():
        over[at] += 1
        over[at + n] -= 1
    gone = [k for k, depth in zip(worded, accumulate(over), strict=False) if depth > 0]
    n_runs = sum(1 for i, depth in enumerate(accumulate(over)) if depth > 0 and depth == over[i])
    away = set(gone)
    return [line for k, line in enumerate(lines) if k not in away], len(worded), len(gone), n_runs


def _with_runs(docs: DataFrame, min_lines: int, whole: bool = False) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = with_rows(docs, whole)
    runs = repeated_runs(rows, min_lines).groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    return rows.join(runs, "row", "left")


def _runs_of(column: pa.Array) -> list[list[tuple[int, int]] | None]:
    return [None if own is None else [(x["at"], x["n"]) for x in own] for own in column.to_pylist()]


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, n_runs, kept_sha256 (of the lines that stay)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [split_lines(t.as_py(), own) for t, own in zip(batch.column(1), _runs_of(batch.column(2)), strict=True)]
            digests = [hashlib.sha256("\n".join(f[0]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], pa.int64()) for k in (1, 2, 3)), pa.array(digests, pa.string())], names=["doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256"])

    return _with_runs(docs, min_lines).select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_lines long, n_removed long, n_runs long, kept_sha256 string")


def remove_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """The documents without later copies of runs; one that loses every line with a word goes.

    All columns stay; ``n_chars`` is counted anew.
    """
    joined = _with_runs(docs, min_lines, whole=True).select("_doc", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [split_lines(t.as_py(), own) if own else None for t, own in zip(batch.column(1), _runs_of(batch.column(2)), strict=True)]
            text = [t.as_py() if f is None else "\n".join(f[0]) for t, f in zip(batch.column(1), found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array([f is None or f[1] > f[2] for f in found])], names=["_doc", "text", "_stays"])

    out = joined.mapInArrow(run, f"_doc {joined.schema['_doc'].dataType.simpleString()}, text string, _stays boolean").filter("_stays")
    return out.select(*whole_columns(docs.columns, {"text": F.col("text"), "n_chars": F.length("text").cast("long")}))


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents
), l AS (
  SELECT doc_id, line, k, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS is_line FROM t
), s AS (
  SELECT doc_id, line, k, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i,
    len(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n FROM l WHERE is_line
), w AS (
  SELECT doc_id, i, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS c, n, lead(n) OVER o AS m FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, i, 3 AS size FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS n FROM w WHERE c IS NOT NULL) q WHERE n > 1
  UNION ALL SELECT doc_id, i, 2 FROM (SELECT doc_id, i, n + m AS words, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, i) AS n FROM w WHERE b IS NOT NULL) q WHERE n > 1 AND words >= 50
  UNION ALL SELECT doc_id, i, 1 FROM (SELECT doc_id, i, n AS words, row_number() OVER (PARTITION BY a ORDER BY doc_id, i) AS n FROM w) q WHERE n > 1 AND words >= 50
), g AS (
  SELECT DISTINCT doc_id, i + d AS i FROM r, (VALUES (0), (1), (2)) v(d) WHERE d < size
), f AS (
  SELECT l.doc_id, l.line, l.k, s.i, g.i IS NOT NULL AS gone, p.i IS NOT NULL AS before
  FROM l LEFT JOIN s ON s.doc_id = l.doc_id AND s.k = l.k LEFT JOIN g ON g.doc_id = s.doc_id AND g.i = s.i LEFT JOIN g p ON p.doc_id = s.doc_id AND p.i = s.i - 1
)
SELECT doc_id, CAST(count(i) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed, CAST(count(*) FILTER (WHERE gone AND NOT before) AS BIGINT) AS n_runs,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
