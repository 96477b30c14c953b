"""Host-level quality rules, by DataFrame functions alone.

Each document gets its counts and four rule verdicts. Failures of each rule are summed by host (``source``); host
rates are shrunk towards an empirical beta prior, fitted over all hosts by moments that weigh hosts by their documents and
take the noise of small hosts off their spread; a host with a shrunk rate over
``HOST_LIMIT`` for any rule is rejected, and its verdict is joined back to its documents. A host of a few documents
thus stays near the prior, whatever they are like.

The counts need no shuffle: they are array functions of one row, with 8-word windows compared as sorted 64-bit hashes.
Hosts are summed map-side first, so a host with a third of all rows costs one row per task. The host table is written
before the join: the planner knows its size and broadcasts it only below Spark's threshold.

Contract: a null or empty text has no words and fails the base rules; a null host is a host of its own; repeated rows
count each, whatever their doc_ids; texts of any length are whole; an empty table gives an empty result; other columns
are ignored (``keep_documents`` keeps all columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, spread_join

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host is rejected beyond this shrunk failure rate of a rule.
HOST_LIMIT = 0.5
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 1e6)
RULES = ("short", "repeats", "symbols", "dup_lines")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    bare = F.trim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _neighbours(sorted_: Column) -> Column:
    return F.filter(sorted_, lambda x, i: (i > 0) & (x == F.get(sorted_, i - 1)))


def repeat_words(tokens: Column, window: int = WINDOW_WORDS) -> Column:
    """Words in windows of so many words that are found twice or more in the text."""

    def covered(hashes: Column) -> Column:
        def places(pairs: Column) -> Column:
            twice = F.filter(pairs, lambda x, i: ((i > 0) & (x["h"] == F.get(pairs, i - 1)["h"])) | F.coalesce(x["h"] == F.get(pairs, i + 1)["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["at"]))

        spans = let(
            let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))), places),
            lambda at: F.transform(at, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - p, F.lit(window)))),
        )
        some = F.size(let(F.sort_array(hashes), _neighbours)) > 0
        return F.when(some, F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))

    def windows(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(own) - (window - 1)), lambda i: F.xxhash64(F.slice(own, i, window)))

    enough = F.size(tokens) >= window
    return F.when(enough, let(let(F.transform(tokens, lambda w: F.xxhash64(w)), windows), covered)).otherwise(F.lit(0).cast("long"))


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` and the columns of the counts, the rule verdicts and ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = words(text)
    counts = let(tokens, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.withColumns(
        {
            "_words": counts,
            "_lines": line_counts,
            "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        }
    ).withColumns({"n_words": F.col("_words.n_words"), "n_repeat_words": F.col("_words.n_repeat_words"), "n_lines": F.col("_lines.n_lines"), "n_dup_lines": F.col("_lines.n_dup_lines")})
    n = F.col("n_words")
    return out.withColumns(
        {
            "short": n < MIN_WORDS,
            "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n,
            "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
            "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        }
    ).withColumn("base_failed", F.col("short") | F.col("repeats")).drop("_words", "_lines")


def host_verdicts(counted: DataFrame) -> DataFrame:
    """One row per host: ``source``, ``host_docs``, ``rate_<rule>`` (shrunk), ``host_kept``."""
    sums = materialise(counted.groupBy("source").agg(F.count(F.lit(1)).alias("host_docs"), *(F.sum(F.col(r).cast("long")).alias(r) for r in RULES)), "hosts")
    # a rule's hosts as k beta-binomial counts x of n with mean p and correlation rho (weight = 1 / rho - 1):
    # E[sum n (x/n - p)^2] = p (1 - p) ((1 - rho) (k - 1) + rho (N - sum n^2 / N))
    n = F.col("host_docs")
    squares = (F.sum(F.pow(F.col(r), F.lit(2)) / n).alias(f"{r}_xx") for r in RULES)
    fitted = sums.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(n.cast("double") * n).alias("nn"), *(F.sum(r).alias(r) for r in RULES), *squares).first()
    out, k, total = sums, fitted["k"], fitted["n"] or 1
    for r in RULES:
        mean = (fitted[r] or 0) / total
        spread, room = mean * (1 - mean), total - (fitted["nn"] or 0) / total - (k - 1)
        rho = ((fitted[f"{r}_xx"] - total * mean * mean) / spread - (k - 1)) / room if spread > 0 and room > 0 else 0.0
        weight = min(max(1 / rho - 1, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1]) if rho > 0 else PRIOR_WEIGHT[1]
        out = out.withColumn(f"rate_{r}", (F.col(r) + F.lit(mean * weight)) / (n + F.lit(weight)))
    return out.withColumn("host_kept", F.greatest(*(F.col(f"rate_{r}") for r in RULES)) <= HOST_LIMIT).drop(*RULES)


def _with_verdicts(counted: DataFrame) -> DataFrame:
    """``counted``, whose rows have a ``_row`` to deal those of hot hosts by, with its hosts' verdicts."""
    key = {"_host": F.coalesce("source", F.lit("")), "_no_host": F.col("source").isNull()}
    hosts = materialise(host_verdicts(counted).withColumns(key).select(*key, "host_docs", "host_kept"), "verdicts")
    joined = spread_join(counted.withColumns(key), hosts, [*key], "host_docs", deal=["_row"])
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop(*key, "host_docs", "_row")


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, the counts, ``base_failed``, ``kept``."""
    columns = ["doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    counted = materialise(with_counts(docs.select("doc_id", "text", "source")).select(F.monotonically_increasing_id().alias("_row"), *columns, *RULES[:3], F.col("dup_lines")), "counts")
    return _with_verdicts(counted).select("doc_id", *columns[2:], "kept")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    inside = docs.select(F.struct(*docs.columns).alias("_doc"), "text", "source")
    counted = materialise(with_counts(inside).select(F.monotonically_increasing_id().alias("_row"), "_doc", "source", "base_failed", *RULES), "counted")
    return _with_verdicts(counted).filter("kept").select("_doc.*")


ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8) q
), d AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) q WHERE n > 1
), r AS (
  SELECT doc_id, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n_repeat_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d) q GROUP BY doc_id
), c AS (
  SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
    coalesce(r.n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id
), f AS (
  SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repeats, 10 * n_symbols > word_chars AS symbols, 10 * n_dup_lines > 3 * n_lines AS dup_lines FROM c
), h AS (
  SELECT source, count(*) AS n, sum(short::INT) AS f1, sum(repeats::INT) AS f2, sum(symbols::INT) AS f3, sum(dup_lines::INT) AS f4 FROM f GROUP BY source
), u AS (
  SELECT source, rule, n, unnest([f1, f2, f3, f4]) AS f, unnest([1, 2, 3, 4]) AS rule_ FROM (SELECT *, 0 AS rule FROM h) q
), p AS (
  SELECT rule_, sum(f) / sum(n) AS m, sum(f * f / n) AS xx, sum(n) AS n, count(*) - 1 AS k, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room FROM u GROUP BY rule_
), o AS (
  SELECT rule_, m, CASE WHEN m * (1 - m) > 0 AND room > 0 THEN ((xx - n * m * m) / (m * (1 - m)) - k) / room ELSE 0 END AS rho FROM p
), s AS (
  SELECT rule_, m, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1), 1e6) ELSE 1e6 END AS k FROM o
), b AS (
  SELECT u.source, max((f + m * k) / (n + k)) <= 0.5 AS host_kept FROM u JOIN s ON s.rule_ = u.rule_ GROUP BY u.source
)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, (f.short OR f.repeats) AS base_failed, NOT (f.short OR f.repeats) AND b.host_kept AS kept
FROM f JOIN b ON b.source IS NOT DISTINCT FROM f.source
"""
