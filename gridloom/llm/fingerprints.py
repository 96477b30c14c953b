"""Document fingerprints: one-permutation MinHash with optimal densification, by DataFrame functions alone.

Five-word shingles are hashed once. The top bits of a hash name its bin, the least hash of a bin is kept, and an empty
bin takes the value of the first filled bin in its own fixed random order (optimal densification: where two documents
are both empty, both look in the same places). Each lane keeps the low ``LANE_BITS`` bits. Two lanes of different
hashes are equal with probability 2^-LANE_BITS, which the estimate takes off again.

Bins come from one sort of the hashes together with one sentinel a bin, so a document costs O(n log n) and no shuffle.

Contract: null text counts as empty; a text of under five words is one shingle, an empty text the shingle of no words,
so empty texts are alike; equal texts have equal fingerprints; repeated rows get a row each; an empty table gives an
empty result; texts of any length are whole; the next of rows with equal doc_ids (or null ones, first) is by the hash
of the text; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import default_partitions, materialise, text_bytes, texts
from .quality_rules import let, words

SHINGLE_WORDS = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
LANE_BITS = 8
#: Bins that an empty one tries one by one, before it ranks all the filled ones.
TRIES = 8
_SHIFT = 64 - BIN_BITS
_LOW = (1 << _SHIFT) - 1
#: Bytes of text in one range of documents that are put in order together.
RANGE_TEXT_BYTES = 8 << 20


def shingle_hashes(tokens: Column, size: int = SHINGLE_WORDS) -> Column:
    def hashed(own: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.size(own) - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(own, i, size)))
        return some

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), hashed)


def lanes(text: Column) -> Column:
    """The fingerprint of a text as an array of lanes."""
    sentinels = F.lit([(b - BINS // 2) << _SHIFT | _LOW for b in range(BINS)])
    filled = lambda x: x.bitwiseAND(F.lit(_LOW)) != _LOW

    def least(all_: Column) -> Column:
        return F.filter(all_, lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(all_, i - 1), _SHIFT)))

    def dense(least_: Column) -> Column:
        def borrowed(b: Column) -> Column:
            def look(t: int) -> Column:
                return let(F.get(least_, F.pmod(F.xxhash64(b, F.lit(t)), F.lit(BINS)).cast("int")), lambda y: F.when(filled(y), y))

            places = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: filled(F.get(least_, j)))
            first = F.array_min(F.transform(places, lambda j: F.struct(F.xxhash64(b, j + TRIES).alias("rank"), j.alias("place"))))
            return F.coalesce(*map(look, range(TRIES)), F.get(least_, first["place"]))

        return F.transform(least_, lambda x, b: F.when(filled(x), x).otherwise(borrowed(b)))

    hashes = let(F.sort_array(F.concat(shingle_hashes(words(text)), sentinels)), least)
    return F.transform(let(hashes, dense), lambda x: x.bitwiseAND(F.lit((1 << LANE_BITS) - 1)).cast("short"))


def packed(lanes_: Column) -> Column:
    """Lanes as a string of hexadecimal digits."""
    return F.array_join(F.transform(lanes_, lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), LANE_BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard similarity estimated from two lane arrays."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << LANE_BITS)
    return F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` of each document: a narrow map."""
    return texts(docs).select("doc_id", packed(lanes(F.col("text"))).alias("fingerprint"))


def in_ranges(docs: DataFrame, range_text_bytes: int = RANGE_TEXT_BYTES) -> DataFrame:
    """``docs`` with ``bucket``: ranges of ascending doc_id (nulls first) and text hash, with about equal rows.

    An id that is several split points has as many ranges, over which its rows are dealt by their texts' hashes, in order.
    There are at most four ranges a shuffle partition. Their split points are approximate quantiles in a table of one
    row, which is joined on a constant, and are looked up in two steps of the square root of their number.
    """
    spark = docs.sparkSession
    n = min(max(1, -(-text_bytes(docs) // range_text_bytes)), 4 * default_partitions(spark))
    fan = math.isqrt(n - 1) + 1
    doc_id = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    splits = docs.agg(F.percentile_approx(doc_id, [i / (fan * fan) for i in range(1, fan * fan)], 100_000)).first()[0] if fan > 1 else None
    if not splits:
        return docs.withColumn("bucket", F.lit(0))
    splits = [*splits, (1 << 63) - 1]
    rows = [splits[i : i + fan] for i in range(0, len(splits), fan)]
    table = spark.createDataFrame([(0, [r[-1] for r in rows[:-1]], rows)], "_one int, _tops array<long>, _splits array<array<long>>")
    below = lambda points: F.size(F.filter(points, lambda s: s < doc_id))
    up_to = lambda points: F.size(F.filter(points, lambda s: s <= doc_id))
    out = docs.withColumn("_one", F.lit(0)).join(F.broadcast(table), "_one").withColumns({"_row": below(F.col("_tops")), "_past": up_to(F.col("_tops"))})
    out = out.withColumns({"bucket": F.col("_row") * fan + below(F.get("_splits", F.col("_row"))), "_past": F.col("_past") * fan + up_to(F.get("_splits", F.col("_past")))})
    own, share = F.col("_past") - F.col("bucket"), F.xxhash64("text") / F.lit(2.0**64) + 0.5
    dealt = F.when(own > 1, F.col("bucket") + F.least(F.floor(share * own), own - 1)).otherwise(F.col("bucket"))
    return out.withColumn("bucket", dealt.cast("int")).drop("_one", "_tops", "_splits", "_row", "_past")


def with_next(rows: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """``rows`` (doc_id, text) with the columns ``derived`` from the text, and ``next``, a struct of the text and the same
    columns of the next row by doc_id (the last: the first).

    One shuffle of the texts: each range is put in order by a window, and the first rows of all ranges (one a range)
    are joined to the ranges before them, which are found from the ranges' numbers alone. Columns of first rows are
    derived after they have been found.
    """
    ranged = in_ranges(rows)
    tie = F.xxhash64("text")
    order = [F.col("doc_id").asc_nulls_first(), tie, F.col("text")]
    known = F.coalesce("doc_id", F.lit(-(1 << 63)))
    first_ids = materialise(ranged.groupBy("bucket").agg(F.min(known).alias("first_id")), "first-ids")
    firsts = ranged.join(first_ids.withColumnRenamed("bucket", "_bucket"), (F.col("bucket") == F.col("_bucket")) & (known == F.col("first_id")), "left_semi")
    firsts = materialise(firsts.groupBy("bucket").agg(F.min_by("text", F.struct(tie, "text")).alias("text")), "firsts")
    along = Window.orderBy("bucket")
    every = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = first_ids.select("bucket", F.coalesce(F.lead("bucket").over(along), F.first("bucket").over(every)).alias("follower"))
    firsts = firsts.withColumns(derived).select(F.col("bucket").alias("follower"), F.struct("text", *derived).alias("after"))
    after = materialise(follows.join(firsts, "follower").select("bucket", "after"), "next-firsts")
    inside = ranged.withColumns(derived).withColumn("_next", F.lead(F.struct("text", *derived)).over(Window.partitionBy("bucket").orderBy(*order)))
    return inside.join(after, "bucket", "left").withColumn("next", F.coalesce("_next", "after")).drop("_next", "after", "bucket")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter is the beginning of the next document."""
    rows = with_next(texts(docs), {"lanes": lanes(F.col("text"))})
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", 1, n - quarter), F.substring(F.col("next.text"), 1, quarter))
    out = rows.select("doc_id", "lanes", n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("next.lanes").alias("next_lanes"))
    out = out.select("doc_id", "n_chars", "lanes", "next_lanes", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), lanes(F.col("edited")).alias("edited_lanes"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("lanes")).alias("fingerprint"), packed(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"), likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
