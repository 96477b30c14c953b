"""Phrase collocation mining: frequent phrases of two and three words by language, scored by how far they beat their parts.

Texts are cut into blocks of about ``BLOCK`` words, each coded by the numbers of its words, and counting goes by levels.
A phrase can be frequent only if all its parts are (Apriori): pairs are candidates if both words are frequent, triples if
both pairs are. Pairs of frequent words are counted by sorting, as all that occur are candidates. A block's candidate pairs
and the triples made of them are the nodes of a double-array trie: an array of bases and one of checks, where the child of
state s by letter c is state base[s] + c if its check is s. Numpy moves the states of all text positions on at once, a
level at a time, and counts the accepting states with one bincount; Spark sums the blocks' counts by phrase.

Frequent words and pairs grow with the corpus, so no trie of all of them is broadcast. Each block's words are joined to
the frequent ones, and frequent pairs are broadcast as a Bloom filter of fixed size, which may let others pass as
candidates but never holds one back; a block's trie has the candidates that occur in it and no others. A word or phrase
has one row a block in every join and sum, however often it occurs.

Contract: null texts count as empty, null langs as ``und``; only A-Z are lower-cased; texts of any length are whole (a
text longer than a block is a block of its own); repeated rows count each; phrases are compared in their UTF-8 bytes; of
equal phrases there is one; languages with few phrases give fewer rows; an empty table gives an empty result; extra
columns are ignored. Sums and scores are whole numbers of up to 38 digits.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import default_partitions, materialise, small_batches

LEAST, TOP = 10, 2000
#: A candidate goes if a longer one that holds it has at least this many per cent of its occurrences.
COVERED = 50
#: Words in a block, after which the next text begins a new one.
BLOCK = 1 << 20
#: Words in a row of codes at least, if a piece of text ends there: Parquet keeps a hundred rows in memory before it looks.
PIECE = 1 << 14
#: Rows in a batch of counts.
ROWS = 1 << 16
#: The filter of frequent pairs has 2 ** FILTER_BITS bits (8 MB); the factors scatter a pair over it.
FILTER_BITS = 26
MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Bits of a word's number; a pair is two of them in a long.
BITS = 31
_TOKENS = re.compile(rb"[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CUTS = {bytes([c]): -1 for c in b".,;:!?\n\x0b\x0c\r"}


class _Numbers(dict):
    """Words of one language to their numbers in the block; what cuts pieces is -1."""

    def __init__(self, lang: str, words: list[tuple[str, bytes]]):
        super().__init__(_CUTS)
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self.words)
        self.words.append((self.lang, word))
        return found


def _pieces(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Codes in parts that end with a cut, so that no phrase goes on from one to the next."""
    ends, at = np.flatnonzero(codes < 0) + 1, 0
    while at < len(codes):
        k = np.searchsorted(ends, at + PIECE)
        end = int(ends[k]) if k < len(ends) else len(codes)
        yield codes[at:end]
        at = end


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to blocks: a row for each distinct word of a block with its number and count, and rows (of number -1) with the
    numbers of all its words in order, -1 between pieces."""
    part, n_blocks = TaskContext.get().partitionId(), 0
    names = ["block", "number", "lang", "word", "c", "codes"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def rows(codes: array, words: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        block, whole = part << 32 | n_blocks, np.frombuffer(codes, np.int32)
        counts = np.bincount(whole[whole >= 0], minlength=len(words))
        for at in range(0, len(words), ROWS):
            own = words[at : at + ROWS]
            columns = [pa.array([block] * len(own)), pa.array(np.arange(at, at + len(own))), pa.array([x[0] for x in own]), pa.array([x[1] for x in own], pa.binary()), pa.array(counts[at : at + ROWS]), pa.nulls(len(own))]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names=names)
        for piece in _pieces(whole):
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([block, -1, None, None, None, piece.tobytes()], kinds, strict=True)], names=names)

    codes, words, numbers = array("i"), [], {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if lang not in numbers:
                numbers[lang] = _Numbers(lang, words)
            codes.extend(map(numbers[lang].__getitem__, _TOKENS.findall(text.as_py().encode().translate(_LOWER))))
            codes.append(-1)
            if len(codes) >= BLOCK:
                yield from rows(codes, words)
                codes, words, numbers, n_blocks = array("i"), [], {}, n_blocks + 1
    if codes:
        yield from rows(codes, words)


class DoubleArray:
    """A trie of words as arrays of bases and checks. The letters are the digits to base 256 of a word's place among ``n``
    words, so a node has 256 children at most; state 0 is the root."""

    def __init__(self, n: int):
        self.digits = max(1, -(-max(n - 1, 1).bit_length() // 8))
        self.base, self.check = np.zeros(1, np.int32), np.full(1, -1, np.int32)

    def _digit(self, words: np.ndarray, k: int) -> np.ndarray:
        return (words >> 8 * (self.digits - 1 - k) & 255) + 1

    def add(self, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The states of new, distinct children; ``parents`` have no children yet."""
        states = parents
        for k in range(self.digits):
            own, back = np.unique(states << 9 | self._digit(words, k), return_inverse=True)
            states = self._place(own >> 9, own & 511)[back]
        return states

    def _place(self, parents: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Places for the children (in order of parents), in fresh room behind the states so far.

        Parents of over 16 children get 256 places each. Those of 2^(j-1) + 1 to 2^j try places at random, all at once, in
        room for 2^j times the children so far: each fits with a fair chance, and only those that do not try again. Single
        children fill what is free.
        """
        starts = np.flatnonzero(np.r_[True, np.diff(parents) != 0])
        sizes, low, rng = np.diff(np.r_[starts, len(parents)]), len(self.base), np.random.default_rng(0)
        base, check, placed, room = self.base, self.check, 0, 0

        def children(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = sizes[nodes]
            offsets = np.cumsum(n) - n
            return offsets, np.repeat(starts[nodes] - offsets, n) + np.arange(n.sum())

        for j in range(5, 0, -1):
            nodes = np.flatnonzero(sizes > 16) if j == 5 else np.flatnonzero((sizes > 1 << (j - 1)) & (sizes <= 1 << j))
            placed += 0 if j == 5 else int(sizes[nodes].sum())
            room = 256 * len(nodes) if j == 5 else max(room, placed << j)
            base, check = (np.r_[x, np.full(max(0, low + room + 257 - len(x)), fill, np.int32)] for x, fill in ((base, 0), (check, -1)))
            while len(nodes):
                offsets, own = children(nodes)
                at = low - 1 + 256 * np.arange(len(nodes)) if j == 5 else rng.integers(low, low + room, len(nodes))
                slots = np.repeat(at, sizes[nodes]) + letters[own]
                first = np.zeros(len(slots), bool)
                first[np.unique(slots, return_index=True)[1]] = True
                fits = np.logical_and.reduceat(first & (check[slots] < 0), offsets)
                inside = np.repeat(fits, sizes[nodes])
                base[parents[starts[nodes[fits]]]] = at[fits]
                check[slots[inside]] = parents[own[inside]]
                nodes = nodes[~fits]
        single = starts[sizes == 1]
        free = low + np.flatnonzero(check[low:] < 0)[: len(single)]
        more = len(single) - len(free)
        base, check = (np.r_[x, np.full(more, fill, np.int32)] for x, fill in ((base, 0), (check, -1)))
        free = np.r_[free, len(check) - more + np.arange(more)]
        base[parents[single]] = free - letters[single]
        check[free] = parents[single]
        self.base, self.check = base, check
        return base[parents].astype(np.int64) + letters

    def step(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The next states of all positions at once, -1 where there is none or the word is -1."""
        states = np.where(words >= 0, states, -1)
        for k in range(self.digits):
            to = self.base[np.maximum(states, 0)].astype(np.int64) + self._digit(words, k)
            to[(to < 0) | (to >= len(self.check))] = 0
            states = np.where((states >= 0) & (self.check[to] == states), to, -1)
        return states


def _places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers in order, and each position's place among them, -1 for what is no candidate."""
    known, places = np.unique(codes, return_inverse=True)
    less = int(len(known) > 0 and known[0] < 0)
    return known[less:].astype(np.int64), places - less


def _accepted(trie: DoubleArray, before: np.ndarray, word: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New nodes for the words that follow the states ``before`` where ``seen``: their parents, their words, their counts."""
    nodes = np.unique(before[seen] << BITS | word[seen])
    parents, own = nodes >> BITS, nodes & (1 << BITS) - 1
    states = trie.add(parents, own)
    ends = trie.step(np.where(seen, before, -1), word)
    return parents, own, np.bincount(ends[ends >= 0], minlength=len(trie.check))[states]


def count_pairs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of frequent words that stand side by side, as longs in order, and their counts. All of these are candidates,
    so sorting them counts them."""
    first, second = codes[:-1].astype(np.int64), codes[1:]
    seen = (first >= 0) & (second >= 0)
    return np.unique(first[seen] << BITS | second[seen], return_counts=True)


def count_triples(codes: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triples whose both pairs are among ``pairs``: the first pair, the third word, the count."""
    words, at = _places(codes)
    trie = DoubleArray(len(words))
    states = trie.add(np.zeros(len(words), np.int64), np.arange(len(words)))
    a, b = (np.searchsorted(words, x) for x in (pairs >> BITS, pairs & (1 << BITS) - 1))
    states = trie.add(states[a], b)
    pair_of = np.zeros(len(trie.check), np.int64)
    pair_of[states] = pairs
    first = trie.step(np.zeros(max(len(at) - 1, 0), np.int64), at[:-1])
    second = trie.step(first, at[1:])
    parents, own, counts = _accepted(trie, second[:-1], at[2:], (second[:-1] >= 0) & (second[1:] >= 0))
    return pair_of[parents], words[own], counts


def _batches(names: list[str], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + ROWS]).cast(pa.int64()) for c in columns], names=names)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """The codes of all rows of a block, one after another; their order says nothing."""
    parts = [np.frombuffer(x.as_buffer(), np.int32) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _renumbered(rows: pa.Table, own: pa.Table) -> pa.Table:
    """A block's codes by the numbers (``id``) of frequent words, -1 for others."""
    codes = _codes(rows["codes"])
    to = np.full(int(codes.max(initial=-1)) + 2, -1, np.int32)
    to[own["number"].to_numpy()] = own["id"].to_numpy()
    codes = to[codes]
    if len(codes):  # one cut stands for any number of words that are no candidates
        codes = np.append(codes[(codes >= 0) | np.r_[False, codes[:-1] >= 0]], np.int32(-1))
    return pa.table({"codes": pa.array([x.tobytes() for x in _pieces(codes)], pa.binary())})


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Codes of about BLOCK words."""
    held, n = [], 0
    for batch in batches:
        for codes in batch.column(0):
            held.append(np.frombuffer(codes.as_py(), np.int32))
            n += len(held[-1])
            if n >= BLOCK:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for codes in _parts(batches):
        yield from _batches(["pair", "c"], *count_pairs(codes))


def _marks(pairs: np.ndarray) -> Iterator[np.ndarray]:
    """The bits of a filter that stand for each pair."""
    mixed = pairs.astype(np.uint64) ^ (pairs.astype(np.uint64) >> np.uint64(29))
    for odd in MIXERS:
        x = mixed * np.uint64(odd)
        yield ((x ^ (x >> np.uint64(32))) * np.uint64(odd)) >> np.uint64(64 - FILTER_BITS)


def pair_filter(frequent: DataFrame) -> np.ndarray:
    """A Bloom filter of the frequent pairs: 2 ** FILTER_BITS bits however many there are, put together by Spark."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bits in _marks(batch.column(0).to_numpy()):
                words, back = np.unique(bits >> np.uint64(6), return_inverse=True)
                own = np.zeros(len(words), np.uint64)
                np.bitwise_or.at(own, back, np.uint64(1) << (bits & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(own.view(np.int64))], names=["at", "bits"])

    found = frequent.select("pair").mapInArrow(marked, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def in_filter(pairs: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether pairs are in a filter; some may be that are not frequent, never the other way."""
    has = np.ones(len(pairs), bool)
    for bits in _marks(pairs):
        has &= (words[bits >> np.uint64(6)] >> (bits & np.uint64(63)) & np.uint64(1)).astype(bool)
    return has


def triples(coded: DataFrame, words: np.ndarray) -> DataFrame:
    """``pair``, ``third``, ``c``: counts by part of the triples of pairs that are in the filter."""
    shipped = coded.sparkSession.sparkContext.broadcast(words)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes in _parts(batches):
            pairs = count_pairs(codes)[0]
            yield from _batches(["pair", "third", "c"], *count_triples(codes, pairs[in_filter(pairs, shipped.value)]))

    return coded.mapInArrow(counted, "pair long, third long, c long")


def frequent_words(tokens: DataFrame, least: int) -> DataFrame:
    """``lang``, ``word``, ``f``, ``id`` of the words found ``least`` times; ids are below 2 ** BITS and nearly dense."""
    parts = default_partitions(tokens.sparkSession)
    words = tokens.filter("number >= 0").groupBy("lang", "word").agg(F.sum("c").alias("f")).filter(F.col("f") >= least)
    part = F.pmod(F.xxhash64("lang", "word"), F.lit(parts))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("lang", "word")) - 1
    return materialise(words.withColumn("_part", part).withColumn("id", place.cast("long") * parts + F.col("_part")).drop("_part"), "words")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) in whole numbers of up to 38 digits."""
    whole = lambda c: c.cast("decimal(15,0)")
    million = F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", million * whole(a) * whole(a), whole(left) * whole(right))


def candidates(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Candidates of two and three words (``lang``, ``phrase``, ``a``, ``l``, ``r``, ``score``, ``covered``: the most
    occurrences of a longer candidate that holds it), and ``lang``, ``n``."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    tokens = materialise(texts.mapInArrow(_coded, "block long, number int, lang string, word string, c long, codes binary"), "tokens")
    totals = tokens.filter("number >= 0").groupBy("lang").agg(F.sum("c").alias("n"))
    words = frequent_words(tokens, least)
    known = tokens.filter("number >= 0").join(words, ["lang", "word"]).select(F.col("block").alias("own"), "number", F.col("id").cast("int").alias("id"))
    rows = tokens.filter("number < 0").select("block", "codes")
    coded = materialise(rows.groupBy("block").cogroup(known.groupBy("own")).applyInArrow(_renumbered, "codes binary"), "coded")
    frequent = materialise(coded.mapInArrow(_pairs, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("a")).filter(F.col("a") >= least), "frequent")
    threes = triples(coded, pair_filter(frequent)).groupBy("pair", "third").agg(F.sum("c").alias("a")).filter(F.col("a") >= least)
    threes = materialise(threes, "triples")
    low = F.lit((1 << BITS) - 1)
    word = lambda n, *more: words.select(F.col("id").alias(f"id{n}"), F.col("word").alias(f"w{n}"), F.col("f").alias(f"f{n}"), *more)
    named = frequent.withColumns({"id1": F.shiftright("pair", BITS), "id2": F.col("pair").bitwiseAND(low)})
    named = materialise(named.join(word(1, "lang"), "id1").join(word(2), "id2").select("pair", "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "f1", "f2"), "named")
    right = F.shiftleft(F.col("pair").bitwiseAND(low), BITS).bitwiseOR(F.col("third"))
    longer = threes.select("pair", "a").union(threes.select(right.alias("pair"), "a")).groupBy("pair").agg(F.max("a").alias("covered"))
    two = named.join(longer, "pair", "left").select("lang", "phrase", "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"), F.coalesce("covered", F.lit(0)).alias("covered"))
    whole = threes.withColumns({"right": right, "id3": F.col("third")}).join(named.select("pair", "lang", "phrase", "f1", F.col("a").alias("a12")), "pair").join(frequent.select(F.col("pair").alias("right"), F.col("a").alias("a23")), "right").join(word(3), "id3")
    cut = lambda k, left, right: F.struct(score(F.col("a"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))
    lowest = F.least(cut(1, F.col("f1"), F.col("a23")), cut(2, F.col("a12"), F.col("f3")))
    three = whole.select("lang", F.concat_ws(" ", "phrase", "w3").alias("phrase"), "a", lowest.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.lit(0).cast("long").alias("covered"))
    return two.union(three), totals


def phrases(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the first ``top`` phrases of each language."""
    found, totals = candidates(docs, least)
    kept = found.filter(100 * F.col("covered") < COVERED * F.col("a")).drop("covered")
    best = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # the best of each part first, so that the last ranking sees no more than ``top`` rows of each
    part = F.pmod(F.xxhash64("phrase"), F.lit(default_partitions(docs.sparkSession)))
    some = kept.withColumn("_part", part).withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best))).filter(F.col("_place") <= top).drop("_part", "_place")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), p AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w, row_number() OVER () AS id FROM d
), t AS (
  SELECT lang, id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM p
), g AS (
  SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM t WINDOW o AS (PARTITION BY id ORDER BY i)
), f1 AS (
  SELECT lang, w, count(*) AS f FROM g GROUP BY 1, 2
), f2 AS (
  SELECT lang, w, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 10
), f3 AS (
  SELECT lang, w, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10
), m AS (
  SELECT lang, w, w2, max(f) AS most FROM (SELECT lang, w, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) q GROUP BY 1, 2, 3
), c AS (
  SELECT f2.lang, f2.w || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w = f2.w JOIN f1 y ON y.lang = f2.lang AND y.w = f2.w2
    LEFT JOIN m ON m.lang = f2.lang AND m.w = f2.w AND m.w2 = f2.w2 WHERE 100 * coalesce(m.most, 0) < 50 * f2.f
), z AS (
  SELECT f3.lang, f3.w || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.f AS a, x.f AS l, y.f AS r, 1 AS k FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w = f3.w JOIN f2 y ON y.lang = f3.lang AND y.w = f3.w2 AND y.w2 = f3.w3
  UNION ALL
  SELECT f3.lang, f3.w || ' ' || f3.w2 || ' ' || f3.w3, f3.f, x.f, y.f, 2 FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w = f3.w AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w = f3.w3
), s AS (
  SELECT lang, phrase, a, l, r, 1 AS k, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM c
  UNION ALL
  SELECT lang, phrase, a, l, r, k, score FROM (SELECT *, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM z) q QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY 1)
SELECT s.lang, row_number() OVER w AS rank, phrase, a, l, r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM s JOIN n ON n.lang = s.lang WINDOW w AS (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000
"""
