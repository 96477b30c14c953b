"""A log-bilinear language model, trained in numpy by noise-contrastive estimation, that scores whole texts.

Words are runs of characters other than ASCII white space, A-Z in lower case, and each text has one end token. The model
predicts a word's class from the ``CONTEXT`` words before it (ends before a text's first one). The ``SINGLE`` most
frequent words are classes of their own; every other word, seen or not, belongs to one of ``GROUPS`` classes by its first
``PREFIX`` bytes. The score of class w is h . r_w + b_w, where h is the sum of the vectors q of the words before, each
multiplied by the vector of its position; b starts at the log unigram probability. Within a class words share by absolute
discounting of their corpus counts, with one place for the class's words that were never seen. So after any words the
probabilities of all seen words and of these places sum to 1, and no word is merged into another.

Counts cover all training rows, as one shuffle of each partition's distinct words. Training covers them too: rows are dealt
by a hash of doc_id and text into ``ROUNDS`` rounds and, in each, into shards of about ``SHARD_TOKENS`` tokens. In a round
every shard steps from the same parameters through its own tokens, then parameters and AdaGrad sums are averaged by
blocks in Spark, at most ``TOGETHER`` copies at a time. A corpus of few shards is gone through again until each copy has
made ``MIN_STEPS`` steps (``MAX_PASSES`` times at most). Seeds come from round and shard, so scores do not depend on how the input is split. What reaches
the driver is one set of parameters and at most ``HEAD_WORDS`` counts; counts of other words are joined, not broadcast.

A normaliser is a sum over classes of products of one factor a position. Scoring makes them for all farthest words of a pair of
nearer ones at once, by a matrix product when a pair is first met, and looks them up from then on (``Normalisers``).

Contract: a null or empty text is the end token alone; ``doc_id`` null is crc32 of ''; repeated rows are scored each, alike;
words of equal counts are ordered by their bytes; texts of any length are scored whole; an empty training set leaves
uniform counts (N = 0, V = 0); other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, texts
from .toxicity import fold

FOLDS, HELD_OUT_FOLD = 7, 2
SINGLE, GROUPS, PREFIX = 192, 192, 2
CLASSES, WIDTH, CONTEXT = SINGLE + GROUPS, 24, 3
#: Words of at most ``HEAD_BYTES`` bytes whose counts are broadcast: a fixed bound of 16 MB.
HEAD_WORDS, HEAD_BYTES = 1 << 18, 64
#: Bytes of words that a task counts at once.
COUNTED_BYTES = 32 << 20
BATCH, NOISE, RATE = 1024, 32, 0.15
ROUNDS, SHARD_TOKENS, MIN_STEPS, MAX_PASSES = 4, 1 << 19, 2000, 8
BLOCKS, TOGETHER = 16, 64
#: Contexts (or pairs of classes) that one matrix product takes at once.
ROWS = 1024
#: Up to these bounds of scores, their exponentials, products and sums stay within the range of single and of double precision.
SINGLE_BOUND, DOUBLE_BOUND = 75.0, 300.0
#: The end token; a space is in no word.
END = b" "


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, FOLDS) == HELD_OUT_FOLD


def words(text: memoryview) -> list[bytes]:
    """bytes.lower() changes A-Z alone, bytes.split() cuts at ASCII white space."""
    return [*bytes(text).lower().split(), END]


def _buffers(column: pa.Array) -> list[memoryview]:
    return [memoryview(x.as_buffer()) for x in column.cast(pa.binary())]


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (binary), ``c`` over the training rows, as a table in the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            found = pc.value_counts(pa.chunked_array(held, pa.binary()))
            found = found.filter(pc.greater(pc.binary_length(found.field("values")), 0))  # white space at a text's edge
            return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "c"])

        held, size, ends = [], 0, 0
        for batch in batches:
            ends += batch.num_rows
            held.append(pc.ascii_split_whitespace(pc.ascii_lower(batch.column(0))).flatten().cast(pa.binary()))
            if (size := size + held[-1].nbytes) > COUNTED_BYTES:
                yield out()
                held, size = [], 0
        yield out()
        yield pa.RecordBatch.from_arrays([pa.array([END] if ends else [], pa.binary()), pa.array([ends] if ends else [], pa.int64())], names=["word", "c"])

    rows = texts(docs).filter(~held_out(F.col("doc_id"))).select("text")
    return materialise(rows.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


def group_of(word: bytes) -> int:
    return SINGLE + zlib.crc32(word[:PREFIX]) % GROUPS


class Vocabulary:
    """The counts that scoring needs everywhere, all bounded; made on the driver."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("c").alias("n"), F.count("c").alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("once"), F.count(F.when(F.col("c") == 2, 1)).alias("twice")).first()
        self.n, self.v = total["n"] or 0, total["v"] or 0
        # words by steps of the logarithm of their counts: a few thousand rows, from which follows where to stop
        short = counts.filter(F.octet_length("word") <= HEAD_BYTES).withColumn("level", F.floor(F.log2("c") * 64))
        levels = sorted(((r["level"], r["n"]) for r in short.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        least, words_so_far = math.inf, 0
        for level, n in levels:
            if (words_so_far := words_so_far + n) > HEAD_WORDS:
                break
            least = level
        rows = short.filter(F.col("level") >= least).select("word", "c").collect() if least < math.inf else []
        self.head = {bytes(r["word"]): r["c"] for r in sorted(rows, key=lambda r: (-r["c"], bytes(r["word"])))}
        self.single = {END: 0} | {w: i + 1 for i, w in enumerate([w for w in self.head if w != END][: SINGLE - 1])}
        self.discount = min(max(total["once"] / (total["once"] + 2 * total["twice"]), 0.1), 0.9) if total["once"] else 0.5
        # counts and distinct words by class
        self.tokens, self.types = np.zeros(CLASSES), np.zeros(CLASSES)
        group = (F.crc32(F.substring("word", 1, PREFIX)) % GROUPS + SINGLE).alias("group")
        for r in counts.groupBy(group).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
            self.tokens[r["group"]], self.types[r["group"]] = r["c"], r["v"]
        for w, i in self.single.items():
            if w in self.head:
                self.tokens[i], self.types[i] = self.head[w], 1
                self.tokens[group_of(w)] -= self.head[w]
                self.types[group_of(w)] -= 1
        self.unigram = (self.tokens + 0.5) / (self.tokens.sum() + 0.5 * CLASSES)

    def class_of(self, word: bytes) -> int:
        found = self.single.get(word)
        return group_of(word) if found is None else found

    def share(self, word: bytes, c: int) -> float:
        """log10 of a word's share of its class, given its count (0: the place of all words that were never seen)."""
        if word in self.single:
            return 0.0
        k = group_of(word)
        return math.log10(c - self.discount if c else self.discount * self.types[k] + 1) - math.log10(self.tokens[k] + 1)


class Model:
    """Parameters as one array of CLASSES rows: q and r (WIDTH each), b, and their AdaGrad sums; below them the rows of
    the positions, m, with theirs."""

    def __init__(self, unigram: np.ndarray, table: np.ndarray | None = None):
        noise = unigram**0.75
        self.noise = noise / noise.sum()
        self.cumulative = np.cumsum(self.noise)
        self.log_noise = np.log(NOISE * self.noise).astype(np.float32)
        if table is None:
            rng = np.random.default_rng(11)
            self.q, self.r = (rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32) for _ in range(2))
            self.b, self.m = np.log(unigram).astype(np.float32), np.full((CONTEXT, WIDTH), 1 / CONTEXT, np.float32)
            self.past = [np.full(x.shape[:1], 0.1, np.float32) for x in (self.q, self.r, self.b)] + [np.full(self.m.shape, 0.1, np.float32)]
        else:
            top, low = table[:CLASSES], table[CLASSES:]
            self.q, self.r, self.b = top[:, :WIDTH].copy(), top[:, WIDTH : 2 * WIDTH].copy(), top[:, 2 * WIDTH].copy()
            self.m = low[:, :WIDTH].copy()
            self.past = [top[:, 2 * WIDTH + k].copy() for k in (1, 2, 3)] + [low[:, WIDTH : 2 * WIDTH].copy()]

    def table(self) -> np.ndarray:
        low = np.zeros((CONTEXT, 2 * WIDTH + 4), np.float32)
        low[:, : 2 * WIDTH] = np.hstack([self.m, self.past[3]])
        return np.vstack([np.column_stack([self.q, self.r, self.b, *self.past[:3]]), low])

    def _step(self, which: int, target: np.ndarray, index: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(index.astype(np.uint16), kind="stable")  # numpy sorts 16 bits by radix
        own = index[order]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        rows, total, past = own[starts], np.add.reduceat(grad[order], starts), self.past[which]
        past[rows] += total * total if total.ndim == 1 else (total * total).mean(axis=1)
        rate = RATE / np.sqrt(past[rows])
        target[rows] += total * (rate if total.ndim == 1 else rate[:, None])

    def learn(self, before: np.ndarray, word: np.ndarray, rng: np.random.Generator) -> None:
        """One step up the noise-contrastive likelihood of a batch (gradients are summed); its noise words are shared."""
        noise = np.minimum(np.searchsorted(self.cumulative, rng.random(NOISE)), CLASSES - 1)
        q, r, rn = self.q[before], self.r[word], self.r[noise]
        h = (q * self.m).sum(axis=1)
        true = np.einsum("ij,ij->i", h, r) + self.b[word] - self.log_noise[word]
        false = h @ rn.T + (self.b[noise] - self.log_noise[noise])
        g_true = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        g_false = -1 / (1 + np.exp(np.clip(-false, -30, 30)))
        g_h = g_true[:, None] * r + g_false @ rn
        g_m = np.einsum("ijk,ik->jk", q, g_h)
        self._step(0, self.q, before.ravel(), (g_h[:, None, :] * self.m).reshape(-1, WIDTH))
        self._step(1, self.r, np.concatenate([word, noise]), np.vstack([g_true[:, None] * h, g_false.T @ h]))
        self._step(2, self.b, np.concatenate([word, noise]), np.concatenate([g_true, g_false.sum(axis=0)]))
        self.past[3] += g_m * g_m
        self.m += RATE * g_m / np.sqrt(self.past[3])

    def log_probabilities(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural logs of the probabilities of classes after the classes ``before``."""
        out, columns = np.empty(len(word)), np.ascontiguousarray(self.r.T)
        for at in range(0, len(word), ROWS):
            scores = (self.q[before[at : at + ROWS]] * self.m).sum(axis=1) @ columns
            scores += self.b
            if scores.max() > 60:  # so that no exponential overflows
                scores -= scores.max(axis=1, keepdims=True)
            own = scores[np.arange(len(scores)), word[at : at + ROWS]]
            np.exp(scores, out=scores)
            out[at : at + ROWS] = own - np.log(scores.sum(axis=1))
        return out


class Normalisers:
    """Probabilities of a model that learns no more, by tables: what each class of a position adds to all scores, and the
    normalisers after all triples of classes, CLASSES of them for each pair of nearer classes that was met. They are no estimates.
    Rows are in the order of their meeting, so memory is touched as pairs come; its bound is 4 * CLASSES**3 bytes (226 MB)."""

    def __init__(self, model: Model):
        self.model = model
        self.parts = [(model.q * m) @ model.r.T for m in model.m]
        self.parts[0] += model.b
        most = sum(float(np.abs(p).max()) for p in self.parts)
        self.bounded = most < DOUBLE_BOUND
        if self.bounded:
            self.near, self.next, far = (np.exp(p, dtype=np.float32 if most < SINGLE_BOUND else np.float64) for p in self.parts)
            self.far = np.ascontiguousarray(far.T)
            self.met, self.row_of, self.logs = 0, np.full(CLASSES * CLASSES, -1, np.int32), np.empty((CLASSES * CLASSES, CLASSES), np.float32)

    def _meet(self, pairs: np.ndarray) -> None:
        for at in range(0, len(pairs), ROWS):
            some = pairs[at : at + ROWS]
            factors = self.near[some // CLASSES]
            factors *= self.next[some % CLASSES]
            np.log(factors @ self.far, out=self.logs[self.met : self.met + len(some)], casting="same_kind")
            self.row_of[some] = np.arange(self.met, self.met + len(some))
            self.met += len(some)

    def log_probabilities(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """What ``Model.log_probabilities`` gives, but for rounding."""
        if not self.bounded:
            return self.model.log_probabilities(before, word)
        pair = before[:, 0] * CLASSES + before[:, 1]
        self._meet(np.unique(pair[self.row_of[pair] < 0]))
        out = -self.logs[self.row_of[pair], before[:, 2]].astype(np.float64)
        for k, part in enumerate(self.parts):
            out += part[before[:, k], word]
        return out


def contexts(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CONTEXT classes before each of the words of several texts, the nearest first; ends (0) before a text."""
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(ids), CONTEXT), np.int32)
    for k in range(CONTEXT):
        out[k + 1 :, k] = ids[: -(k + 1)]
        out[place <= k, k] = 0
    return out


class _Groups(dict):
    """First bytes of a word to its group: 65,792 entries at most, so that distinct words do not fill it."""

    def __missing__(self, prefix: bytes) -> int:
        found = self[prefix] = group_of(prefix)
        return found


def classes_of(words_: list[bytes], single: dict[bytes, int], groups: _Groups) -> list[int]:
    """Classes of words; END is 0 among ``single``."""
    get = single.get
    return [groups[w[:PREFIX]] if (k := get(w)) is None else k for w in words_]


def _events(docs: DataFrame, vocabulary: Vocabulary, shards: int) -> DataFrame:
    """``turn``, ``shard``, ``place``, ``ids``: the classes of each training text's words, as a table in the shared folder."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary.single)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, groups = shipped.value, _Groups()
        for batch in batches:
            ids = [np.array(classes_of(words(t), single, groups), "<u2").tobytes() for t in _buffers(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["place", "ids"])

    own = texts(docs).filter(~held_out(F.col("doc_id"))).select(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text").alias("place"), "text")
    dealt = own.mapInArrow(encode, "place long, ids binary")
    return materialise(dealt.select(F.pmod("place", F.lit(ROUNDS)).cast("int").alias("turn"), F.pmod(F.shiftright("place", 8), F.lit(shards)).cast("int").alias("shard"), "place", "ids"), "events")


def _averaged(parts: DataFrame, copies: int) -> DataFrame:
    """Weighted means of parameter blocks (``shard``, ``block``, ``weight``, ``part``), TOGETHER copies at a time."""

    def average(group: pa.Table) -> pa.Table:
        total, weight = 0.0, 0.0
        for at in np.argsort(group["shard"].to_numpy(), kind="stable").tolist():
            w = group["weight"][at].as_py()
            total, weight = total + np.frombuffer(group["part"][at].as_buffer(), np.float32) * np.float64(w), weight + w
        return pa.table({"shard": pa.array([min(group["shard"].to_pylist())], pa.int32()), "block": group["block"][:1], "weight": pa.array([weight]), "part": pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())})

    ddl = "shard int, block int, weight double, part binary"
    while copies > 1:
        grouped = parts.withColumn("some", F.floor(F.col("shard") / TOGETHER).cast("int")).groupBy("some", "block").applyInArrow(average, ddl)
        parts, copies = grouped.withColumn("shard", F.floor(F.col("shard") / TOGETHER).cast("int")), -(-copies // TOGETHER)
    return parts


def train(docs: DataFrame, vocabulary: Vocabulary) -> Model:
    spark = docs.sparkSession
    model = Model(vocabulary.unigram)
    if not vocabulary.n:
        return model
    unigram = vocabulary.unigram
    shards = max(1, round(vocabulary.n / ROUNDS / SHARD_TOKENS))
    steps = max(1, vocabulary.n // ROUNDS // shards // BATCH)  # of each copy in one round
    events = _events(docs, vocabulary, shards)

    def stepping(turn: int):
        shipped = spark.sparkContext.broadcast(model.table())

        def local(group: pa.Table) -> pa.Table:
            shard = group["shard"][0].as_py()
            own, rng = Model(unigram, shipped.value), np.random.default_rng([turn, shard])
            texts_ = sorted(zip(group["place"].to_pylist(), group["ids"].to_pylist(), strict=True))
            ids = np.frombuffer(b"".join(x for _, x in texts_), "<u2").astype(np.int32)
            before = contexts(ids, np.array([len(x) // 2 for _, x in texts_]))
            order = rng.permutation(len(ids))
            for at in range(0, len(order), BATCH):
                own.learn(before[order[at : at + BATCH]], ids[order[at : at + BATCH]], rng)
            parts = np.array_split(own.table(), BLOCKS)
            return pa.table({"shard": pa.array([shard] * BLOCKS, pa.int32()), "block": pa.array(range(BLOCKS), pa.int32()), "weight": pa.array([float(len(ids))] * BLOCKS), "part": pa.array([p.tobytes() for p in parts], pa.binary())})

        return local

    for turn in range(ROUNDS * min(MAX_PASSES, -(-MIN_STEPS // (ROUNDS * steps)))):
        rows = events.filter(F.col("turn") == turn % ROUNDS).select("shard", "place", "ids")
        parts = _averaged(rows.groupBy("shard").applyInArrow(stepping(turn), "shard int, block int, weight double, part binary"), shards).collect()
        if parts:
            table = np.concatenate([np.frombuffer(bytes(p["part"]), np.float32) for p in sorted(parts, key=lambda p: p["block"])])
            model = Model(unigram, table.reshape(CLASSES + CONTEXT, -1))
    return model


class _Tail:
    """For each text its words outside the head, how often it holds them, and the log10 of the unseen place of their class."""

    def __init__(self):
        self.ends, self.words, self.tf, self.unseen = [0], [], [], []

    def array(self) -> pa.Array:
        fields = [pa.array(self.words, pa.binary()), pa.array(self.tf, pa.int64()), pa.array(self.unseen, pa.float64())]
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.StructArray.from_arrays(fields, names=["word", "tf", "unseen"]))


class _Scorer:
    """What a task needs to score texts: arrays by a word's place in the head, whose last entries are for all others."""

    def __init__(self, vocabulary: Vocabulary, table: np.ndarray):
        head = vocabulary.head
        self.normalisers, self.single, self.groups = Normalisers(Model(vocabulary.unigram, table)), vocabulary.single, _Groups()
        self.place, self.outside = {w: i for i, w in enumerate(head)}, len(head)
        self.class_of = np.array([*classes_of([*head], self.single, self.groups), 0], np.int32)
        self.base_of = np.array([math.log10(c + 1) for c in head.values()] + [0.0])
        self.share_of = np.array([vocabulary.share(w, c) for w, c in head.items()] + [0.0])
        self.base_total, self.in_class = math.log10(vocabulary.n + vocabulary.v + 1), np.log10(vocabulary.tokens + 1)
        self.unseen = np.log10(vocabulary.discount * vocabulary.types + 1).tolist()

    def add(self, held: list[list[bytes]], out: list[list], tail: _Tail) -> None:
        """Score the texts ``held``. A word outside the head gets here its class's probability over the class's count; what
        its own count adds is joined later."""
        get, outside = self.place.get, self.outside
        sizes = np.array([len(t) for t in held])
        at = np.array([get(w, outside) for t in held for w in t], np.int32)
        first = np.cumsum(sizes) - sizes
        ids = self.class_of[at]
        rare = np.flatnonzero(at == outside)
        cuts = np.searchsorted(rare, [*first.tolist(), len(at)]).tolist()
        classes = []
        for k, t in enumerate(held):
            own = [t[i] for i in (rare[cuts[k] : cuts[k + 1]] - first[k]).tolist()]
            some = Counter(own)
            found = dict(zip(some, classes_of([*some], self.single, self.groups), strict=True))
            tail.words.extend(some)
            tail.tf.extend(some.values())
            tail.unseen.extend([self.unseen[k] for k in found.values()])
            tail.ends.append(len(tail.words))
            classes += [found[w] for w in own]
        ids[rare] = classes
        logs = self.normalisers.log_probabilities(contexts(ids, sizes), ids) * math.log10(math.e) + self.share_of[at]
        logs[rare] -= self.in_class[ids[rare]]
        out[0] += sizes.tolist()
        out[1] += (sizes - np.diff(cuts)).tolist()
        out[2] += (np.add.reduceat(self.base_of[at], first) - sizes * self.base_total).tolist()
        out[3] += np.add.reduceat(logs, first).tolist()


class _Shipped:
    """What is broadcast for scoring. A worker keeps a broadcast's value between tasks, and so its scorer and tables."""

    def __init__(self, vocabulary: Vocabulary, table: np.ndarray):
        self.vocabulary, self.table = vocabulary, table

    @functools.cached_property
    def scorer(self) -> _Scorer:
        return _Scorer(self.vocabulary, self.table)


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, model: Model) -> DataFrame:
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(_Shipped(vocabulary, model.table()))
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<struct<word: binary, tf: long, unseen: double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shipped.value.scorer
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[list] = [[] for _ in range(4)]
            tail = _Tail()
            held, size = [], 0
            for text in _buffers(batch.column(2)):
                held.append(words(text))
                size += len(held[-1])
                if size > 16 * ROWS:
                    scorer.add(held, out, tail)
                    held, size = [], 0
            if held:
                scorer.add(held, out, tail)
            columns = (pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, tail.array()], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail"])

    rows = texts(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, ddl)
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.tf", "t.unseen").join(counts, "word", "left")
    c, tf = F.coalesce("c", F.lit(0)), F.col("tf")
    share = F.when(c > 0, F.log10(c - vocabulary.discount)).otherwise(F.col("unseen"))
    tail = tail.groupBy("row").agg(F.sum(F.when(c > 0, tf).otherwise(0)).alias("known"), F.sum(tf * F.log10(c + 1.0)).alias("more_base"), F.sum(tf * share).alias("more_score"))
    out = rows.drop("tail").join(tail, "row", "left")
    add = lambda x, more: F.col(x) + F.coalesce(more, F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", add("n_known", "known").cast("long").alias("n_known"), F.lit(vocabulary.n).cast("long").alias("train_tokens"), add("base", "more_base").alias("base_score"), add("score", "more_score").alias("score"))


def lm_scoring(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    small_batches(docs.sparkSession)
    counts = word_counts(docs)
    vocabulary = Vocabulary(counts)
    return score(docs, counts, vocabulary, train(docs, vocabulary))
