"""Order-preserving packing of documents into fixed windows by dynamic programming.

Documents stand in ascending doc_id order. Windows of at most ``length`` tokens are cut from their token stream at
document ends (free), sentence ends (``SENTENCE_CUT``) or, where a sentence is long, inside it (``WORD_CUT``; the costs
are in tokens of padding). The program minimises padding plus these truncation penalties: with places p, cost

    best(j) = min over i with p_j - length <= p_i < p_j of best(i) + length - (p_j - p_i) + cut(j)

so best(i) + p_i is all that matters of i, and a monotone queue gives each minimum in constant amortised time. A
sequence whose length is a power of two needs no padding, so the rest of a partition is cut into powers of two.

Each range partition is packed by itself in blocks of ``BLOCK_TOKENS``; what a block leaves open goes on into the next.

Contract: null text counts as empty (a document of the end id alone); null doc_ids come first, equal ones are ordered
by their texts' hashes; an empty table gives no pieces; other columns are ignored; texts of any length are cut.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .binary_records import in_order
from .common import small_batches
from .tokenizer import read_tokenizer, worker_encoder

LENGTH = 2048
SENTENCE_CUT, WORD_CUT = 1, 4
#: No two places to cut are further apart.
WIDEST_GAP = 32
BLOCK_TOKENS = 1 << 20
#: Bytes of text in a partition, which is a stream: the first in corpora of up to 64 GB, at most the second.
PARTITION_TEXT_BYTES, MOST_TEXT_BYTES = 16 << 20, 512 << 20
_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def places_to_cut(ends: np.ndarray, sentences: np.ndarray, total: int, widest: int = WIDEST_GAP) -> tuple[np.ndarray, np.ndarray]:
    """Places (0 first, ``total`` last) and the penalty of a cut at each. ends, sentences: places after such tokens."""
    cost = np.full(total + 1, WORD_CUT, np.int32)
    cost[sentences] = SENTENCE_CUT
    cost[ends] = 0
    cost[[0, total]] = 0
    known = np.union1d(np.union1d(ends, sentences), [0, total])
    gaps = np.diff(known)
    extra = (gaps - 1) // widest
    first = np.repeat(np.cumsum(extra) - extra, extra)
    steps = np.arange(len(first)) - first + 1
    places = np.union1d(known, np.repeat(known[:-1], extra) + steps * widest)
    return places, cost[places]


def cut_windows(places: list[int], costs: list[int], length: int) -> tuple[list[int], list[float]]:
    """For each place the index of the window's start before it, and the least cost of ending a window there."""
    best: list[float] = [0.0] * len(places)
    came = [0] * len(places)
    keys: list[float] = [float(places[0])] * len(places)
    queue = deque([0])
    for j in range(1, len(places)):
        place = places[j]
        least = place - length
        while places[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        came[j] = i
        best[j] = value = keys[i] + length - place + costs[j]
        keys[j] = key = value + place
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    return came, best


def _way(came: list[int], j: int) -> list[int]:
    way = []
    while j:
        way.append(j)
        j = came[j]
    return way[::-1]


def window_ends(places: np.ndarray, costs: np.ndarray, length: int, last: bool) -> list[int]:
    """Where windows end. last: the whole stream is cut, its rest into powers of two; else the rest stays open."""
    at, total = places.tolist(), int(places[-1])
    if total == 0:
        return []
    came, best = cut_windows(at, costs.tolist(), length)
    near = range(int(np.searchsorted(places, max(0, total - length))), len(at))
    if not last:  # the cheapest end in the last window's reach, by cost and what is left unused
        j = min(near, key=lambda j: best[j] + at[j])
        return [at[k] for k in _way(came, j)]
    # a rest of r tokens becomes as many windows as r has bits, without padding
    j = min(near, key=lambda j: best[j] + (WORD_CUT * ((total - at[j]).bit_count() - 1) if total > at[j] else 0))
    ends, rest, place = [at[k] for k in _way(came, j)], total - at[j], at[j]
    while rest:
        size = 1 << (rest.bit_length() - 1)
        place, rest = place + size, rest - size
        ends.append(place)
    return ends


class _Packer:
    """Packs one partition's stream; holds one block and the open rest before it."""

    def __init__(self, length: int, sentence_end: np.ndarray, first_sequence: int):
        self.length, self.sentence_end, self.sequence = length, sentence_end, first_sequence
        self.docs: list[tuple[int | None, int, int, int]] = []  # doc_id, all its tokens, start in it, tokens here
        self.ids: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        for at in range(0, len(ids), BLOCK_TOKENS):
            part = ids[at : at + BLOCK_TOKENS]
            self.docs.append((doc_id, len(ids), at, len(part)))
            self.ids.append(part)
            self.held += len(part)
            if self.held >= BLOCK_TOKENS:
                yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.held:
            return
        ids = np.concatenate(self.ids)
        sizes = np.array([d[3] for d in self.docs])
        after = np.cumsum(sizes)
        whole = after[[d[1] == d[2] + d[3] for d in self.docs]]
        places, costs = places_to_cut(whole, np.flatnonzero(self.sentence_end[ids]) + 1, len(ids))
        raw = memoryview(ids.astype("<u4").tobytes())
        doc, begin, used = 0, 0, 0  # used: tokens of this document already given out
        for end in window_ends(places, costs, self.length, last):
            offset = 0
            while offset < end - begin:
                doc_id, total, start, size = self.docs[doc]
                n = min(size - used, end - begin - offset)
                place = begin + offset
                yield doc_id, start + used, n, zlib.crc32(raw[4 * place : 4 * (place + n)]), total, self.sequence, offset
                offset, used = offset + n, used + n
                if used == size:
                    doc, used = doc + 1, 0
            self.sequence += 1
            begin = end
        rest = self.docs[doc:]
        if rest:
            rest[0] = (rest[0][0], rest[0][1], rest[0][2] + used, rest[0][3] - used)
        self.docs, self.ids, self.held = rest, [ids[begin:].copy()], len(ids) - begin


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shipped.value)
        table = encoder.library.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(table.values()) + 1, bool)
        ends[[i for t, i in table.items() if t.endswith((".", "!", "?", "Ċ"))]] = True
        packer = _Packer(length, ends, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], encoder.dtype).tobytes()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += packer.add(doc_id, np.frombuffer(encoder.encode(text.as_py()) + end, encoder.dtype))
            if rows:
                yield out(rows)
        if rows := list(packer.flush(True)):
            yield out(rows)
        encoder.chunks.settle()

    return in_order(docs, PARTITION_TEXT_BYTES, MOST_TEXT_BYTES).mapInArrow(run, ", ".join(f"{n} long" for n, _ in _FIELDS))
