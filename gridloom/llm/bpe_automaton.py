"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled by successive merge gadgets. At first one state accepts every sequence of byte symbols. The
gadget of a merge (u, v) -> w takes the state that u's arcs lead to; if it has an arc for v, u's arcs are redirected
to a copy of that state without the v arc, and each state with a u arc gets a w arc to where v's arcs lead. What the
final automaton accepts are exactly the properly merged token sequences, one for each byte string.

All arcs of a label lead to one state, and an arc never changes once both its state and its label exist. So the
automaton needs no table of states x labels: a state is (its birth, the state it was copied from, the label removed),
a label is (its birth, its left part), and the presence of an arc follows from these in a few steps.

Encoding runs a pre-split word through the automaton by a transition table (state, label) -> next state, whose entries
are made from the gadgets when they are first asked for: for each prefix, exactly one token ends there whose arc leaves
the state of the prefix before it. Decoding emits the byte labels of the arcs.

Contract: a null text counts as empty, an empty text has no tokens; ties do not occur (the path is unique); repeated
rows give repeated rows; an empty table gives an empty result; other columns of the input are ignored. Very long
words take time linear in their length (times the longest token).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches, texts
from .tokenizer import _SPACED, _UNSAFE, Chunks, read_tokenizer

#: The public pre-split pattern of byte-level BPE (a fixed value of the vocabulary's format).
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else 256 onwards."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _joined(parts: Iterable[tuple]) -> tuple:
    return tuple(chain.from_iterable(parts))


class Automaton:
    """States, labels and the words encoded so far."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in merges]
        symbols = byte_symbols()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels: dict[int, bytes] = {i: bytes(symbols[c] for c in t) for t, i in vocab.items()}
        self.decoding = self.labels | {i: t.encode() for t, i in self.added.items()}
        # states: 0 is the start
        self.copied, self.removed, self.state_born = [0], [-1], [-1]
        self.label_born: dict[int, int] = {i: -1 for t, i in vocab.items() if len(t) == 1}
        self.left: dict[int, int] = {}
        self.leads: dict[int, int] = dict.fromkeys(self.label_born, 0)
        for time, (u, v) in enumerate(merges):
            self._gadget(time, vocab[u], vocab[v], vocab[u + v])
        self.tokens = {self.labels[i]: i for i in self.label_born}
        self.lengths = sorted({len(t) for t in self.tokens}, reverse=True)
        # lengths of the labels that begin with three bytes, longest first, and the shorter ones that may
        self.short = tuple(x for x in self.lengths if x < 3)
        begun: dict[bytes, set[int]] = {}
        for t in self.tokens:
            if len(t) > 2:
                begun.setdefault(t[:3], set()).add(len(t))
        self.begun = {t: (*sorted(found, reverse=True), *self.short) for t, found in begun.items()}
        self.table: dict[int, int] = {}
        self.word_split = regex.compile(PRE_SPLIT)
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.chunks = Chunks(self.encode_chunk, _joined)
        # for digests: of each chunk its ids in decimals, with commas behind, and the bytes that they decode to
        self.written = Chunks(self._write, _joined)

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        if w in self.label_born or u not in self.leads or v not in self.leads:
            return
        state, after = self.leads[u], self.leads[v]
        if not self.has_arc(state, v):
            return
        self.copied.append(state)
        self.removed.append(v)
        self.state_born.append(time)
        self.leads[u] = len(self.copied) - 1
        self.label_born[w], self.left[w], self.leads[w] = time, u, after

    def has_arc(self, state: int, label: int) -> bool:
        while True:
            born = self.label_born[label]
            if born >= self.state_born[state]:
                if born < 0:
                    return True
                label = self.left[label]
            elif self.removed[state] == label:
                return False
            else:
                state = self.copied[state]

    def transition(self, state: int, label: int) -> int:
        """The next state, -1 without an arc; the entry goes into the table, which is bounded."""
        if len(self.table) > 2_000_000:
            self.table.clear()
        found = self.table[state << 32 | label] = self.leads[label] if self.has_arc(state, label) else -1
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """The token path of one pre-split word.

        Takes the longest label first and steps back where no arc goes on. Only one valid path leads to each prefix,
        so a place that once failed stays closed and each place is left at most once.
        """
        n, tokens, table, leads, begun, short = len(word), self.tokens, self.table, self.leads, self.begun, self.short
        if (whole := tokens.get(word)) is not None:
            return [whole]
        path: list[int] = []
        at: list[int] = []
        closed = bytearray(n + 1)
        place, state, sizes = 0, 0, iter(begun.get(word[:3], short))
        tried: list[Iterator[int]] = []
        while place < n:
            for size in sizes:
                if place + size > n:
                    continue
                token = tokens.get(word[place : place + size])
                if token is None or closed[place + size]:
                    continue
                after = table.get(state << 32 | token)
                if after is None:
                    after = self.transition(state, token)
                if after >= 0:
                    path.append(token)
                    at.append(place)
                    tried.append(sizes)
                    place += size
                    state, sizes = after, iter(begun.get(word[place : place + 3], short))
                    break
            else:
                closed[place] = 1
                path.pop()
                place, sizes = at.pop(), tried.pop()
                state = leads[path[-1]] if path else 0
        return path

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(self.encode_word(w.encode()) for w in self.word_split.findall(chunk)))

    def _plain(self, text: str, chunks: Chunks) -> list:
        if ("  " in text or _SPACED.search(text) or text[-2:].isspace()) and _UNSAFE.search(text):
            return list(chain.from_iterable(map(chunks.encode, self.word_split.findall(text))))
        head, *rest = text.split(" ")
        return [*(chunks.bare[head] if head else ()), *chain.from_iterable(map(chunks.__getitem__, rest))]

    def _whole(self, text: str, chunks: Chunks) -> list:
        if not self.added or not any(t in text for t in self.added):
            return self._plain(text, chunks) if text else []
        one = (lambda x: [self.added[x]]) if chunks is self.chunks else (lambda x: self._parts([self.added[x]]))
        return list(chain.from_iterable(one(x) if x in self.added else self._plain(x, chunks) for x in self.added_split.split(text) if x))

    def encode(self, text: str) -> list[int]:
        return self._whole(text, self.chunks)

    def _parts(self, ids: Iterable[int]) -> tuple[str, bytes]:
        return "".join([f"{i}," for i in ids]), b"".join(map(self.decoding.__getitem__, ids))

    def _write(self, chunk: str) -> tuple[str, bytes]:
        return self._parts(self.encode_chunk(chunk))

    def write(self, text: str) -> tuple[int, str, str]:
        """How many ids a text has, the ids in decimals joined by commas, and what they decode to."""
        parts = self._whole(text, self.written)
        decimals = "".join(parts[::2])
        return decimals.count(","), decimals[:-1], b"".join(parts[1::2]).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.decoding.__getitem__, ids)).decode("utf-8", "replace")


_automata: dict[int, Automaton] = {}


def worker_automaton(tokenizer_json: str) -> Automaton:
    key = hash(tokenizer_json)
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(tokenizer_json)
    return _automata[key]


def bpe_encode(docs: DataFrame, tokenizer_path: str, with_ids: bool = True, with_text: bool = True, digests: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens`` and, as asked, ``ids``, the ``decoded`` text, and the digests of both.

    A narrow map over the input's partitions: no shuffle, and what a task holds is one Arrow batch.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids + [("decoded", pa.string())] * with_text + [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] * digests
    ddl = "doc_id long, n_tokens long" + ", ids array<int>" * with_ids + ", decoded string" * with_text + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = worker_automaton(shipped.value)
        written = digests and not with_ids
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if written:
                    n, decimals, decoded = automaton.write(text.as_py())
                    row: list = [doc_id, n]
                else:
                    ids = automaton.encode(text.as_py())
                    decoded = automaton.decode(ids) if with_text or digests else None
                    decimals = ",".join(map(str, ids)) if digests else ""
                    row = [doc_id, len(ids), ids] if with_ids else [doc_id, len(ids)]
                row += [decoded] * with_text
                if digests:
                    row += [hashlib.sha256(decimals.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True)], names=[n for n, _ in fields])

    return texts(docs).mapInArrow(run, ddl)


def bpe_decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id``, ``ids`` to ``doc_id``, ``text``: the byte labels of the ids; null ids give an empty text."""
    spark = encoded.sparkSession
    shipped = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = worker_automaton(shipped.value)
        for batch in batches:
            decoded = [automaton.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "cast(ids as array<int>) ids").mapInArrow(run, "doc_id long, text string")
