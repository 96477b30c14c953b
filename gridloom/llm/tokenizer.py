"""Whole texts to token ids with the ``tokenizers`` library, one call for each distinct chunk.

A byte-level BPE pre-tokenizer never joins characters across a boundary that lies before a single space (unless white
space stands on both sides). Texts are cut there, each distinct chunk is encoded once per worker by the library, and
texts with such white space, or with the text of a special token, go to the library whole. The ids equal
``Tokenizer.encode(text, add_special_tokens=False).ids``.
"""

from __future__ import annotations

import json
import re
import string
from array import array
from itertools import islice

import numpy as np

#: Chunks kept per generation of a worker's cache; two generations bound its memory.
CACHE_CHUNKS = 250_000
#: Longest chunk that is kept.
CACHE_CHARS = 64
_SPACED = re.compile(r" [^\S ]")
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: Line feeds between two characters that are no white space.
_FEEDS = re.compile(r"(?<=\S)\n(?=\S)")
#: ASCII marks; the apostrophe is left out, as it begins pre-tokens with letters.
_MARKS = string.punctuation.replace("'", "")


class Chunks(dict):
    """Chunk (without ``before``, which stands before it) to what ``encode`` makes of it; ``join`` puts parts together.

    Lines and the marks after a word are cut off first: neither a single line feed nor a run of such marks after a
    letter is ever in one pre-token with what stands before it. Two bounded generations are kept. ``word``, if given, encodes
    a chunk of ASCII letters, from what stands before it and the chunk.
    """

    def __init__(self, encode, join, before: str = " ", limit: int = CACHE_CHUNKS, word=None):
        super().__init__()
        self.encode, self.join, self.before, self.limit, self.old, self.word = encode, join, before, limit, {}, word
        self.bare = Chunks(encode, join, "", limit // 4, word) if before else self

    def __missing__(self, chunk: str):
        found = self.old.get(chunk)
        if found is None:
            if chunk.isalpha():
                found = self.word(self.before, chunk) if self.word and chunk.isascii() else self.encode(self.before + chunk)
            elif "\n" in chunk:
                found = self._lines(chunk)
                if chunk != "\n":
                    return found
            else:
                stem = chunk.rstrip(_MARKS)
                if stem and len(stem) < len(chunk) and stem[-1] < "ɐ" and stem[-1].isalpha():
                    found = self[stem] + self.bare[chunk[len(stem) :]]
                else:
                    found = self.encode(self.before + chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found

    def settle(self) -> None:
        """Let the older generation go at the end of a task, so that an idle worker holds one at most; as much of it as there
        is room for stays in the other, its first (most frequent) chunks first."""
        for chunk, found in islice(self.old.items(), max(0, self.limit - len(self))):
            self.setdefault(chunk, found)
        self.old = {}
        if self.bare is not self:
            self.bare.settle()

    def _lines(self, chunk: str):
        first, _, rest = chunk.partition("\n")
        if "\n" not in rest:
            if first and rest and not first[-1].isspace() and not rest[0].isspace():
                return self.join((self[first], self.bare["\n"], self.bare[rest]))
        else:
            first, *lines = _FEEDS.split(chunk)
            if lines:
                feed = self.bare["\n"]
                return self.join([self[first], *(part for line in lines for part in (feed, self.bare[line]))])
        return self.encode(self.before + chunk)


class TextEncoder:
    """Encodes texts; ``bytes`` of ``dtype`` ids."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(tokenizer_json)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.chunked = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not spec.get("post_processor")
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.model = self.library.model
        # the characters that stand for bytes
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        others = iter(range(256, 512))
        self.symbol = [chr(b) if b in printable else chr(next(others)) for b in range(256)].__getitem__
        self.space = self.symbol(32)
        self.chunks = Chunks(self._piece, b"".join, word=self._word)

    def _word(self, before: str, word: str) -> bytes:
        return array(self.code, [x.id for x in self.model.tokenize(self.space + word if before else word)]).tobytes()

    def _piece(self, text: str) -> bytes:
        """A word of letters, with or without a space before it, is one pre-token: the library's BPE takes it as it is."""
        word = text[1:] if text[0] == " " else text
        if word.isalpha():
            if word.isascii():
                found = self.model.tokenize(self.space + word if word is not text else word)
            elif max(word) < "ɐ":
                found = self.model.tokenize("".join(map(self.symbol, text.encode())))
            else:
                return self._whole(text)
            return array(self.code, [x.id for x in found]).tobytes()
        return self._whole(text)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.chunked or any(s in text for s in self.special):
            return self._whole(text)
        if ("  " in text or _SPACED.search(text) or text[-2:].isspace()) and _UNSAFE.search(text):
            return self._whole(text)
        head, *rest = text.split(" ")
        return (self.chunks.bare[head] if head else b"") + b"".join(map(self.chunks.__getitem__, rest))


_encoders: dict[str, TextEncoder] = {}


def worker_encoder(tokenizer_json: str) -> TextEncoder:
    """One encoder per Python worker, kept between tasks."""
    if tokenizer_json not in _encoders:
        _encoders.clear()
        _encoders[tokenizer_json] = TextEncoder(tokenizer_json)
    return _encoders[tokenizer_json]


def read_tokenizer(path: str) -> str:
    """The tokenizer's file, read once on the driver and broadcast (a fixed 1.6 MB, whatever the corpus)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
