"""Token ids of whole texts by the ``tokenizers`` library, at batch speed.

A byte-level BPE tokenizer splits a text before it merges, and never inside a
run of characters that are not white space followed by white space. So a text
is cut there into chunks, each chunk is encoded by the library's own model, and its
ids (little-endian bytes) are remembered in a bounded cache: a text's ids are the
joined ids of its chunks, exactly those of the whole text
(``tests/llm/test_packing.py``). A tokenizer of another kind, or a text that
holds one of its added tokens as a string, is encoded whole.

The operators take ``encoder(path)``: the file's tokenizer as it is, so a special
token that a text spells out, such as ``<|endoftext|>``, is one id.
"""

from __future__ import annotations

import json
import os
import struct
from functools import lru_cache

import numpy as np
import regex

#: Unicode White_Space, which the library's splitting pattern takes as \s (fixed value)
_SPACE = "\t-\r \x85\xa0  -     　"
#: the byte-level splitting pattern (fixed value)
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: entries of a cache's generation; a cache has two. Longer chunks are not kept
CACHE_ROWS = 500_000
_LONGEST = 64


def vocab_file(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Remembered(dict):
    """key -> ``make(key)`` for the keys met lately, in two generations of ``rows``
    entries: when the young one is full it becomes the old one, and an old entry that
    is met again moves to the young one. So keys in steady use stay, at any corpus size."""

    def __init__(self, make, rows: int):
        super().__init__()
        self.make, self.rows, self.old = make, rows, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.rows:
            self.old = dict(self)
            self.clear()
        if len(key) <= _LONGEST:
            self[key] = value

    def holds(self, key) -> bool:
        return key in self or key in self.old


def shown_bytes() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


class OddSpace(ValueError):
    """A text has white space other than a single space or line end between other characters."""


def check_word(word: str) -> None:
    """Raises ``OddSpace`` unless ``word``, a line end before it aside, has characters and no white space."""
    core = word[1:] if word[:1] == "\n" else word
    if core.split() != [core]:
        raise OddSpace


class Encoder:
    """``bytes_of(text)``: the ids as little-endian unsigned integers of ``width`` bytes.
    Special tokens spelled out in a text are their ids with ``special``, else plain characters."""

    def __init__(self, path: str, special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.pack = {n: struct.Struct(f"<{n}{'H' if self.width == 2 else 'I'}").pack for n in range(1, 2 * _LONGEST)}
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.plain = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                      and not spec.get("normalizer") and model["type"] == "BPE" and not model.get("dropout"))
        self.added = [t["content"] for t in spec.get("added_tokens") or [] if special or not t.get("special")]
        self.chunk = regex.compile(f"[{_SPACE}]*+[^{_SPACE}]++|[{_SPACE}]++")
        self.piece = regex.compile(_PIECES)
        self.shown = shown_bytes()
        self.space = self.shown[ord(" ")]
        self.pieces = Remembered(self._merge, CACHE_ROWS // 4)
        self.chunks = Remembered(self._split, CACHE_ROWS // 4)
        #: words without the space before them, or with the line end
        self.words = Remembered(self._word, CACHE_ROWS)

    def _ids(self, shown: str) -> bytes:
        ids = [t.id for t in self.tok.model.tokenize(shown)]
        pack = self.pack.get(len(ids))
        return pack(*ids) if pack else np.array(ids, self.dtype).tobytes()

    def _merge(self, piece: str) -> bytes:
        return self._ids(piece.encode().decode("latin-1").translate(self.shown))

    def _split(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.piece.findall(chunk)))

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._ids(self.space + (word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)))
        body = word[:-1]
        if body.isalpha() and word[-1] in ".,":
            return self.words[body] + self.pieces[word[-1]]
        check_word(word)
        return self._split(word if word[:1] == "\n" else " " + word)

    def bytes_of(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.plain or any(t in text for t in self.added):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        # single spaces and line ends only: splitting at spaces is faster. A line
        # end becomes a part of its own line's first word, as in the chunks below
        first, *words = text.replace("\n", " \n").split(" ")
        try:
            check_word(first)
            return self.chunks[first] + b"".join(map(self.words.__getitem__, words))
        except OddSpace:
            return b"".join(map(self.chunks.__getitem__, self.chunk.findall(text)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path, special=True)


def ids32(ids: bytes, width: int) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    return ids if width == 4 else np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
