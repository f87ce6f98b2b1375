"""SentencePiece encoding and decoding, batched in numpy.

A model's pieces, scores and kind are read from its file. A BPE model (the
kind of ``VOCAB``) merges: of all neighbouring parts whose join is a piece the
one with the highest score, the leftmost of equal ones, is joined until none is
left, as the library does. A unigram model takes the segmentation with the
highest sum of scores (Viterbi). Other kinds are refused. Characters no piece
covers become byte pieces. No piece has a word mark after another character, so
a text falls apart before every run of word marks, and its parts, the *words*,
are segmented on their own.

Different words of a batch are segmented together, by length; hashes of
substrings come from prefix hashes and probe the sorted hashes of the pieces.
Merging: every word of a length does one join a round, and only the two pairs
beside it are looked up again; a word over ``LONG_WORD`` characters is merged
alone from a heap. Viterbi: for each end position the maximum over starts and
the start that attains it are vectorised, and the latter are the backpointers.
Scores are summed in float32 from left to right, as the library does; of equal
sums the longer last piece wins. Words already met come from a bounded cache.

Normalisation is that of the model file's flags: word marks for spaces, and
the dummy prefix. A model with another rule set than identity is refused.

Defined results: null text counts as empty and has no ids; repeated rows get
one result each; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iolens.llm.common import doc_text, map_text, prepare, table
from iolens.llm.tokens import vocab_file

VOCAB = "piece_bpe_32k.model"
MARK = "▁"
CACHE_WORDS = 500_000
#: words longer than this are cut into the batch one by one
BATCH_CHARS = 1 << 18
#: words longer than this are merged from a heap: a round looks at all characters of a word
LONG_WORD = 256
#: model kinds of the file (fixed values)
UNIGRAM, BPE = 1, 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: what a character without a piece costs beside the worst piece (fixed value of the unigram model)
UNKNOWN = np.float32(10.0)


class Pieces:
    """A model's pieces, ready to encode and decode."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            spec = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        self.kind = spec.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if any(p.type == p.USER_DEFINED or self.kind == BPE and p.type == p.UNUSED for p in spec.pieces):
            raise ValueError("user-defined pieces, and unused ones of a BPE model, are not supported")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(k) for k in range(n)]
        self.unknown = sp.unk_id()
        self.bytes = {int(self.text[k][3:5], 16): k for k in range(n) if sp.is_byte(k)}
        self.byte_of = {v: k for k, v in self.bytes.items()}
        self.control = {k for k in range(n) if sp.is_control(k)}
        plain = [k for k in range(n) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
        if any(MARK in self.text[k].lstrip(MARK) for k in plain):
            raise ValueError("a piece has a word mark after another character")
        probe = sp.encode("a  b", out_type=str)
        self.prefix = probe[0].startswith(MARK)
        if "".join(probe).lstrip(MARK) != f"a{MARK}{MARK}b" or "".join(sp.encode("ﬁ", out_type=str)).lstrip(MARK) == "fi":
            raise ValueError("only models without normalisation rules are supported")
        self.longest = max(len(self.text[k]) for k in plain)
        scores = np.array([sp.get_score(k) for k in plain], np.float32)
        self.floor = np.float32(scores.min()) - UNKNOWN
        self.powers = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for _ in range(self.longest):
                self.powers.append(self.powers[-1] * _BASE)
            hashes = np.array([self._hash(self.text[k]) for k in plain], np.uint64)
        self.power = np.array(self.powers, np.uint64)
        self.by_text: dict[str, tuple[float, int]] | None = None
        order = np.argsort(hashes)
        self.keys, self.ids, self.scores = hashes[order], np.array(plain, np.int64)[order], scores[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have the same hash")
        self.lengths = np.array([len(self.text[k]) for k in plain])[order]
        #: Viterbi segmentations and merged ones
        self.cache: dict[str, bytes] = {}
        self.merged: dict[str, bytes] = {}

    def _hash(self, piece: str) -> np.uint64:
        h = np.uint64(0)
        for c in piece:
            h = h * _BASE + np.uint64(ord(c) + 1)
        return h

    # ------------------------------------------------------------------ encode

    def words(self, text: str) -> list[str]:
        """The parts of a text that are segmented on their own."""
        if not text:
            return []
        t = text.replace(" ", MARK)
        if self.prefix:
            t = MARK + t
        out, start = [], 0
        at = t.find(MARK, 1)
        while at >= 0:
            if t[at - 1] != MARK:
                out.append(t[start:at])
                start = at
            at = t.find(MARK, at + 1)
        out.append(t[start:])
        return out

    def _coded(self, words: list[str]) -> np.ndarray:
        """Prefix hashes of words of one and the same length."""
        n, length = len(words), len(words[0])
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, length).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((n, length + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(length):
                prefix[:, k + 1] = prefix[:, k] * _BASE + code[:, k]
        return prefix

    def _find(self, prefix: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the pieces ``start:end`` of the rows; -inf and -1 if there is none."""
        size = end - start
        with np.errstate(over="ignore"):
            h = prefix[row, end] - prefix[row, start] * self.power[np.minimum(size, self.longest)]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = (self.keys[at] == h) & (self.lengths[at] == size)
        return np.where(hit, self.scores[at], np.float32(-np.inf)), np.where(hit, self.ids[at], -1)

    def _ids(self, word: str, part: list[tuple[int, int]]) -> bytes:
        """Ids of a word's parts (place, id or -1), characters without a piece as
        bytes, or else a run of them as one unknown."""
        out: list[int] = []
        for at, k in part:
            if k >= 0:
                out.append(k)
            elif self.bytes:
                out.extend(self.bytes[b] for b in word[at].encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, "<u4").tobytes()

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of words of one and the same length by merging."""
        n, length = len(words), len(words[0])
        prefix = self._coded(words)
        every, place = np.repeat(np.arange(n), length), np.tile(np.arange(length), n)
        own = self._find(prefix, every, place, place + 1)[1].reshape(n, length)
        # by first character of a part: where the next and the one before begin,
        # and the score and id of its join with the next
        after = np.tile(np.arange(1, length + 2), (n, 1))
        before = np.tile(np.arange(-1, length), (n, 1))
        score, join = np.full((n, length), -np.inf, np.float32), np.full((n, length), -1, np.int64)
        if length > 1:
            every, place = np.repeat(np.arange(n), length - 1), np.tile(np.arange(length - 1), n)
            got = self._find(prefix, every, place, place + 2)
            score[:, :-1], join[:, :-1] = (x.reshape(n, length - 1) for x in got)
        part = np.ones((n, length), bool)
        todo = np.arange(n)
        while len(todo):
            p = score[todo].argmax(axis=1)  # the first of equal ones
            more = score[todo, p] > -np.inf
            todo, p = todo[more], p[more]
            q = after[todo, p]
            end = after[todo, q]
            own[todo, p] = join[todo, p]
            part[todo, q] = False
            score[todo, q] = -np.inf
            after[todo, p], before[todo, end] = end, p
            score[todo, p] = -np.inf
            w = np.flatnonzero(end < length)
            r, a = todo[w], p[w]
            score[r, a], join[r, a] = self._find(prefix, r, a, after[r, end[w]])
            w = np.flatnonzero(p > 0)
            r, a = todo[w], before[todo[w], p[w]]
            score[r, a], join[r, a] = self._find(prefix, r, a, end[w])
        size = part.sum(axis=1)
        flat = own[part]
        ends = np.cumsum(size)
        ids = flat.astype("<u4")
        rare = np.zeros(n, bool)
        rare[np.repeat(np.arange(n), size)[flat < 0]] = True
        return [self._ids(words[k], [(int(a), int(own[k, a])) for a in np.flatnonzero(part[k])]) if bad else ids[e - m:e].tobytes()
                for k, (e, m, bad) in enumerate(zip(ends.tolist(), size.tolist(), rare.tolist()))]

    def merge_long(self, word: str) -> bytes:
        """Ids of one word by merging from a heap of pairs."""
        if self.by_text is None:
            self.by_text = {self.text[k]: (-float(x), k) for k, x in zip(self.ids.tolist(), self.scores)}
        get, n = self.by_text.get, len(word)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        part = [True] * n
        own = [get(c, (0, -1))[1] for c in word]
        heap: list[tuple[float, int, int, int, int]] = []

        def pair(a: int) -> None:
            mid = after[a]
            if mid < n and after[mid] - a <= self.longest and (got := get(word[a:after[mid]])):
                heapq.heappush(heap, (got[0], a, mid, after[mid], got[1]))

        for a in range(n):
            pair(a)
        while heap:
            _, a, mid, end, k = heapq.heappop(heap)
            if not (part[a] and mid < n and part[mid] and after[a] == mid and after[mid] == end):
                continue  # one of the two has been joined since
            part[mid], own[a], after[a], before[end] = False, k, end, a
            pair(a)
            if before[a] >= 0:
                pair(before[a])
        return self._ids(word, [(a, own[a]) for a in range(n) if part[a]])

    def segment(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of one and the same length by Viterbi."""
        n, length = len(words), len(words[0])
        prefix = self._coded(words)
        with np.errstate(over="ignore"):
            best = np.full((n, length + 1), -np.inf, np.float32)
            best[:, 0] = 0
            back = np.zeros((n, length + 1), np.int32)
            piece = np.full((n, length + 1), -1, np.int32)
            for end in range(1, length + 1):
                # one unknown character is always possible
                top, start, own = best[:, end - 1] + self.floor, np.full(n, end - 1, np.int32), np.full(n, -1, np.int32)
                for k in range(1, min(end, self.longest) + 1):
                    h = prefix[:, end] - prefix[:, end - k] * self.powers[k]
                    at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                    hit = (self.keys[at] == h) & (self.lengths[at] == k)
                    if not hit.any():
                        continue
                    total = np.where(hit, best[:, end - k] + self.scores[at], -np.inf).astype(np.float32)
                    better = total >= top if k > 1 else hit
                    top = np.where(better, total, top)
                    start = np.where(better, end - k, start)
                    own = np.where(better, self.ids[at], own)
                best[:, end], back[:, end], piece[:, end] = top, start, own
        out: list[list[int]] = [[] for _ in words]
        place = np.full(n, length)
        alive = np.arange(n)
        while len(alive):
            got = piece[alive, place[alive]]
            for w, p, e in zip(alive.tolist(), got.tolist(), place[alive].tolist()):
                if p >= 0:
                    out[w].append(p)
                else:
                    fall = [self.bytes[b] for b in words[w][e - 1].encode()] if self.bytes else [self.unknown]
                    out[w].extend(reversed(fall))
            place[alive] = back[alive, place[alive]]
            alive = alive[place[alive] > 0]
        return [np.array(x[::-1], "<u4") for x in out]

    def _fill(self, cache: dict[str, bytes], words: set[str], segment) -> None:
        """Put what ``segment`` makes of words into a cache, those of a length together."""
        if len(cache) > CACHE_WORDS:
            cache.clear()
        by: dict[int, list[str]] = {}
        for w in words - cache.keys():
            by.setdefault(len(w), []).append(w)
        for length, group in by.items():
            step = max(1, BATCH_CHARS // length)
            for k in range(0, len(group), step):
                part = group[k:k + step]
                cache.update(zip(part, segment(part)))

    def add(self, words: set[str]) -> None:
        """Put the Viterbi segmentations of words into the cache."""
        self._fill(self.cache, words, lambda part: [x.tobytes() for x in self.segment(part)])

    def add_merged(self, words: set[str]) -> None:
        """Put the merged segmentations of words into their cache."""
        self._fill(self.merged, words, lambda part: [*map(self.merge_long, part)] if len(part[0]) > LONG_WORD else self.merge(part))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers, segmented as the model's kind asks."""
        add, cache = (self.add_merged, self.merged) if self.kind == BPE else (self.add, self.cache)
        split = [self.words(t) for t in texts]
        add(set().union(*split) if split else set())
        return [b"".join(map(cache.__getitem__, w)) for w in split]

    # ------------------------------------------------------------------ decode

    def decode(self, ids: bytes) -> str:
        """Text of ids: pieces joined, byte pieces read as UTF-8 (wrong bytes become
        U+FFFD), word marks as spaces, without the dummy prefix."""
        out = bytearray()
        for k in np.frombuffer(ids, "<u4").tolist():
            b = self.byte_of.get(k)
            if b is not None:
                out.append(b)
            elif k not in self.control:
                out += " ⁇ ".encode() if k == self.unknown else self.text[k].encode()
        text = out.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(text: Column, path: str) -> Column:
    """Ids of a text column as array<int>."""
    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, "<u4").astype(np.int32) for x in pieces(path).encode(texts.tolist())])

    return ids(F.coalesce(text, F.lit("")))


def decode(ids: Column, path: str) -> Column:
    """Text of an array<int> column."""
    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        return pd.Series([pieces(path).decode(np.asarray(x, "<u4").tobytes()) for x in rows])

    return text(F.coalesce(ids, F.array().cast("array<int>")))


def describe(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, n_unknown`` (byte or unknown pieces),
    ``round_trip`` (decoding gives the text back) of every row."""
    def batch(b: pa.RecordBatch) -> dict:
        p = pieces(path)
        texts = b.column("text").to_pylist()
        out: dict[str, list] = {"n_pieces": [], "ids_crc32": [], "n_unknown": [], "round_trip": []}
        rare = np.array(sorted([*p.byte_of, p.unknown]), np.uint32)
        for text, ids in zip(texts, p.encode(texts)):
            out["n_pieces"].append(len(ids) // 4)
            out["ids_crc32"].append(zlib.crc32(ids))
            out["n_unknown"].append(int(np.isin(np.frombuffer(ids, "<u4"), rare).sum()))
            out["round_trip"].append(p.decode(ids) == text.replace(MARK, " "))
        return out | {"doc_id": b.column("doc_id")}

    return map_text(doc_text(docs), "doc_id long, n_pieces long, ids_crc32 long, n_unknown long, round_trip boolean", batch)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Encode every document with the pieces of a public vocabulary, and decode it again."""
    prepare(spark)
    return describe(table(spark, sf_dir, "documents"), vocab_file(VOCAB))
