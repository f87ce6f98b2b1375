"""Two tokenizers' tokens of the same texts, aligned by the bytes they cover.

A is a byte-level BPE of the ``tokenizers`` library, which encodes a space and
the text; B is a SentencePiece model, which puts that space there itself. Both
give the same bytes, so both sets of tokens cut one byte string.

*Cuts.* The libraries say where a token lies: ``tokenizers`` by character
offsets, ``sentencepiece`` by the spans of its proto result (bytes of the text). These are the
coarse cuts: the end of a token is a byte place wherever the next token starts
at or after it. Inside a character that several tokens share, and inside a run
of byte-fallback tokens, the spans can't tell the tokens apart; there the cuts
advance by the tokens' decoded bytes from the last coarse cut. A text counts only
if each side's decoded bytes are exactly the space and the text.

*Groups* end where both sides cut. *Links* are the pairs of an A and a B token
that share a byte: one for each stretch between neighbouring cuts of either
side, as two tokens share one stretch at most.

*Units.* Neither library joins characters across a single space or line end
between other characters (checked on the model's pieces, and on the pattern of the
byte-level split), so a plain text is the chain of its units, a word with the
space or line end before it, and a worker aligns a unit once while it remembers it.
Neither joins a letter to a full stop or comma (checked likewise), so these are
units of their own after a word of letters.
Any other text (white space of another kind, at an end or in runs; a unit whose
bytes differ) is encoded whole by the libraries.

*Corpus counts.* A text's links are stored as distinct (B id, A id) pairs with
their number; Spark sums them over the corpus and finds every B id's highest
count. The pairs' table is written sorted, and cut into slices of about ``SLICE``
pairs at borders of its key. Slices go to the texts, not texts to the pairs: a
task reads one slice (bounded memory) and adds what its texts' links find there;
with several slices a text's sums are added. So a pair that half of all links
are is one entry and no key of a shuffle. There are at most ``len(A) * len(B)``
pairs however long the corpus is.

Defined results: null and empty texts, and texts that fail the byte check, have
no tokens: zeros and ''. Strings of special tokens are plain text. Rows that repeat a
doc_id, or have none, are rows of their own; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iolens.llm.common import doc_text, map_text, prepare, table, written
from iolens.llm.tokens import OddSpace, Remembered, check_word, shown_bytes, vocab_file
from iolens.session import scratch_path

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: pairs of the corpus table that a task holds at once (16 bytes each)
SLICE = 4_000_000
#: units that a worker remembers in a generation
UNITS = 450_000
_SPACE = "▁"  # fixed value: how SentencePiece writes a space

#: numbers of A tokens, B tokens and groups; the groups as text; the links' pairs, packed integers B id * len(A) + A id
Summary = tuple[int, int, int, bytes, bytes]


def refined(spans: list[tuple[int, int]], sizes: list[int], loose: list[bool] | None = None) -> list[int]:
    """Byte ends of tokens from their spans: a span's end is a cut if it isn't
    empty, the next span begins there or later, and it isn't ``loose`` (what
    spans say is no cut); elsewhere the token's decoded bytes count on from the cut before."""
    if not (loose and any(loose)) and all(x[1] <= y[0] and x[0] < x[1] for x, y in zip(spans, spans[1:])) and spans and spans[-1][0] < spans[-1][1]:
        return [e for _, e in spans]
    ends, at, last = [], 0, len(spans) - 1
    for k, ((begin, end), size) in enumerate(zip(spans, sizes)):
        clean = end > begin and (k == last or spans[k + 1][0] >= end) and not (loose and loose[k])
        at = end if clean else at + size
        ends.append(at)
    return ends


class Aligner:
    """Both tokenizers, and the units this worker has met."""

    def __init__(self, a_path: str, b_path: str, units: int = UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(a_path)
        self.tok.encode_special_tokens = True
        self.sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.shown = shown_bytes()
        self.space = self.shown[ord(" ")]
        byte_of = {c: b for b, c in self.shown.items()}
        self.n_a, self.n_b = self.tok.get_vocab_size(), self.sp.get_piece_size()
        self.a_bytes: list[bytes] = [b""] * self.n_a
        for token, k in self.tok.get_vocab().items():
            self.a_bytes[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = self.pieces = [self.sp.id_to_piece(k) for k in range(self.n_b)]
        self.fallback = [self.sp.is_byte(k) for k in range(self.n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if f else p.replace(_SPACE, " ").encode() for p, f in zip(pieces, self.fallback)]
        self.a_text, self.b_text = ([str(k) for k in range(n)] for n in (self.n_a, self.n_b))
        #: an id and what follows it in the groups' text
        self.text_of = np.array([[f"{k}{c}" for k in range(max(self.n_a, self.n_b))] for c in (",", "|", ";", "\n")], object)
        self.b_size = list(map(len, self.b_bytes))
        self.lone_space = self.sp.piece_to_id(_SPACE)
        self.kind, self.code = (np.uint32, "I") if self.n_a * self.n_b < 1 << 32 else (np.uint64, "Q")
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.in_units = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
                         and not any(not t.get("special") for t in spec.get("added_tokens") or [])
                         and not any(regex.search(f"[^{_SPACE}]{_SPACE}|\n", p) for p in pieces))
        self.marks = {m: x for m in ".," if (x := self._mark(m))} if self.in_units else {}
        self.units = Remembered(self._unit, units)

    def a_tokens(self, text: str, got=None) -> tuple[list[int], list[int]] | None:
        """A's ids of a string and their byte ends; None if their bytes are not the
        string's. ``got``: the library's encoding, if it is there already."""
        got = got or self.tok.encode(text, add_special_tokens=False)
        ids, spans, raw = got.ids, got.offsets, text.encode()
        decoded = list(map(self.a_bytes.__getitem__, ids))
        if b"".join(decoded) != raw:
            return None
        if len(raw) != len(text):  # characters to bytes
            starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80).tolist()
            starts.append(len(raw))
            spans = [(starts[b], starts[e]) for b, e in spans]
        return ids, refined(spans, list(map(len, decoded)))

    def b_tokens(self, text: str, got=None) -> tuple[list[int], list[int]] | None:
        """B's ids of a string and their byte ends in a space and the string; None if
        their bytes are not those. ``got``: the library's proto, if it is there already."""
        got = got or self.sp.encode(text, return_type="proto")
        found = [(p.id, p.end + 1) for p in got.pieces]  # spans don't count the space that the model puts first
        ids, ends = map(list, zip(*found))
        decoded = [self.b_bytes[k] for k in ids]
        if b"".join(decoded) != b" " + text.encode():
            return None
        sizes = list(map(len, decoded))
        if list(accumulate(sizes)) != ends:  # spans that are no cuts
            spans = [(p.begin + 1, p.end + 1) for p in got.pieces]
            spans[0] = 0, spans[0][1]
            ends = refined(spans, sizes, [self.fallback[k] for k in ids])
        return ids, ends

    def align(self, text: str) -> Summary | None:
        """The summary of a text that the libraries encode whole, or None if it has no tokens."""
        a, b = self.a_tokens(" " + text), self.b_tokens(text)
        return self.summary(*a, *b) if a and b else None

    def _unit(self, unit: str, a=None, b=None) -> Summary | None:
        """The summary of a unit: a word (after a space), or a line end and a word. ``a``, ``b``: as of ``a_tokens`` and ``b_tokens``."""
        if unit[-1:] in self.marks and unit[:-1].isalpha():
            word, mark = self.units[unit[:-1]], self.marks[unit[-1]]
            return tuple([x + y for x, y in zip(word[:3], mark[:3])] + [word[3] + b";" + mark[3], word[4] + mark[4]]) if word and mark else None
        if unit.isalpha():
            return self._word(unit)
        check_word(unit)
        if unit[0] != "\n":
            a, b = self.a_tokens(" " + unit, a), self.b_tokens(unit, b)
        else:
            a, b = self.a_tokens(unit, a), self.b_tokens(unit, b)
            if a and b:  # the space that B puts first belongs to no line end
                b = (b[0][1:], [e - 1 for e in b[1][1:]]) if b[0][0] == self.lone_space else None
        return self.summary(*a, *b) if a and b else None

    def _shown(self, word: str) -> str:
        """A's characters for a space and a word."""
        return self.space + (word if word.isascii() else word.encode().decode("latin-1").translate(self.shown))

    def _word(self, word: str) -> Summary | None:
        return self._words([word])[0]

    def _words(self, words: list[str]) -> list[Summary | None]:
        """Units of letters, together. A's model takes such a word in one piece, in characters that stand
        for its bytes, so the model's own offsets (in UTF-8 of these characters) are the cuts;
        B's spans are, unless they differ from the decoded bytes' running sum."""
        a_ids, a_ends, a_n, b_ids, b_ends, b_n, base = [], [], [], [], [], [], 0
        for word, proto in zip(words, self.sp.encode(words, return_type="proto", num_threads=1)):
            shown = self._shown(word)
            got = self.tok.model.tokenize(shown)
            a_n.append(len(got))
            a_ids += [t.id for t in got]
            if word.isascii():  # the space's character alone has two bytes
                a_ends += [base + t.offsets[1] - 1 for t in got]
            else:
                place = [k for k, c in enumerate(shown) for _ in range(1 + (c > "\x7f"))] + [len(shown)]
                a_ends += [base + place[t.offsets[1]] for t in got]
            pieces = proto.pieces
            b_n.append(len(pieces))
            b_ids += [p.id for p in pieces]
            b_ends += [base + p.end + 1 for p in pieces]
            base += len(shown)
        raw = b" " + " ".join(words).encode()
        if list(accumulate(map(self.b_size.__getitem__, b_ids))) != b_ends or b"".join([self.b_bytes[k] for k in b_ids]) != raw:
            # a word whose bytes differ or whose spans are no cuts: one by one
            both = [(self.a_tokens(" " + w), self.b_tokens(w)) for w in words]
            return [self.summary(*x, *y) if x and y else None for x, y in both]
        return self._summaries(*(np.array(x, np.int64) for x in (a_ids, a_ends, a_n, b_ids, b_ends, b_n)))

    def _summaries(self, a, a_ends, a_n, b, b_ends, b_n) -> list[Summary]:
        """``summary`` of many units that lie one after another: ids, ends and numbers of tokens of both sides."""
        ends = np.union1d(a_ends, b_ends)
        x, y = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        pairs = (b[y] * self.n_a + a[x]).astype(self.kind).tobytes()
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        last_a, last_b = np.searchsorted(a_ends, common), np.searchsorted(b_ends, common)  # a group's last tokens
        close = a_ends[np.cumsum(a_n) - 1]  # ends of the units
        # a group is A's ids, a bar, B's ids, and a semicolon or the unit's end
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[last_a] = 1
        mark_b[last_b] = 2
        mark_b[np.cumsum(b_n) - 1] = 3
        out = np.empty(len(a) + len(b), object)
        group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
        out[np.arange(len(a)) + np.concatenate(([0], last_b + 1))[group_a]] = self.text_of[mark_a, a]
        out[np.arange(len(b)) + last_a[group_b] + 1] = self.text_of[mark_b, b]
        groups = "".join(out.tolist()).encode().split(b"\n")
        cut = (np.searchsorted(ends, close) + 1) * self.kind(0).itemsize
        n_groups = np.diff(np.searchsorted(common, close) + 1, prepend=0)
        return [(n, m, k, g, pairs[i:j]) for n, m, k, g, i, j in zip(a_n.tolist(), b_n.tolist(), n_groups.tolist(), groups, [0, *cut.tolist()], cut.tolist())]

    def _mark(self, mark: str) -> Summary | None:
        """A mark after a word, if B has no piece of a letter and the mark: what both make of it in ``a`` and the mark."""
        if any(regex.search(rf"\p{{L}}{regex.escape(mark)}", p) for p in self.pieces):
            return None
        a, b = self.a_tokens(" a" + mark), self.b_tokens("a" + mark)
        if not a or not b or 2 not in a[1] or 2 not in b[1]:
            return None
        i, j = a[1].index(2) + 1, b[1].index(2) + 1
        return self.summary(a[0][i:], [e - 2 for e in a[1][i:]], b[0][j:], [e - 2 for e in b[1][j:]])

    def summary(self, a: list[int], a_ends: list[int], b: list[int], b_ends: list[int]) -> Summary:
        """Walks both sides' tokens along the bytes."""
        n_a, a_text, b_text, links, groups = self.n_a, self.a_text, self.b_text, [], []
        i = j = first_a = first_b = 0
        x, y, last = a_ends[0], b_ends[0], len(a) - 1
        while True:
            links.append(b[j] * n_a + a[i])
            if x < y:
                i += 1
                x = a_ends[i]
            elif y < x:
                j += 1
                y = b_ends[j]
            else:
                groups.append(",".join([a_text[k] for k in a[first_a:i + 1]]) + "|" + ",".join([b_text[k] for k in b[first_b:j + 1]]))
                if i == last:
                    break
                i, j = i + 1, j + 1
                first_a, first_b, x, y = i, j, a_ends[i], b_ends[j]
        return len(a), len(b), len(groups), ";".join(groups).encode(), array(self.code, links).tobytes()

    def learn(self, units: set[str]) -> None:
        """Align new units, in few calls of the libraries."""
        known, words, others = self.units, [], []
        for u in units:
            if not known.holds(u):
                if u[-1:] in self.marks and u[:-1].isalpha():
                    u = u[:-1]  # put together from its word and the mark
                    if known.holds(u) or u in units:
                        continue
                if u.isalpha():
                    words.append(u)
                elif u.split() == [u]:
                    others.append(u)
        for k in range(0, len(words), 2048):
            part = words[k:k + 2048]
            for u, got in zip(part, self._words(part)):
                known.keep(u, got)
        for k in range(0, len(others), 2048):
            part = others[k:k + 2048]
            a = self.tok.encode_batch([" " + u for u in part], add_special_tokens=False)
            b = self.sp.encode(part, return_type="proto", num_threads=1)
            for u, x, y in zip(part, a, b):
                known.keep(u, self._unit(u, x, y))

    def texts(self, texts: list[str | None]) -> list[Summary | None]:
        """The summaries of whole texts; None for one that has no tokens."""
        split = [t.replace("\n", " \n").split(" ") if t and self.in_units else None for t in texts]
        self.learn({u for units in split if units for u in units})
        return [self._text(t, units) for t, units in zip(texts, split)]

    def _text(self, text: str | None, units: list[str] | None) -> Summary | None:
        if not text:
            return None
        if units:
            try:
                got = list(map(self.units.__getitem__, units))
                if None not in got:
                    a, b, n, groups, links = zip(*got)
                    return sum(a), sum(b), sum(n), b";".join(groups), b"".join(links)
            except OddSpace:
                pass
        return self.align(text)


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


# ------------------------------------------------------------------- the corpus

_TEXTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each text: its numbers, its groups' hash, and its distinct pairs
    (sorted, packed integers) with how many links are such a pair (packed uint32)."""
    def batch(b: pa.RecordBatch) -> dict:
        al, rows = aligner(a_path, b_path), []
        for got in al.texts(b.column("text").to_pylist()):
            if got is None:
                rows.append((0, 0, 0, 0, "", b"", b""))
            else:
                n_a, n_b, n, groups, links = got
                pairs, times = np.unique(np.frombuffer(links, al.kind), return_counts=True)
                rows.append((n_a, n_b, n, len(links) // al.kind(0).itemsize, hashlib.sha256(groups).hexdigest(), pairs.tobytes(), times.astype(np.uint32).tobytes()))
        return dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"), zip(*rows))) | {"doc_id": b.column("doc_id")}

    return map_text(doc_text(docs), _TEXTS, batch)


def _packed(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Integers of a column of packed ones, and each row's number of them."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.array([len(r) for r in rows], np.int64) // np.dtype(kind).itemsize


def _summed(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted, and the sums of their numbers."""
    order = np.argsort(pair, kind="stable")
    pair, n = pair[order], n[order]
    start = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[:len(pair)])
    return pair[start], np.add.reduceat(n, start) if len(start) else n


def pair_counts(texts: DataFrame, kind) -> DataFrame:
    """``pair, n``: links of the corpus by pair. A task sums its texts' pairs while they fit, so few rows are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        base = wait = 0

        def fold() -> tuple[np.ndarray, np.ndarray]:
            return _summed(*(np.concatenate(x) for x in zip(*held)))

        for b in batches:
            pairs, times = _packed(b.column("pairs"), kind)[0], _packed(b.column("times"), np.uint32)[0]
            held.append((pairs.astype(np.int64), times.astype(np.int64)))
            wait += len(pairs)
            if wait > max(base, 1 << 20):
                held, wait = [fold()], 0
                base = len(held[0][0])
                if base > SLICE // 2:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), names=["pair", "n"])
                    held, base = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, fold())), names=["pair", "n"])

    return texts.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def pair_table(counts: DataFrame, n_a: int, slice_rows: int = SLICE) -> tuple[str, list[int]]:
    """The corpus's pairs as a Parquet folder sorted by pair, ``n`` negative where it
    is the highest of its B id, and the ascending borders of its slices."""
    counts = written(counts, "align-counts")
    b = F.floor(F.col("pair") / n_a)
    top = counts.groupBy(b.alias("b")).agg(F.max("n").alias("top"))  # a row for each B id
    marked = counts.withColumn("b", b).join(top, "b").select("pair", F.when(F.col("n") == F.col("top"), -F.col("n")).otherwise(F.col("n")).alias("n"))
    path = scratch_path(counts.sparkSession, "align-pairs")
    marked.repartitionByRange("pair").sortWithinPartitions("pair").write.parquet(path)
    slices = max(1, -(-counts.count() // slice_rows))
    cuts = counts.select(F.percentile_approx("pair", [k / slices for k in range(1, slices)])).first()[0] if slices > 1 else []
    return path, sorted(set(cuts))


@lru_cache(maxsize=1)
def _slice(path: str, low: int | None, high: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The table's pairs from ``low`` to under ``high``, sorted, and their counts."""
    from pyarrow import dataset, fs

    store, at = fs.FileSystem.from_uri(path)
    pair = dataset.field("pair")
    keep = (pair >= low if low is not None else pair == pair) & (pair < high if high is not None else pair == pair)
    t = dataset.dataset(at, filesystem=store, format="parquet", schema=pa.schema([("pair", pa.int64()), ("n", pa.int64())])).to_table(filter=keep)
    pairs, n = (t.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pairs, kind="stable")
    return pairs[order], n[order]


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _scored_in(texts: DataFrame, path: str, low: int | None, high: int | None, kind) -> DataFrame:
    """``texts`` with what their links find in one slice: ``n_best`` and ``count_sum``."""
    names = ["row", "doc_id", *_NUMBERS, "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (pairs, n), times = _packed(b.column("pairs"), kind), _packed(b.column("times"), np.uint32)[0].astype(np.int64)
            known, count = _slice(path, low, high)
            best = total = np.zeros(len(pairs), np.int64)
            if len(known):
                pairs = pairs.astype(np.int64)
                at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                found = np.where(known[at] == pairs, count[at], 0)
                best, total = np.where(found < 0, times, 0), times * np.abs(found)
            end = np.cumsum(n)
            sums = [np.append(0, np.cumsum(x)) for x in (best, total)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(x[end] - x[end - n]) for x in sums], names=[*names, "n_best", "count_sum"])

    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in [*names, "n_best", "count_sum"])
    return texts.mapInArrow(run, schema)


def scored(texts: DataFrame, path: str, cuts: list[int], kind) -> DataFrame:
    """``texts`` without their pairs, with ``n_best`` and ``count_sum``, slice by slice."""
    parts = [_scored_in(texts, path, low, high, kind) for low, high in zip([None, *cuts], [*cuts, None])]
    out = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            out = out.unionByName(p)
        out = out.groupBy("row", "doc_id", *_NUMBERS, "groups_sha256").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.drop("row")


def alignment(docs: DataFrame, a_path: str, b_path: str, slice_rows: int = SLICE) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` of every text."""
    a = aligner(a_path, b_path)
    texts = written(aligned(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()), "align-texts")
    path, cuts = pair_table(pair_counts(texts, a.kind), a.n_a, slice_rows)
    return scored(texts, path, cuts, a.kind)


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Align the byte-level BPE's tokens with the SentencePiece model's in every document."""
    prepare(spark)
    got = alignment(table(spark, sf_dir, "documents"), vocab_file(A_FILE), vocab_file(B_FILE))
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
