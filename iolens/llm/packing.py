"""Best-fit packing by bin completion.

Texts become token ids, documents longer than a sequence are cut (the first
piece may be shorter, all others are full), and pieces are packed whole into
sequences of at most ``capacity`` tokens.

Sizes are integers up to ``capacity``, so the packing problem of any corpus is
a histogram of at most ``capacity`` counts, which Spark aggregates. The solver
works on that histogram: a *pattern* is one filled sequence, used as many times
as the counts allow, so its work doesn't grow with the corpus. Spark then gives
every piece its rank among the pieces of its size and, by that rank, its place
in a pattern: no piece list ever meets in one task.

The solver (``bin_completion``) branches over the undominated fillings around
the largest piece left:

* a filling is dominated, and not tried, if a further piece fits beside it, or
  if one of its pieces can be exchanged for a larger one that still fits;
* a filling is pruned if its waste, with the waste so far, leaves no room
  to beat the incumbent: waste <= (incumbent - 1) * capacity - total;
* the incumbent is the best-fit-decreasing packing of what is left, at the
  start and again after some branches; a search ends when it meets the lower bound
  (total / capacity, and pieces over half a sequence).

Defined results: null text counts as empty and its document is the end id
alone; repeated rows are packed one by one; rows with a null doc_id too; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from iolens.llm.common import doc_text, prepare, table, written
from iolens.llm.tokens import encoder, ids32, vocab_file

CAPACITY = 1024
END_ID = 2
VOCAB = "byte_bpe_50k.json"
#: completions tried before the incumbent is taken; bounds the driver's work
NODES = 3_000
#: fillings tried around one largest piece
FILLINGS = 8
#: fillings of one waste that are looked at for an undominated one; twice as many around one largest piece
TRIES = 100
#: branches between two best-fit completions of what is left
TAIL_EVERY = 256
#: rows of one size numbered in one task, on average
BLOCK_ROWS = 500_000

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((size, times), ...), uses


# ---------------------------------------------------------------------- solver

def best_fit(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram: each piece goes to the fullest open
    sequence that holds it. Equal sequences are handled together."""
    open_: dict[int, list[list]] = {}  # room left -> [[pieces, uses], ...]

    def put(room: int, pieces: tuple, uses: int) -> None:
        if uses:
            open_.setdefault(room, []).append([pieces, uses])

    for size in range(capacity, 0, -1):
        left = int(count[size])
        for room in sorted(r for r in open_ if r >= size):
            fit = room // size
            kinds, open_[room] = open_.get(room, []), []
            for pieces, uses in kinds:
                full = min(uses, left // fit)
                put(room - fit * size, (*pieces, (size, fit)), full)
                left -= full * fit
                rest = uses - full
                if rest and 0 < left < fit:
                    put(room - left * size, (*pieces, (size, left)), 1)
                    left, rest = 0, rest - 1
                put(room, pieces, rest)
            if not left:
                break
        if left:
            fit = capacity // size
            put(capacity - fit * size, ((size, fit),), left // fit)
            if left % fit:
                put(capacity - left % fit * size, ((size, left % fit),), 1)
    return [(pieces, uses) for kinds in open_.values() for pieces, uses in kinds]


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """Sequences any packing needs: by tokens, and by pieces that can't share."""
    sizes = np.arange(len(count))
    best = -int(-int((count * sizes).sum()) // capacity)
    above = np.cumsum(count[::-1])[::-1]
    for k in range(1, capacity // 2 + 1):
        if not count[k]:
            continue
        alone = int(above[capacity - k + 1]) if capacity - k + 1 < len(count) else 0
        half = np.arange(capacity // 2 + 1, capacity - k + 1)
        shared = int(count[half].sum())
        room = shared * capacity - int((count[half] * half).sum())
        small = np.arange(k, capacity // 2 + 1)
        need = int((count[small] * small).sum()) - room
        best = max(best, alone + shared + max(0, -int(-need // capacity)))
    return max(best, int(above[capacity // 2 + 1]) if capacity // 2 + 1 < len(count) else 0)


def fillings(count: np.ndarray, room: int, slack: int) -> Iterator[tuple[int, tuple[tuple[int, int], ...]]]:
    """Undominated fillings of ``room`` that waste at most ``slack``, as (waste,
    ((size, times), ...)): fuller before emptier, large pieces first. ``reach[k]``
    holds, as bits, the sums that sizes from the k-th on can make, so the search
    has no dead ends."""
    have = count.tolist()  # the counts now; they change before the next filling is asked for
    order = [s for s in range(room, 0, -1) if have[s]]
    reach = [0] * len(order) + [1]
    mask = (1 << room + 1) - 1
    for k in range(len(order) - 1, -1, -1):
        sums, left, step = reach[k + 1], min(have[order[k]], room // order[k]), 1
        while left:
            step = min(step, left)
            sums |= sums << step * order[k] & mask
            left, step = left - step, step * 2
        reach[k] = sums

    def exact(left: int, start: int):
        if not left:
            yield ()
            return
        for k in range(start, len(order)):
            s = order[k]
            for t in range(min(have[s], left // s), 0, -1):
                if reach[k + 1] >> left - t * s & 1:
                    for rest in exact(left - t * s, k + 1):
                        yield ((s, t), *rest)

    left_over = sum(1 << s for s in order)

    def undominated(used: dict[int, int], waste: int) -> bool:
        free = left_over
        for s, t in used.items():
            if have[s] <= t:
                free ^= 1 << s
        span = (1 << waste) - 1  # the sizes up to `waste`, or above a used size by as much
        return not (free >> 1 & span) and not any(free >> s + 1 & span for s in used)

    looked = 0
    for waste in range(min(slack, room) + 1):
        if reach[0] >> room - waste & 1 and looked < 2 * TRIES:
            for used in islice(exact(room - waste, 0), TRIES):
                looked += 1
                if not waste or undominated(dict(used), waste):
                    yield waste, used


def bin_completion(count: np.ndarray, capacity: int, nodes: int = NODES) -> list[Pattern]:
    """Patterns that pack ``count[size]`` pieces of every size into few sequences.
    Depth-first branch and bound; ``nodes`` bounds the completions tried, after
    which the best packing found so far stands."""
    count = np.asarray(count, np.int64).copy()
    sizes = np.arange(len(count))
    total = int((count * sizes).sum())
    if not total:
        return []
    least = lower_bound(count, capacity)
    best = best_fit(count, capacity)
    best_uses = sum(u for _, u in best)
    spent = 0
    done: list[Pattern] = []
    stack: list[tuple[int, int, Iterator]] = []  # (patterns done, waste so far, fillings left to try)

    def branches(waste: int) -> Iterator:
        large = int(np.flatnonzero(count)[-1])
        left = count.copy()
        left[large] -= 1
        found = fillings(left, capacity - large, (best_uses - 1) * capacity - total - waste)
        return ((w, _merged(large, pieces)) for w, pieces in islice(found, FILLINGS))

    waste = 0
    stack.append((0, 0, branches(0)))
    while stack and best_uses > least and spent < nodes:
        depth, waste, rest = stack[-1]
        for pieces, uses in done[depth:]:
            for s, t in pieces:
                count[s] += t * uses
        del done[depth:]
        step = next(rest, None)
        if step is None:
            stack.pop()
            continue
        spent += 1
        lost, pieces = step
        uses = int(min(count[s] // t for s, t in pieces))
        if lost:
            uses = min(uses, max(0, (best_uses - 1) * capacity - total - waste) // lost)
        if uses <= 0:
            continue
        for s, t in pieces:
            count[s] -= t * uses
        done.append((pieces, uses))
        if not count.any() or spent % TAIL_EVERY == 0:
            tail = best_fit(count, capacity)
            now = sum(u for _, u in done) + sum(u for _, u in tail)
            if now < best_uses:
                best, best_uses = [*done, *tail], now
        if count.any():
            stack.append((len(done), waste + lost * uses, branches(waste + lost * uses)))
    return best


def _merged(large: int, pieces: tuple[tuple[int, int], ...]) -> tuple[tuple[int, int], ...]:
    got = dict(pieces)
    got[large] = got.get(large, 0) + 1
    return tuple(sorted(got.items(), reverse=True))


# ------------------------------------------------------------------ Spark side

def piece_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: only the first may be short."""
    full = (n - 1) // capacity
    return [n - full * capacity, *[capacity] * full]


def pieces(docs: DataFrame, vocab: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the pieces of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = [[], [], [], [], []]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = ids32(enc.bytes_of(text), enc.width) + end
                at = 0
                for k, n in enumerate(piece_lengths(len(ids) // 4, capacity)):
                    for col, v in zip(out, (doc, k, at, n, zlib.crc32(ids[4 * at:4 * (at + n)]))):
                        col.append(v)
                    at += n
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return doc_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """By size, the runs of ranks that patterns take, sorted by rank: columns are
    first rank, pieces of this size in one sequence, first sequence, offset of
    the first such piece."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for content, uses in patterns:
        offset = 0
        for size, times in content:
            runs.setdefault(size, []).append((rank.get(size, 0), times, sequence, offset))
            rank[size] = rank.get(size, 0) + times * uses
            offset += size * times
        sequence += uses
    return {size: np.array(r, np.int64) for size, r in runs.items()}


def pack(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
         nodes: int = NODES) -> DataFrame:
    """The pieces of ``docs`` with ``sequence_id`` (dense, from 0) and ``offset``."""
    spark = docs.sparkSession
    prepare(spark)
    got = written(pieces(docs, vocab or vocab_file(VOCAB), capacity, end_id), "packing-pieces")
    # at most `capacity` rows
    hist = {r["length"]: r["n"] for r in got.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    count = np.zeros(capacity + 1, np.int64)
    for size, n in hist.items():
        count[size] = n
    at = places(bin_completion(count, capacity, nodes))
    # rank of a piece among those of its size: a size may hold any share of the
    # rows, so ranks are counted in blocks of pieces and shifted by block totals
    blocks = int(max(1, -(-int(count.max()) // BLOCK_ROWS)))
    cut = got.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    before = cut.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(inside) - 1).join(before, ["length", "block"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            seq, off = np.empty_like(rank), np.empty_like(rank)
            for s in np.unique(size):
                me = size == s
                runs = at[int(s)]
                first, times, sequence, offset = runs[np.searchsorted(runs[:, 0], rank[me], side="right") - 1].T
                k = rank[me] - first
                seq[me] = sequence + k // times
                off[me] = offset + k % times * s
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                                              pa.array(seq), pa.array(off)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
