"""SimHash near-duplicate groups by Golay-code fuzzy hashing.

Every document gets a 64-bit SimHash over its word shingles. Distinct
fingerprints that differ in at most three bits are linked, and the connected
components of the links are the groups.

Finding the links. The binary Golay code [23, 12, 7] is perfect: every 23-bit
word has one codeword within distance 3, and, if that distance is 3, exactly
five more at distance 4. A word's *keys* are the message indices of these one
or six codewords, and two words at distance two or less always share a key
(``tests/llm/test_simhash.py`` tries it). A fingerprint is cut into four
segments of 16 bits. With three errors or fewer at least one segment agrees
exactly (pigeonhole); the other 48 bits hold two 23-bit words, and their errors
are either two or fewer in each word, so the words share Golay keys, or three
in one word, so the other word agrees exactly. Hence the keys of a fingerprint,
for each of the four segments:

* segment + Golay key of word A + Golay key of word B (40 bits), and
* segment + word A itself, segment + word B itself (39 bits).

Two fingerprints within three bits share at least one key; sharers are
verified by their real distance. A fingerprint has about 110 keys on average,
148 at most, however large the corpus is.

Copies never meet in pairs: keys are made for distinct fingerprints only, and
a key shared by more than ``PAIRS_UP_TO`` of them yields a spanning forest of
its links (one row less than members), not all pairs.

Defined results: null or empty text, or text of white space only, has
fingerprint zero and links like any other; fewer words than a shingle make one
shingle of the whole sequence; rows that repeat a doc_id are kept, one output
row each; rows with a null doc_id get a fingerprint and the component of their
text, whose id is the smallest non-null doc_id in it, or null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iolens.llm.common import doc_text, map_text, prepare, text_bytes, written

SHINGLE = 3
MAX_BITS = 3
SEED = 42
PAIRS_UP_TO = 8
#: generator polynomial of the [23, 12, 7] Golay code (fixed value)
GOLAY = 0xAE3
_CHUNK = 1 << 16


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one text given as UTF-8."""
    import xxhash

    h = xxhash.xxh64_intdigest
    words = text.lower().split()  # bytes: lower() is A-Z only, split() is \x20 and \x09-\x0D
    n = len(words) - shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        return h(joined, SEED)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends[:n - 1]]
    hashes = np.fromiter((h(joined[a:b - 1], SEED) for a, b in zip(starts, ends[shingle - 1:])), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        part = hashes[k:k + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint's bits as a signed long), one row per input row."""
    def batch(b: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, shingle) for t in text_bytes(b.column("text"))], np.uint64)
        return {"doc_id": b.column("doc_id"), "fp": fps.view(np.int64)}

    return map_text(doc_text(docs), "doc_id long, fp long", batch)


# ------------------------------------------------------------------ Golay keys

@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the 12 message bits, and by syndrome: the error of weight
    <= 3, whether its weight is 3, and the five errors of weight 4."""
    def remainder(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GOLAY << (k - 11)
        return x

    rem = np.array([remainder(m << 11) for m in range(1 << 12)], np.int64)
    bit = [remainder(1 << k) for k in range(23)]
    near, heavy, more = np.zeros(2048, np.int64), np.zeros(2048, bool), [[] for _ in range(2048)]
    for w in range(5):
        for at in combinations(range(23), w):
            s = e = 0
            for k in at:
                s ^= bit[k]
                e |= 1 << k
            if w == 4:
                more[s].append(e)
            else:
                near[s], heavy[s] = e, w == 3
    five = np.array([m if len(m) == 5 else [0] * 5 for m in more], np.int64)
    return rem, near, heavy, five


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Message indices of the codewords within distance 4 of 23-bit words:
    shape (n, 6), and which of the six exist."""
    rem, near, heavy, five = golay_tables()
    s = rem[words >> 11] ^ (words & 0x7FF)
    errors = np.concatenate([near[s][:, None], five[s]], axis=1)
    there = np.concatenate([np.ones((len(words), 1), bool), np.repeat(heavy[s][:, None], 5, axis=1)], axis=1)
    return (words[:, None] ^ errors) >> 11, there


def search_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position of the fingerprint) of all search keys of ``fps`` (uint64)."""
    keys, rows = [], []
    at = np.arange(len(fps))
    for s in range(4):
        low = fps & np.uint64((1 << 16 * s) - 1)
        high = fps >> np.uint64(16 * s) >> np.uint64(16)
        rest = (low | high << np.uint64(16 * s)).astype(np.int64)
        seg = (fps >> np.uint64(16 * s) & np.uint64(0xFFFF)).astype(np.int64) << 24
        a, b = rest & 0x7FFFFF, rest >> 23 & 0x7FFFFF
        (ka, ta), (kb, tb) = golay_keys(a), golay_keys(b)
        both = (ta[:, :, None] & tb[:, None, :]).reshape(len(fps), 36)
        pair = (ka[:, :, None] << 12 | kb[:, None, :]).reshape(len(fps), 36) | (seg | s << 40)[:, None]
        keys += [pair[both], seg | a | (4 + s) << 40, seg | b | (8 + s) << 40]
        rows += [np.repeat(at, both.sum(axis=1)), at, at]
    return np.concatenate(keys), np.concatenate(rows)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for k in range(0, len(fps), 1024):
            part = fps[k:k + 1024]
            key, row = search_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part.view(np.int64)[row])], names=["key", "fp"])


# ----------------------------------------------------------------------- links

def local_groups(fps: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Smallest fingerprint reachable from each of ``fps`` (distinct uint64)
    within the array. Exact; each member is expanded once, either against all
    members not yet reached or, where that is less work, by looking up every
    flip of up to ``max_bits`` of the bits that vary, so that the work is at most
    (number of such flips) per member."""
    order = np.argsort(fps)
    x = fps[order]
    root = np.zeros(len(x), np.uint64)
    left = np.ones(len(x), bool)
    vary = [k for k in range(64) if (np.bitwise_or.reduce(x) ^ np.bitwise_and.reduce(x)) >> np.uint64(k) & np.uint64(1)]
    v = len(vary)
    ways = v + v * (v - 1) // 2 * (max_bits > 1) + v * (v - 1) * (v - 2) // 6 * (max_bits > 2)
    flips = None
    if max_bits <= 3 and ways * 8 < len(x):
        flips = np.array([sum(1 << k for k in c) for w in range(1, max_bits + 1) for c in combinations(vary, w)], np.uint64)
    for seed in range(len(x)):
        if not left[seed]:
            continue
        left[seed] = False
        root[seed] = x[seed]
        todo = [seed]
        while todo:
            i = todo.pop()
            if flips is None:
                rest = np.flatnonzero(left)
                hit = rest[np.bitwise_count(x[rest] ^ x[i]) <= max_bits]
            else:
                near = flips ^ x[i]
                at = np.minimum(np.searchsorted(x, near), len(x) - 1)
                hit = at[(x[at] == near) & left[at]]
            left[hit] = False
            root[hit] = x[seed]
            todo.extend(hit.tolist())
    out = np.empty(len(x), np.uint64)
    out[order] = root
    return out


def _links_of(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows with equal keys; the rows are sorted by key and groups are whole."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    small = np.repeat(size <= PAIRS_UP_TO, size)
    a, b = [], []
    for s in range(1, PAIRS_UP_TO):
        at = np.flatnonzero((key[s:] == key[:-s]) & small[s:]) if len(key) > s else []
        if len(at) == 0:
            break
        near = np.bitwise_count(fp[at] ^ fp[at + s]) <= max_bits
        a.append(fp[at][near])
        b.append(fp[at + s][near])
    for k in np.flatnonzero(size > PAIRS_UP_TO):
        members = np.unique(fp[first[k]:first[k] + size[k]])
        root = local_groups(members, max_bits)
        a.append(root[root != members])
        b.append(members[root != members])
    if not a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
    return pairs[:, 0], pairs[:, 1]


def _links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait_k, wait_f = [], []

        def out(key, fp):
            a, b = _links_of(key, fp, max_bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # where the last, maybe unfinished, key begins
            if last or (wait_k and wait_k[0][0] != key[0]):
                whole = np.concatenate([*wait_k, key[:last]]), np.concatenate([*wait_f, fp[:last]])
                if len(whole[0]) > 1:
                    yield from out(*whole)
                wait_k, wait_f = [], []
            wait_k.append(key[last:])
            wait_f.append(fp[last:])
        if wait_k:
            yield from out(np.concatenate(wait_k), np.concatenate(wait_f))

    return run


def links(distinct_fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints exactly as all pairs within
    ``max_bits`` (3 at most) do: every pair of a small key group, a spanning
    forest of a large one."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the Golay keys cover distances of at most 3 bits")
    keys = distinct_fps.select("fp").mapInArrow(_emit_keys, "key long, fp long")
    dealt = keys.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links(max_bits), "a long, b long").dropDuplicates(["a", "b"])


# ------------------------------------------------------------------ components

def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``root``: the smallest node reachable, for all nodes of ``edges``
    (a, b). Alternating large-star and small-star steps; each round's edges are
    a written table, so lineage stays short, and a round's rows never exceed
    twice the edges."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), "simhash-edges")
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = written(big.filter("u <> v").distinct(), "simhash-star")
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v")))
        e = written(small.filter("u <> v").distinct(), "simhash-star")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: ``doc_id``, ``fp`` (signed), ``component_id`` (the
    smallest doc_id reachable over links, its own included)."""
    prepare(docs.sparkSession)
    fps = written(fingerprints(docs, shingle), "simhash-fp")
    # in the signed order that Spark's long has; only the choice of the root's name depends on it
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-distinct")
    roots = written(components(links(nodes, max_bits)), "simhash-roots")
    linked = nodes.join(roots, nodes.fp == roots.node).select("root", "fp", "first_doc")
    least = linked.groupBy("root").agg(F.min("first_doc").alias("m"))
    heads = roots.select("root").distinct().join(nodes, F.col("root") == F.col("fp")).select("root", "first_doc")
    least = least.join(heads, "root").select("root", F.least("m", "first_doc").alias("component_id"))
    members = roots.select(F.col("node").alias("fp"), "root").union(
        roots.select(F.col("root").alias("fp"), "root").distinct())
    named = members.join(least, "root").select("fp", "component_id")
    of = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_doc").alias("component_id"))
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def _hashable(column: Column, kind: T.DataType) -> Column:
    """What of a column goes into a row's hash: itself, a map's sorted entries, the
    JSON of a column that a map lies deeper in, a variant's text."""
    def nested(t: T.DataType) -> bool:
        if isinstance(t, T.ArrayType):
            return nested(t.elementType)
        if isinstance(t, T.StructType):
            return any(nested(f.dataType) for f in t)
        return isinstance(t, T.MapType)

    if isinstance(kind, T.MapType) and not nested(kind.keyType) and not nested(kind.valueType):
        return F.array_sort(F.map_entries(column))
    if nested(kind):
        return F.to_json(F.struct(column.alias("c")))
    return column.cast("string") if isinstance(kind, T.VariantType) else column


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` of each group of near copies, columns as they were: the
    one with the least doc_id (null after all others), of these with the least
    hash of its text, then of all columns (a map as its sorted entries). Groups are named by fingerprint, not
    by doc_id, so doc_ids may be null or repeat."""
    prepare(docs.sparkSession)
    every = [_hashable(docs[f"`{f.name}`"], f.dataType) for f in docs.schema]
    text = F.coalesce(docs["text"], F.lit(""))
    key = {"id": docs["doc_id"].cast("long"), "text_hash": F.xxhash64(text),
           "row_hash": F.xxhash64(*every, *[c.isNull() for c in every])}  # nulls add nothing to a hash

    names = list(key)

    def batch(b: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, shingle) for t in text_bytes(b.column("text"))], np.uint64)
        return {k: b.column(k) for k in names} | {"fp": fps.view(np.int64)}

    rows = map_text(docs.select(*[v.alias(k) for k, v in key.items()], text.alias("text")),
                    "id long, text_hash long, row_hash long, fp long", batch)
    rows = written(rows, "simhash-rows")
    nodes = written(rows.select("fp").distinct(), "simhash-distinct")
    roots = written(components(links(nodes, max_bits)), "simhash-roots")
    each = rows.groupBy("fp", *key).agg(F.count(F.lit(1)).alias("copies")).join(roots, F.col("fp") == F.col("node"), "left")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), *key, "copies"))
    heads = each.groupBy(F.coalesce("root", "fp").alias("root")).agg(least.alias("head")).select("head.*")
    heads = written(heads, "simhash-heads")

    def of(part: DataFrame, once: bool = False) -> DataFrame:
        same = key["id"].eqNullSafe(part["id"]) & (key["text_hash"] == part["text_hash"]) & (key["row_hash"] == part["row_hash"])
        rows = docs.join(part, same, "left_semi")
        if not once:
            return rows
        names = {f"__key_{k}": v for k, v in key.items()}
        return rows.withColumns(names).dropDuplicates(list(names)).drop(*names)

    if heads.filter("copies > 1").isEmpty():
        return of(heads)
    # rows that are equal in all columns
    return of(heads.filter("copies = 1")).union(of(heads.filter("copies > 1"), once=True))


def hex64(fp):
    """A signed long's 64 bits as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document; see the module's docstring."""
    from iolens.llm.common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
